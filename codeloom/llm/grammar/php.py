"""Grammar and lexer of PHP. Text outside the tags is no source; a closing tag ends a statement."""

from __future__ import annotations

import re

from codeloom.llm.grammar.lexers import LexError, _operators
from codeloom.llm.grammar.scanning import Lexis, Quote

_KEYWORDS = "abstract array as break callable case catch class clone const continue declare default die do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile enum exit extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new print private protected public readonly require require_once return static switch throw trait try unset use var while yield and or xor __halt_compiler"

PHP = """
file: top*
top: statement | 'namespace' NAME ';' | 'namespace' NAME? '{' top* '}' | 'use' kind? uses ';' | 'use' kind? NAME '\\' '{' kind? use ( ',' kind? use )* ','? '}' ';' | attribute* 'const' consts ';' | '__halt_compiler' '(' ')' ';'
kind: 'function' | 'const'
uses: use ( ',' use )*
use: NAME ( 'as' NAME )?
id: NAME | 'enum' | 'readonly'
any: NAME | {any}
statement: block | ';' | expr ';' | 'if' '(' expr ')' statement elseif* ( 'else' statement )? | 'if' '(' expr ')' ':' statement* altelse* ( 'else' ':' statement* )? 'endif' ';'
    | 'while' '(' expr ')' ( statement | ':' statement* 'endwhile' ';' ) | 'do' statement 'while' '(' expr ')' ';' | 'for' '(' exprs? ';' exprs? ';' exprs? ')' ( statement | ':' statement* 'endfor' ';' )
    | 'foreach' '(' expr 'as' ( expr '=>' )? '&'? expr ')' ( statement | ':' statement* 'endforeach' ';' ) | 'switch' '(' expr ')' ( '{' ';'? case* '}' | ':' ';'? case* 'endswitch' ';' )
    | ( 'break' | 'continue' ) NUM? ';' | 'return' expr? ';' | 'echo' exprs ';' | 'global' exprs ';' | 'static' statics ';' | 'unset' '(' exprs ','? ')' ';' | 'try' block catch+ ( 'finally' block )? | 'try' block 'finally' block
    | 'declare' '(' NAME '=' expr ')' ( statement | ':' statement* 'enddeclare' ';' ) | 'goto' NAME ';' | NAME ':' | function | class
block: '{' statement* '}'
elseif: 'elseif' '(' expr ')' statement
altelse: 'elseif' '(' expr ')' ':' statement*
case: ( 'case' expr | 'default' ) ( ':' | ';' ) statement*
catch: 'catch' '(' NAME ( '|' NAME )* VAR? ')' block
statics: VAR ( '=' expr )? ( ',' VAR ( '=' expr )? )*
attribute: '#[' exprs ','? ']'
function: attribute* 'function' '&'? any '(' params? ')' returns? block
returns: ':' type
class: attribute* classword* 'class' id extends? implements? classbody | attribute* 'interface' id ( 'extends' names )? classbody | attribute* 'trait' id classbody | attribute* 'enum' NAME returns? implements? classbody
classword: 'abstract' | 'final' | 'readonly'
extends: 'extends' NAME
implements: 'implements' names
names: NAME ( ',' NAME )*
classbody: '{' member* '}'
word: 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'var' | 'readonly' | ( 'public' | 'protected' | 'private' ) '(' NAME ')'
member: attribute* word* 'function' '&'? any '(' params? ')' returns? ( block | ';' ) | attribute* word+ type? property ( ',' property )* ';' | attribute* word+ type? property hooks | attribute* word* 'const' type? consts ';' | 'use' names ( ';' | '{' adaptation* '}' ) | attribute* 'case' any ( '=' expr )? ';'
property: VAR ( '=' expr )?
hooks: '{' hook* '}'
hook: attribute* 'final'? '&'? NAME ( '(' params? ')' )? ( '=>' expr ';' | block | ';' )
consts: const ( ',' const )*
const: any '=' expr
adaptation: ( NAME '::' )? any ( 'insteadof' names | 'as' ( 'public' | 'protected' | 'private' )? any | 'as' ( 'public' | 'protected' | 'private' ) ) ';'
params: param ( ',' param )* ','?
param: attribute* word* type? '&'? '...'? VAR ( '=' expr )? hooks?
type: '?'? atom | union | meet
union: piece ( '|' piece )+
piece: atom | '(' meet ')'
meet: atom ( '&' atom )+
atom: NAME | 'array' | 'callable' | 'static'
exprs: expr ( ',' expr )*
expr: chain | chain '?' expr? ':' expr
chain: unary | chain binop unary
binop: '+' | '-' | '*' | '/' | '%' | '**' | '.' | '=' | '=' '&' | ASSIGN | '==' | '!=' | '===' | '!==' | '<>' | '<' | '>' | '<=' | '>=' | '<=>' | '&&' | '||' | '??' | '&' | '|' | '^' | '<<' | '>>' | 'and' | 'or' | 'xor' | 'instanceof' | '|>'
unary: ( '+' | '-' | '!' | '~' | '@' | '++' | '--' | CAST | 'clone' | 'print' | 'include' | 'include_once' | 'require' | 'require_once' ) unary | postfix | ( 'throw' | YIELDFROM ) expr | 'yield' | 'yield' expr | 'yield' expr '=>' expr | closure
postfix: primary | postfix '[' expr? ']' | postfix ( '->' | '?->' | '::' ) ( NAME | variable | '{' expr '}' ) | postfix '(' args? ')' | postfix '++' | postfix '--'
variable: VAR | '$' variable | '$' '{' expr '}'
args: arg ( ',' arg )* ','?
arg: expr | '...' expr | '...' | any ':' expr | '&' expr
items: ','* item ( ','+ item )* ','* | ','+
item: expr | expr '=>' '&'? expr | '&' expr | '...' expr
string: STR | TPL expr ( TPL_MID expr )* TPL_END
primary: variable | id | NUM | string | 'array' '(' items? ')' | 'list' '(' items? ')' | '[' items? ']' | '(' expr ')' | new | 'match' '(' expr ')' '{' ( arm ( ',' arm )* ','? )? '}' | 'isset' '(' exprs ','? ')' | 'empty' '(' expr ')' | ( 'exit' | 'die' ) | 'static'
arm: ( exprs ','? | 'default' ','? ) '=>' expr
new: 'new' target ( '(' args? ')' )? | 'new' attribute* 'readonly'? 'class' ( '(' args? ')' )? extends? implements? classbody
target: NAME | 'static' | '(' expr ')' | object
object: variable | ( object | NAME | 'static' ) ( '->' | '?->' | '::' ) ( NAME | variable ) | object '[' expr ']'
closure: attribute* 'static'? 'function' '&'? '(' params? ')' ( 'use' '(' ( '&'? VAR ( ',' '&'? VAR )* ','? )? ')' )? returns? block | attribute* 'static'? 'fn' '&'? '(' params? ')' returns? '=>' expr
""".replace("{any}", " | ".join(f"'{w}'" for w in _KEYWORDS.split()))

_HEREDOC = re.compile(r"<<<[ \t]*(?P<quote>[\"']?)(?P<tag>[^\W\d]\w*)(?P=quote)\r?\n")
_HALT = re.compile(r"__halt_compiler\s*\(\s*\)\s*(?:;|\?>)", re.I)
_OPEN = re.compile(r"<\?(?:php\b|=)", re.I)
_LEXIS = Lexis(
    r"\s+|//[^\n]*?(?=\?>|\n|\Z)|#(?!\[)[^\n]*?(?=\?>|\n|\Z)",
    (Quote("[bB]?'", "'", lines=True), Quote('[bB]?"', '"', lines=True, opens="{$"), Quote("`", "`", lines=True, opens="{$")),
    [
        ("CAST", r"\([ \t]*(?i:int|integer|bool|boolean|float|double|real|string|binary|array|object|unset)[ \t]*\)"),
        ("NUM", r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)(?!\w)"),
        ("VAR", r"\$[^\W\d]\w*"),
        ("YIELDFROM", r"(?i:yield\s+from)\b"),
        ("WORD", r"\\?[^\W\d]\w*(?:\\[^\W\d]\w*)*"),
        ("ASSIGN", r"(?:\*\*|\?\?|<<|>>|[-+*/.%&|^])="),
        ("OP", _operators("#[ ?-> -> => :: ... === !== == != <> <=> <= >= << >> && || ?? ++ -- ** |> + - * / % . = < > ! ~ ? : @ & | ^ $ ( ) [ ] { } , ; \\")),
    ],
    _KEYWORDS,
    nested=False,
    folds=True,
    extra=lambda *given: _tag_or_heredoc(*given),
)


def _tag_or_heredoc(lexis: Lexis, text: str, at: int, out: list, fresh: bool):
    if text.startswith("?>", at):
        out.append((";", at, fresh))
        again = _OPEN.search(text, at)
        if again and again.group() == "<?=":
            out.append(("echo", again.start(), False))
        return "", again.end() if again else len(text)
    halt = _HALT.match(text, at)
    if halt:  # what follows is data
        out.extend((kind, at, False) for kind in ("__halt_compiler", "(", ")", ";"))
        return "", len(text)
    if text.startswith("<<<", at):
        m = _HEREDOC.match(text, at)
        end = m and re.compile(rf"^[ \t]*{m.group('tag')}\b", re.M).search(text, m.end())
        if not end:
            raise LexError(at, "unterminated literal or comment")
        if m.group("quote") == "'":
            return "STR", end.end()
        body = text[: end.start()] + "\0"
        lexis.string(body, m.end(), Quote("", "\0", lines=True, opens="{$"), m, out, fresh)
        return "", end.end()
    return None


def php_tokens(text: str) -> list[tuple]:
    """Keywords count in any letter case, and are names after ``->``, ``::`` and before a namespace separator."""
    first = _OPEN.search(text)
    if not first:
        return []
    out: list[tuple] = [("echo", first.start(), False)] if first.group() == "<?=" else []
    _LEXIS.scan(text, first.end(), out, "")
    for i in range(1, len(out)):
        kind, at, fresh = out[i]
        if out[i - 1][0] in ("->", "?->", "::") and kind[0].isalpha() and kind not in ("VAR", "NUM", "STR", "TPL"):
            out[i] = ("NAME", at, fresh)
    return out
