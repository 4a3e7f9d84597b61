"""Grammar and lexer of Scala 2 and 3. A line end may end a statement or not: both readings are followed. A line that is
further right after a token that may open a block begins one, which ends with the lines or the bracket around it."""

from __future__ import annotations

import re

from codeloom.llm.grammar.lexers import _jsx_end, _operators
from codeloom.llm.grammar.scanning import Lexis, Quote

_MODIFIERS = "abstract final sealed implicit lazy override private protected inline opaque open transparent infix erased tracked"
_SOFT = "derives end extension using as"
_HARD = "case catch class def do else enum export extends false finally for given if import match new null object package return super then this throw trait try true type val var while with yield forSome macro"

SCALA = """
file: stats?
stats: ';'+ | ';'* stat ( ';'+ stat )* ';'*
stat: 'package' path | 'package' path body | 'package' 'object' id extends? | ( 'import' | 'export' ) imported ( ',' imported )* | definition | expr | 'end' ( id | 'if' | 'while' | 'for' | 'match' | 'try' | 'new' | 'this' | 'given' | 'val' | 'extension' )
word: NAME | {soft} | 'inline' | 'opaque' | 'open' | 'transparent' | 'infix' | 'erased' | 'tracked'
id: word | OPER | '*' | '-' | '+' | '|' | '&' | '!' | '~' | '<' | '>' | '/' | '%' | '^'
path: id ( '.' id )*
imported: ref '.' '{' ( selector ( ',' selector )* ','? )? '}' | ref '.' ( '*' | 'given' type? ) | ref 'as' id | ref
ref: ( id | 'this' ) ( '.' ( id | 'this' | 'type' ) )*
selector: id | id ( '=>' | 'as' ) id | 'given' type?
annotation: '@' simple ( '(' args? ')' )*
modifier: annotation | {modifiers} | ( 'private' | 'protected' ) '[' ( path | 'this' ) ']'
definition: modifier* kind
kind: ( 'val' | 'var' ) pats ( ':' type )? ( '=' expr )? | 'def' ( id | 'this' ) clause* ( ':' type )? ( '=' 'macro'? expr | block )? | 'type' id tparams? bounds? ( '=' type )? | 'type' id tparams? ( clause )* '=' type
    | 'case'? 'class' id tparams? ( modifier* clause )* extends? derives? | 'case'? 'object' id extends? derives? | 'trait' id tparams? clause* extends? derives? | 'enum' id tparams? ( modifier* clause )* ( 'extends' parents )? ( 'derives' type ( ',' type )* )? enumbody
    | 'given' ( id clause* ':' )? given | 'given' id clause* ':' type | 'extension' clause+ ( definition | body | stats_ )
enumbody: '{' enumstats? '}' | ':' INDENT enumstats DEDENT
enumstats: ';'+ | ';'* enumstat ( ';'+ enumstat )* ';'*
enumstat: stat | modifier* 'case' id ( ',' id )* | modifier* 'case' id tparams? clause* ( 'extends' parents )?
given: type ( '=' expr | 'with'? body )? | tparams? clause* '=>' given | parents 'with' body
stats_: INDENT stats DEDENT
derives: 'derives' type ( ',' type )* body?
extends: 'extends' parents body? | 'extends' body | body
parents: parent ( ( 'with' | ',' ) parent )*
parent: simple ( '(' args? ')' )*
body: '{' ( self )? stats? '}' | ':' INDENT self? stats DEDENT | INDENT self? stats DEDENT | 'with' INDENT stats DEDENT
self: ( id | 'this' ) ( ':' type )? '=>' | 'this' '=>'
clause: '(' ( 'using' | 'implicit' )? params? ')' | '(' 'using' type ( ',' type )* ')' | tparams
params: param ( ',' param )* ','?
param: modifier* ( 'val' | 'var' )? id ':' ptype ( '=' expr )?
ptype: '=>'? type '*'?
tparams: '[' tparam ( ',' tparam )* ','? ']'
tparam: annotation* ( '+' | '-' )? id tparams? bounds? ( ':' type | '<%' type )*
bounds: '>:' type | '<:' type | '>:' type '<:' type
type: infix | function | tparams '=>>' type | tparams '=>' type | infix 'match' cases | infix 'forSome' '{' stats '}'
function: infix ( '=>' | '?=>' ) type | '(' ( ptype ( ',' ptype )* )? ')' ( '=>' | '?=>' ) type | '(' id ':' type ( ',' id ':' type )* ')' ( '=>' | '?=>' ) type
infix: with ( id with )*
with: simple annotation* ( 'with' simple )* | simple? '{' stats? '}' | with '{' stats? '}'
simple: ref | simple '#' id | simple targs | '(' type ( ',' type )* ')' | '(' id ':' type ( ',' id ':' type )* ')' | literal | '?' bounds? | '-' literal
targs: '[' targ ( ',' targ )* ','? ']'
targ: ( '+' | '-' )? type | id '=' type | id bounds | '?' bounds?
block: '{' inside? '}' | INDENT inside DEDENT
inside: stats | cases | head stats?
head: ( id | 'implicit' id | ( 'using' )? '(' ( lparam ( ',' lparam )* )? ')' | modifier* id ':' with ) ( '=>' | '?=>' )
lparam: modifier* id ( ':' ptype )? | 'using' id ':' type
cases: case+ | INDENT case+ DEDENT | '{' ';'* case+ '}'
case: 'case' pattern ( 'if' chain )? '=>' stats? | 'case' pattern ( 'if' chain )? '=>' INDENT stats DEDENT ';'*
pattern: pat ( '|' pat )*
pats: pat ( ',' pat )*
pat: infixpat | infixpat ':' infix
infixpat: atom ( id atom )*
atom: literal | '-' literal | path targs | path ( targs? '(' ( pattern ( ',' pattern )* ','? )? ')' )? | 'this' '.' path | string | id '@' atom | '(' ( pattern ( ',' pattern )* ','? )? ')' | atom '*' | 'given' type | XML | path '.' 'this' '.' path | path '.' 'type'
expr: chain | tail | chain binop tail | postfix '=' expr | chain ':' type | chain ':' annotation+ | chain ':' word '*'
tail: function_ | 'if' '(' expr ')' 'then'? expr ( ';'? 'else' expr )? | 'if' expr 'then' expr ( ';'? 'else' expr )? | 'while' '(' expr ')' 'do'? expr | 'while' expr 'do' expr | 'do' expr ';'? 'while' expr | 'for' enums ( 'yield' | 'do' )? expr | 'try' expr catch? ( 'finally' expr )? | 'throw' expr | 'return' expr? | 'inline' tail | unary_ tail
unary_: '!' | '-' | '+' | '~'
catch: 'catch' ( cases | expr | case )
enums: '(' ';'* gens ';'* ')' | '{' ';'* gens ';'* '}' | INDENT gens DEDENT | gens
gens: gen ( ';'+ gen | gen )*
gen: 'case'? pat '<-' expr | pat '=' expr | 'if' chain | 'val' pat ( '<-' | '=' ) expr
function_: head_ ( '=>' | '?=>' ) expr | head_ ( '=>' | '?=>' ) | tparams '=>' expr
head_: id | 'implicit' id | '(' ( lparam ( ',' lparam )* ','? )? ')' | id ':' with
chain: unary | chain binop unary | chain 'match' cases | chain '.' 'match' cases | chain id
binop: id targs? | '?'
unary: unary_ unary | postfix | 'new' parents body? | 'new' body
postfix: primary | postfix '.' ( id | 'type' | 'this' | 'super' | 'class' ) | postfix targs | postfix '(' args? ')' | postfix block | postfix ':' INDENT inside DEDENT | postfix ':' head INDENT inside DEDENT
args: arg ( ',' arg )* ','?
arg: 'using'? expr | id '=' expr | 'inline' expr
string: STR | TPL stats? ( TPL_MID stats? )* TPL_END
literal: NUM | CHAR | string | 'true' | 'false' | 'null' | SYMBOL
primary: literal | word | 'this' | 'super' ( '[' id ']' )? | '(' ( args )? ')' | block | XML+ | ( QUOTE | '$' ) '{' stats? '}' | QUOTE '[' type ']'
"""
SCALA = SCALA.replace("{soft}", " | ".join(f"'{w}'" for w in _SOFT.split())).replace("{modifiers}", " | ".join(f"'{w}'" for w in _MODIFIERS.split()))

_SYMBOLS = r"[-!#%&*+/:<=>?@\\^|~\u2190-\u2bff]"
_RESERVED = frozenset(": = => <- <: >: # @ - + * | & ! ~ < > / % ^ <% ?=> =>> ?".split())


def _markup(lexis: Lexis, text: str, at: int, out: list, fresh: bool):
    if text[at] == "<" and (at == 0 or text[at - 1] in " \t\n({=>") and re.match(r"<[A-Za-z_!?]", text[at : at + 2]) and not (out and out[-1][0] in ("NAME", ")", "]", "NUM", "STR") and not fresh):
        if text.startswith("<!--", at) or text.startswith("<?", at):
            end = text.find("-->" if text[at + 1] == "!" else "?>", at)
            return ("XML", end + (3 if text[at + 1] == "!" else 2)) if end > 0 else None
        return "XML", _jsx_end(text, at, lambda a: lexis.scan(text, a + 1, [], "}"))
    return None


_LEXIS = Lexis(
    r"[\s﻿]+|//[^\n]*|\A#![^\n]*",
    (
        Quote(r'[A-Za-z_]\w*"""', '"""', escapes=False, lines=True, opens="${"),
        Quote(r'raw"', '"', opens="${"),
        Quote(r'[A-Za-z_]\w*"', '"', opens="${"),
        Quote('"""', '"""', escapes=False, lines=True),
        Quote('"', '"'),
    ),
    [
        ("CHAR", r"'(?:\\(?:u+[0-9a-fA-F]{4}|[btnfr'\"\\]|[0-7]{1,3})|[^'\\\n])'"),
        ("SYMBOL", r"'(?=[A-Za-z_])\w+(?!')"),
        ("QUOTE", r"'(?=[\[{])"),
        ("NUM", r"(?:0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[lLfFdD]?)(?!\w)"),
        ("NAME", r"\?\?\?"),
        ("WORD", rf"[^\W\d_]\w*(?<=_){_SYMBOLS}+|(?:[^\W\d]|\$(?=\w))[\w$]*|`[^`\n]+`"),
        ("OP", rf"{_SYMBOLS}+?(?=//|/\*)|{_SYMBOLS}+|" + _operators("( ) [ ] { } . , ; $")),
    ],
    _HARD + " " + _SOFT + " " + _MODIFIERS,
    extra=_markup,
)
_OPENS = frozenset("= => <- : ?=> =>> then else do yield try catch finally match return throw with if while for )".split())


def scala_tokens(text: str) -> list[tuple]:
    """With virtual INDENT and DEDENT where a block may be written without braces."""
    out: list[tuple] = []
    raw = _LEXIS.tokens(text)
    open_: list[tuple] = []  # (bracket or "", column)
    for i, (kind, at, fresh) in enumerate(raw):
        if kind[0] in "-!#%&*+/:<=>?@\\^|~" or 0x2190 <= ord(kind[0]) <= 0x2BFF:
            kind = {"⇒": "=>", "←": "<-"}.get(kind, kind)
            kind = kind if kind in _RESERVED else "OPER"
        last = out[-1][0] if out else ""
        if fresh:
            line = text.rfind("\n", 0, at) + 1
            column = at - line if not text[line:at].strip() else len(text[line:at]) - len(text[line:at].lstrip())
            around = next((c for b, c in reversed(open_) if b == "" or b == "{"), 0)
            while open_ and not open_[-1][0] and column < open_[-1][1]:
                open_.pop()
                out.append(("DEDENT", at, False))
            if last in _OPENS and kind not in ("{", "}", ")", "]", "."):
                start = raw[i - 1][1]
                begin = text.rfind("\n", 0, start) + 1
                base = len(text[begin:start]) - len(text[begin:start].lstrip())
                base = max(base, around) if open_ and not open_[-1][0] else base
                if column > base and last != ")" or column > base and last == ")" and _header(raw, i):
                    open_.append(("", column))
                    out.append(("INDENT", at, False))
        if kind in (")", "]", "}") or kind == "," and any(b for b, _ in open_):
            while open_ and not open_[-1][0]:
                open_.pop()
                out.append(("DEDENT", at, False))
            if kind != "," and open_:
                open_.pop()
        elif kind in ("(", "[", "{"):
            open_.append((kind, 0))
        elif kind == "TPL":
            open_.append(("TPL", 0))
        elif kind in ("TPL_MID", "TPL_END"):
            while open_ and not open_[-1][0]:
                open_.pop()
                out.append(("DEDENT", at, False))
            if kind == "TPL_END" and open_:
                open_.pop()
        out.append((kind, at, fresh))
    out += [("DEDENT", len(text), False) for b, _ in open_ if not b]
    return out


def _header(raw: list[tuple], at: int) -> bool:
    """Whether the parenthesis before token ``at`` closes the parameters of an extension or the condition of a control."""
    depth = 0
    for i in range(at - 1, -1, -1):
        kind = raw[i][0]
        depth += (kind in (")", "]")) - (kind in ("(", "["))
        if depth == 0 and kind in ("(", "["):
            before = raw[i - 1][0] if i else ""
            if before in ("if", "while", "for", "extension"):
                return True
            if before not in (")", "]"):
                return False
    return False
