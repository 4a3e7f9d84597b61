"""Grammar and lexer of Swift. A line end may end a statement or not: both readings are followed. Lines of conditional
compilation are left out, so that every branch counts."""

from __future__ import annotations

import re

from codeloom.llm.grammar.lexers import LexError, _operators
from codeloom.llm.grammar.scanning import Lexis, Quote

_MODIFIERS = "public private fileprivate internal open package static final override mutating nonmutating lazy weak unowned dynamic optional required convenience prefix postfix infix indirect nonisolated distributed consuming borrowing async"
_SOFT = "get set willSet didSet _read _modify throws rethrows some any each sending isolated actor macro precedencegroup operator await consume copy unknown"
_HARD = "import let var func init deinit subscript struct class enum protocol extension typealias associatedtype case where if else guard while repeat for in switch default do catch defer return throw break continue fallthrough try is as self super true false nil inout"
_TRIES = "try? try! as? as!"
_OPERATORS = "-> === !== == != <= >= && || ?? ..< ... += -= *= /= %= &= |= ^= <<= << &+ &- &* &+= &-= &*= &<< &>> ~= + - * / % = < > ! ? & | ^ ~ . , ; : @ \\\\"


def _choice(words: str) -> str:
    return " | ".join(f"'{w}'" for w in words.split())


SWIFT = (
    """
file: stmts?
stmts: ';'+ | ';'* stmt ( ';'+ stmt )* ';'*
tt: any | '(' tt* ')' | '[' tt* ']' | '{' tt* '}'
any: NAME | NUM | STR | OPT | BANG | OPER | {any}
id: NAME | {soft}
name: id | {hard}
attribute: '@' id ( '.' id )* targs? ( '(' tt* ')' )?
modifier: attribute | ( {modifiers} ) ( '(' id ')' | '(' 'set' ')' )? | 'class'
stmt: declaration | id ':' control | expr | 'guard' conds 'else' block | 'while' conds block | 'repeat' block 'while' expr | for | 'defer' block | 'return' expr? | 'throw' expr | ( 'break' | 'continue' ) id? | 'fallthrough'
for: 'for' 'try'? 'await'? 'case'? pat ( ':' type )? 'in' expr ( 'where' expr )? block
control: if | switch | do | for | 'while' conds block | 'repeat' block 'while' expr
if: 'if' conds block ( 'else' ( if | block ) )?
switch: 'switch' expr '{' case* '}'
case: attribute* ( 'case' item ( ',' item )* | 'default' ) ':' stmts
item: pat ( 'where' expr )?
do: 'do' thrown? block catch*
thrown: 'throws' ( '(' type ')' )?
catch: 'catch' ( item ( ',' item )* )? block
block: '{' stmts? '}'
conds: cond ( ',' cond )* ','?
cond: expr | ( 'let' | 'var' ) pat ( ':' type )? ( '=' expr )? | 'case' pat ( ':' type )? '=' expr
pat: ( 'let' | 'var' ) pat | 'is' type | pat 'as' type | pat OPT | '(' ( pats ','? )? ')' | way '(' pats? ')' | chain
way: type? '.' name | type
pats: labelled ( ',' labelled )*
labelled: ( name ':' )? pat
declaration: modifier* kind
kind: 'import' ( 'struct' | 'class' | 'enum' | 'protocol' | 'typealias' | 'func' | 'var' | 'let' )? name ( '.' name )* | ( 'let' | 'var' ) binding ( ',' binding )* | 'func' ( id | op ) generics? '(' params? ')' effect* ( '->' type )? where? block? | 'init' ( OPT | BANG )? generics? '(' params? ')' effect* where? block?
    | 'deinit' block | 'subscript' generics? '(' params? ')' effect* '->' type where? accessors? | ( 'struct' | 'class' | 'enum' | 'protocol' | 'extension' | 'actor' ) utype generics? inherits? where? '{' members? '}' | 'typealias' id generics? '=' type where? | 'associatedtype' id inherits? ( '=' type )? where?
    | 'operator' op ( ':' id ( ',' id )* )? ( '{' '}' )? | 'precedencegroup' id '{' tt* '}' | 'macro' id generics? '(' params? ')' effect* ( '->' type )? ( '=' expr )? where?
inherits: ':' type ( ',' type )*
members: ';'+ | ';'* member ( ';'+ member )* ';'*
member: declaration | modifier* 'case' variant ( ',' variant )* | HASH ( '(' args? ')' )? closure?
variant: name ( '(' slots? ')' )? ( '=' expr )?
binding: bound ( ':' type )? ( '=' expr )? accessors?
bound: id | '(' bound ( ',' bound )* ')'
accessors: block | '{' accessor ( ';'? accessor )* '}'
accessor: modifier* ( 'get' | 'set' | 'willSet' | 'didSet' | '_read' | '_modify' | 'init' ) ( '(' id ')' )? effect* block?
effect: 'async' | thrown | 'rethrows'
params: param ( ',' param )* ','?
param: attribute* name id? ':' type '...'? ( '=' expr )?
generics: '<' generic ( ',' generic )* ','? '>'
generic: ( 'each' | 'let' )? id ( ':' type )?
where: 'where' need ( ',' need )*
need: type ( ':' | '==' ) type
type: plain | ( attribute | 'inout' | 'some' | 'any' | 'borrowing' | 'consuming' | 'each' | 'repeat' | 'sending' | 'isolated' | '~' | 'nonisolated' ) type
plain: utype | plain ( OPT | BANG | '??' | '?' ) | plain '.' id | '[' type ']' | '[' type ':' type ']' | '(' slots? ')' | '(' slots? ')' effect* '->' type | plain '&' plain
utype: id targs? ( '.' ( id | 'self' ) targs? )* | 'self'
targs: '<' type ( ',' type )* ','? '>' | '<' '>'
slots: slot ( ',' slot )* ','?
slot: ( name id? ':' )? type '...'? ( '=' expr )?
op: OPER | {ops}
expr: chain
chain: unary | chain binop unary | chain 'is' type | chain ( 'as' | 'as?' | 'as!' ) type | chain '?' expr ':' unary
binop: op | '='
unary: ( 'try' | 'try?' | 'try!' | 'await' | 'consume' | 'copy' | 'each' | 'repeat' | 'any' | OPER | '-' | '+' | '!' | '~' | '&' | '..<' | '...' | '<' ) unary | postfix | if | switch | do
postfix: primary | postfix '(' args? ')' | postfix '(' ( name ':' )+ ')' | postfix '[' args? ']' | postfix '.' ( name | NUM ) | postfix ( OPT | BANG | '...' | OPER ) | postfix targs | postfix closure | postfix name ':' closure
args: arg ( ',' arg )* ','?
arg: ( ( name | NUM ) ':' )? ( expr | op )
string: STR | TPL args ( TPL_MID args )* TPL_END
primary: NUM | string | REGEX | 'true' | 'false' | 'nil' | id | HASH | 'self' | 'super' | 'init' | '.' name | '(' args? ')' | '[' elements? ']' | '[' ':' ']' | closure | '\\\\' postfix | '\\\\' '.' '[' args ']' | '[' type ']' | '[' type ':' type ']' | '(' slots? ')' effect* '->' type
elements: expr ( ',' expr )* ','? | expr ':' expr ( ',' expr ':' expr )* ','?
closure: '{' head? stmts? '}'
head: attribute* caught? 'in' | attribute* caught? ( id ( ',' id )* | '(' ( closing ( ',' closing )* ','? )? ')' ) effect* ( '->' type )? 'in'
caught: '[' ( capture ( ',' capture )* )? ']'
capture: ( ( 'weak' | 'unowned' ) ( '(' id ')' )? )? ( id | 'self' ) ( '=' expr )? | 'self'
closing: attribute* name id? ( ':' type '...'? )?
""".replace("{any}", _choice(" ".join([_HARD, _SOFT, _MODIFIERS, _TRIES, _OPERATORS])) + " | TPL tt* ( TPL_MID tt* )* TPL_END | HASH | REGEX")
    .replace("{soft}", _choice(_SOFT + " " + _MODIFIERS))
    .replace("{hard}", _choice(_HARD))
    .replace("{modifiers}", _choice(_MODIFIERS))
    .replace("{ops}", _choice("=== !== == != <= >= && || ?? ..< ... += -= *= /= %= &= |= ^= <<= << &+ &- &* &+= &-= &*= &<< &>> ~= + - * / % < > & | ^ ~ !") + " | '>' '>' | '>' '>='")
    .replace("'\\\\\\\\'", "'\\'")
    .replace("'\\\\'", "'\\'")
)

_LEXIS = Lexis(
    r"[\s﻿]+|//[^\n]*|\A#![^\n]*|#(?:if|elseif|else|endif|sourceLocation)\b[^\n]*",
    (
        Quote(r'(#+)"""', lambda m: '"""' + m.group(1), escapes=False, lines=True, opens=lambda m: "\\" + m.group(1) + "("),
        Quote(r'(#+)"', lambda m: '"' + m.group(1), escapes=False, opens=lambda m: "\\" + m.group(1) + "("),
        Quote('"""', '"""', lines=True, opens="\\("),
        Quote('"', '"', opens="\\("),
    ),
    [
        ("REGEX", r"#/[\s\S]*?/#|(?<=[(,=:\[{])\s*/(?![*/\s])(?:\\.|[^/\\\n])+/|(?<=[(,=:\[{] )/(?![*/\s])(?:\\.|[^/\\\n])+(?<!\s)/"),
        ("HASH", r"#(?:available|unavailable)\s*\([^()\n]*\)|#\w+"),
        ("NUM", r"(?:0x[0-9a-fA-F_]+(?:\.[0-9a-fA-F_]+)?(?:[pP][+-]?\d+)?|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?)(?!\w)"),
        ("TRY", r"try[?!]|as[?!]"),
        ("WORD", r"[^\W\d]\w*|`[^`\n]+`|\$\d+|\$\w+"),
        ("OPER", r"&&&|\|\|\||<[*|$^~+%]+>?|>>>|\|>|[-+*/%^|~=]*(?:<>|\*\*|\+\+|--|=~)[-+*/%^|~=<>]*|\.{2,}[-+*/<>=]+(?<!\.\.<)"),
        ("OP", _operators("-> === !== == != <= >= && || ?? ..< ... += -= *= /= %= &= |= ^= <<= << &+ &- &* &+= &-= &*= &<< &>> ~= + - * / % = < > ! ? & | ^ ~ . , ; : @ \\ ( ) [ ] { }")),
    ],
    " ".join([_HARD, _SOFT, _MODIFIERS]),
)
_ENDS = frozenset("NAME NUM STR TPL_END HASH ) ] } > OPT BANG self super nil true false init".split()) | frozenset((_SOFT + " " + _MODIFIERS).split())
_CONDITION = re.compile(r"^[ \t]*#(if|elseif|else|endif)\b", re.M)


def swift_tokens(text: str) -> list[tuple]:
    """A question or exclamation mark right behind a value belongs to it; after a point every word is a name."""
    out = _LEXIS.tokens(text)
    for i, (kind, at, fresh) in enumerate(out):
        if kind == "TRY":
            out[i] = (text[at : at + (4 if text[at] == "t" else 3)], at, fresh)
        elif kind in ("?", "!") and i and out[i - 1][0] in _ENDS and not text[at - 1].isspace():
            out[i] = ("OPT" if kind == "?" else "BANG", at, fresh)
    depth = 0
    strings = [(q, out[j + 1][1] if j + 1 < len(out) else len(text)) for j, (k, q, _) in enumerate(out) if k == "STR"]
    for m in _CONDITION.finditer(text):
        if any(a < m.start() < b and text.startswith(('"""', "#"), a) for a, b in strings):
            continue
        depth += (m.group(1) == "if") - (m.group(1) == "endif")
        if depth < 0 or depth == 0 and m.group(1) in ("else", "elseif"):
            raise LexError(m.start(), "unmatched condition")
    if depth:
        raise LexError(len(text) - 1, "open condition")
    return out
