"""Grammar and lexer of Kotlin. A line end may end a statement or not: both readings are followed."""

from codeloom.llm.grammar.lexers import _operators
from codeloom.llm.grammar.scanning import Lexis, Quote

_MODIFIERS = "public private internal protected abstract final open sealed data inner enum annotation companion override lateinit const vararg noinline crossinline reified tailrec operator infix inline external suspend expect actual value out"
_SOFT = "context by catch constructor finally get import init set where"
_HARD = "as break class continue do else false for fun if in interface is null object package return super this throw true try typealias val var when while"

_BODY = """
stmts: ';'+ | ';'* statement ( ';'+ statement )* ';'*
statement: declaration | expr
id: NAME | {soft}
path: id ( '.' id )*
annotation: '@' utype call? | '@' id ':' utype call? | '@' ( id ':' )? '[' ( utype call? )+ ']'
call: '(' args? ')'
modifier: annotation | 'context' '(' type ( ',' type )* ')' | {modifier}
declaration: modifier* kind
kind: ( 'class' | 'interface' | 'fun' 'interface' ) id typeparams? primary_? ( ':' supers )? where? body? | 'object' id? ( ':' supers )? body? | 'fun' typeparams? receiver? id typeparams? '(' params? ')' ( ':' type )? where? ( block | '=' expr )?
    | ( 'val' | 'var' ) typeparams? ( receiver? id ( ':' type )? | multi ) where? ( ( '=' | 'by' ) expr )? accessor* | 'typealias' id typeparams? '=' type
primary_: modifier* 'constructor'? '(' params? ')'
member: declaration | 'init' block | modifier* 'constructor' '(' params? ')' ( ':' ( 'this' | 'super' ) call )? block?
body: '{' members? '}' | '{' ';'* entry ( ',' entry )* ','? ( ';' members? )? '}'
members: ';'+ | ';'* member ( ';'+ member )* ';'*
entry: annotation* id call? body?
accessor: ';'? modifier* ( 'get' | 'set' ) ( '(' ( modifier* id ( ':' type )? ','? )? ')' ( ':' type )? ( block | '=' expr ) )?
receiver: type '.' | type '?.'
multi: '(' one ( ',' one )* ','? ')'
one: annotation* id ( ':' type )?
params: param ( ',' param )* ','?
param: modifier* ( 'val' | 'var' )? id ':' type ( '=' expr )?
supers: super ( ',' super )*
super: annotation* ( utype call? | utype call? 'by' expr | function )
where: 'where' bound ( ',' bound )*
bound: annotation* id ':' type
typeparams: '<' typeparam ( ',' typeparam )* ','? '>'
typeparam: ( modifier | 'in' )* id ( ':' type )?
type: plain | ( annotation | 'suspend' )+ plain
plain: utype | plain '?' | '(' type ')' | function | plain '&' plain
function: ( utype '.' | utype '?.' | '(' type ')' '.' | '(' type ')' '?.' )? '(' ( slot ( ',' slot )* ','? )? ')' '->' type
slot: type | id ':' type
utype: id targs? ( '.' annotation* id targs? )*
targs: '<' targ ( ',' targ )* ','? '>'
targ: ( 'in' | 'out' )? type | '*'
block: '{' stmts? '}'
expr: chain | tail | chain binop tail
tail: 'return' ATLABEL? expr? | 'throw' expr
chain: unary | chain binop unary | chain ( 'as' | 'as?' | 'is' | '!is' ) type
binop: '*' | '/' | '%' | '+' | '-' | '..' | '..<' | NAME | '?:' | 'in' | '!in' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&&' | '||' | '=' | '+=' | '-=' | '*=' | '/=' | '%='
unary: ( '-' | '+' | '!' | '++' | '--' | annotation | LABEL ) unary | postfix
postfix: primary | postfix ( '++' | '--' | '!!' ) | postfix call | postfix targs call | postfix targs? lambda | postfix '[' exprs ']' | postfix ( '.' | '?.' ) ( id | '(' expr ')' ) | postfix targs? '?'? '::' ( id | 'class' ) | '::' ( id | 'class' )
lambda: LABEL? annotation* '{' ( lparams? '->' )? stmts? '}'
lparams: lparam ( ',' lparam )* ','?
lparam: one | multi ( ':' type )?
args: arg ( ',' arg )* ','?
arg: ( id '=' )? '*'? expr
exprs: expr ( ',' expr )* ','?
string: STR | TPL stmts? ( TPL_MID stmts? )* TPL_END
primary: NUM | CHAR | string | 'true' | 'false' | 'null' | id | '(' expr ')' | '[' exprs? ']' | 'this' ATLABEL? | 'super' ( '<' type '>' )? ATLABEL? | lambda | ( 'break' | 'continue' ) ATLABEL? | 'object' ( ':' supers )? body
    | 'suspend'? 'fun' receiver? '(' ( params | lparams )? ')' ( ':' type )? where? ( block | '=' expr ) | 'if' '(' expr ')' expr? | 'if' '(' expr ')' expr? ';'? 'else' expr? | 'for' '(' ( one | annotation* multi ) 'in' expr ')' expr? | 'while' '(' expr ')' expr? | 'do' expr? ';'? 'while' '(' expr ')'
    | 'try' block catch+ ( 'finally' block )? | 'try' block 'finally' block | 'when' ( '(' ( annotation* 'val' id ( ':' type )? '=' )? expr ')' )? '{' ';'* case* '}'
catch: 'catch' '(' annotation* id ':' type ','? ')' block
case: conds ( 'if' expr )? '->' expr ';'*
conds: cond ( ',' cond )* ','? | 'else'
cond: expr | ( 'in' | '!in' ) expr | ( 'is' | '!is' ) type
""".replace("{soft}", " | ".join(f"'{w}'" for w in (_SOFT + " " + _MODIFIERS).split())).replace("{modifier}", " | ".join(f"'{w}'" for w in _MODIFIERS.split()))

_HEAD = "'package' path | 'import' path ( '.' '*' )? ( 'as' id )? | '@' NAME ':' ( utype call? | '[' ( utype call? )+ ']' )"
KOTLIN = f"\nfile: pieces?\npieces: ';'+ | ';'* piece ( ';'+ piece )* ';'*\npiece: {_HEAD} | declaration{_BODY}"
#: scripts (.kts) hold statements
SCRIPT = f"\nfile: pieces?\npieces: ';'+ | ';'* piece ( ';'+ piece )* ';'*\npiece: {_HEAD} | statement{_BODY}"

_LEXIS = Lexis(
    r"[\s﻿]+|//[^\n]*|\A#![^\n]*",
    (Quote('"""', '"""', escapes=False, lines=True, opens="${"), Quote('"', '"', opens="${")),
    [
        ("CHAR", r"'(?:\\(?:u[0-9a-fA-F]{4}|[tbnr'\"\\$])|[^'\\\n])'"),
        ("NUM", r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)(?:[uU]?L?|[fF])(?!\w)"),
        ("ATLABEL", r"(?:(?<=return)|(?<=break)|(?<=continue)|(?<=this)|(?<=super)|(?<=super<\w>))@[^\W\d]\w*"),
        ("LABEL", r"(?!(?:return|break|continue|this|super)@)[^\W\d]\w*@(?=[\s{(])"),
        ("WORD", r"(?!as\?)[^\W\d]\w*|`[^`\n]+`"),
        ("OP", r"as\?|!in\b|!is\b|" + _operators("=== !== ..< .. -> :: ?. ?: !! ++ -- && || == != <= >= += -= *= /= %= + - * / % = < > ! ? : . , ; @ & ( ) [ ] { }")),
    ],
    " ".join([_HARD, _SOFT, _MODIFIERS]),
)


def kotlin_tokens(text: str) -> list[tuple]:
    return _LEXIS.tokens(text)
