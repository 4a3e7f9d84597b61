"""Grammar and lexer of C#. Lines of the preprocessor are left out, so that every branch counts."""

from codeloom.llm.grammar.lexers import _operators
from codeloom.llm.grammar.scanning import Lexis, Quote

_CONTEXTUAL = "record partial async await get set init add remove where when yield global from select group into orderby join let on equals by ascending descending file required scoped with and or not alias unmanaged"
_HARD = "abstract as base break case catch checked class const continue default delegate do else enum event explicit extern finally fixed for foreach goto if implicit in interface internal is lock namespace new operator out override params private protected public readonly ref return sealed sizeof stackalloc static struct switch this throw true false null try typeof unchecked unsafe using virtual volatile while"

CSHARP = """
file: item*
item: space | 'extern' 'alias' id ';' | global | statement
global: '[' id ':' attr ( ',' attr )* ','? ']'
space: 'global'? 'using' 'static'? 'unsafe'? ( id '=' )? type ';' | attribute* 'namespace' qname ( ';' | '{' inside* '}' ';'? ) | attribute* modifier* typedecl
inside: space | 'extern' 'alias' id ';'
id: NAME | {contextual}
attribute: '[' ( ( id | 'return' | 'event' ) ':' )? attr ( ',' attr )* ','? ']'
attr: qname ( '(' args? ')' )?
modifier: 'public' | 'private' | 'protected' | 'internal' | 'static' | 'abstract' | 'sealed' | 'virtual' | 'override' | 'readonly' | 'extern' | 'unsafe' | 'volatile' | 'new' | 'partial' | 'async' | 'required' | 'file' | 'ref'
typedecl: ( 'class' | 'struct' | 'interface' | 'record' | 'record' 'class' | 'record' 'struct' ) id typeparams? ( '(' params? ')' )? ( ':' bases )? where* ( '{' member* '}' ';'? | ';' ) | 'enum' id ( ':' type )? '{' ( enumerator ( ',' enumerator )* ','? )? '}' ';'? | 'delegate' type id typeparams? '(' params? ')' where* ';'
enumerator: attribute* id ( '=' expr )?
bases: base ( ',' base )*
base: type ( '(' args? ')' )?
where: 'where' id ':' constraint ( ',' constraint )*
constraint: type | 'class' '?'? | 'struct' | 'new' '(' ')' | 'default'
typeparams: '<' typeparam ( ',' typeparam )* '>'
typeparam: attribute* ( 'in' | 'out' )? id
member: attribute* modifier* ( typedecl | 'const' type declarators ';' | type declarators ';' | 'event' type declarators ';' | 'event' type name '{' accessor* '}' | type name typeparams? '(' params? ')' where* body | type name property | type ( qname '.' )? 'this' '[' params ']' property
    | type ( qname '.' )? 'operator' 'checked'? op '(' params ')' body | ( 'implicit' | 'explicit' ) ( qname '.' )? 'operator' 'checked'? type '(' params ')' body | id '(' params? ')' ( ':' ( 'base' | 'this' ) '(' args? ')' )? body | '~' id '(' ')' body | 'fixed' type id '[' expr ']' ';' )
name: id | qname '.' id
op: '+' | '-' | '!' | '~' | '++' | '--' | 'true' | 'false' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' | '==' | '!=' | '<' | '>' | '<=' | '>='
body: block | '=>' expr ';' | ';'
property: '{' accessor* '}' | '{' accessor* '}' '=' init ';' | '=>' expr ';'
accessor: attribute* ( 'public' | 'private' | 'protected' | 'internal' | 'readonly' )* ( 'get' | 'set' | 'init' | 'add' | 'remove' ) body
params: param ( ',' param )*
param: attribute* ( 'this' | 'ref' | 'out' | 'in' | 'params' | 'readonly' | 'scoped' )* type id ( '=' expr )? | '__arglist'
type: simple | type '?' | type '*' | type '[' ','* ']' | 'ref' 'readonly'? type
simple: qname | '(' slot ( ',' slot )+ ')' | 'delegate' '*' ( id ( '[' id ( ',' id )* ']' )? )? '<' ( ( 'ref' | 'out' | 'in' )? type ) ( ',' ( 'ref' | 'out' | 'in' )? type )* '>'
slot: type id?
qname: ( id '::' )? seg ( '.' seg )*
seg: id targs?
targs: '<' ','* '>' | '<' type ( ',' type )* '>'
declarators: declarator ( ',' declarator )*
declarator: id ( '=' init )?
init: expr | braces
block: '{' statement* '}'
statement: block | ';' | local ';' | 'await'? 'using' local ';' | attribute* ( 'static' | 'async' | 'unsafe' | 'extern' )* type id typeparams? '(' params? ')' where* body | expr ';' | 'if' '(' expr ')' statement ( 'else' statement )? | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';'
    | 'for' '(' ( local | exprs )? ';' expr? ';' exprs? ')' statement | 'await'? 'foreach' '(' ( ( 'ref' | 'scoped' )? type id | expr ) 'in' expr ')' statement | 'switch' '(' args ')' '{' section* '}' | 'return' expr? ';' | 'break' ';' | 'continue' ';' | 'goto' ( id | 'case' expr | 'default' ) ';' | 'throw' expr? ';'
    | 'try' block catch+ ( 'finally' block )? | 'try' block 'finally' block | 'lock' '(' expr ')' statement | 'await'? 'using' '(' ( local | expr ) ')' statement | 'fixed' '(' local ')' statement | ( 'checked' | 'unchecked' | 'unsafe' ) block | 'yield' 'return' expr ';' | 'yield' 'break' ';' | id ':' statement
local: ( 'const' | 'scoped' | 'static' )? type declarators
catch: 'catch' ( '(' type id? ')' )? ( 'when' '(' expr ')' )? block
section: label+ statement+
label: 'case' pattern ( 'when' expr )? ':' | 'default' ':'
pattern: pat | pattern ( 'and' | 'or' ) pat
pat: 'not' pat | type id? | chain | ( '<' | '>' | '<=' | '>=' ) unary | type? '{' ( subs ','? )? '}' id? | type? '(' subs? ')' ( '{' ( subs ','? )? '}' )? id? | '[' ( pattern ( ',' pattern )* ','? )? ']' id? | '..' pat? | '(' pattern ')'
subs: sub ( ',' sub )*
sub: pattern | qname ':' pattern
exprs: expr ( ',' expr )*
expr: chain | chain '?' expr ':' expr | chain assign init | lambda | query | 'throw' expr | chain '??' 'throw' expr | chain ( '&&' | '||' | '??' ) lambda
assign: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' | '??='
chain: unary | chain binop unary | chain 'is' pattern | chain 'as' type | chain 'switch' '{' ( arm ( ',' arm )* ','? )? '}' | chain 'with' braces | chain '..'
arm: pattern ( 'when' expr )? '=>' expr
binop: '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' | '??' | '..'
lambda: attribute* ( 'async' | 'static' )* ( type? '(' ( params | lparams )? ')' | id ) '=>' ( expr | block ) | ( 'async' | 'static' )* 'delegate' ( '(' params? ')' )? block
lparams: lparam ( ',' lparam )*
lparam: ( 'ref' | 'out' | 'in' | 'scoped' )? id
unary: ( '+' | '-' | '!' | '~' | '++' | '--' | '&' | '*' | '^' | '..' | 'await' | 'ref' ) unary | '(' type ')' unary | '(' type ')' lambda | '..' | postfix
postfix: primary | postfix ( '.' | '?.' | '->' ) seg | postfix '(' args? ')' | postfix '?'? '[' args ']' | postfix ( '++' | '--' | '!' )
args: arg ( ',' arg )* ','?
arg: ( id ':' )? ( expr | ( 'ref' | 'out' | 'in' ) expr | 'out' type id )
string: STR | TPL part ( TPL_MID part )* TPL_END
part: expr ( ',' expr )?
primary: NUM | CHAR | string | 'true' | 'false' | 'null' | seg | id '::' seg | '(' expr ')' | '(' targ ( ',' targ )+ ')' | 'this' | 'base' | new | 'typeof' '(' type ')' | 'default' ( '(' type ')' )? | 'sizeof' '(' type ')' | ( 'checked' | 'unchecked' ) '(' expr ')' | 'stackalloc' type? '[' expr? ']' braces? | 'stackalloc' type braces | '[' ( element ( ',' element )* ','? )? ']'
targ: ( id ':' )? expr | type id
element: expr
new: 'new' simple '?'? '(' args? ')' braces? | 'new' type braces | 'new' '(' args? ')' braces? | 'new' '[' ','* ']' braces | 'new' type '[' exprs ']' ( '[' ','* ']' )* braces? | 'new' braces
braces: '{' ( member_ ( ',' member_ )* ','? )? '}'
member_: expr | braces | '[' args ']' '=' init | id '=' braces
query: 'from' type? id 'in' expr clause* ( 'select' expr | 'group' expr 'by' expr ) into*
into: 'into' id clause* ( 'select' expr | 'group' expr 'by' expr )
clause: 'from' type? id 'in' expr | 'let' id '=' expr | 'where' expr | 'join' type? id 'in' expr 'on' expr 'equals' expr ( 'into' id )? | 'orderby' order ( ',' order )*
order: expr ( 'ascending' | 'descending' )?
""".replace("{contextual}", " | ".join(f"'{w}'" for w in _CONTEXTUAL.split()))

_LEXIS = Lexis(
    r"\n\s*(?:#[^\n]*)?|\A\s*#[^\n]*|[\s﻿]+|//[^\n]*",
    (
        Quote(r'(\$+)("{3,})', lambda m: m.group(2), escapes=False, lines=True, opens=lambda m: "{" * len(m.group(1))),
        Quote(r'("{3,})', lambda m: m.group(1), escapes=False, lines=True),
        Quote(r'(?:\$@|@\$)"', '"', escapes=False, lines=True, opens="{", doubled=True),
        Quote('@"', '"', escapes=False, lines=True, doubled=True),
        Quote(r'\$"', '"', opens="{"),
        Quote('"', '"'),
    ),
    [
        ("CHAR", r"'(?:\\(?:x[0-9a-fA-F]{1,4}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|['\"\\0abfnrtve])|[^'\\\n])'"),
        ("NUM", r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)(?:[uU]?[lL]?|[lL][uU]|[fFdDmM])(?!\w)"),
        ("WORD", r"@?[^\W\d]\w*"),
        ("OP", r"\?\.(?!\d)|" + _operators("=> -> :: ?? ??= ++ -- && || == != <= >= += -= *= /= %= &= |= ^= <<= << .. + - * / % = < > ! ~ ? : . , ; & | ^ ( ) [ ] { }")),
    ],
    _HARD + " " + _CONTEXTUAL,
    nested=False,
    formats=True,
)


def csharp_tokens(text: str) -> list[tuple]:
    out = _LEXIS.tokens(text)
    return [t for i, t in enumerate(out) if not (t[0] == "NAME" and i and out[i - 1][0] in ("STR", "TPL_END") and text.startswith("u8", t[1]))]
