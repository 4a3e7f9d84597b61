"""Grammar and lexer of Rust. What stands in macros and attributes is held to paired brackets, as Rust itself does."""

from codeloom.llm.grammar.lexers import _operators
from codeloom.llm.grammar.scanning import Lexis, Quote

_KEYWORDS = "as async await box break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while _ union default auto macro_rules raw safe"
_OPERATORS = "... ..= .. :: -> => == != <= && || += -= *= /= %= ^= &= |= + - * / % ^ ! & | = < > @ . , ; : # $ ? ~"

RUST = """
file: inner* item*
inner: '#' '!' '[' tt* ']'
outer: '#' '[' tt* ']'
tt: any | tree
tree: '(' tt* ')' | '[' tt* ']' | '{' tt* '}'
any: NAME | NUM | STR | CHAR | LIFETIME | {any}
id: NAME | 'union' | 'default' | 'auto' | 'macro_rules' | 'raw' | 'safe' | 'box'
item: outer* vis? kind | outer* bang
bang: path '!' id? ( '{' tt* '}' | '(' tt* ')' ';' | '[' tt* ']' ';' )
vis: 'pub' | 'pub' '(' path ')' | 'pub' '(' 'in' path ')' | 'crate'
path: '::'? part ( '::' part )*
part: id | 'self' | 'Self' | 'super' | 'crate'
kind: 'use' use ';' | 'extern' 'crate' part ( 'as' ( id | '_' ) )? ';' | 'mod' id ';' | 'unsafe'? 'mod' id body | 'unsafe'? 'extern' STR? body | function
    | 'type' id generics? ( ':' bounds )? where? ( '=' type where? )? ';' | 'struct' id generics? where? ( '{' fields? '}' | ';' ) | 'struct' id generics? '(' slots? ')' where? ';'
    | 'union' id generics? where? '{' fields? '}' | 'enum' id generics? where? '{' variants? '}' | 'const' ( id | '_' ) ':' type ( '=' expr )? ';' | 'static' 'mut'? id ':' type ( '=' expr )? ';'
    | 'unsafe'? 'auto'? 'trait' id generics? ( ':' bounds? )? where? body | 'default'? 'unsafe'? 'impl' generics? impl where? body
impl: type | '!'? type 'for' type
body: '{' inner* item* '}'
use: usepath | usepath 'as' ( id | '_' ) | '*' | usepath '::' '*' | '::' '*' | ( usepath '::' | '::' )? '{' ( use ( ',' use )* ','? )? '}'
usepath: '::'? part ( '::' part )*
fields: field ( ',' field )* ','?
field: outer* vis? id ':' type
slots: slot ( ',' slot )* ','?
slot: outer* vis? type
variants: variant ( ',' variant )* ','?
variant: outer* id ( '{' fields? '}' | '(' slots? ')' )? ( '=' expr )?
function: quality* 'fn' id generics? '(' params? ')' ( '->' type )? where? ( block | ';' )
quality: 'const' | 'async' | 'unsafe' | 'extern' | 'extern' STR | 'default' | 'safe'
params: param ( ',' param )* ','?
param: outer* ( pattern ':' type | '...' | ( id ':' )? '...' | selfparam )
slotparams: outer* slotparam ( ',' outer* slotparam )* ','?
slotparam: type | ( id | '_' ) ':' type | '...'
selfparam: ( '&' LIFETIME? )? 'mut'? 'self' ( ':' type )?
generics: '<' ( generic ( ',' generic )* ','? )? '>'
generic: outer* ( LIFETIME ( ':' bounds? )? | id ( ':' bounds? )? ( '=' type )? | 'const' id ':' type ( '=' constant )? )
constant: block | literal | '-' literal | id
bounds: bound ( '+' bound )* '+'?
bound: LIFETIME | simplebound | '(' simplebound ')' | 'use' targs
simplebound: ( '?' | '~' 'const' | 'const' )? forall? tpath
forall: 'for' generics
where: 'where' ( predicate ( ',' predicate )* ','? )?
predicate: LIFETIME ':' bounds? | forall? type ':' bounds?
type: '(' ')' | '(' type ')' | '(' type ',' ')' | '(' type ( ',' type )+ ','? ')' | '!' | ( '&' | '&&' ) LIFETIME? 'mut'? type | '*' ( 'const' | 'mut' ) type | '[' type ']' | '[' type ';' expr ']' | '_'
    | forall? pointer | 'impl' bounds | 'dyn' bounds | forall? tpath | tpath '!' tree
pointer: quality* 'fn' '(' slotparams? ')' ( '->' type )?
tpath: '::'? seg ( '::' seg )* | '<' type ( 'as' tpath )? '>' ( '::' seg )+
seg: part | part '::'? targs | part '::'? '(' ( type ( ',' type )* ','? )? ')' ( '->' type )? | part '(' '..' ')'
targs: '<' ( targ ( ',' targ )* ','? )? '>'
targ: LIFETIME | type | tpath '+' bounds | literal | '-' literal | block | id targs? '=' ( type | constant ) | id targs? ':' bounds
literal: NUM | STR | CHAR | 'true' | 'false'
expr: chain | tail | chain binop tail
chain: unary | chain binop unary | chain 'as' type | chain range
range: '..' | '..='
binop: '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '&&' | '||' | '==' | '!=' | '<' | '>' | '<=' | '>' '=' | '<' '<' | '>' '>' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<' '<=' | '>' '>' '=' | range
prefix: '-' | '!' | '*' | ( '&' | '&&' ) 'mut'? | '&' 'raw' ( 'const' | 'mut' ) | range | outer
unary: postfix | prefix unary | '..' | 'let' pattern '=' unary
tail: prefix tail | forall? 'static'? 'async'? 'move'? bars ( expr | '->' type block ) | 'return' expr? | 'break' LIFETIME? expr? | 'continue' LIFETIME?
bars: '||' | '|' '|' | '|' bar ( ',' bar )* ','? '|'
bar: outer* pat ( ':' type )?
postfix: primary | postfix '?' | postfix '.' id ( '::' targs )? | postfix '.' ( NUM | 'await' | 'match' ) | postfix '(' exprs? ')' | postfix '[' expr ']'
primary: literal | epath | epath '{' ( inits ','? | ( inits ',' )? '..' expr? )? '}' | '(' exprs? ')' | '[' exprs? ']' | '[' expr ';' expr ']' | blocklike | epath '!' tree | '_'
epath: '::'? eseg ( '::' eseg )* | '<' type ( 'as' tpath )? '>' ( '::' eseg )+
eseg: part ( '::' targs )?
inits: init ( ',' init )*
init: outer* id | outer* ( id | NUM ) ':' expr
exprs: expr ( ',' expr )* ','?
blocklike: block | 'unsafe' block | 'const' block | 'async' 'move'? block | ( LIFETIME ':' )? loop | LIFETIME ':' block | if | 'match' expr '{' inner* arm* lastarm? '}'
loop: 'loop' block | 'while' expr block | 'for' pattern 'in' expr block
if: 'if' expr block ( 'else' ( if | block ) )?
arm: outer* pattern ( 'if' expr )? '=>' ( expr ',' | blocklike )
lastarm: outer* pattern ( 'if' expr )? '=>' expr
block: '{' inner* statement* ( expr )? '}'
statement: ';' | outer* vis? kind | outer* 'let' pattern ( ':' type )? ( '=' expr ( 'else' block )? )? ';' | expr ';' | outer* blocklike | outer* epath '!' '{' tt* '}' | outer* path '!' id tree ';'?
pattern: '|'? pat ( '|' pat )*
pat: '_' | '..' | end | end '...' end | end range end? | range end | '&' 'mut'? pat | '&&' 'mut'? pat | 'mut' id ( '@' pat )? | 'ref' 'mut'? id ( '@' pat )? | id '@' pat | epath '(' pats? ')' | epath '{' ( fieldpat ( ',' fieldpat )* ','? )? '}' | '(' pats? ')' | '[' pats? ']' | epath '!' tree | 'const' block | 'box' pat
end: literal | '-' literal | epath
pats: pattern ( ',' pattern )* ','?
fieldpat: outer* ( '..' | ( id | NUM ) ':' pattern | 'box'? 'ref'? 'mut'? id )
""".replace("{any}", " | ".join(f"'{w}'" for w in _KEYWORDS.split() + _OPERATORS.split()))

_LEXIS = Lexis(
    r"[\s﻿]+|//[^\n]*|\A#!(?!\s*\[)[^\n]*",
    (Quote(r'(?:b|c)?r(#*)"', lambda m: '"' + m.group(1), escapes=False, lines=True), Quote(r'[bc]?"', '"', lines=True)),
    [
        ("CHAR", r"b?'(?:\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|[nrt0\\'\"])|[^'\\\n\t])'"),
        ("LIFETIME", r"'(?:r#)?[^\W\d]\w*"),
        ("NUM", r"0[xob][0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?(?!\w)|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?\w*"),
        ("WORD", r"(?:r#)?[^\W\d]\w*"),
        ("OP", _operators(_OPERATORS + " ( ) [ ] { }")),
    ],
    _KEYWORDS,
)


def rust_tokens(text: str) -> list[tuple]:
    return _LEXIS.tokens(text)
