"""Bundled grammars. They decide well-formedness only, so operators have no precedence levels and some rules cover a little
more than the language (checks that need names or types are none of theirs)."""

import re


#: A terminal that no lexer makes.
_NEVER = "'\x01'"


def _fill(text: str, **parts: str) -> str:
    """``text`` with each ``{name}`` replaced by that part."""
    return re.sub(r"\{(\w+)\}", lambda m: parts[m.group(1)], text)


JSON = """
file: value
value: '{' '}' | '{' pair ( ',' pair )* '}' | '[' ']' | '[' value ( ',' value )* ']' | STR | NUM | 'true' | 'false' | 'null'
pair: STR ':' value
"""

YAML = """
file: document | file DOC | file DOC document | DOC | DOC document
document: INDENT node DEDENT | NODE
node: entries | items | NODE
entries: entry+
entry: KEY | KEY NODE | KEY INDENT node DEDENT | KEY items
items: item+
item: DASH | DASH NODE | DASH INDENT node DEDENT
"""

SHELL = """
file: script fragment* | fragment*
script: NL+ | clist
fragment: FRAGMENT ( NL* | clist ) FRAGMENT_END
clist: sep* andor ( sep+ andor )* sep*
sep: ';' | '&' | NL
andor: pipeline ( ( '&&' | '||' ) NL* pipeline )*
pipeline: 'time'? '!'? command ( ( '|' | '|&' ) NL* command )*
command: element+ | compound redir* | function
element: ASSIGN | WORD | redir
redir: REDIR WORD | HEREDOC
compound: '{' clist '}' | '(' clist ')' | 'if' clist 'then' clist ( 'elif' clist 'then' clist )* ( 'else' clist )? 'fi'
    | 'while' clist 'do' clist 'done' | 'until' clist 'do' clist 'done'
    | ( 'for' | 'select' ) WORD ( NL* 'in' WORD* )? sep* 'do' clist 'done'
    | 'case' WORD NL* 'in' NL* 'esac' | 'case' WORD NL* 'in' NL* arm+ 'esac' | 'case' WORD NL* 'in' NL* arm* lastarm 'esac'
pattern: '('? WORD ( '|' WORD )* ')'
arm: pattern ( clist | NL* ) ( ';;' | ';&' | ';;&' ) NL*
lastarm: pattern ( clist | NL* )
function: WORD '(' ')' NL* compound redir* | 'function' WORD ( '(' ')' )? NL* compound redir*
"""

SQL = """
file: statement? ( ';' statement? )*
statement: query | insert | update | delete | create | drop | alter | 'begin' | 'commit' | 'rollback' | 'explain' 'analyze'? query | 'truncate' name | grant
name: id ( '.' ( id | '*' ) )*
id: NAME | 'first' | 'last' | 'range' | 'rows' | 'filter' | 'escape' | 'window' | 'view' | 'key' | 'index' | 'temp' | 'add' | 'column' | 'replace' | 'values' | 'set' | 'offset' | 'interval' | 'left' | 'right' | 'check' | 'partition' | 'over' | 'recursive' | 'within' | 'begin' | 'cast' | 'if' | 'explain' | 'commit' | 'rollback' | 'analyze' | 'truncate' | 'temporary' | 'grant' | 'revoke' | 'cascade' | 'alter' | 'insert' | 'update' | 'delete' | 'drop' | 'row_'
query: ( 'with' 'recursive'? cte ( ',' cte )* )? body tail*
cte: id ( '(' ids ')' )? 'as' '(' query ')'
ids: id ( ',' id )*
body: select ( ( 'union' | 'intersect' | 'except' ) ( 'all' | 'distinct' )? select )*
select: 'select' ( 'all' | 'distinct' ( 'on' '(' exprs ')' )? )? columns ( 'from' sources )? ( 'where' expr )? ( 'group' 'by' exprs )? ( 'having' expr )? ( 'window' id 'as' over ( ',' id 'as' over )* )? | 'values' row ( ',' row )* | '(' query ')'
row: '(' exprs ')'
tail: 'order' 'by' orders | 'limit' expr | 'offset' expr | 'fetch' ( 'first' | NAME ) NUM? 'rows' NAME?
orders: order ( ',' order )*
order: expr ( 'asc' | 'desc' )? ( 'nulls' ( 'first' | 'last' ) )?
columns: column ( ',' column )*
column: '*' | expr ( 'as'? id | 'as' STR )?
sources: source ( ',' source )*
source: relation | source joinkind? 'join' 'lateral'? relation ( 'on' expr | 'using' '(' ids ')' )?
joinkind: 'inner' | 'cross' | 'natural' | ( 'left' | 'right' | 'full' ) 'outer'?
relation: name alias? | 'lateral'? '(' query ')' alias? | '(' source ')' alias? | name '(' exprs? ')' alias?
alias: 'as'? id ( '(' ids ')' )?
exprs: expr ( ',' expr )*
expr: unary ( binop unary | 'is' 'not'? ( 'null' | 'true' | 'false' | 'distinct' 'from' unary ) | 'not'? 'in' '(' ( exprs | query ) ')' | 'not'? 'between' unary 'and' unary | 'not'? ( 'like' | 'ilike' ) unary ( 'escape' unary )? | '::' type | 'collate' name | '[' expr ( ':' expr )? ']' )*
binop: 'and' | 'or' | '=' | '<>' | '!=' | '<' | '>' | '<=' | '>=' | '+' | '-' | '*' | '/' | '%' | '^' | '||' | '&' | '|' | '<<' | '>>' | '->' | '->>' | '#' | '~' | '~*' | '!~'
unary: ( 'not' | '-' | '+' | '~' )? primary | 'not' unary
primary: NUM | STR | PARAM | 'null' | 'true' | 'false' | 'default' | name | call | '(' expr ( ',' expr )* ')' | '(' query ')' | 'exists' '(' query ')' | case | 'cast' '(' expr 'as' type ')' | 'interval' STR NAME? | NAME STR | '[' exprs? ']'
call: name '(' ( '*' | ( 'distinct' | 'all' )? exprs ( 'order' 'by' orders )? )? ')' ( 'filter' '(' 'where' expr ')' )? ( 'within' 'group' '(' 'order' 'by' orders ')' )? ( 'over' ( id | over ) )?
over: '(' ( 'partition' 'by' exprs )? ( 'order' 'by' orders )? frame? ')'
frame: ( 'rows' | 'range' ) ( bound | 'between' bound 'and' bound )
bound: NAME NAME | expr NAME
case: 'case' expr? ( 'when' expr 'then' expr )+ ( 'else' expr )? 'end'
type: NAME+ ( '(' NUM ( ',' NUM )? ')' )? ( '[' ']' )*
insert: ( 'with' 'recursive'? cte ( ',' cte )* )? 'insert' 'into' name ( '(' ids ')' )? ( query | 'default' 'values' ) ( 'on' NAME ( '(' ids ')' )? NAME ( NAME | 'update' 'set' sets ) )? returning?
update: 'update' name alias? 'set' sets ( 'from' sources )? ( 'where' expr )? returning?
delete: 'delete' 'from' name alias? ( 'using' sources )? ( 'where' expr )? returning?
returning: 'returning' columns
sets: name '=' expr ( ',' name '=' expr )*
create: 'create' ( 'or' 'replace' )? ( 'temp' | 'temporary' | 'unique' )? ( 'table' exists? name ( '(' part ( ',' part )* ')' ( 'as' query )? | 'as' query ) | 'view' name ( '(' ids ')' )? 'as' query | 'index' exists? name? 'on' name ( 'using' NAME )? '(' orders ')' ( 'where' expr )? )
exists: 'if' 'not' 'exists'
part: id type limit* | ( 'constraint' id )? ( 'primary' 'key' '(' ids ')' | 'unique' '(' ids ')' | 'check' '(' expr ')' | 'foreign' 'key' '(' ids ')' reference )
limit: 'not' 'null' | 'null' | 'primary' 'key' | 'unique' | 'default' primary | 'default' '-' NUM | 'check' '(' expr ')' | reference | 'collate' name
reference: 'references' name ( '(' ids ')' )? ( 'on' ( 'delete' | 'update' ) ( 'cascade' | 'set' ( 'null' | 'default' ) | NAME+ ) )*
drop: 'drop' ( 'table' | 'view' | 'index' ) ( 'if' 'exists' )? name ( ',' name )* 'cascade'?
alter: 'alter' 'table' name ( 'add' 'column'? id type limit* | 'drop' 'column'? id | 'add' part | NAME 'column'? id 'to' id | NAME 'to' id )
grant: ( 'grant' | 'revoke' ) ( 'all' | 'select' | 'insert' | 'update' | 'delete' ) 'on' name ( 'to' | 'from' ) id
"""

PYTHON = """
file: statement* ( FRAGMENT ( stars | yield ) FRAGMENT_END )*
statement: simple ( ';' simple )* ';'? NEWLINE | compound | NEWLINE
block: NEWLINE INDENT statement+ DEDENT | simple ( ';' simple )* ';'? NEWLINE
simple: stars ( '=' ( stars | yield ) )* | stars augmented ( stars | yield ) | target ':' test ( '=' ( stars | yield ) )? | yield | 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' ( test ( 'from' test )? )?
    | 'del' stars | 'global' NAME ( ',' NAME )* | 'nonlocal' NAME ( ',' NAME )* | 'assert' test ( ',' test )? | import | 'type' NAME generic? '=' test
augmented: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
target: primary
import: 'import' dotted ( 'as' NAME )? ( ',' dotted ( 'as' NAME )? )* | 'from' ( ( '.' | '...' )+ dotted? | dotted ) 'import' ( '*' | names | '(' names ','? ')' )
dotted: NAME ( '.' NAME )*
names: NAME ( 'as' NAME )? ( ',' NAME ( 'as' NAME )? )*
yield: 'yield' stars? | 'yield' 'from' test
compound: 'if' named ':' block ( 'elif' named ':' block )* ( 'else' ':' block )? | 'while' named ':' block ( 'else' ':' block )? | 'async'? 'for' stars 'in' stars ':' block ( 'else' ':' block )?
    | 'try' ':' block ( handler+ ( 'else' ':' block )? ( 'finally' ':' block )? | 'finally' ':' block ) | 'async'? 'with' ( withs | '(' withs ','? ')' ) ':' block
    | decorator* ( 'async'? 'def' NAME generic? '(' params? ')' ( '->' stars )? ':' block | 'class' NAME generic? ( '(' args? ')' )? ':' block )
    | 'match' stars ':' NEWLINE INDENT arm+ DEDENT
handler: 'except' '*'? ( stars ( 'as' NAME )? )? ':' block
withs: with ( ',' with )*
with: test ( 'as' star )?
decorator: '@' named NEWLINE
generic: '[' typevar ( ',' typevar )* ','? ']'
typevar: ( '*' | '**' )? NAME ( ':' test )? ( '=' test )?
arm: 'case' patterns ( 'if' named )? ':' block
patterns: pattern ( ',' pattern )* ','?
pattern: '*' NAME | alternative ( 'as' NAME )?
alternative: closed ( '|' closed )*
closed: '-'? NUM ( ( '+' | '-' ) NUM )? | STR+ | 'None' | 'True' | 'False' | dotted ( '(' ( patarg ( ',' patarg )* ','? )? ')' )? | '(' patterns? ')' | '[' patterns? ']' | '{' ( patpair ( ',' patpair )* ','? )? '}'
patarg: ( NAME '=' )? pattern
patpair: '**' NAME | closed ':' pattern
params: param ( ',' param )* ','?
param: NAME ( ':' test )? ( '=' test )? | '*' ( NAME ( ':' star )? )? | '**' NAME ( ':' test )? | '/'
stars: star ( ',' star )* ','?
star: '*' operand ( binop operand )* | named
named: test ( ':=' test )?
test: ortest ( 'if' ortest 'else' test )? | lambda
lambda: 'lambda' ( lambdaparam ( ',' lambdaparam )* ','? )? ':' test
lambdaparam: NAME ( '=' test )? | '*' NAME? | '**' NAME | '/'
ortest: operand ( binop operand )*
binop: 'and' | 'or' | '==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '&' | '|' | '^' | '<<' | '>>' | '**'
operand: ( 'not' | '-' | '+' | '~' | 'await' ) operand | primary
primary: atom | primary '.' NAME | primary '(' args? ')' | primary '[' subs ']'
atom: NAME | NUM | STR+ | '...' | 'None' | 'True' | 'False' | '(' ')' | '(' yield ')' | '(' star for+ ')' | '(' stars ')' | '[' ']' | '[' stars ']' | '[' star for+ ']' | '{' '}' | '{' pairs '}' | '{' pair for+ '}' | '{' stars '}' | '{' star for+ '}'
pairs: pair ( ',' pair )* ','?
pair: test ':' test | '**' operand ( binop operand )*
for: 'async'? 'for' stars 'in' ortest ( 'if' ( ortest | ortest ':=' ortest | lambda ) )*
args: arg ( ',' arg )* ','?
arg: named | named for+ | NAME '=' test | '*' test | '**' test
subs: sub ( ',' sub )* ','?
sub: star | test? ':' test? ( ':' test? )?
"""

GO = """
file: 'package' NAME ';' ( importdecl ';' )* ( topdecl ';' )*
importdecl: 'import' importspec | 'import' '(' ( importspec ';' )* importspec? ')'
importspec: ( NAME | '.' )? STR
topdecl: decl | 'func' receiver? NAME typeparams? signature block?
receiver: '(' params? ')'
decl: 'const' constspec | 'const' '(' ( constspec ';' )* constspec? ')' | 'var' varspec | 'var' '(' ( varspec ';' )* varspec? ')' | 'type' typespec | 'type' '(' ( typespec ';' )* typespec? ')'
constspec: names ( type? '=' exprs )?
varspec: names type ( '=' exprs )? | names '=' exprs
typespec: NAME typeparams? '='? type
typeparams: '[' typeparam ( ',' typeparam )* ','? ']'
typeparam: names constraint
constraint: '~'? type ( '|' '~'? type )*
names: NAME ( ',' NAME )*
signature: '(' params? ')' result?
result: type | '(' params? ')'
params: param ( ',' param )* ','?
param: type | NAME type | NAME? '...' type
type: typename | '*' type | '[' ']' type | '[' '...' ']' type | '[' expr ']' type | 'map' '[' type ']' type | 'chan' type | 'chan' '<-' type | '<-' 'chan' type | 'func' signature | 'struct' '{' ( field ';' )* field? '}' | 'interface' '{' ( method ';' )* method? '}' | '(' type ')'
typename: NAME ( '.' NAME )? ( '[' type ( ',' type )* ','? ']' )?
field: names type STR? | '*'? typename STR?
method: NAME signature | constraint
block: '{' stmts '}' | '{' '}'
stmts: stmt | stmts ';' | stmts ';' stmt | ';'
stmt: decl | simple | 'go' expr | 'defer' expr | 'return' exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | block | if | NAME ':' stmt? | for | switch | select
simple: expr | expr '<-' expr | exprs ( '++' | '--' ) | exprs assignop exprs
assignop: '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
if: 'if' ( simple? ';' )? simple block ( 'else' ( if | block ) )?
for: 'for' block | 'for' simple block | 'for' simple? ';' simple? ';' simple? block | 'for' ( exprs ( '=' | ':=' ) )? 'range' expr block
switch: 'switch' ( simple? ';' )? simple? '{' ( clause )* '}'
clause: ( 'case' cases | 'default' ) ':' stmts?
cases: casetype ( ',' casetype )*
casetype: expr | type
select: 'select' '{' comm* '}'
comm: ( 'case' simple | 'default' ) ':' stmts?
exprs: expr ( ',' expr )* 
expr: unary ( binop unary )*
binop: '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^'
unary: ( '+' | '-' | '!' | '^' | '*' | '&' | '<-' ) unary | primary
primary: operand | primary '.' NAME | primary '.' '(' ( type | 'type' ) ')' | primary '[' expr ( ',' type )* ','? ']' | primary '[' expr? ':' expr? ( ':' expr )? ']' | primary '(' ( callarg ( ',' callarg )* '...'? ','? )? ')'
callarg: expr | type
operand: NUM | STR | CHAR | NAME | '(' expr ')' | '(' type ')' | 'func' signature block | literaltype body | typename body | conversion '(' expr ','? ')'
conversion: '[' ']' type | 'map' '[' type ']' type | 'chan' type | 'func' signature | 'interface' '{' '}' | '[' expr ']' type
literaltype: '[' ']' type | '[' '...' ']' type | '[' expr ']' type | 'map' '[' type ']' type | 'struct' '{' ( field ';' )* field? '}'
body: '{' '}' | '{' element ( ',' element )* ','? '}'
element: ( ( expr | body ) ':' )? ( expr | body )
"""

JAVA = """
file: ( annotation* 'package' qualified ';' )? imports? typedecl* | imports? 'module_' 
imports: ( 'import' 'static'? qualified ( '.' '*' )? ';' | ';' )+
id: NAME | 'record' | 'sealed' | 'permits' | 'var' | 'yield'
qualified: id ( '.' id )*
annotation: '@' qualified ( '(' ( annoargs )? ')' )?
annoargs: annoarg ( ',' annoarg )* ','?
annoarg: ( id '=' )? annovalue
annovalue: expr | annotation | '{' ( annovalue ( ',' annovalue )* )? ','? '}'
modifier: annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | NAME '-' NAME
typedecl: modifier* typebody | ';'
typebody: 'class' id typeparams? ( 'extends' type )? ( 'implements' types )? ( 'permits' types )? classbody | 'interface' id typeparams? ( 'extends' types )? ( 'permits' types )? classbody | 'enum' id ( 'implements' types )? '{' ( constant ( ',' constant )* )? ','? ( ';' member* )? '}' | 'record' id typeparams? '(' params? ')' ( 'implements' types )? classbody | '@' 'interface' id classbody
constant: annotation* id ( '(' args? ')' )? classbody?
typeparams: '<' typeparam ( ',' typeparam )* '>'
typeparam: annotation* id ( 'extends' type ( '&' type )* )?
types: type ( ',' type )*
type: annotation* ( simpletype ) ( annotation* '[' ']' )*
simpletype: 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double' | 'void' | classtype
classtype: id typeargs? ( '.' annotation* id typeargs? )*
typeargs: '<' '>' | '<' typearg ( ',' typearg )* '>'
typearg: type | annotation* '?' ( ( 'extends' | 'super' ) type )?
classbody: '{' member* '}'
member: ';' | modifier* typebody | 'static'? block | modifier* typeparams? type id '(' params? ')' ( '[' ']' )* throws? ( block | ';' | 'default' annovalue ';' ) | modifier* typeparams? id '(' params? ')' throws? block | modifier* type variables ';' | modifier* id block
throws: 'throws' types
params: param ( ',' param )*
param: modifier* type ( annotation* '...' )? ( id ( '.' 'this' )? | 'this' ) ( '[' ']' )*
variables: variable ( ',' variable )*
variable: id ( '[' ']' )* ( '=' ( expr | arrayinit ) )?
arrayinit: '{' ( ( expr | arrayinit ) ( ',' ( expr | arrayinit ) )* )? ','? '}'
block: '{' statement* '}'
statement: block | ';' | modifier* type variables ';' | modifier* typebody | expr ';' | 'if' '(' expr ')' statement ( 'else' statement )? | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';' | for | 'return' expr? ';' | 'break' id? ';' | 'continue' id? ';' | 'throw' expr ';' | 'yield' expr ';'
    | 'assert' expr ( ':' expr )? ';' | 'synchronized' '(' expr ')' block | try | switch | id ':' statement
for: 'for' '(' ( modifier* type variables | exprs )? ';' expr? ';' exprs? ')' statement | 'for' '(' modifier* type id ':' expr ')' statement
try: 'try' block ( catch+ ( 'finally' block )? | 'finally' block ) | 'try' '(' resource ( ';' resource )* ';'? ')' block catch* ( 'finally' block )?
resource: modifier* type id '=' expr | expr
catch: 'catch' '(' modifier* type ( '|' type )* id ')' block
switch: 'switch' '(' expr ')' '{' ( group | rule )* '}'
group: label ':' statement*
rule: label '->' ( expr ';' | block | 'throw' expr ';' )
label: 'case' casearg ( ',' casearg )* ( NAME expr )? | 'default'
casearg: cond | modifier* pattern | 'default'
pattern: type id | type '(' ( pattern ( ',' pattern )* )? ')' id?
exprs: expr ( ',' expr )*
args: exprs
expr: cond | cond assignop expr | lambda
assignop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '=' | '>' '>' '>' '=' | '>' '='
lambda: ( id | '(' ( id ( ',' id )* )? ')' | '(' params ')' ) '->' ( expr | block )
cond: binary | binary '?' expr ':' ( cond | lambda )
binary: unary | binary binop unary | binary 'instanceof' ( 'final'? type id? | pattern )
binop: '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>' '=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%'
unary: ( '+' | '-' | '!' | '~' | '++' | '--' ) unary | '(' type ( '&' type )* ')' unary | '(' type ( '&' type )* ')' lambda | postfix
postfix: primary | postfix '++' | postfix '--'
primary: literal | 'this' | 'super' | id | '(' expr ')' | primary '.' typeargs? id | primary '.' 'this' | primary '.' 'super' | primary '.' 'class' | primary '.' new | primary '(' args? ')' | primary '[' expr ']' | new | type '::' ( id | 'new' ) | primary '::' typeargs? ( id | 'new' ) | arraytype '.' 'class' | 'int' '.' 'class' | 'void' '.' 'class' | switch
arraytype: simpletype ( '[' ']' )+
literal: NUM | STR | CHAR | 'true' | 'false' | 'null'
new: 'new' annotation* ( classtype | simpletype ) ( '(' args? ')' classbody? | ( '[' expr ']' )+ ( '[' ']' )* | ( '[' ']' )+ arrayinit )
"""

_C_COMMON = """
primary: id | NUM | CHAR | STR+ | '(' exprs ')' | '(' block ')' | {primary}
postfix: primary | postfix '[' exprs? ']' | postfix '(' args? ')' | postfix '.' member | postfix '->' member | postfix '++' | postfix '--' | '(' typename ')' braces | {postfix}
member: id | {member}
args: arg ( ',' arg )*
arg: assign | {arg}
unary: postfix | ( '++' | '--' | '&' | '*' | '+' | '-' | '~' | '!' ) unary | 'sizeof' unary | 'sizeof' '(' typename ')' | '(' typename ')' unary | {unary}
binary: unary | binary binop unary
binop: '*' | '/' | '%' | '+' | '-' | '<<' | '>' '>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&' | '^' | '|' | '&&' | '||' | {binop}
cond: binary | binary '?' exprs? ':' cond | {cond}
assign: cond | cond assignop ( assign | braces ) | {assign}
assignop: '=' | '*=' | '/=' | '%=' | '+=' | '-=' | '<<=' | '>>=' | '&=' | '^=' | '|='
exprs: assign ( ',' assign )*
braces: '{' '}' | '{' init ( ',' init )* ','? '}'
init: ( designator+ '=' )? ( assign | braces ) | {init}
designator: '[' cond ']' | '.' id | '[' cond '...' cond ']'
block: '{' item* '}'
item: declaration | statement | {item}
attribute: '__attribute__' '(' '(' attrs? ')' ')' | {attribute}
attrs: attr ( ',' attr? )*
attr: id ( '(' args? ')' )? | 'const'
asm: ( 'asm' | '__asm__' ) ( 'volatile' | 'goto' )* '(' STR+ ( ':' asmops? )* ')'
asmops: asmop ( ',' asmop )*
asmop: ( '[' id ']' )? STR+ ( '(' exprs ')' )?
"""

C = """
file: external*
external: declaration | function | ';' | asm ';'
function: specifiers declarator declaration* block
id: NAME
declaration: specifiers ( initdeclarator ( ',' initdeclarator )* )? ';' | '_Static_assert' '(' args ')' ';'
initdeclarator: declarator asm? attribute* ( '=' ( assign | braces ) )?
specifiers: qualifier* basetype qualifier* | qualifier+
basetype: builtin ( qualifier* builtin )* | NAME | struct | enum
builtin: 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | '_Complex'
qualifier: 'const' | 'volatile' | 'restrict' | 'static' | 'extern' | 'inline' | 'register' | 'auto' | 'typedef' | '_Noreturn' | '_Thread_local' | '_Atomic' | '_Alignas' '(' ( cond | typename ) ')' | attribute
struct: ( 'struct' | 'union' ) attribute* ( NAME | NAME? '{' field* '}' ) attribute*
field: specifiers ( fielddecl ( ',' fielddecl )* )? ';' | ';' | '_Static_assert' '(' args ')' ';'
fielddecl: declarator ( ':' cond )? attribute* | ':' cond
enum: 'enum' attribute* ( NAME | NAME? '{' enumerator ( ',' enumerator )* ','? '}' )
enumerator: NAME ( '=' cond )?
declarator: pointer* direct attribute*
pointer: '*' qualifier*
direct: NAME | '(' attribute* declarator ')' | direct '[' qualifier* ( assign | '*' )? ']' | direct '(' params? ')'
params: param ( ',' param )* ( ',' '...' )? | '...'
param: specifiers ( declarator | abstract )?
abstract: pointer+ | pointer* directabstract
directabstract: '(' abstract ')' | '[' qualifier* assign? ']' | directabstract '[' assign? ']' | directabstract? '(' params? ')'
typename: specifiers abstract?
statement: block | exprs? ';' | 'if' '(' exprs ')' statement ( 'else' statement )? | 'switch' '(' exprs ')' statement | 'while' '(' exprs ')' statement | 'do' statement 'while' '(' exprs ')' ';' | 'for' '(' ( exprs? ';' | declaration ) exprs? ';' exprs? ')' statement
    | 'return' exprs? ';' | 'break' ';' | 'continue' ';' | 'goto' NAME ';' | NAME ':' ( statement | declaration )? | 'case' cond ( '...' cond )? ':' | 'default' ':' | asm ';'
""" + _fill(_C_COMMON, primary="'_Generic' '(' assign ',' generic ( ',' generic )* ')'", postfix="'_Alignof' '(' typename ')'", member="NAME", arg="typename", unary=_NEVER, binop=_NEVER, cond=_NEVER, assign=_NEVER, init="designator id ':' assign", item="function", attribute="'[' '[' attrs ']' ']'") + """
generic: ( typename | 'default' ) ':' assign
"""

CPP = """
file: external*
external: declaration | function | ';' | asm ';' | namespace | template external | 'extern' STR ( '{' external* '}' | external ) | 'export' external
namespace: 'inline'? 'namespace' attribute* ( id ( '::' 'inline'? id )* )? '{' external* '}' | 'namespace' id '=' name ';'
template: 'template' 'T<' ( tparam ( ',' tparam )* )? 'T>' requires?
requires: 'requires' binary
tparam: ( 'typename' | 'class' | template ( 'class' | 'typename' ) | name ) '...'? id? ( '=' ( typename | name ) )? | param
id: NAME | 'final' | 'override'
name: '::'? ( segment '::' 'template'? )* segment
segment: id | id 'T<' ( targ ( ',' targ )* )? 'T>' | '~' id | operator
targ: typename '...'? | binary '...'?
operator: 'operator' ( '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '~' | '!' | '=' | '<' | '>' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<' | '>' '>' | '<<=' | '>>=' | '==' | '!=' | '<=' | '>=' | '<=>' | '&&' | '||' | '++' | '--' | ',' | '->*' | '->' | '(' ')' | '[' ']' | 'new' ( '[' ']' )? | 'delete' ( '[' ']' )? | STR id ) | 'operator' typename
function: specifiers? declarator suffix* ( ctorinit? block | 'try' ctorinit? block handler+ | '=' ( 'default' | 'delete' ) ';' )
suffix: 'const' | 'volatile' | 'noexcept' ( '(' binary ')' )? | '&' | '&&' | 'override' | 'final' | '->' typename | 'throw' '(' ( typename ( ',' typename )* )? ')' | attribute | requires
ctorinit: ':' initializer ( ',' initializer )*
initializer: name ( '(' args? ')' | braces ) '...'?
declaration: specifiers ( initdeclarator ( ',' initdeclarator )* )? ';' | 'static_assert' '(' args ')' ';' | 'using' ( 'namespace' name | 'typename'? name | id attribute* '=' typename ) ';' | 'friend' ( function | declaration ) | 'template' specifiers ';' | 'enum' 'class' id ';' | specifiers '[' id ( ',' id )* ']' ( '=' assign | braces | '(' args ')' ) ';' | specifiers ( '&' | '&&' ) '[' id ( ',' id )* ']' '=' assign ';' | 'concept' id '=' binary ';'
initdeclarator: declarator suffix* asm? ( '=' ( assign | braces | 'default' | 'delete' | NUM ) | '(' args ')' | braces )?
specifiers: qualifier* basetype qualifier* | qualifier+
basetype: builtin ( qualifier* builtin )* | name | class | enum | 'typename' name | 'decltype' '(' ( exprs | 'auto' ) ')' | 'auto'
builtin: 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | 'bool' | 'wchar_t' | 'char8_t' | 'char16_t' | 'char32_t'
qualifier: 'const' | 'volatile' | 'static' | 'extern' | 'inline' | 'register' | 'typedef' | 'mutable' | 'virtual' | 'explicit' ( '(' binary ')' )? | 'constexpr' | 'consteval' | 'constinit' | 'thread_local' | 'friend' | 'alignas' '(' ( cond | typename ) ')' | attribute
class: ( 'class' | 'struct' | 'union' ) attribute* ( name 'final'? )? ( ':' bases )? '{' classitem* '}' | ( 'class' | 'struct' | 'union' ) attribute* name
bases: base ( ',' base )*
base: ( 'public' | 'private' | 'protected' | 'virtual' )* name '...'?
classitem: ( 'public' | 'private' | 'protected' ) ':' | declarator suffix* ( '=' ( 'default' | 'delete' | NUM ) )? ';' | declaration | function | ';' | template classitem | specifiers ( declarator? ':' cond ( '=' assign )? ( ',' declarator? ':' cond )* )? ';'
enum: 'enum' ( 'class' | 'struct' )? attribute* ( name ( ':' specifiers )? | name? ( ':' specifiers )? '{' ( enumerator ( ',' enumerator )* ','? )? '}' )
enumerator: id attribute* ( '=' cond )?
declarator: pointer* direct attribute*
pointer: '*' qualifier* | '&' | '&&' | name '::' '*' qualifier*
direct: name | '(' declarator ')' | direct '[' assign? ']' | direct '(' params? ')' | '...' id
params: param ( ',' param )* ( ','? '...' )? | '...'
param: specifiers ( declarator | abstract )? ( '=' ( assign | braces ) )? | 'this' specifiers declarator
abstract: pointer+ '...'? | pointer* directabstract | '...'
directabstract: '(' abstract ')' | '[' assign? ']' | directabstract '[' assign? ']' | directabstract? '(' params? ')' suffix*
typename: specifiers abstract?
statement: block | exprs? ';' | 'if' ( 'constexpr' | '!'? 'consteval' )? '(' condition ')' statement ( 'else' statement )? | 'switch' '(' condition ')' statement | 'while' '(' condition ')' statement | 'do' statement 'while' '(' exprs ')' ';' | 'for' '(' ( exprs? ';' | declaration ) condition? ';' exprs? ')' statement
    | 'for' '(' ( declaration | exprs ';' )? rangedecl ':' ( exprs | braces ) ')' statement | ( 'return' | 'co_return' ) ( exprs | braces )? ';' | 'break' ';' | 'continue' ';' | 'goto' id ';' | id ':' ( statement | declaration )? | 'case' cond ':' | 'default' ':' | 'try' block handler+ | asm ';' | attribute statement
condition: exprs | ( declaration | exprs ';' ) condition | specifiers declarator ( '=' assign | braces )
rangedecl: specifiers ( pointer* id | pointer* '[' id ( ',' id )* ']' )
handler: 'catch' '(' ( '...' | param ) ')' block
lambda: '[' ( capture ( ',' capture )* )? ']' ( 'T<' tparam ( ',' tparam )* 'T>' )? ( '(' params? ')' )? ( 'mutable' | 'constexpr' | 'static' )* ( 'noexcept' ( '(' binary ')' )? )? attribute* ( '->' typename )? block
capture: '=' | '&' | '&'? id ( '=' assign | braces )? '...'? | '*'? 'this' | '...' id
""" + _fill(_C_COMMON, 
    primary="name | 'true' | 'false' | 'nullptr' | 'this' | lambda | '(' '...' binop binary ')' | '(' binary binop '...' ')' | '(' binary binop '...' binop binary ')' | 'requires' ( '(' params? ')' )? '{' requirement+ '}'",
    postfix="name braces | builtin '(' args? ')' | builtin braces | 'typename' name ( '(' args? ')' | braces ) | 'auto' '(' args ')' | ( 'static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast' ) 'T<' typename 'T>' '(' exprs ')' | 'typeid' '(' ( exprs | typename ) ')' | 'decltype' '(' exprs ')' ( '(' args? ')' | braces )",
    member="'template'? name", arg="braces | assign '...'", unary="'&&' id | 'sizeof' '...' '(' id ')' | 'alignof' '(' typename ')' | 'noexcept' '(' exprs ')' | '::'? 'delete' ( '[' ']' )? unary | '::'? 'new' ( '(' args ')' )? newtype ( '(' args? ')' | braces )? | 'co_await' unary",
    binop="'<=>' | '->*' | '.*'", cond="'throw' assign? | 'co_yield' ( assign | braces )", assign="binary '?' exprs ':' 'throw' assign", init="assign '...'", item="function", attribute="'[' '[' attrs ']' ']' | '[' '[' 'using' id ':' attrs ']' ']'",
) + """
newtype: specifiers pointer* ( '[' exprs ']' )* | '(' typename ')'
requirement: exprs ';' | 'typename' name ';' | '{' exprs '}' 'noexcept'? ( '->' name )? ';' | 'requires' binary ';'
"""

_SCRIPT = """
file: item* ( FRAGMENT '...'? exprs FRAGMENT_END )*
item: statement | import | export
id: NAME | 'async' | 'of' | 'get' | 'set' | 'from' | 'as' | 'static' | 'let' | 'yield' | 'await' {ids}
word: id | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'enum' | 'export' | 'extends' | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with'
statement: block | variables ';' | ';' | exprs ';' | function | class | 'if' '(' exprs ')' statement ( 'else' statement )? | 'do' statement 'while' '(' exprs ')' ';'? | 'while' '(' exprs ')' statement | for | 'continue' id? ';' | 'break' id? ';' | 'return' exprs? ';' | 'with' '(' exprs ')' statement
    | id ':' statement | 'switch' '(' exprs ')' '{' clause* '}' | 'throw' exprs ';' | 'try' block ( 'catch' ( '(' binding annotation? ')' )? block ( 'finally' block )? | 'finally' block ) | 'debugger' ';' {statement}
block: '{' statement* '}'
clause: ( 'case' exprs | 'default' ) ':' statement*
variables: ( 'var' | 'let' | 'const' ) variable ( ',' variable )*
variable: binding definite? annotation? ( '=' assign )?
definite: {definite}
annotation: {annotation}
for: 'for' '(' ( variables | exprs )? ';' exprs? ';' exprs? ')' statement | 'for' 'await'? '(' ( ( 'var' | 'let' | 'const' ) binding | lhs ) ( 'of' assign | 'in' exprs ) ')' statement
binding: id | '[' ( ','* bindelem ( ','+ bindelem )* )? ','* ']' | '{' ( bindprop ( ',' bindprop )* ','? )? '}'
bindelem: '...'? binding ( '=' assign )?
bindprop: id ( '=' assign )? | key ':' bindelem | '...' binding
function: 'async'? 'function' '*'? id generics? '(' params? ')' returns? fbody
fbody: block {fbody}
params: param ( ',' param )* ','?
param: decorator* access* '...'? binding optional? annotation? ( '=' assign )? {param}
access: {access}
optional: {optional}
generics: {generics}
returns: {returns}
decorator: '@' lhs
class: decorator* 'abstract_'? 'class' id generics? heritage* '{' member* '}' {class}
heritage: 'extends' lhs typeargs? {heritage}
typeargs: {typeargs}
member: ';' | decorator* modifier* key optional? definite? annotation? ( '=' assign )? ';' | decorator* modifier* 'async'? '*'? key optional? generics? '(' params? ')' returns? fbody | decorator* modifier* ( 'get' | 'set' ) key '(' params? ')' returns? fbody | 'static' block {member}
modifier: 'static' {modifier}
key: word | STR | NUM | PRIVATE | '[' assign ']'
import: 'import' STR with? ';' | 'import' {typeonly} clauses 'from' STR with? ';' {import}
with: ( 'with' | NAME ) '{' ( ( word | STR ) ':' STR ( ',' ( word | STR ) ':' STR )* )? ','? '}'
clauses: id | '*' 'as' id | named | id ',' '*' 'as' id | id ',' named
named: '{' ( specifier ( ',' specifier )* ','? )? '}'
specifier: {typeonly} ( word | STR ) ( 'as' ( word | STR ) )?
export: 'export' '*' ( 'as' ( word | STR ) )? 'from' STR with? ';' | 'export' {typeonly} named ( 'from' STR with? )? ';' | 'export' ( variables ';' | function | class ) | 'export' 'default' ( assign ';' | function | class | 'async'? 'function' '*'? '(' params? ')' returns? fbody | decorator* 'class' heritage* '{' member* '}' ) {export}
exprs: assign ( ',' assign )*
assign: cond | lhs assignop assign | arrow | 'yield' | 'yield' '*'? assign | 'async' arrow
assignop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
arrow: ( id | generics? '(' params? ')' returns? ) '=>' ( assign | block )
cond: binary | binary '?' assign ':' assign
binary: unary | binary binop unary {binary}
binop: '+' | '-' | '*' | '/' | '%' | '**' | '<<' | '>' '>' | '>' '>' '>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&' | '^' | '|' | '&&' | '||' | '??' | 'in' | 'instanceof'
unary: postfix | ( 'delete' | 'void' | 'typeof' | '++' | '--' | '+' | '-' | '~' | '!' | 'await' ) unary | PRIVATE {unary}
postfix: lhs | lhs '++' | lhs '--'
lhs: primary | lhs '.' ( word | PRIVATE ) | lhs '?.' ( word | PRIVATE ) | lhs '[' exprs ']' | lhs '?.' '[' exprs ']' | lhs '(' args? ')' | lhs '?.' '(' args? ')' | lhs template | 'new' lhs | 'new' '.' word | 'import' '.' word | 'import' '(' args ')' {lhs}
args: arg ( ',' arg )* ','?
arg: '...'? assign
template: TEMPLATE | TPL_START exprs ( TPL_MID exprs )* TPL_END
primary: id | 'this' | 'super' | 'null' | 'true' | 'false' | NUM | STR | REGEX | JSX | template | '(' exprs ')' | '[' ','* ( arg ( ','+ arg )* ','* )? ']' | '{' ( property ( ',' property )* ','? )? '}' | 'async'? 'function' '*'? id? generics? '(' params? ')' returns? block | decorator* 'class' id? generics? heritage* '{' member* '}'
property: id ( '=' assign )? | key ':' assign | '...' assign | 'async'? '*'? key generics? '(' params? ')' returns? block | ( 'get' | 'set' ) key '(' params? ')' returns? block
"""

JAVASCRIPT = _fill(
    _SCRIPT,
    ids="", statement="", definite=_NEVER, annotation=_NEVER, fbody="", param="", access=_NEVER, optional=_NEVER, generics=_NEVER, returns=_NEVER, **{"class": ""}, heritage="", typeargs=_NEVER, member="", modifier="", typeonly="", export="", binary="", unary="", lhs="", **{"import": ""}
)

TYPESCRIPT = _fill(
    _SCRIPT,
    ids="| 'type' | 'interface' | 'namespace' | 'module' | 'declare' | 'abstract' | 'readonly' | 'public' | 'private' | 'protected' | 'implements' | 'keyof' | 'infer' | 'is' | 'satisfies' | 'asserts' | 'unique' | 'override' | 'accessor' | 'out' | 'global'",
    statement="| declaration",
    definite="'!'",
    annotation="':' type | ':' predicate",
    fbody="| ';'",
    param="| 'this' ':' type",
    access="'public' | 'private' | 'protected' | 'readonly' | 'override'",
    optional="'?'",
    generics="'<' generic ( ',' generic )* ','? '>'",
    returns="':' type | ':' predicate",
    heritage="| 'implements' type ( ',' type )*",
    typeargs="'<' type ( ',' type )* ','? '>'",
    member="| modifier* '[' id ':' type ']' annotation? ';'",
    modifier="| 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'declare' | 'override' | 'accessor'",
    typeonly="'type'?",
    export="| 'export' declaration | 'export' '=' exprs ';' | 'export' 'as' 'namespace' id ';' | 'export' 'default' ( interface | 'abstract' class )",
    binary="| binary ( 'as' | 'satisfies' ) ( type | 'const' )",
    unary="| '<' type '>' unary",
    lhs="| lhs '!' | lhs typeargs '(' args? ')' | lhs typeargs template | lhs '?.' typeargs '(' args? ')' | 'new' lhs typeargs",
    **{"class": "", "import": "| 'import' 'type'? id '=' ( 'require_' '(' STR ')' | lhs ) ';'"},
).replace("'abstract_'?", "'abstract'?") + """
declaration: interface | 'type' id generics? '=' type ';' | 'const'? 'enum' id '{' ( enumerator ( ',' enumerator )* ','? )? '}' | ( 'namespace' | 'module' ) ( id ( '.' id )* | STR ) '{' item* '}' | 'declare' ( variables ';' | function | class | declaration | ( 'module' STR ';' ) ) | 'declare' 'global' '{' item* '}' | 'declare' 'function' id generics? '(' params? ')' returns? ';'
interface: 'interface' id generics? ( 'extends' type ( ',' type )* )? objecttype
enumerator: ( word | STR ) ( '=' assign )?
generic: ( 'const' | 'in' | 'out' )* id ( 'extends' type )? ( '=' type )?
predicate: ( id | 'this' ) 'is' type | 'asserts' ( id | 'this' ) ( 'is' type )?
type: union | union 'extends' union '?' type ':' type | 'abstract'? 'new'? generics? '(' params? ')' '=>' ( type | predicate )
union: ( '|' | '&' )? intersect ( ( '|' | '&' ) intersect )*
intersect: ( 'keyof' | 'readonly' | 'unique' )* posttype | 'infer' id ( 'extends' type )?
posttype: primtype | posttype '[' ']' | posttype '[' type ']'
primtype: typeref | 'void' | 'null' | 'this' | 'true' | 'false' | STR | '-'? NUM | template | TPL_START type ( TPL_MID type )* TPL_END | objecttype | '[' ( tupleitem ( ',' tupleitem )* ','? )? ']' | '(' type ')' | 'typeof' lhsname typeargs? | 'import' '(' STR ')' ( '.' id )* typeargs? | 'asserts' id
typeref: lhsname typeargs?
lhsname: id ( '.' word )* | 'this' ( '.' word )+ | 'import' '(' STR ')' ( '.' word )*
tupleitem: '...'? ( word '?'? ':' )? type '?'?
objecttype: '{' ( typemember ( ( ';' | ',' )+ typemember )* ( ';' | ',' )* )? '}'
typemember: 'readonly'? key '?'? annotation? | ( 'get' | 'set' )? key '?'? generics? '(' params? ')' returns? | 'new'? generics? '(' params? ')' returns? | ( ( '+' | '-' )? 'readonly' )? '[' id ':' type ']' annotation | ( ( '+' | '-' )? 'readonly' )? '[' id 'in' type ( 'as' type )? ']' ( ( '+' | '-' )? '?' )? annotation?
"""
