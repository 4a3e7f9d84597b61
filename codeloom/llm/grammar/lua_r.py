"""Grammars and lexers of Lua and R."""

from __future__ import annotations

from codeloom.llm.grammar.lexers import _operators, _scan

LUA = """
file: block?
block: stat+ ret? | ret
ret: 'return' explist? ';'?
stat: ';' | targets '=' explist | call | '::' NAME '::' | 'break' | 'goto' NAME | 'do' block? 'end' | 'while' exp 'do' block? 'end' | 'repeat' block? 'until' exp | 'if' exp 'then' block? other* last? 'end' | 'for' NAME '=' exp ',' exp 'do' block? 'end' | 'for' NAME '=' exp ',' exp ',' exp 'do' block? 'end' | 'for' names 'in' explist 'do' block? 'end' | 'function' path body | 'function' path ':' NAME body | 'local' 'function' NAME body | 'local' attribs | 'local' attribs '=' explist
other: 'elseif' exp 'then' block?
last: 'else' block?
path: NAME ( '.' NAME )*
names: NAME ( ',' NAME )*
attribs: attrib ( ',' attrib )*
attrib: NAME | NAME '<' NAME '>'
targets: target ( ',' target )*
target: NAME | prefix '[' exp ']' | prefix '.' NAME
prefix: target | call | '(' exp ')'
call: prefix args | prefix ':' NAME args
args: '(' ')' | '(' explist ')' | table | STR
body: '(' ')' block? 'end' | '(' params ')' block? 'end'
params: names | names ',' '...' | '...'
explist: exp ( ',' exp )*
exp: term ( binary term )*
term: unary* simple
simple: 'nil' | 'true' | 'false' | NUM | STR | '...' | 'function' body | prefix | table
unary: '-' | 'not' | '#' | '~'
binary: '+' | '-' | '*' | '/' | '//' | '^' | '%' | '&' | '~' | '|' | '>>' | '<<' | '..' | '<' | '<=' | '>' | '>=' | '==' | '~=' | 'and' | 'or'
table: '{' '}' | '{' field ( separator field )* separator? '}'
separator: ',' | ';'
field: exp | NAME '=' exp | '[' exp ']' '=' exp
"""

R = """
file: sep* | sep* exp ( sep+ exp )* sep*
sep: ';' | NL
exp: term ( binary NL* term )*
term: unary* value
unary: '-' | '+' | '!' | '~' | '?'
binary: '+' | '-' | '*' | '/' | '^' | ':' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&' | '&&' | '|' | '||' | '~' | '<-' | '<<-' | '->' | '->>' | '=' | ':=' | '|>' | '?' | SPECIAL
value: atom post*
post: '(' args ')' | '[' args ']' | '[[' args ']]' | '$' part | '@' part | '::' part | ':::' part
part: NAME | STR | '(' exp ')' | 'next'
args: arg ( ',' arg )*
arg: NONE | exp | NAME '='
atom: NAME | NUM | STR | '(' exp ')' | '{' sep* '}' | '{' sep* exp ( sep+ exp )* sep* '}' | 'function' '(' params ')' NL* exp | '\\' '(' params ')' NL* exp | 'if' '(' exp ')' NL* exp | 'if' '(' exp ')' NL* exp 'else' NL* exp | 'for' '(' NAME 'in' exp ')' NL* exp | 'while' '(' exp ')' NL* exp | 'repeat' NL* exp | 'next' | 'break'
params: param ( ',' param )*
param: NONE | NAME | NAME '=' exp
"""

_LUA = [
    ("SPACE", r"\s+|--\[(?P<eq>=*)\[[\s\S]*?\](?P=eq)\]|--(?!\[=*\[)[^\n]*"),
    ("STR", r"\[(?P<level>=*)\[[\s\S]*?\](?P=level)\]|\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*'"),
    ("BAD", r"[\"']|\[=*\[|--\["),
    ("NUM", r"(?:0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)(?:[pP][+-]?\d+)?|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?!\w)"),
    ("WORD", r"[A-Za-z_]\w*"),
    ("OP", _operators("... .. :: // << >> <= >= == ~= + - * / % ^ # & ~ | < > = ( ) { } [ ] ; : , .")),
]
_LUA_KEYWORDS = frozenset(["and", "break", "do", "else", "elseif", "end", "false", "for", "function", "goto", "if", "in", "local", "nil", "not", "or", "repeat", "return", "then", "true", "until", "while"])
_R = [
    ("SPACE", r"[ \t\f\r]+|#[^\n]*"),
    ("NL", r"\n"),
    ("STR", r"[rR](?P<q>[\"'])(?P<d>-*)\([\s\S]*?\)(?P=d)(?P=q)|\"(?:\\[\s\S]|[^\"\\])*\"|'(?:\\[\s\S]|[^'\\])*'"),
    ("QUOTED", r"`(?:\\[\s\S]|[^`\\])*`"),
    ("BAD", r"[\"'`]"),
    ("NUM", r"(?:0[xX][0-9a-fA-F]+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[Li]?(?!\w)"),
    ("SPECIAL", r"%[^%\n]*%"),
    ("WORD", r"(?:[^\W\d_]|\.(?!\d))[\w.]*"),
    ("OP", _operators("<<- ->> ::: <- -> :: := |> <= >= == != && || + - * / ^ ! < > = & | ~ ? : $ @ ( ) { } [ ] , ; \\")),
]
_R_KEYWORDS = frozenset(["if", "else", "repeat", "while", "function", "for", "next", "break", "in"])


def lua_tokens(text: str) -> list[tuple]:
    if text.startswith("#"):  # a first line for the shell
        text = " " * (text.find("\n") if "\n" in text else len(text)) + text[text.find("\n") if "\n" in text else len(text) :]
    return [(kind, at, fresh) for kind, at, _, fresh in _scan(text, _LUA, _LUA_KEYWORDS)]


def r_tokens(text: str) -> list[tuple]:
    """Line ends count outside parentheses only, and not before an ``else`` in braces; ``[[`` pairs with ``]]``, and an
    argument that is left out is a token of its own."""
    out: list[tuple] = []
    open_: list[str] = []
    for kind, at, _, fresh in _scan(text, _R, _R_KEYWORDS):
        kind = "NAME" if kind == "QUOTED" else kind
        if kind == "NL" and open_ and open_[-1] != "{":
            continue
        last = out[-1][0] if out else ""
        if kind == "else" and open_ and open_[-1] == "{":
            while out and out[-1][0] == "NL":
                out.pop()
        if kind == "[" and last == "[" and out[-1][1] == at - 1 and len(out) > 1:
            out[-1] = ("[[", at - 1, fresh)
            open_[-1] = "[["
            continue
        if kind in ("]", ")", ",") and last in ("(", "[", "[[", ",") or kind in ("]", ")") and last == "=":
            out += [("NONE", at, fresh)] if last != "=" else []
        if kind in ("(", "[", "{"):
            open_.append(kind)
        elif kind in (")", "]", "}") and open_:
            if kind == "]" and open_[-1] == "[[":
                open_[-1] = "]"  # the second bracket is to follow
                continue
            if kind == "]" and open_[-1] == "]":
                kind = "]]"
            open_.pop()
        out.append((kind, at, fresh))
    return out
