"""Grammar and lexer of Ruby. A line end may end a statement or not: both readings are followed."""

from __future__ import annotations

import copy
import re

from codeloom.llm.grammar.lexers import LexError, _operators
from codeloom.llm.grammar.scanning import Lexis, Quote

_KEYWORDS = "alias and begin BEGIN break case class def defined? do else elsif end END ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield"

RUBY = """
file: stmts?
stmts: ';'+ | ';'* stmt ( ';'+ stmt )* ';'*
then: ';' | 'then' | ';' 'then'
stmt: line | stmt ( 'if_mod' | 'unless_mod' | 'while_mod' | 'until_mod' | 'rescue_mod' ) line | 'alias' fitem fitem | 'undef' fitem ( ',' fitem )* | ( 'BEGIN' | 'END' ) '{' stmts? '}' | multi
fitem: NAME | SYM | VAR | symbol
multi: left ',' '=' right | left ( ',' left )* '=' right
left: postfix | '*' postfix | '*' | '(' left ( ',' left )+ ','? ')' | '(' '*' postfix ')'
right: arg ( ',' arg )* | command | multi
arg: expr | '*' expr
line: one | line ( 'and' | 'or' ) one
one: 'not' one | expr | command | '!' command | expr '=>' pattern | expr 'in' pattern
command: head cargs | chain assign command | chain assign expr 'rescue_mod' expr
head: NAME | postfix dot NAME | 'super' | 'yield' | 'return' | 'break' | 'next' | 'defined?'
cargs: carg ( ',' carg )* ( ',' command )? | command
carg: expr | '*' expr | '**' expr | '&' expr | '*' | '**' | '&' | '...' | LABEL | LABEL expr | string LCOL expr | expr '=>' expr | LABEL command
args: carg ( ',' carg )* ','? | command | carg ( ',' carg )* ',' command
pairs: pair ( ',' pair )* ','?
pair: LABEL | LABEL expr | string LCOL expr | expr '=>' expr | '**' expr | '**'
expr: chain | chain '?' expr ':' expr | chain '?' LABEL expr | chain '?' expr SYM
chain: unary | chain binop unary | chain assign unary | chain ( '..' | '...' ) | ( '..' | '...' ) unary
assign: '=' | ASSIGN
binop: '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '=~' | '!~' | '<=>' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>>' | '..' | '...'
unary: ( '-' | '+' | '!' | '~' | 'defined?' ) unary | postfix
dot: '.' | '&.' | '::'
postfix: primary | postfix '(' args? ')' | postfix '[' args? ']' | postfix dot NAME | postfix dot '(' args? ')' | postfix block
block: '{' bars? stmts? '}' | 'do' bars? stmts? rescues? 'end'
bars: '||' | '|' '|' | '|' params ( ';' NAME ( ',' NAME )* )? '|' | '|' ';' NAME ( ',' NAME )* '|'
params: param ( ',' param )* ','?
param: NAME | NAME '=' expr | '*' NAME? | '**' NAME? | '**' 'nil' | '&' NAME? | LABEL | LABEL expr | '(' params ')' | '...'
symbol: SYMTPL inside? TPL_END
string: part+
part: STR | TPL inside? TPL_END
inside: stmts ( TPL_MID stmts? )* | ( TPL_MID stmts? )+
literal: NUM | string | SYM | symbol | 'self' | 'nil' | 'true' | 'false' | VAR
primary: literal | NAME | '::' NAME | '(' stmts? ')' | '[' args? ']' | '{' pairs? '}' | '->' ( params | '(' params? ( ';' NAME ( ',' NAME )* )? ')' )? ( '{' stmts? '}' | 'do' stmts? rescues? 'end' )
    | ( 'if' | 'unless' ) line then stmts? elsif* otherwise? 'end' | ( 'while' | 'until' ) line loop stmts? 'end' | 'for' left ( ',' left )* 'in' line loop stmts? 'end'
    | 'case' line? ';'* when+ otherwise? 'end' | 'case' line ';'* in+ otherwise? 'end' | 'begin' stmts? rescues? 'end' | definition
    | 'class' cpath stmts? rescues? 'end' | 'class' cpath '<' expr ';' stmts? rescues? 'end' | 'class' '<<' expr ';' stmts? rescues? 'end' | 'module' cpath stmts? 'end'
    | 'yield' | 'super' | 'return' | 'break' | 'next' | 'redo' | 'retry' | 'defined?' '(' line ')' | 'not' '(' line? ')'
loop: 'do_loop' | ';' | ';' 'do_loop'
elsif: 'elsif' line then stmts?
otherwise: 'else' stmts?
when: 'when' arg ( ',' arg )* then stmts?
in: 'in' pattern ( ( 'if' | 'unless' | 'if_mod' | 'unless_mod' ) line )? then stmts?
rescues: rescue+ otherwise? ensure? | otherwise? ensure
rescue: 'rescue' ( arg ( ',' arg )* )? ( '=>' postfix )? then stmts?
ensure: 'ensure' stmts?
cpath: '::'? NAME ( '::' NAME )* | postfix '::' NAME
definition: 'def' dname ( '(' params? ')' ) stmts? rescues? 'end' | 'def' dname params? ';' stmts? rescues? 'end' | 'def' dname rescues 'end' | 'def' dname 'end' | 'def' dname ( '(' params? ')' )? '=' ( expr | command )
dname: NAME | owner ( '.' | '::' ) NAME
owner: 'self' | NAME | VAR | '(' expr ')'
pattern: pats | keys
pats: pat ( ',' pat )* ','?
keys: key ( ',' key )* ','?
key: LABEL | LABEL pat | string LCOL pat? | '**' NAME | '**' 'nil'
pat: alt | alt '=>' NAME
alt: value | alt '|' value
value: '-'? literal | range | '->' '{' stmts? '}' | const | const '(' pattern? ')' | const '[' pattern? ']' | '[' pats? ']' | '{' keys? '}' | '^' NAME | '^' VAR | '^' '(' expr ')' | '*' NAME? | '(' pat ')'
const: '::'? NAME ( '::' NAME )*
range: end ( '..' | '...' ) end? | ( '..' | '...' ) end
end: '-'? literal | const
"""

_INSIDE = {"(": ")", "[": "]", "{": "}", "<": ">"}
_LEXIS = Lexis(
    r"[ \t\r\n\f\v﻿]+|\\\r?\n|^=begin\b[\s\S]*?^=end\b[^\n]*|#[^\n]*",
    (Quote('"', '"', lines=True, opens="#{"), Quote("'", "'", lines=True), Quote("`", "`", lines=True, opens="#{")),
    [
        ("NUM", r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+(?![\d.])|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?)(?:ri?|i)?(?!\w)"),
        ("VAR", r"@@?[^\W\d]\w*|\$(?:[^\W\d]\w*|-\w|\d+|[!@&`'+~=/\\,;.<>_*$?:\"])"),
        ("SYM", r":(?:[^\W\d]\w*(?:[?!](?!=)|=(?![=~>]))?|@@?[^\W\d]\w*|\$\w+|\[\]=?|\*\*|<=>|===?|=~|![=~]?|<<|>>|<=|>=|[+-]@|[+\-*/%<>~^&|`](?![=]))(?<!::)"),
        ("LABEL", r"[^\W\d]\w*[?!]?:(?!:)"),
        ("WORD", r"defined\?|[^\W\d]\w*(?:[?!](?![=~])|[?!](?===|=~|=>))?"),
        ("ASSIGN", r"(?:\+|-|\*\*?|/|%|&&?|\|\|?|\^|<<|>>)=(?![=~>])"),
        ("OP", _operators("... .. :: -> => === == =~ != !~ <=> <= >= << >> && || &. ** + - * / % ^ ! & | = < > . , ; : ? ~ ( ) [ ] { }")),
    ],
    _KEYWORDS,
    blocks=False,
)
_VALUES = frozenset("NAME NUM STR TPL_END VAR SYM ) ] } end self nil true false".split())
_MODIFIERS = frozenset("if unless while until rescue".split())
_MODIFIED = _VALUES | frozenset("return break next redo retry super yield".split())
_DEF_NAME = re.compile(r"(?:[^\W\d]\w*(?:[?!](?!=)|=(?=[(])|=(?=[ \t]+\w+[ \t]*(?:\n|;))|=(?=\w))?|\[\]=?|\*\*|<=>|===?|=~|![=~]?|<<|>>|<=|>=|[+\-!~]@|[+\-*/%<>~^&|`])")
_PERCENT = re.compile(r"%([qQwWiIrsx]?)([^\w\s])")
_HEREDOC = re.compile(r"<<([~-]?)(?:([\"'`])([^\n]+?)\2|([^\W\d]\w*))")
_REGEX = Quote("/", "/", lines=True, opens="#{")


def ruby_tokens(text: str) -> list[tuple]:
    """Regular expressions, heredocs, labels and names that are keywords elsewhere are told by what stands before them; the
    ``do`` of a loop and the ``if`` behind a statement are tokens of their own."""
    end = re.search(r"^__END__\r?$", text, re.M)
    if end:
        text = text[: end.start()]
    bodies: dict[int, int] = {}  # line end: where the bodies of its heredocs end

    def follow(out: list) -> None:
        """Tells the ``do`` of loops, and conditions behind a statement from those that begin one."""
        depth = 0
        loops: list[int] = []
        for seen, (kind, at, fresh) in enumerate(out):
            if loops and fresh and loops[-1] == depth and seen and out[seen - 1][0] in _VALUES | {";"}:
                loops.pop()
            if kind in _MODIFIERS and not fresh and seen and out[seen - 1][0] in _MODIFIED:
                out[seen] = (kind + "_mod", at, fresh)
            elif kind in ("while", "until", "for"):
                loops.append(depth)
            elif kind in ("(", "[", "{", "TPL", "SYMTPL"):
                depth += 1
            elif kind in (")", "]", "}", "TPL_END"):
                depth -= 1
                while loops and loops[-1] > depth:
                    loops.pop()
            elif kind == ";" and loops and loops[-1] == depth:
                loops.pop()
            elif kind == "do" and loops and loops[-1] == depth:
                loops.pop()
                out[seen] = ("do_loop", at, fresh)

    def extra(lexis: Lexis, text: str, at: int, out: list, fresh: bool):
        c = text[at]
        last = out[-1][0] if out else ""
        if c == "\n":
            return (None, bodies[at]) if at in bodies else (None, at + 1)
        if c in " \t\r":
            return None if not bodies else ("" if not fresh else None, at + 1)
        if c == "#" and bodies:  # a comment may hide the end of a line with heredocs
            stop = text.find("\n", at)
            return (None if fresh else "", len(text) if stop < 0 else stop)
        spaced = at > 0 and text[at - 1] in " \t\n"
        tight = at + 1 < len(text) and text[at + 1] not in " \t\r\n="
        free = last not in _VALUES or fresh
        argument = free or last == "NAME" and spaced and tight
        named = last in (".", "&.") or last == "::" and not (c.isupper() and spaced)
        if last == "def" or named and len(out) > 2 and out[-3][0] == "def" or last in ("alias", "undef") or len(out) > 1 and out[-2][0] == "alias":
            m = _DEF_NAME.match(text, at)
            if m and not (m.group() == "self" and text.startswith(".", m.end())) and not (last == "def" and text[m.end() : m.end() + 1] == "."):
                return "NAME", m.end()
        if named:
            m = re.compile(r"[^\W\d]\w*[?!]?(?!=[^=~>])|[^\W\d]\w*|\[\]=?(?=\()|!(?![=~])|(?:[+\-*/%<>&|^]|==|<=>|<<|>>|<=|>=|\*\*|=~)(?=\()").match(text, at)
            if m:
                return "NAME", m.end()
        if c == "/" and argument:
            at = lexis.string(text, at, _REGEX, re.compile("/").match(text, at), out, fresh)
            while at < len(text) and text[at] in "mixounse":
                at += 1
            return "", at
        if c == "%" and argument:
            m = _PERCENT.match(text, at) or free and re.compile("%()( )").match(text, at)
            if m and (m.group(2) not in "=" or free):
                kind, opening = m.groups()
                close = _INSIDE.get(opening, opening)
                quote = Quote("", close, lines=True, opens="#{" if kind in ("", "Q", "W", "I", "r", "x") else "", nests=opening if close != opening else "")
                at = lexis.string(text, at, quote, m, out, fresh)
                while kind == "r" and at < len(text) and text[at] in "mixounse":
                    at += 1
                return "", at
        if c == "?" and (free or argument and re.compile(r"\?\w\s*(?:$|[,).])", re.M).match(text, at)):
            m = re.compile(r"\?(?:\\(?:u\{?\w+\}?|[CM]-.|[\s\S])|\S)(?!\w)").match(text, at)
            if m:
                return "STR", m.end()
        if c == "<" and (argument or text.startswith("<<~", at)) and last != "class":
            m = _HEREDOC.match(text, at)
            if m:
                line = text.find("\n", at)
                tag = m.group(3) or m.group(4)
                if line < 0:
                    raise LexError(at, "unterminated literal or comment")
                begin = bodies.get(line, line + 1)
                stop = re.compile(rf"^{'[ \t]*' if m.group(1) else ''}{re.escape(tag)}\r?$", re.M).search(text, begin)
                if not stop:
                    raise LexError(at, "unterminated literal or comment")
                bodies[line] = stop.end() if stop.end() >= len(text) else stop.end()
                if m.group(2) == "'":
                    return "STR", m.end()
                body = text[: stop.start()] + "\0"
                lexis.string(body, begin, Quote("", "\0", lines=True, opens="#{"), re.compile("").match(body, begin), out, fresh)
                return "", m.end()
        if c in "\"'":
            before = last
            size = len(out)
            quote = lexis.quotes[0 if c == '"' else 1]
            stop = lexis.string(text, at, quote, re.compile(c).match(text, at), out, fresh)
            if text.startswith(":", stop) and not text.startswith("::", stop) and before in ("{", ",", "(", "|", "NAME"):
                out.append(("LCOL", stop, False))
                stop += 1
            elif len(out) == size:
                return None
            return "", stop
        if c == ":" and text[at + 1 : at + 2] in ('"', "'") and (last != "?" and (free or spaced) or last == "("):
            q = lexis.quotes[0 if text[at + 1] == '"' else 1]
            size = len(out)
            stop = lexis.string(text, at + 1, q, re.compile("[\"']").match(text, at + 1), out, fresh)
            kind, begun, new = out[size]
            out[size] = ("SYM" if kind == "STR" else "SYMTPL", begun, new)
            return "", stop
        if c == ":" and last in _VALUES and not spaced and not text.startswith("::", at):
            return ":", at + 1
        if c == "\\" and text[at + 1 : at + 3].startswith(("\n", "\r\n")):
            return "", text.index("\n", at) + 1
        if c.isalpha() or c == "_":  # a name before the colon of a conditional is no label
            m = re.compile(r"([^\W\d]\w*[?!]?):(?!:)").match(text, at)
            if m and last == "?" and text[m.end() : m.end() + 1] not in (" ", "\n"):
                return ("NAME" if m.group(1) not in lexis.keywords else m.group(1)), m.end(1)
        return None

    lexis = copy.copy(_LEXIS)
    lexis.extra = extra
    out: list[tuple] = []
    lexis.scan(text, 0, out, "")
    follow(out)
    return out
