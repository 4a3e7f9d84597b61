"""Token streams of the bundled languages: lists of (kind, position, on a new line).

A kind is a keyword or operator itself, or a class in capitals. Text that no token covers raises ``LexError``.
"""

from __future__ import annotations

import re


class LexError(Exception):
    def __init__(self, position: int, message: str):
        super().__init__(message)
        self.position, self.message = position, message


def _operators(text: str) -> str:
    return "|".join(re.escape(o) for o in sorted(text.split(), key=len, reverse=True))


_IDENT = r"[^\W\d]\w*"
_DSTR = r'"(?:\\[\s\S]|[^"\\\n])*"'
_SSTR = r"'(?:\\[\s\S]|[^'\\\n])*'"


def _scan(text: str, rules: list[tuple[str, str]], keywords: frozenset[str], names: str = "NAME", at: int = 0, formatted=None):
    """(kind, start, end, on a new line) with white space and comments left out. ``formatted`` gives the end of a string that
    holds expressions, which is told by its opening."""
    master = re.compile("|".join(f"(?P<{n}>{p})" for n, p in rules))
    fresh, n = True, len(text)
    match = master.match
    while at < n:
        m = match(text, at)
        if m is None or m.end() == at:
            raise LexError(at, f"unexpected {text[at]!r}")
        kind, at = m.lastgroup, m.end()
        if kind == "SPACE":
            fresh = fresh or "\n" in m.group()
            continue
        if kind == "BAD":
            raise LexError(m.start(), "unterminated literal or comment")
        word = m.group()
        if kind == "WORD":
            kind = word if word in keywords else names
        elif kind == "OP":
            kind = word
        elif kind == "FORMATTED":
            kind, at = "STR", formatted(m.start(), word)
        yield kind, m.start(), at, fresh
        fresh = False


def _fragments(parts: list[tuple[int, list[tuple]]]) -> list[tuple]:
    """Tokens of the expressions that stand inside strings and elements, to follow those of the text around them."""
    out: list[tuple] = []
    for at, tokens in parts:
        out += [("FRAGMENT", at, True), *tokens, ("FRAGMENT_END", tokens[-1][1] if tokens else at, False)]
    return out


# ------------------------------------------------------------------ Python

_PY_KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_PY = [
    ("SPACE", r"[ \t\f]+|\\\r?\n|#[^\n]*"),
    ("LINE", r"\r?\n|\r"),
    ("FORMATTED", r"""(?:[fFtT][rR]?|[rR][fFtT])(?:\"{3}|'{3}|["'])"""),
    ("STR", r'(?:[rRuUbB]|[rR][bB]|[bB][rR])?(?:"""(?:\\[\s\S]|[^\\])*?"""|\'\'\'(?:\\[\s\S]|[^\\])*?\'\'\'|"(?!"")(?:\\[\s\S]|[^"\\\n])*"|\'(?!\'\')(?:\\[\s\S]|[^\'\\\n])*\')'),
    ("BAD", r"[\"']"),
    ("NUM", r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?![\w])"),
    ("WORD", _IDENT),
    ("OP", _operators("** // >> << <= >= == != -> += -= *= /= //= %= @= &= |= ^= >>= <<= **= ... := + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; = !")),
]


def _formatted_end(text: str, begun: int, opening: str, parts: list) -> int:
    """End of the formatted string that ``opening`` begins; its expressions go to ``parts``."""
    quote = opening.lstrip("fFtTrR")
    at, n = begun + len(opening), len(text)
    while at < n:
        c = text[at]
        if c == "\\":
            name = text.startswith("\\N{", at) and len(opening) - len(quote) == 1
            at = max(text.find("}", at), at) + 1 if name else at + (1 if text[at + 1 : at + 2] in ("{", "}") else 2)
        elif text.startswith(quote, at):
            return at + len(quote)
        elif text.startswith(("{{", "}}"), at):
            at += 2
        elif c == "{":
            at = _field_end(text, at + 1, quote, parts)
        elif c == "}":
            raise LexError(at, "single '}' in a formatted string")
        elif c == "\n" and len(quote) == 1:
            break
        else:
            at += 1
    raise LexError(begun, "unterminated literal or comment")


def _field_end(text: str, begun: int, quote: str, parts: list) -> int:
    tokens: list[tuple] = []
    depth, at, n = 0, begun, len(text)
    for kind, a, b, _ in _scan(text, _PY, _PY_KEYWORDS, at=begun, formatted=lambda start, opening: _formatted_end(text, start, opening, parts)):
        at = b
        if kind == "LINE":
            continue
        if depth == 0 and kind in ("}", "!", ":", ":="):
            at = a
            break
        if depth == 0 and kind == "=" and re.compile(r"\s*[}!:]").match(text, b):
            continue
        depth += (kind in ("(", "[", "{")) - (kind in (")", "]", "}"))
        tokens.append((kind, a, False))
    if not tokens:
        raise LexError(begun, "empty expression in a formatted string")
    parts.append((begun, tokens))
    conversion = re.compile(r"!\s*[rsa]\s*(?=[:}])|(?=[:}])").match(text, at)
    if not conversion:
        raise LexError(min(at, n - 1), "formatted string: '}' expected")
    at = conversion.end()
    if text[at] == ":":
        at += 1
        while at < n and text[at] != "}":
            if text[at] == "{":
                at = _field_end(text, at + 1, quote, parts)
            elif text.startswith(quote, at):
                break
            else:
                at += 1
    if text[at : at + 1] != "}":
        raise LexError(min(at, n - 1), "formatted string: '}' expected")
    return at + 1


def python_tokens(text: str) -> list[tuple]:
    out: list[tuple] = []
    parts: list[tuple[int, list[tuple]]] = []
    indents, depth, start = [(0, 0)], 0, True
    opened: list[str] = []
    line_begin = True
    for kind, a, b, _ in _scan(text, _PY, _PY_KEYWORDS, formatted=lambda start, opening: _formatted_end(text, start, opening, parts)):
        if kind == "LINE":
            if depth == 0 and not start:
                out.append(("NEWLINE", a, True))
                start = True
            line_begin = True
            continue
        if depth == 0 and start and line_begin:
            head = text[text.rfind("\n", 0, a) + 1 : a]
            if head.strip("\ufeff \t\f"):
                head = ""
            head = head.rsplit("\f", 1)[-1]
            width = (len(head.expandtabs(8)), len(head.expandtabs(1)))
            if width[0] > indents[-1][0]:
                if width[1] <= indents[-1][1]:
                    raise LexError(a, "inconsistent use of tabs")
                indents.append(width)
                out.append(("INDENT", a, True))
            else:
                while width[0] < indents[-1][0]:
                    indents.pop()
                    out.append(("DEDENT", a, True))
                if width != indents[-1]:
                    raise LexError(a, "unindent matches no outer level")
        line_begin = False
        if kind in ("(", "[", "{"):
            opened.append(kind)
            depth += 1
        elif kind in (")", "]", "}"):
            if not opened or "([{".index(opened.pop()) != ")]}".index(kind):
                raise LexError(a, f"unmatched {kind!r}")
            depth -= 1
        if kind == "NAME" and start:
            word = text[a:b]
            if word in ("match", "case", "type"):
                rest = text[b : text.find("\n", b) if "\n" in text[b:] else len(text)]
                follows = rest.lstrip()
                if word == "type" and re.match(r"[^\W\d]\w*\s*(?:\[[^\]]*\])?\s*=", follows):
                    kind = "type"
                elif word != "type" and rest[:1] in " \t(['\"-" and not re.match(r"(?:=[^=]|[.,:)\]}]|[-+*/%@&|^]?=|(?:in|is|and|or|not|if)\b)", follows) and (re.search(r":\s*(?:#.*)?$", rest) or rest.rstrip().endswith(("(", "[", "{", ",")) or word == "case" and ":" in rest):
                    kind = word
        start = False
        out.append((kind, a, False))
    if depth:
        raise LexError(len(text), f"{opened[-1]!r} was never closed")
    if not start:
        out.append(("NEWLINE", len(text), True))
    out += [("DEDENT", len(text), True)] * (len(indents) - 1)
    return out + _fragments(parts)


# ------------------------------------------------------------------ JavaScript and TypeScript

_JS_KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with "
    "async await yield let static of get set from as".split()
)
_TS_KEYWORDS = _JS_KEYWORDS | frozenset("type interface namespace module declare abstract readonly public private protected implements keyof infer is satisfies asserts unique override accessor out global".split())
_JS_NUM = r"(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[bB][01](?:_?[01])*|0[oO]?[0-7](?:_?[0-7])*(?![\d.])|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)n?(?![\w$])"
_JS_OPS = _operators("{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << & | ^ ! ~ && || ?? ? : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => . ... ?. @")
_JS = re.compile(
    "|".join(
        f"(?P<{n}>{p})"
        for n, p in [
            ("SPACE", r"[\s\ufeff]+|//[^\n]*|/\*[\s\S]*?\*/"),
            ("BADC", r"/\*"),
            ("STR", _DSTR + "|" + _SSTR),
            ("BAD", r"[\"']"),
            ("NUM", _JS_NUM),
            ("PRIVATE", r"#[^\W\d][\w$]*|#\$[\w$]*"),
            ("WORD", r"(?:[^\W\d]|\$)[\w$]*"),
            ("OP", r"\?\.(?=\d)|" + _JS_OPS),
        ]
    )
)
_JS_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_JS_VALUE = frozenset("NAME NUM STR REGEX TEMPLATE PRIVATE JSX ) ] } this super true false null async of get set from as let static type namespace module declare abstract readonly is ++ --".split())
_JSX_TAG = re.compile(r"<(/?)\s*([\w$.:-]*)")


def _jsx_end(text: str, at: int, nested) -> int:
    """End of the JSX element that starts at ``at``; ``nested`` checks an embedded expression and returns its end."""
    depth, n = 0, len(text)
    while at < n:
        if text[at] == "{":
            at = nested(at)
            continue
        if text[at] != "<":
            at += 1
            continue
        tag = _JSX_TAG.match(text, at)
        closing, at = bool(tag.group(1)), tag.end()
        empty = False
        while at < n and text[at] != ">":
            if text[at] == "{":
                at = nested(at)
            elif text[at] in "\"'":
                end = text.find(text[at], at + 1)
                if end < 0:
                    raise LexError(at, "unterminated attribute")
                at = end + 1
            elif text.startswith("/>", at):
                empty = True
                at += 1
            elif text[at] == "<":
                raise LexError(at, "unexpected '<' in a tag")
            else:
                at += 1
        if at >= n:
            raise LexError(n, "unterminated tag")
        at += 1
        depth += 0 if empty else -1 if closing else 1
        if depth < 0:
            raise LexError(at, "closing tag without an opening one")
        if depth == 0:
            return at
    raise LexError(n, "unterminated element")


def script_tokens(text: str, typed: bool = False, jsx: bool = True) -> list[tuple]:
    keywords = _TS_KEYWORDS if typed else _JS_KEYWORDS
    out: list[tuple] = []
    start = len(text[: text.find("\n") + 1] or text) if text.startswith("#!") else 0
    parts: list[tuple[int, list[tuple]]] = []
    _script(text, start, out, keywords, jsx, "", parts)
    return out + _fragments(parts)


def _script(text: str, at: int, out: list, keywords: frozenset, jsx: bool, until: str, parts: list) -> int:
    """Appends tokens up to the brace that closes ``until`` (or to the end) and returns the position behind them; expressions
    inside elements go to ``parts``."""
    n, fresh, braces = len(text), True, 0
    match = _JS.match

    def nested(a: int) -> int:
        inner: list[tuple] = []
        end = _script(text, a + 1, inner, keywords, jsx, "{", parts)
        if inner:  # braces may hold nothing but a comment
            parts.append((a, inner))
        return end

    while at < n:
        m = match(text, at)
        if m is None:
            if text[at] == "`":
                at = _template(text, at, out, keywords, jsx, fresh, parts)
                fresh = False
                continue
            raise LexError(at, f"unexpected {text[at]!r}")
        kind = m.lastgroup
        if kind == "SPACE":
            fresh = fresh or "\n" in m.group()
            at = m.end()
            continue
        if kind in ("BAD", "BADC"):
            raise LexError(at, "unterminated literal or comment")
        word, a, at = m.group(), at, m.end()
        if kind == "OP":
            kind = word
            value = bool(out) and out[-1][0] in _JS_VALUE
            if word in ("/", "/=") and not value:
                regex = _JS_REGEX.match(text, a)
                if not regex:
                    raise LexError(a, "unterminated regular expression")
                kind, at = "REGEX", regex.end()
            elif word == "<" and jsx and not value and re.match(r"<(?:[A-Za-z_$>])", text[a : a + 2]):
                kind, at = "JSX", _jsx_end(text, a, nested)
            elif word in ("++", "--") and fresh and value:
                out.append((";", a, False))  # no line end may stand before a postfix operator
            elif word == "{":
                braces += 1
            elif word == "}":
                braces -= 1
                if braces < 0:
                    if until:
                        return at
                    raise LexError(a, "unmatched '}'")
        elif kind == "WORD":
            kind = word if word in keywords else "NAME"
        out.append((kind, a, fresh))
        fresh = False
    if until:
        raise LexError(n, "unterminated substitution")
    return n


def _template(text: str, at: int, out: list, keywords: frozenset, jsx: bool, fresh: bool, parts: list) -> int:
    begun = at
    at += 1
    parts = False
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            out.append(("TPL_END" if parts else "TEMPLATE", begun, fresh and not parts))
            return at + 1
        elif text.startswith("${", at):
            out.append(("TPL_MID" if parts else "TPL_START", begun, fresh and not parts))
            parts = True
            at = _script(text, at + 2, out, keywords, jsx, "{", parts)
        else:
            at += 1
    raise LexError(begun, "unterminated template")


# ------------------------------------------------------------------ Go, Java, C, C++

_GO_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GO = [
    ("SPACE", r"[ \t\r\n\ufeff]+|//[^\n]*|/\*[\s\S]*?\*/"),
    ("STR", _DSTR + r"|`[^`]*`"),
    ("CHAR", r"'(?:\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})|[^'\\\n])'"),
    ("BAD", r"[\"'`]|/\*"),
    ("NUM", r"(?:0[xX](?:_?[0-9a-fA-F])+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?)i?(?![\w])"),
    ("WORD", _IDENT),
    ("OP", _operators("+ - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- == < > = ! != <= >= := ... ( ) [ ] { } , ; . : ~")),
]
_GO_ENDS = frozenset("NAME NUM STR CHAR break continue fallthrough return ++ -- ) ] }".split())


def go_tokens(text: str) -> list[tuple]:
    out: list[tuple] = []
    end = 0
    for kind, a, b, _ in _scan(text, _GO, _GO_KEYWORDS):
        if out and out[-1][0] in _GO_ENDS and "\n" in text[end:a]:
            out.append((";", end, False))
        out.append((kind, a, False))
        end = b
    if out and out[-1][0] in _GO_ENDS:
        out.append((";", end, False))
    return out


_JAVA_KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null "
    "record sealed permits var yield".split()
)
_JAVA = [
    ("SPACE", r"[\s\ufeff]+|//[^\n]*|/\*[\s\S]*?\*/"),
    ("STR", r'"""[ \t]*\n(?:\\[\s\S]|[^\\])*?"""|"(?!"")(?:\\.|[^"\\\n])*"|""(?!")'),
    ("CHAR", r"'(?:\\(?:[btnfrs\\'\"]|[0-7]{1,3}|u+[0-9a-fA-F]{4})|[^'\\\n])'"),
    ("BAD", r"[\"']|/\*"),
    ("NUM", r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|(?:\d(?:_*\d)*\.?(?:\d(?:_*\d)*)?|\.\d(?:_*\d)*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w])"),
    ("WORD", r"(?:[^\W\d]|\$)[\w$]*"),
    ("OP", _operators("-> :: ... ++ -- == <= != && || += -= *= /= %= &= |= ^= <<= << @ ( ) { } [ ] ; , . = > < ! ~ ? : + - * / & | ^ %")),
]


def java_tokens(text: str) -> list[tuple]:
    return [(k, a, f) for k, a, _, f in _scan(text, _JAVA, _JAVA_KEYWORDS)]


_C_KEYWORDS = frozenset("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Alignas _Alignof _Atomic _Generic _Noreturn _Static_assert _Thread_local __attribute__ asm __asm__".split())
_CPP_KEYWORDS = (_C_KEYWORDS - {"restrict"}) | frozenset(
    "alignas alignof bool catch char8_t char16_t char32_t class concept const_cast consteval constexpr constinit co_await co_return co_yield decltype delete dynamic_cast explicit export false friend mutable namespace new noexcept nullptr operator private protected public reinterpret_cast requires static_assert static_cast template this thread_local throw true try typeid typename using virtual wchar_t final override".split()
)
_C_RULES = [
    ("SPACE", r"(?:\s|\\\r?\n|\ufeff)+|//(?:\\\r?\n|[^\n])*|/\*[\s\S]*?\*/"),
    ("STR", r'(?:u8|[uUL])?R"(?P<tag>[^()\\ \n]{0,16})\([\s\S]*?\)(?P=tag)"|(?:u8|[uUL])?' + r'"(?:\\[\s\S]|[^"\\\n])*"'),
    ("CHAR", r"(?:u8|[uUL])?'(?:\\(?:[abefnrtv\\'\"?]|[0-7]{1,3}|x[0-9a-fA-F]+|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})|[^'\\\n]){1,4}'"),
    ("BAD", r"[\"']|/\*"),
    ("NUM", r"(?:0[xX](?:'?[0-9a-fA-F])+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB](?:'?[01])+|(?:\d(?:'?\d)*\.?(?:\d(?:'?\d)*)?|\.\d(?:'?\d)*)(?:[eE][+-]?\d+)?)(?:_\w+|[uUlLfFzZ]*)(?![\w])"),
    ("WORD", _IDENT),
    ("OP", _operators("... <=> ->* -> ++ -- << <= == != && || += -= *= /= %= &= |= ^= <<= :: .* ( ) { } [ ] ; , . = > < ! ~ ? : + - * / & | ^ %") + r"|>>=|>="),
]
# Preprocessing directives.
_DIRECTIVES = frozenset("include include_next define undef if ifdef ifndef elif elifdef elifndef else endif error warning pragma line ident import".split())


def _preprocess(text: str) -> str:
    """Directives and the branches after the first of each conditional as blanks; unknown directives and open conditionals fail."""
    kept, hidden, at = [], [], 0
    in_comment = False
    joined = False
    for line in text.split("\n"):
        stripped = line.strip()
        if joined or (not in_comment and stripped.startswith("#")):
            if not joined:
                word = re.match(r"#\s*(\w*)", stripped).group(1)
                if word not in _DIRECTIVES and word:
                    raise LexError(at, f"unknown directive {word!r}")
                if word == "include" and not re.match(r"#\s*include\s*(?:<[^>]+>|\"[^\"]+\"|[A-Za-z_])", stripped):
                    raise LexError(at, "include without a file")
                if word == "define" and not re.match(r"#\s*define\s+[A-Za-z_]", stripped):
                    raise LexError(at, "define without a name")
                if word in ("if", "ifdef", "ifndef"):
                    hidden.append(bool(re.match(r"#\s*if\s+0\s*(?:$|/)", stripped)))
                elif word in ("elif", "else", "elifdef", "elifndef"):
                    if not hidden:
                        raise LexError(at, f"{word} without if")
                    hidden[-1] = not (hidden[-1] and word == "else")
                elif word == "endif":
                    if not hidden:
                        raise LexError(at, "endif without if")
                    hidden.pop()
            joined = line.endswith("\\")
            opens = re.sub(r'"(?:\\.|[^"\\])*"|//.*', "", line)
            in_comment = opens.rfind("/*") > opens.rfind("*/")
            kept.append(" " * (len(line) - 2) + line[opens.rfind("/*") :][:2] if in_comment and len(line) > 1 else " " * len(line))
        else:
            bare = re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])+\'', "", line) if not in_comment else line
            if not in_comment:
                bare = re.sub(r"//.*", "", bare)
            a, b = bare.rfind("/*"), bare.rfind("*/")
            in_comment = a > b if (a >= 0 or b >= 0) else in_comment
            kept.append(" " * len(line) if any(hidden) else line)
        at += len(line) + 1
    if hidden:
        raise LexError(len(text), "unterminated conditional")
    return "\n".join(kept)


def c_tokens(text: str) -> list[tuple]:
    return [(k, a, f) for k, a, _, f in _scan(_preprocess(text), _C_RULES, _C_KEYWORDS)]


_OPENS_ARGUMENTS = frozenset("NAME template static_cast dynamic_cast const_cast reinterpret_cast ] final override".split())
_AFTER_ARGUMENTS = frozenset("( :: { ) , ; > * & && ... [ ] = :".split())


def _closing_angle(tokens: list[tuple], at: int) -> int | None:
    """Number of the ``>`` that closes the argument list opened at ``at``, None if it is a comparison."""
    angles, rounds = 1, 0
    for j in range(at + 1, min(len(tokens), at + 400)):
        kind = tokens[j][0]
        if kind in ("(", "["):
            rounds += 1
        elif kind in (")", "]"):
            rounds -= 1
            if rounds < 0:
                return None
        elif rounds:
            continue
        elif kind in (";", "{", "}", "||", "==", "!=", "=>") or kind == "&&" and tokens[j + 1 : j + 2] and tokens[j + 1][0] not in (">", ",", "..."):
            return None
        elif kind == "<" and tokens[j - 1][0] in _OPENS_ARGUMENTS:
            angles += 1
        elif kind == ">":
            angles -= 1
            if not angles:
                return j
    return None


def cpp_tokens(text: str, names_may_follow: bool = True) -> list[tuple]:
    """Tokens with the angle brackets of template arguments as ``T<`` and ``T>``, told from comparisons by what they enclose
    and what follows; with ``names_may_follow``, also where a name follows."""
    tokens = [(k, a, f) for k, a, _, f in _scan(_preprocess(text), _C_RULES, _CPP_KEYWORDS)]
    for i, (kind, at, fresh) in enumerate(tokens):
        if kind == "<" and i and tokens[i - 1][0] in _OPENS_ARGUMENTS:
            j = _closing_angle(tokens, i)
            if j is None:
                continue
            after = tokens[j + 1][0] if j + 1 < len(tokens) else ";"
            sure = tokens[i - 1][0] not in ("NAME", "]", "final", "override")
            if sure or after in _AFTER_ARGUMENTS or names_may_follow and (after[0].isalpha() or after in ("~", "T>")):
                tokens[i] = ("T<", at, fresh)
                tokens[j] = ("T>", *tokens[j][1:])
    return tokens


# ------------------------------------------------------------------ JSON, SQL

_JSON = [
    ("SPACE", r"[ \t\r\n]+"),
    ("STR", r'"(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})|[^"\\\x00-\x1f])*"'),
    ("NUM", r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])"),
    ("WORD", r"[A-Za-z]+"),
    ("OP", r"[{}\[\],:]"),
]


def json_tokens(text: str) -> list[tuple]:
    return [(k, a, f) for k, a, _, f in _scan(text, _JSON, frozenset(("true", "false", "null")))]


_SQL_KEYWORDS = frozenset(
    "select from where group by having order limit offset fetch union intersect except all distinct as on using join inner left right full outer cross natural lateral and or not in is null like ilike between exists case when then else end asc desc nulls first last with recursive values insert into update set delete create replace temporary temp table view index unique primary key foreign references check default constraint drop alter add column if cast over partition rows range returning begin commit rollback true false escape window filter within cascade truncate grant revoke to analyze explain interval collate".split()
)
_SQL = [
    ("SPACE", r"[\s\ufeff]+|--[^\n]*|/\*[\s\S]*?\*/"),
    ("STR", r"(?:[eEbBxXnN])?'(?:''|[^'])*'|\$(?P<tag>\w*)\$[\s\S]*?\$(?P=tag)\$"),
    ("QUOTED", r'"(?:""|[^"])+"|`[^`]+`'),
    ("BAD", r"[\"'`]|/\*"),
    ("NUM", r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w])"),
    ("PARAM", r"[:@$?]\w+|\?"),
    ("WORD", _IDENT),
    ("OP", _operators(":: <= >= <> != || -> ->> => << >> ~* !~ ~ ( ) [ ] , ; . = < > + - * / % ^ & | #")),
]


def sql_tokens(text: str) -> list[tuple]:
    out = []
    for kind, a, b, fresh in _scan(text, _SQL, frozenset()):
        word = text[a:b].lower()
        out.append((word if kind == "NAME" and word in _SQL_KEYWORDS else "NAME" if kind == "QUOTED" else kind, a, fresh))
    return out


# ------------------------------------------------------------------ shell

_SH_RESERVED = frozenset("if then else elif fi for while until do done case esac in function select time { } ! [[ ]]".split())
_SH_PLAIN = re.compile(r"[^\s;&|<>()'\"`\\$]+")
_SH_OP = re.compile(r"&&|\|\||;;&?|;&|&>>?|<<-|<<<|<<|>>|>&|<&|<>|>\||\|&|[;&|<>()]")


def _sh_part(text: str, at: int, parts: list, quoted: bool) -> int:
    """End of what a dollar sign or backquote begins at ``at``; the commands in it go to ``parts``."""
    if text[at] == "`":
        end = re.compile(r"`((?:\\[\s\S]|[^`\\])*)`").match(text, at)
        if not end:
            raise LexError(at, "unterminated quotation")
        if "\\" not in end.group():
            parts.append((at, _shell(text[: end.end() - 1], at + 1, parts, False)[0]))
        return end.end()
    if text.startswith("$((", at):
        depth = 0
        for m in re.compile(r"[()]").finditer(text, at):
            depth += 1 if m.group() == "(" else -1
            if depth == 1 and m.group() == ")" and text.startswith("))", m.start()):
                return m.start() + 2
            if depth == 0:
                break
    if text.startswith("$(", at):
        tokens, end = _shell(text, at + 2, parts, True)
        parts.append((at, tokens))
        return end
    if text.startswith("${", at):
        begun, at = at, at + 2
        while at < len(text):
            c = text[at]
            if c == "}":
                return at + 1
            if c == "\\":
                at += 2
            elif c == '"' or c == "'" and not quoted:
                at = _sh_quoted(text, at, parts)
            elif c == "`" or c == "$" and text[at + 1 : at + 2] in ("(", "{"):
                at = _sh_part(text, at, parts, quoted)
            else:
                at += 1
        raise LexError(begun, "'${' is not closed")
    return at + 1


def _sh_quoted(text: str, at: int, parts: list) -> int:
    begun, n = at, len(text)
    if text[at] == "'":
        end = text.find("'", at + 1)
        if end < 0:
            raise LexError(begun, "unterminated quotation")
        return end + 1
    at += 1
    while at < n:
        c = text[at]
        if c == '"':
            return at + 1
        at = at + 2 if c == "\\" else _sh_part(text, at, parts, True) if c in "$`" else at + 1
    raise LexError(begun, "unterminated quotation")


def _sh_word(text: str, at: int, parts: list) -> int:
    begun, n = at, len(text)
    while at < n:
        c = text[at]
        plain = _SH_PLAIN.match(text, at)
        if plain:
            at = plain.end()
        elif c == "\\":
            at = min(at + 2, n)
        elif text.startswith("$'", at):
            end = re.compile(r"\$'(?:\\[\s\S]|[^'\\])*'").match(text, at)
            if not end:
                raise LexError(at, "unterminated quotation")
            at = end.end()
        elif c in "'\"":
            at = _sh_quoted(text, at, parts)
        elif c in "$`":
            at = _sh_part(text, at, parts, False)
        elif c in "<>" and text.startswith("(", at + 1):
            tokens, end = _shell(text, at + 2, parts, True)
            parts.append((at, tokens))
            at = end
        else:
            break
    if at == begun:
        raise LexError(at, "unterminated quotation")
    return at


def shell_tokens(text: str) -> list[tuple]:
    parts: list[tuple[int, list[tuple]]] = []
    return _shell(text, 0, parts, False)[0] + _fragments(parts)


def _shell(text: str, at: int, parts: list, inside: bool) -> tuple[list[tuple], int]:
    """Tokens, and the end of the text or, ``inside`` a substitution, the place behind its closing parenthesis."""
    out: list[tuple] = []
    begun, n, documents = at, len(text), []
    depth = 0
    command = True  # a reserved word is one only where a command may start

    def put(kind: str, a: int) -> None:
        out.append((kind, a, False))

    while at < n:
        c = text[at]
        if c in " \t\r" or text.startswith("\\\n", at):
            at += 1 if c != "\\" else 2
        elif c == "#":
            at = text.find("\n", at)
            at = n if at < 0 else at
        elif c == "\n":
            put("NL", at)
            at += 1
            command = True
            for tag, strip in documents:
                while True:
                    if at >= n:
                        raise LexError(n, f"here-document {tag!r} is not closed")
                    end = text.find("\n", at)
                    end = n if end < 0 else end
                    line = text[at:end]
                    at = min(n, end + 1)
                    if (line.lstrip("\t") if strip else line) == tag:
                        break
            documents.clear()
        elif text.startswith("((", at) and command:
            end = text.find("))", at)
            if end < 0:
                raise LexError(at, "'((' is not closed")
            put("WORD", at)
            at, command = end + 2, False
        else:
            op = _SH_OP.match(text, at) if not re.match(r"[<>]\(", text[at : at + 2]) else None
            if op:
                kind = op.group()
                at = op.end()
                if kind in ("<<", "<<-"):
                    tag = re.compile(r"[ \t]*(?:'([^'\n]*)'|\"([^\"\n]*)\"|\\?([^\s;&|<>()]+))").match(text, at)
                    if not tag:
                        raise LexError(at, "here-document without a word")
                    documents.append((next(g for g in tag.groups() if g is not None), kind == "<<-"))
                    at = tag.end()
                    put("HEREDOC", op.start())
                    continue
                if kind in ("<", ">", ">>", ">&", "<&", "<>", ">|", "&>", "&>>", "<<<"):
                    put("REDIR", op.start())
                else:
                    if inside and kind == ")" and depth == 0:
                        cases = sum((k == "case") - (k == "esac") for k, _, _ in out)
                        if not cases:
                            return out, at
                    elif kind in ("(", ")"):
                        depth = max(0, depth + (1 if kind == "(" else -1))
                    put(kind, op.start())
                    command = kind != ")"
                    if kind == ")":
                        command = True
                continue
            a, at = at, _sh_word(text, at, parts)
            value = text[a:at]
            if re.fullmatch(r"\d+", value) and at < n and text[at] in "<>":
                continue
            before = out[-1][0] if out else "NL"
            two = out[-2][0] if len(out) > 1 else ""
            if value == "[[" and command:
                end = re.compile(r"(?s).*?\s\]\](?=[\s;&|)]|$)").match(text, at)
                if not end:
                    raise LexError(a, "'[[' is not closed")
                put("WORD", a)
                at, command = end.end(), False
            elif value in _SH_RESERVED and (command or value == "in" and two in ("for", "case", "select") or value == "do" and before in ("WORD",) and two in ("for", "select") or value == "}" and before in (";", "NL", "&")):
                put(value, a)
                command = value not in ("for", "case", "in", "function", "select")
                if before == "WORD" and value == "in":
                    command = two == "case" and False
            elif re.fullmatch(r"[A-Za-z_]\w*\+?=(?:.|\n)*", value) and command:
                put("ASSIGN", a)
                if value.endswith("=") and at < n and text[at] == "(":
                    depth, k = 0, at
                    while k < n:
                        depth += (text[k] == "(") - (text[k] == ")")
                        k += 1
                        if not depth:
                            break
                    if depth:
                        raise LexError(at, "array is not closed")
                    at = k
            else:
                put("WORD", a)
                command = before == "function"
    if documents:
        raise LexError(n, f"here-document {documents[0][0]!r} is not closed")
    if inside:
        raise LexError(begun, "'(' is not closed")
    return out, at


# ------------------------------------------------------------------ YAML

_YAML_KEY = re.compile(r"""(?:"(?:\\.|[^"\\\n])*"|'(?:''|[^'\n])*'|(?![-?:](?:\s|$))[^\s#&*!|>'"%@`{}\[\],][^\n]*?)\s*:(?=\s|$)""")
_YAML_SCALAR = re.compile(r"(?![-?:](?:\s|$))[^\s#&*!|>'\"%@`{}\[\],]")


def yaml_tokens(text: str) -> list[tuple]:
    """Block structure as INDENT and DEDENT around the nodes of a deeper level; flow collections are checked by bracket."""
    out: list[tuple] = []
    levels = [-1]
    lines = text.split("\n")
    offsets = [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line) + 1)
    i = 0

    def close(to: int, at: int) -> None:
        while levels[-1] > to:
            levels.pop()
            out.append(("DEDENT", at, True))

    def flow(start_line: int, column: int) -> tuple[int, int]:
        stack: list[str] = []
        row, col = start_line, column
        while row < len(lines):
            line = lines[row]
            while col < len(line):
                c = line[col]
                if c in "\"'":
                    end = re.compile(r'"(?:\\.|[^"\\])*"' if c == '"' else r"'(?:''|[^'])*'", re.S).match("\n".join(lines[row:]), col)
                    if not end:
                        raise LexError(offsets[row] + col, "unterminated scalar")
                    inside = end.group()
                    skipped = inside.count("\n")
                    col = end.end() if not skipped else len(inside) - inside.rfind("\n") - 1
                    row += skipped
                    line = lines[row]
                    continue
                if c == "#" and (col == 0 or line[col - 1] in " \t"):
                    break
                if c in "{[":
                    stack.append(c)
                elif c in "}]":
                    if not stack or "{[".index(stack.pop()) != "}]".index(c):
                        raise LexError(offsets[row] + col, f"unmatched {c!r}")
                    if not stack:
                        return row, col + 1
                col += 1
            row, col = row + 1, 0
        raise LexError(offsets[start_line] + column, "flow collection is not closed")

    def scalar(row: int, col: int, parent: int, plain_more: bool) -> int:
        """Checks the node that starts at (row, col) and returns the row of its last line."""
        line = lines[row]
        m = re.compile(r"(?:[&!][^\s]*\s*)+").match(line, col)
        if m:
            col = m.end()
        if col >= len(line.rstrip()) or line[col] == "#":
            return row
        c = line[col]
        if c == "*":
            if not re.compile(r"\*[^\s,\[\]{}]+\s*(?:#.*)?$").match(line, col):
                raise LexError(offsets[row] + col, "text after an alias")
            return row
        if c in "|>":
            if not re.compile(r"[|>][-+0-9]{0,2}\s*(?:\s#.*)?$").match(line, col):
                raise LexError(offsets[row] + col, "text after a block scalar's mark")
            last = row
            for r in range(row + 1, len(lines)):
                if lines[r].strip() and len(lines[r]) - len(lines[r].lstrip(" ")) <= parent:
                    break
                last = r
            return last
        if c in "{[":
            r, k = flow(row, col)
            if lines[r][k:].strip() and not lines[r][k:].lstrip().startswith("#"):
                raise LexError(offsets[r] + k, "text after a flow collection")
            return r
        if c in "\"'":
            rest = "\n".join(lines[row:])
            end = re.compile(r'"(?:\\[\s\S]|[^"\\])*"' if c == '"' else r"'(?:''|[^'])*'").match(rest, col)
            if not end:
                raise LexError(offsets[row] + col, "unterminated scalar")
            r = row + end.group().count("\n")
            k = end.end() if r == row else len(end.group()) - end.group().rfind("\n") - 1
            if lines[r][k:].strip() and not re.match(r"\s+#", lines[r][k:]):
                raise LexError(offsets[r] + k, "text after a quoted scalar")
            return r
        if not _YAML_SCALAR.match(line, col) and not re.match(r"[-?:]\S", line[col : col + 2]):
            raise LexError(offsets[row] + col, f"a scalar can't start with {c!r}")
        if re.search(r":(\s|$)", re.sub(r"\s#.*", "", line[col:])):
            raise LexError(offsets[row] + col, "a mapping can't stand here")
        last = row
        if plain_more:
            for r in range(row + 1, len(lines)):
                body = lines[r].strip()
                if not body:
                    continue
                if len(lines[r]) - len(lines[r].lstrip(" ")) <= parent or body.startswith("#") or re.match(r"(---|\.\.\.)(\s|$)", lines[r]):
                    break
                if re.search(r":(\s|$)", re.sub(r"\s#.*", "", body)):
                    raise LexError(offsets[r], "a mapping can't stand here")
                last = r
        return last

    while i < len(lines):
        line = lines[i]
        body = line.strip()
        if not body or body.startswith("#") or body.startswith("%") and not out:
            i += 1
            continue
        if re.match(r"(---|\.\.\.)(\s|$)", line):
            close(-1, offsets[i])
            out.append(("DOC", offsets[i], True))
            rest = line[3:].strip()
            if rest and not rest.startswith("#"):
                i = scalar(i, line.index(rest), -1, True)
                out.append(("NODE", offsets[i], True))
            i += 1
            continue
        lead = len(line) - len(line.lstrip(" "))
        if line[lead] == "\t":
            raise LexError(offsets[i] + lead, "a tab can't indent")
        col = lead
        while True:
            close(col, offsets[i])
            if levels[-1] < col:
                levels.append(col)
                out.append(("INDENT", offsets[i] + col, True))
            if re.match(r"-(\s|$)", line[col:]):
                out.append(("DASH", offsets[i] + col, True))
                rest = line[col + 1 :]
                if not rest.strip() or rest.lstrip().startswith("#"):
                    i += 1
                    break
                col += 1 + len(rest) - len(rest.lstrip(" "))
                key = _YAML_KEY.match(line, col)
                if key or re.match(r"[-?](\s|$)", line[col:]):
                    continue
                i = scalar(i, col, levels[-1], True) + 1
                out.append(("NODE", offsets[i - 1], True))
                break
            if re.match(r"\?\s", line[col:]):
                out.append(("KEY", offsets[i] + col, True))
                i = scalar(i, col + 2, levels[-1], True) + 1
                break
            key = _YAML_KEY.match(line, col)
            if key:
                out.append(("KEY", offsets[i] + col, True))
                rest = line[key.end() :]
                if rest.strip() and not rest.lstrip().startswith("#"):
                    start = key.end() + len(rest) - len(rest.lstrip())
                    anchors = re.fullmatch(r"\s*(?:[&!]\S*\s*)+(?:#.*)?", rest)
                    if not anchors:
                        i = scalar(i, start, levels[-1], True)
                        out.append(("NODE", offsets[i], True))
                i += 1
                break
            i = scalar(i, col, levels[-2] if len(levels) > 1 else -1, True) + 1
            out.append(("NODE", offsets[i - 1], True))
            break
    close(-1, len(text))
    return out
