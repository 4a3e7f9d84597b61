"""Definitions and references of JavaScript, TypeScript, Go, Java, C and C++ by a scanner of braces.

Comments and strings are blanked first, so nothing inside them counts; blocks are matched by their braces, and the text
before each opening brace decides what the block is. Approximate where only a full grammar would know (macros, for example).
"""

from __future__ import annotations

import re
from bisect import bisect_right

_SKIP = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`")
_SKIP_SCRIPT = re.compile(_SKIP.pattern + r"|(?:(?<=[=(,:;!&|?\[])|(?<=[=(,:;!&|?\[] )|(?<=return ))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_CONTROL = frozenset("if for while switch catch do else try finally synchronized return throw new case select with function".split())
_CLASS = {
    "javascript": re.compile(r"\bclass\s+(?P<name>[\w$]+)(?:\s+extends\s+(?P<bases>[\w$.]+))?[^{};]*$"),
    "typescript": re.compile(r"\bclass\s+(?P<name>[\w$]+)(?:<[^{}]*?>)?(?:\s+extends\s+(?P<bases>[\w$.]+)(?:<[^{}]*?>)?)?(?:\s+implements\s+(?P<more>[^{};]+))?\s*$"),
    "java": re.compile(r"\b(?:class|interface|enum|record)\s+(?P<name>\w+)(?:<[^{}]*?>)?(?:\s*\([^{}]*\))?(?:\s+extends\s+(?P<bases>[\w.<>, ]+?))?(?:\s+implements\s+(?P<more>[\w.<>, ]+?))?(?:\s+permits\s+[\w., ]+)?\s*$"),
    "go": re.compile(r"\btype\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?:struct|interface)\s*$"),
    "cpp": re.compile(r"\b(?:class|struct)\s+(?:\w+\s+)*?(?P<name>\w+)(?:\s+final)?(?:\s*:\s*(?P<bases>[^{};]+))?\s*$"),
}
_FUNCTION = {
    "javascript": re.compile(r"(?:\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*\([^{}]*\)|\b(?:const|let|var)\s+(?P<arrow>[\w$]+)\s*=\s*(?:async\s*)?(?:\([^{}]*\)|[\w$]+)\s*=>|(?:^|[\s}])(?P<method>#?[\w$]+)\s*\([^{}]*\))\s*$"),
    "typescript": re.compile(r"(?:\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^{}()]*>)?\s*\([^{}]*\)(?:\s*:\s*[^{};]+)?|\b(?:const|let|var)\s+(?P<arrow>[\w$]+)[^={}]*=\s*(?:async\s*)?(?:\([^{}]*\)(?:\s*:\s*[^{};=]+)?|[\w$]+)\s*=>|(?:^|[\s}])(?P<method>#?[\w$]+)\s*(?:<[^{}()]*>)?\s*\([^{}]*\)(?:\s*:\s*[^{};]+)?)\s*$"),
    "java": re.compile(r"(?P<method>\b\w+)\s*\([^{}]*\)\s*(?:throws\s+[\w., ]+)?\s*$"),
    "go": re.compile(r"\bfunc\s*(?:\(\s*(?:\w+\s+)?\*?\s*(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)(?:\[[^\]]*\])?\s*\([^{}]*\)[^{}]*$"),
    "cpp": re.compile(r"(?P<method>~?\b\w+)\s*\([^{};]*\)\s*(?:const|noexcept|override|final|->\s*[\w:<>*& ]+|\s)*(?::\s*[^{};]*)?\s*$"),
}
_CALL = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*(?:\.|->|::))*[A-Za-z_$][\w$]*)\s*\(")
_NEW = re.compile(r"\bnew\s+([A-Za-z_$][\w$.:]*)")
_IMPORTS = {
    "javascript": [re.compile(r"""^\s*import\s+(?:type\s+)?(?P<names>[^;'"]*?)\s*from\s*['"](?P<module>[^'"]+)['"]"""), re.compile(r"""^\s*import\s+['"](?P<module>[^'"]+)['"]"""), re.compile(r"""require\(\s*['"](?P<module>[^'"]+)['"]\s*\)""")],
    "java": [re.compile(r"^\s*import\s+(?:static\s+)?(?P<module>[\w.]+(?:\.\*)?)\s*;")],
    "cpp": [re.compile(r"""^\s*#\s*include\s*[<"](?P<module>[^>"]+)[>"]""")],
    "go": [re.compile(r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"(?P<module>[^"]+)"\s*$')],
}
_TYPES = {
    "typescript": re.compile(r"(?<=:)\s*([A-Z][\w$.]*)"),
    "java": re.compile(r"(?:[(,{;]|\b(?:private|protected|public|static|final)\b)\s*([A-Z][\w.]*)(?:<[^<>]*>)?(?:\[\])?\s+\w+\s*(?=[,)=;])"),
    "cpp": re.compile(r"(?:[(,{;}]|\bconst\b)\s*(?:const\s+)?([A-Z]\w*)\s*[*&]?\s+[*&]?\w+\s*(?=[,)=;])"),
    "go": re.compile(r"(?:[(,]\s*\w+\s+|\)\s*)[*\[\]]*([A-Z][\w.]*|[a-z]\w*\.[A-Z]\w*)"),
}


def _family(language: str) -> str:
    return "cpp" if language == "c" else language


def blank(text: str, family: str = "") -> str:
    """Comments and literals as blanks, line by line as long as before."""
    return (_SKIP_SCRIPT if family in ("javascript", "typescript") else _SKIP).sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _blocks(bare: str) -> list[tuple[int, int, int, str]]:
    """(start of the head, opening brace, closing brace, head text) of every block, in order of their opening."""
    out, stack, head = [], [], 0
    depth = 0
    for m in re.finditer(r"[{}();]", bare):
        c, i = m.group(), m.start()
        if c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif c == ";" and not depth:
            head = i + 1
        elif c == "{":
            stack.append((len(out), depth))
            out.append((head, i, -1, bare[head:i]))
            head, depth = i + 1, 0
        elif c == "}":
            if stack:
                k, depth = stack.pop()
                out[k] = (out[k][0], out[k][1], i, out[k][3])
            if not depth:
                head = i + 1
    return [b if b[2] >= 0 else (b[0], b[1], len(bare) - 1, b[3]) for b in out]


#: A comment's score: base, up to so much for being near, for naming the symbol, for the marks of documentation.
DOC_BASE, DOC_NEAR, DOC_NAMED, DOC_STYLE, DOC_LEAST, DOC_LINES = 0.5, 0.2, 0.2, 0.1, 0.5, 2


def comment_score(comment: str, distance: int, name: str) -> float:
    """How surely a comment that ends ``distance`` lines above a declaration, with no blank line between, documents it."""
    if not 0 < distance <= DOC_LINES:
        return 0.0
    near = DOC_NEAR * (1 - (distance - 1) / DOC_LINES)
    return min(1.0, DOC_BASE + near + DOC_NAMED * (bool(name) and name.lower() in comment.lower()) + DOC_STYLE * comment.lstrip().startswith(("/**", "///")))


def _doc_above(text: str, line: int, name: str) -> str | None:
    """The comment above ``line`` (1-based), annotations between allowed: a block comment or a run of line comments that
    scores ``DOC_LEAST`` or more."""
    lines = text.split("\n")
    at = line - 2
    while at >= 0 and lines[at].strip().startswith("@"):
        at -= 1
    if at < 0 or not lines[at].strip():
        return None
    last = lines[at].strip()
    first = at
    if last.endswith("*/"):
        while first > 0 and "/*" not in lines[first]:
            first -= 1
        found = "\n".join(lines[first : at + 1]).strip()
    elif last.startswith("//"):
        while first > 0 and lines[first - 1].strip().startswith("//"):
            first -= 1
        found = "\n".join(x.strip() for x in lines[first : at + 1])
    else:
        return None
    return found if comment_score(found, 1, name) >= DOC_LEAST else None


def _symbols(text: str, language: str) -> list[tuple]:
    """(kind, name, head position, closing position, owner, bases) of classes, functions and methods."""
    family = _family(language)
    bare = blank(text, family)
    found: list[tuple] = []
    open_: list[tuple] = []  # (closing position, kind, name)
    for start, brace, end, head in _blocks(bare):
        while open_ and open_[-1][0] < brace:
            open_.pop()
        flat = re.sub(r"\s+", " ", head).strip()
        flat = flat.rsplit("; ", 1)[-1] if family != "go" else flat
        kind, name, owner, bases = "", "", None, []
        in_class = bool(open_) and open_[-1][1] == "class"
        cls = _CLASS[family].search(flat) if language != "c" else None
        fun = _FUNCTION[family].search(flat)
        if cls and not re.search(r"[=(]\s*$", flat[: cls.start()]):
            groups = cls.groupdict()
            kind, name = "class", groups["name"]
            bases = [re.sub(r"<.*", "", b).replace("public ", "").replace("private ", "").replace("protected ", "").replace("virtual ", "").strip() for part in (groups.get("bases"), groups.get("more")) if part for b in part.split(",")]
        elif fun:
            groups = fun.groupdict()
            name = groups.get("name") or groups.get("arrow") or groups.get("method") or ""
            first = flat.split(" ", 1)[0].split("(", 1)[0]
            if name in _CONTROL or first in _CONTROL and first != "function" or re.search(r"(?:=|\bnew\b|\breturn\b|=>|\.)\s*[\w$.]*\s*\([^()]*$", flat) and not groups.get("name") and not groups.get("arrow"):
                name = ""
            if groups.get("method") and family in ("javascript", "typescript") and not in_class:
                name = ""
            if groups.get("method") and family == "cpp" and (any(o[1] == "function" for o in open_) or re.search(r"[=.]|->", flat[: fun.start("method")])):
                name = ""
            if groups.get("method") and family == "java" and not in_class:
                name = ""
            if name:
                owner = groups.get("owner") or (open_[-1][2] if in_class else None)
                kind = "method" if owner else "function"
                if any(o[1] == "function" for o in open_) and not owner:
                    kind = ""
        shift = len(head) - len(head.lstrip())
        if kind:
            found.append((kind, name, start + shift, end, owner, [b for b in bases if b]))
        open_.append((end, "class" if kind == "class" else "function" if kind else "block", name))
    return found


def definitions(text: str, language: str) -> list[tuple]:
    """(node_type, name, start_line, end_line, content, parent_name, docstring)."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    out = []
    for kind, name, a, b, owner, _ in _symbols(text, language):
        line = bisect_right(starts, a)
        out.append((kind, name, line, bisect_right(starts, b), text[a : b + 1], owner, _doc_above(text, line, name)))
    return out


def references(text: str, language: str) -> list[tuple]:
    """(name, ref_type, line, parent_symbol): imports, base classes, calls, constructions and named types."""
    family = _family(language)
    bare = blank(text, family)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    symbols = sorted(_symbols(text, language), key=lambda s: s[2])
    declared = {(s[1], bisect_right(starts, s[2])) for s in symbols}

    begins = [s[2] for s in symbols]

    def scope(at: int) -> str | None:
        for k in range(bisect_right(begins, at) - 1, -1, -1):
            if at <= symbols[k][3]:
                return f"{symbols[k][4]}.{symbols[k][1]}" if symbols[k][4] else symbols[k][1]
        return None

    out = []
    for n, line in enumerate(text.split("\n"), 1):
        for pattern in _IMPORTS.get("javascript" if family == "typescript" else family, []):
            m = pattern.search(line)
            if m:
                module = m["module"]
                out.append((module, "import", n, None))
                names = re.sub(r"[{}]|\*\s+as\s+", " ", m.groupdict().get("names") or "")
                out += [(f"{module}.{x.strip().split(' as ')[0].strip()}", "import", n, None) for x in names.split(",") if x.strip()]
                break
    for kind, _, a, _, _, bases in symbols:
        out += [(b, "inheritance", bisect_right(starts, a), None) for b in bases if kind == "class"]
    for m in _CALL.finditer(bare):
        name, line = m.group(1).replace("->", ".").replace("::", "."), bisect_right(starts, m.start())
        first = name.split(".", 1)[0]
        if first not in _CONTROL and first not in ("func", "import", "sizeof", "typeof", "super", "require") and (name, line) not in declared and not bare[: m.start()].endswith(("func ", "new ", "function ")):
            out.append((name, "call", line, scope(m.start())))
    out += [(m.group(1).replace("::", "."), "call", bisect_right(starts, m.start()), scope(m.start())) for m in _NEW.finditer(bare)]
    if family in _TYPES:
        out += [(m.group(1), "type_annotation", bisect_right(starts, m.start(1)), scope(m.start(1))) for m in _TYPES[family].finditer(bare)]
    return out
