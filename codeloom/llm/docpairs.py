"""Functions paired with their documentation.

Signatures are found by regular expressions on source whose comments and strings are blanked, bodies are delimited by an
indentation stack (Python), a brace stack (C-like languages) or an end-keyword stack (Ruby, Lua), and the comment that ends
on the line above a signature (line distance 1, decorators between them allowed), or the string that opens the body, is its
documentation. Documentation counts if one of its statements tells more than the name, the parameters and their types.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Language of a file name extension, for the languages whose functions are extracted.
FAMILY = {
    "python": "indent", "javascript": "brace", "typescript": "brace", "go": "brace", "java": "brace", "c": "brace", "cpp": "brace", "rust": "brace", "kotlin": "brace", "scala": "brace", "csharp": "brace", "swift": "brace", "php": "brace", "ruby": "end", "lua": "end",
}

_NOT_NAMES = frozenset("if for while switch catch return else do try new throw await typeof sizeof super with function in case and or not elif synchronized".split())
_SIGNATURES = {
    "indent": re.compile(r"^(?P<lead>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*\("),
    "end": re.compile(r"^(?P<lead>[ \t]*)(?:local[ \t]+)?(?:def|function)[ \t]+(?P<name>[\w.:?!]+)"),
    "brace": re.compile(
        r"^(?P<lead>[ \t]*)(?:"
        r"(?:(?:export|default|async|public|private|protected|static|pub|unsafe|inline|extern|override|open|final|fun|fn|func|function\b\*?)[ \t]+)*(?:func|function|fn|fun|def)\b\*?[ \t]*(?:\([^()]*\)[ \t]*)?(?P<name>[\w$]+)[ \t]*(?:<[^<>]*>|\[[^\[\]]*\])?[ \t]*\("
        r"|(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<arrow>[\w$]+)[ \t]*(?::[^=]+)?=[ \t]*(?:async[ \t]*)?(?:function\b|\([^()]*\)[ \t]*(?::[^=]+)?=>|[\w$]+[ \t]*=>)"
        r"|(?:@\w+[ \t]+)*(?:[\w$<>\[\],.?&*:~]+[ \t]+)*?[*&]*(?P<method>~?#?[\w$]+)[ \t]*\((?=[^;]*$|[^;]*\{))"
    ),
}
_ROUND = re.compile(r"[()]")
_PY_STRING = re.compile(r"[ \t]*[rRbBuUfF]{0,2}(\"\"\"|'''|\"|')")


def blank_out(text: str, family: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with comments and string contents as blanks (same length), and the line spans of its comments (1-based)."""
    out, comments, i, n, line = list(text), [], 0, len(text), 1

    def wipe(a: int, b: int) -> None:
        for j in range(a, b):
            if out[j] != "\n":
                out[j] = " "

    while i < n:
        c = text[i]
        two = text[i : i + 2]
        if c == "\n":
            line += 1
            i += 1
        elif family == "brace" and two == "//" or family == "indent" and c == "#" or family == "end" and (c == "#" or two == "--"):
            j = text.find("\n", i)
            j = n if j < 0 else j
            comments.append((line, line))
            wipe(i, j)
            i = j
        elif family == "brace" and two == "/*":
            j = text.find("*/", i + 2)
            j = n if j < 0 else j + 2
            comments.append((line, line + text.count("\n", i, j)))
            line += text.count("\n", i, j)
            wipe(i, j)
            i = j
        elif family == "indent" and text[i : i + 3] in ('"""', "'''"):
            j = text.find(text[i : i + 3], i + 3)
            j = n if j < 0 else j + 3
            line += text.count("\n", i, j)
            wipe(i + 3, j - 3)
            i = j
        elif c in "\"'" or c == "`" and family == "brace":
            j = i + 1
            while j < n and text[j] != c and (text[j] != "\n" or c == "`"):
                j += 2 if text[j] == "\\" else 1
            j = min(n, j + 1)
            line += text.count("\n", i, j)
            wipe(i + 1, j - 1)
            i = j
        else:
            i += 1
    return "".join(out), comments


def _body_end(lines: list[str], first: int, family: str) -> int:
    """Index of the last line of the body whose signature stands at line ``first``."""
    if family == "indent":
        depth, at = 0, first
        while at < len(lines):  # the signature may run over several lines
            depth += sum(lines[at].count(c) for c in "([{") - sum(lines[at].count(c) for c in ")]}")
            if depth <= 0:
                break
            at += 1
        lead = len(lines[first]) - len(lines[first].lstrip())
        at = last = min(at, len(lines) - 1)
        for k in range(at + 1, len(lines)):
            if lines[k].strip():
                if len(lines[k]) - len(lines[k].lstrip()) <= lead:
                    break
                last = k
        return last
    if family == "end":
        depth = 0
        for k in range(first, len(lines)):
            leads = bool(re.match(r"\s*(?:if|unless|while|until|for|case|class|module|begin|repeat)\b", lines[k]))
            depth += leads + len(re.findall(r"\b(?:function|def)\b" if leads else r"\b(?:function|def|do)\b", lines[k]))
            depth -= len(re.findall(r"(?<![\w.])end\b", lines[k]))
            if depth <= 0 and k > first:
                return k
        return len(lines) - 1
    depth = round_ = 0
    seen = False
    for k in range(first, len(lines)):
        for c in lines[k]:
            round_ += (c == "(") - (c == ")")
            if c == "{" and round_ <= 0:
                depth, seen = depth + 1, True
            elif c == "}" and round_ <= 0:
                depth -= 1
                if seen and depth <= 0:
                    return k
            elif c == ";" and not seen and round_ <= 0:
                return k
    return len(lines) - 1


def _closing(text: str, at: int) -> int:
    """Index of the parenthesis that closes the one at ``at``, however many lines below; the last index without one."""
    depth = 0
    for m in _ROUND.finditer(text, at):
        depth += 1 if m.group() == "(" else -1
        if depth == 0:
            return m.start()
    return len(text) - 1


def _opening_string(lines: list[str], blank: list[str], first: int, last: int) -> str:
    """The string that is the first statement below a Python signature."""
    depth, at = 0, first
    while at <= min(last, len(blank) - 1):
        depth += sum(blank[at].count(c) for c in "([{") - sum(blank[at].count(c) for c in ")]}")
        if depth <= 0 and blank[at].rstrip().endswith(":"):
            break
        at += 1
    at += 1
    while at < len(lines) and not lines[at].strip():
        at += 1
    if at >= len(lines):
        return ""
    start = _PY_STRING.match(lines[at])
    if not start:
        return ""
    quote = start.group(1)
    rest = "\n".join([lines[at][start.end() :], *lines[at + 1 :]])
    end = re.search(r"(?<!\\)" + re.escape(quote), rest)
    return rest[: end.start()] if end else rest


def family_of(language: str | None, text: str = "") -> str:
    known = FAMILY.get((language or "").strip().lower())
    if known:
        return known
    return "indent" if re.search(r"^\s*(?:async\s+)?def\s+\w+\s*\(.*|^\s*@\w+", text, re.M) and not re.search(r"[{;]\s*$", text, re.M) else "brace"


def functions_in(text: str, family: str, first_only: bool = False) -> Iterator[tuple[str, int, int, str, str]]:
    """(name, first line, last line, documentation, signature) of every function or method, lines 1-based."""
    blanked, comments = blank_out(text, family)
    lines, blank = text.split("\n"), blanked.split("\n")
    starts = [0, *(m.end() for m in re.finditer("\n", blanked))]
    ends = {b: a for a, b in comments}
    whole = {k for a, b in comments for k in range(a, b + 1) if not blank[k - 1].strip()}
    signature = _SIGNATURES[family]
    for at, line in enumerate(blank):
        found = signature.match(line)
        if not found:
            continue
        groups = found.groupdict()
        name = groups.get("name") or groups.get("arrow") or groups.get("method")
        if not name or name in _NOT_NAMES or groups.get("method") and re.match(r"\s*(?:return|throw|else|new|await|case|go|defer|delete)\b", line):
            continue
        if groups.get("method") and not groups.get("name"):
            close = _closing(blanked, starts[at] + found.end() - 1)
            if not re.compile(r"[^;={}()]*(?:\([^()]*\)[^;={}()]*)*\{").match(blanked, close + 1):
                continue
        last = _body_end(blank, at, family)
        above = at  # 0-based line above is at - 1, whose 1-based number is ``above``
        while above > 0 and lines[above - 1].lstrip().startswith("@") and above not in whole:
            above -= 1
        notes: list[str] = []
        while above in ends and above in whole:
            start = ends[above]
            notes = lines[start - 1 : above] + notes
            above = start - 1
        doc = "\n".join(notes)
        if family == "indent":
            inner = _opening_string(lines, blank, at, last)
            doc = inner if not strip_marks(doc) else doc + "\n" + inner if inner else doc
        head = blanked.find("(", starts[at])
        end = starts[last] + len(blank[last])
        yield name, at + 1, last + 1, doc, blanked[starts[at] : _closing(blanked, head) + 1 if 0 <= head < end else end]
        if first_only:
            return


def strip_marks(doc: str) -> str:
    """Documentation without comment marks, quotes and rulers; empty if nothing but marks is left."""
    out = []
    for line in doc.split("\n"):
        line = line.strip()
        line = re.sub(r"^(?:[rRbBuUfF]{0,2}(?:\"\"\"|'''))", "", line)
        line = re.sub(r"(?:\"\"\"|''')$", "", line)
        line = re.sub(r"^(?:/\*+!?|\*+/|<!--|//+[/!]*|#+|--+(?=\s|$)|\*+(?!\w)|;+)\s?", "", line)
        line = re.sub(r"\s*(?:\*+/|-->)$", "", line).strip()
        if line and not re.fullmatch(r"[\W_]*", line):
            out.append(line)
    return "\n".join(out)


# Words that carry nothing by themselves in the documentation of a function, by language.
_EMPTY_BY_LANGUAGE = {
    "en": "a an the this that these those it its of to for in on by with and or from as at is are be will would shall should can may do does something anything thing things function functions method methods func fn def procedure routine helper constructor class object call calls called implementation implements handle handles simply just here name named using use used value values param parameter parameters args arguments returns return result description doc docs docstring documentation comment",
    "de": "der die das ein eine einen dem den des von zu und oder ist sind wird diese dieser dieses etwas macht tut funktion methode klasse",
    "fr": "le la les un une des du de et ou est sont qui que cette ce cet fait quelque chose fonction méthode classe",
    "es": "el la los las un una unos de del y o es son que esta este esto hace algo función método clase",
    "it": "il lo la gli le un una di del della e o è sono che questa questo fa qualcosa funzione metodo classe",
    "nl": "de het een van en of is zijn wordt dit dat deze die iets doet functie methode klasse",
    "pt": "o a os as um uma de do da e ou é são que esta este isto faz algo função método classe",
}
_EMPTY_WORDS = frozenset(w for words in _EMPTY_BY_LANGUAGE.values() for w in words.split())
_TYPES = frozenset("int integer float double str string bool boolean bytes byte list dict map set tuple array object none null undefined void any char long short number self cls optional true false size_t node error uint int32 int64 float64 float32 const unsigned static vector".split())
_PLACEHOLDER = re.compile(
    r"^\W*(?:todo|fixme|xxx|tbd|tba|hack|wip|lorem|placeholder|n/?a|none|doc|docs|docstring|description|comment|missing docs?|undocumented|no (?:docs?|documentation|description)|add (?:a )?(?:description|docs?|documentation|comment)|(?:description|documentation|docs?) (?:goes|go|here|to follow|pending|missing)|"
    r"(?:write|document|describe|fill) (?:me|this|in)|to be (?:done|written|documented|added)|coming soon|insert .* here|\.{2,}|\?+|-+)\b",
    re.I,
)
_ELSEWHERE = re.compile(r"^\W*(?:see|cf\.?|siehe|voir|véase|ver|refer to|inherited|inherits|inheritdoc|same as|as in|overrides?|override|copied from|documented in)\b", re.I)
_LEGAL = re.compile(r"\b(?:spdx-license|copyright|licen[sc]ed? (?:under|to)|all rights reserved|permission is hereby)\b|^\W*\(c\)\s|^\W*licen[sc]e\b", re.I)
_DIRECTIVE = re.compile(
    r"^\W*(?:pylint|noqa|nosec|mypy|type:\s*ignore|flake8|isort|yapf|fmt|pragma|pyright|eslint|jshint|jslint|tslint|prettier|istanbul|c8|v8|@ts-|ts-|nolint|go:|\+build|nosonar|checkstyle|spotless|clang-format|suppresswarnings|noinspection|coverage|codecov|lint|global|jest|webpack|@?flow|cppcheck|iwyu|region|endregion|#?region)\b",
    re.I,
)
_CODE = re.compile(
    r"^(?:return\b(?:\s+[\w.\[\]()'\"]+)?;?$|[\w.\[\]]+\s*(?:[-+*/|&]|:)?=\s*\S.*|(?:[\w.]+)\(.*\)\s*[;{]?$|(?:if|for|while|switch)\s*\(.*|(?:if|for|while|with|elif|try|else|except)\b.*:$|(?:import|from|package|using|include)\s+[\w.{}\"<>/]+;?$|[{}()\[\];]+|(?:var|let|const|int|long|double|float|char|bool|auto)\s+\w+\s*(?:=.*)?;|.*;$|(?:await|throw|raise|yield|del|break|continue|pass)\b(?:\s+[\w.()]+)?;?$)"
)
# A sentence of one word that is a term of its own, such as a property of the function.
_ONE_WORD = re.compile(r"[^\W\d_]{8,}\.")
_TAG = re.compile(r"^[@\\:](?P<tag>\w+)\s*(?P<rest>.*)$")
_FIELD = re.compile(r"^(?P<name>\*{0,2}[\w$]+)\s*(?:\([^)]*\)|\[[^\]]*\])?\s*(?::|--?|–|—)\s*(?P<rest>.*)$")
_HEADER = re.compile(r"^(?:args?|arguments?|param(?:eter)?s?|returns?|yields?|raises?|throws?|notes?|examples?|attributes?|keyword args?|other parameters|see also)\s*:?$", re.I)


def _pieces(text: str) -> list[str]:
    """Words in lower case, identifiers taken apart."""
    return [p.lower() for p in re.findall(r"[^\W\d_]+", re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z])", " ", text)) if len(p) > 1]


def _same(word: str, names: set[str]) -> bool:
    if word in names:
        return True
    for tail in ("es", "s", "ed", "d", "ing", "er", "ies"):
        if word.endswith(tail):
            stem = word[: -len(tail)]
            if stem in names or stem + "e" in names or stem + "y" in names or stem[-1:] * 2 == stem[-2:] and stem[:-1] in names:
                return True
    return False


def _new_words(text: str, names: set[str]) -> int:
    return sum(1 for w in _pieces(text) if w not in _EMPTY_WORDS and w not in _TYPES and not _same(w, names))


def says_something(doc: str | None, name: str, signature: str = "") -> bool:
    """Whether one statement of the documentation tells behaviour, purpose or a condition.

    Not counted: the words of the name again, parameter and type lists (a description that repeats the parameter included),
    placeholders, references elsewhere, licences, directives for tools, and disabled code. Any natural language counts.
    """
    names = set(_pieces(name or ""))
    section = ""
    for line in strip_marks(doc or "").split("\n"):
        line = re.sub(r"^(?:[-*+•]|\d+[.)])\s+", "", line.strip())
        if not line:
            continue
        if _HEADER.match(line):
            section = line.lower()
            continue
        if _LEGAL.search(line) or _DIRECTIVE.search(line):
            continue
        tag = _TAG.match(line)
        if line.startswith("{@") or tag and tag["tag"].lower() in ("override", "inheritdoc", "see", "link", "author", "since", "version", "type", "rtype", "private", "public", "internal", "async", "static", "template", "memberof", "copyright", "license"):
            continue
        if tag:
            rest = re.sub(r"^\{[^}]*\}\s*", "", tag["rest"])
            own = set(names)
            if tag["tag"].lower() in ("param", "arg", "argument", "parameter", "keyword", "property", "tparam", "prop", "throws", "raises", "exception"):
                first = re.match(r"(?:[\w.<>\[\]|]+\s+)?(\[?[\w$.]+\]?)\s*:?\s*(.*)$", rest) if tag["rest"].count(":") and line.startswith(":") else re.match(r"(\[?[\w$.]+\]?)\s*[-:]?\s*(.*)$", rest)
                if first:
                    own |= set(_pieces(first.group(1)))
                    rest = first.group(2)
            rest = rest.lstrip(":").strip()
            if _PLACEHOLDER.search(rest) or _ELSEWHERE.search(rest):
                continue
            if _new_words(rest, own) >= 2 or len(_pieces(rest)) >= 2 and _new_words(rest, own) >= 1 and not tag["tag"].lower().startswith("return"):
                return True
            continue
        field = _FIELD.match(line)
        if field and (section[:3] in ("arg", "par", "key", "oth", "att") or re.search(rf"\b{re.escape(field['name'].lstrip('*'))}\b", signature if "(" in signature else "")):
            own = names | set(_pieces(field["name"]))
            rest = field["rest"]
            if not _PLACEHOLDER.search(rest) and len(_pieces(rest)) >= 2 and _new_words(rest, own) >= 1:
                return True
            continue
        if section and (len(_pieces(line)) <= 1 or re.fullmatch(r"\*{0,2}[\w$.]+(?:\s*,\s*\*{0,2}[\w$.]+)*", line)):
            continue
        if _CODE.match(line) or _ELSEWHERE.search(line):
            continue
        for sentence in re.split(r"(?<=[.!?])\s+", line):
            if _PLACEHOLDER.search(sentence) or _ELSEWHERE.search(sentence) or _CODE.match(sentence):
                continue
            if _new_words(sentence, names) >= 2 or _ONE_WORD.fullmatch(sentence) and _new_words(sentence, names) == 1:
                return True
    return False


def documentation_of(name: str, content: str, docstring: str | None, language: str | None) -> tuple[str, str, str]:
    """(documentation, signature, code) of one node: the docstring, or, if it is blank, what its content carries; the code is
    the delimited function, or the whole content where no signature is found."""
    family = family_of(language, content)
    found = next(functions_in(content, family, first_only=True), None)
    if found is None and family == "brace":
        found = next(functions_in(content, "indent", first_only=True), None)
    signature = found[4] if found else ""
    code = "\n".join(content.split("\n")[found[1] - 1 : found[2]]) if found else content
    if docstring and strip_marks(docstring):
        return docstring, signature, code
    return (found[3] if found else ""), signature, code


def pair_nodes(nodes: DataFrame) -> DataFrame:
    """(node_id, code, documentation) of every function or method node whose documentation says something.

    ``nodes`` has node_id, node_type (any letter case), name, content, docstring and language. The code is the function from
    its signature to the end of its body, so comments above it are in the documentation only. Null content or name counts as
    empty; null node ids are left out; repeated rows are kept as often as they occur. Extra columns are ignored.
    """
    chosen = nodes.where(F.lower(F.trim("node_type")).isin("function", "method") & F.col("node_id").isNotNull())
    chosen = chosen.select("node_id", "name", "content", "docstring", "language")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for node, name, content, docstring, language in batch.itertuples(index=False, name=None):
                name, content, docstring, language = (x if isinstance(x, str) else "" for x in (name, content, docstring, language))
                doc, signature, code = documentation_of(name, content, docstring, language)
                if says_something(doc, name, signature):
                    out.append((node, code, strip_marks(doc)))
            yield pd.DataFrame(out, columns=["node_id", "code", "documentation"])

    return chosen.mapInPandas(run, f"node_id {dict(chosen.dtypes)['node_id']}, code string, documentation string")


def pair_files(files: DataFrame, languages: dict[str, str]) -> DataFrame:
    """(file_path, name, start_line, end_line, code, documentation) of documented functions in whole source files.

    ``languages`` maps extensions to language names; files of other extensions have none. Null content has none.
    """
    chosen = files.select("file_path", "content").where("file_path is not null and length(content) > 0").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file_path", "name", "start_line", "end_line", "code", "documentation"]
        for batch in batches:
            out = []
            for path, text in batch.itertuples(index=False, name=None):
                family = FAMILY.get(languages.get("." + path.rsplit(".", 1)[-1].lower(), ""))
                if not family:
                    continue
                lines = text.split("\n")
                for name, a, b, doc, signature in functions_in(text, family):
                    if says_something(doc, name, signature):
                        out.append((path, name, a, b, "\n".join(lines[a - 1 : b]), strip_marks(doc)))
            yield pd.DataFrame(out, columns=columns)

    return chosen.mapInPandas(run, "file_path string, name string, start_line int, end_line int, code string, documentation string")
