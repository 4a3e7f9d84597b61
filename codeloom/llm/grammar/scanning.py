"""A lexer for languages whose strings hold expressions: the tokens of an interpolation stand between those of its string.

A string without interpolation is STR; one with them is TPL, the tokens of the first, TPL_MID, those of the second and so on,
TPL_END. Line ends are no tokens, but every token says whether it is the first of its line.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from codeloom.llm.grammar.lexers import LexError

_MARK = re.compile(r"(?:<{7}|>{7}|\|{7})(?: |$)|={7}$", re.M)
_PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Quote:
    """One way of writing strings. ``close`` and ``opens`` (what begins an interpolation) may depend on the opening's match."""

    opening: str
    close: str | Callable[[re.Match], str]
    escapes: bool = True
    lines: bool = False
    opens: str | Callable[[re.Match], str] = ""
    doubled: bool = False
    token: str = "STR"
    nests: str = ""


class Lexis:
    """Token rules of a language: ``space`` (with comments to the end of a line), block comments if ``blocks``, quotes, token
    classes and operators. ``folds``: keywords in any letter case. ``extra`` may take what starts at a position before the rules do: (kind, end) or None."""

    def __init__(self, space: str, quotes: tuple[Quote, ...], rules: list[tuple[str, str]], keywords: str, nested: bool = True, blocks: bool = True, formats: bool = False, folds: bool = False, extra: Callable | None = None):
        self.quotes, self.keywords, self.nested, self.blocks, self.formats, self.folds, self.extra = quotes, frozenset(keywords.split()), nested, blocks, formats, folds, extra
        self.openings = [re.compile(q.opening) for q in quotes]
        parts = [f"(?P<SPACE>{space})"] + [f"(?P<Q{i}>{re.sub(r'[(](?![?])', '(?:', q.opening)})" for i, q in enumerate(quotes)] + [f"(?P<{n}>{p})" for n, p in rules]
        self.match = re.compile("|".join(parts), re.M).match

    def tokens(self, text: str, at: int = 0) -> list[tuple]:
        out: list[tuple] = []
        self.scan(text, at, out, "")
        return out

    def scan(self, text: str, at: int, out: list, until: str) -> int:
        """Appends tokens up to the bracket ``until`` that closes what was opened before, and returns the place behind it."""
        fresh, depth, match, n = not until, 0, self.match, len(text)
        while at < n:
            if (at == 0 or text[at - 1] == "\n") and text[at] in "<>|=" and _MARK.match(text, at):
                raise LexError(at, "conflict mark")
            if self.blocks and text.startswith("/*", at):
                end = _block_end(text, at, self.nested)
                fresh, at = fresh or "\n" in text[at:end], end
                continue
            if self.extra:
                taken = self.extra(self, text, at, out, fresh)
                if taken:
                    if taken[0]:
                        out.append((taken[0], at, fresh))
                        fresh = False
                    elif taken[0] is None:
                        fresh = True
                    else:
                        fresh = False
                    at = taken[1]
                    continue
            m = match(text, at)
            if m is None or m.end() == at:
                raise LexError(at, "unterminated literal or comment" if text[at] in "\"'`" else f"unexpected {text[at]!r}")
            kind, word = m.lastgroup, m.group()
            if kind == "SPACE":
                fresh, at = fresh or "\n" in word, m.end()
                continue
            if kind[0] == "Q" and kind[1:].isdigit():
                i = int(kind[1:])
                at = self.string(text, at, self.quotes[i], self.openings[i].match(text, at), out, fresh)
                fresh = False
                continue
            if kind == "WORD":
                word = word.lower() if self.folds else word
                kind = word if word in self.keywords else "NAME"
            elif kind == "OP":
                kind = word
                if until and depth == 0 and self.formats and word == ":":
                    end = text.find(until, at)
                    if end < 0:
                        break
                    return end + 1
                if word in _PAIRS:
                    depth += 1
                elif word in (")", "]", "}"):
                    depth -= 1
                    if depth < 0 and until:
                        if word != until:
                            raise LexError(at, f"unexpected {word}")
                        return m.end()
            out.append((kind, at, fresh))
            fresh, at = False, m.end()
        if until:
            raise LexError(n - 1, "unterminated literal or comment")
        return at

    def string(self, text: str, begun: int, quote: Quote, m: re.Match, out: list, fresh: bool) -> int:
        close = quote.close(m) if callable(quote.close) else quote.close
        opens = quote.opens(m) if callable(quote.opens) else quote.opens
        at, parts, n, depth = m.end(), False, len(text), 0
        while at < n:
            if opens and text.startswith(opens, at):
                if opens == "{" and text.startswith("{{", at):
                    at += 2
                    continue
                out.append(("TPL_MID" if parts else "TPL", begun, fresh and not parts))
                parts = True
                bracket = "{" if "{" in opens else "("
                at = self.scan(text, at + opens.index(bracket) + opens.count(bracket), out, _PAIRS[bracket])
                if opens.count(bracket) > 1:
                    at += opens.count(bracket) - 1
            elif quote.doubled and text.startswith(close * 2, at):
                at += 2
            elif quote.escapes and text[at] == "\\":
                at += 2
            elif text.startswith(close, at) and depth == 0:
                at += len(close)
                if len(close) == 3:  # quotes before the closing ones belong to the text
                    while at < n and text[at] == close[0]:
                        at += 1
                out.append(("TPL_END" if parts else quote.token, at - 1 if parts else begun, fresh and not parts))
                return at
            elif text[at] == "\n" and not quote.lines:
                break
            else:
                if quote.nests:
                    depth += (text[at] == quote.nests) - (text[at] == close)
                at += 1
        raise LexError(min(begun, n - 1), "unterminated literal or comment")


def _block_end(text: str, at: int, nested: bool) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        if m.group() == "/*":
            depth = depth + 1 if nested else 1
        else:
            depth -= 1
        if depth <= 0:
            return m.end()
    raise LexError(at, "unterminated literal or comment")
