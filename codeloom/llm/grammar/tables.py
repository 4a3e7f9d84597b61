"""From grammar text to SLR parse tables that keep conflicts, and the recogniser that follows all of them.

Grammar text: ``name: alternative | alternative``; quoted terminals are token kinds as the lexer gives them, upper-case
names are token classes, lower-case names are rules; ``( ) ? * +`` as usual; a rule may run over indented lines. Optional
parts are expanded, so that no production is empty (but that of an empty file).
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict

_PART = re.compile(r"'[^']*'|[A-Za-z_]\w*|[()|?*+]")
END = "$end"


def _symbol(part: str) -> str:
    """A terminal as it is; a rule in angle brackets, so that a rule and a keyword may share a name."""
    return part[1:-1] if part[0] == "'" else part if part.isupper() or part[0].isupper() else f"<{part}>"


def read_grammar(text: str) -> tuple[list[tuple[str, tuple[str, ...]]], str]:
    """Productions (name, symbols) and the start rule (the first)."""
    rules: list[list[str]] = []
    for line in text.split("\n"):
        line = re.sub(r"(^|\s)#\s.*$", "", line)
        if not line.strip():
            continue
        if line[0].isspace():
            rules[-1].append(line)
        else:
            rules.append([line])
    out: dict[tuple, None] = {}
    made: dict[tuple, str] = {}
    start = ""

    def plus(variants: list[tuple]) -> str:
        key = tuple(variants)
        if key not in made:
            name = made[key] = f"<+{len(made)}>"
            for v in variants:
                if v:
                    out[name, v] = None
                    out[name, (name, *v)] = None
        return made[key]

    def alternatives(parts: list[str], i: int) -> tuple[list[tuple], int]:
        whole: list[tuple] = []
        current: list[tuple] = [()]
        while i < len(parts) and parts[i] != ")":
            if parts[i] == "|":
                whole += current
                current = [()]
                i += 1
                continue
            if parts[i] == "(":
                inner, i = alternatives(parts, i + 1)
                i += 1
            else:
                inner, i = [(_symbol(parts[i]),)], i + 1
            mark = parts[i] if i < len(parts) and parts[i] in "?*+" else ""
            if mark:
                i += 1
            if mark in ("*", "+"):
                inner = [(plus(inner),)]
            if mark in ("?", "*"):
                inner = [(), *inner]
            current = [a + b for a, b in itertools.product(current, inner)]
        return whole + current, i

    for lines in rules:
        name, body = " ".join(lines).split(":", 1)
        name = _symbol(name.strip())
        start = start or name
        for v in alternatives(_PART.findall(body), 0)[0]:
            out[name, v] = None
    return list(out), start


def build_tables(text: str) -> dict:
    """action: per state {token: actions}; an action >= 0 shifts to that state, one < 0 reduces production -action - 1."""
    productions, start = read_grammar(text)
    empty_file = (start, ()) in productions
    productions = [p for p in productions if p[1]]
    productions.insert(0, ("$start", (start,)))
    by_name: dict[str, list[int]] = defaultdict(list)
    for i, (name, _) in enumerate(productions):
        by_name[name].append(i)
    missing = {s for _, body in productions for s in body if s[0] == "<" and s[-1] == ">" and len(s) > 3} - set(by_name)
    assert not missing, missing

    first: dict[str, set] = {n: set() for n in by_name}
    changed = True
    while changed:
        changed = False
        for name, body in productions:
            add = first.get(body[0], {body[0]})
            if not add <= first[name]:
                first[name] |= add
                changed = True
    follow: dict[str, set] = {n: set() for n in by_name}
    follow["$start"].add(END)
    changed = True
    while changed:
        changed = False
        for name, body in productions:
            for a, b in itertools.pairwise([*body, None]):
                if a in follow:
                    add = follow[name] if b is None else first.get(b, {b})
                    if not add <= follow[a]:
                        follow[a] |= add
                        changed = True

    # rules that may start where a rule is expected
    opens: dict[str, set] = {}
    for n in by_name:
        seen, todo = {n}, [n]
        while todo:
            for i in by_name[todo.pop()]:
                s = productions[i][1][0]
                if s in by_name and s not in seen:
                    seen.add(s)
                    todo.append(s)
        opens[n] = seen

    states: dict[frozenset, int] = {}
    order: list[frozenset] = []

    def number(kernel: frozenset) -> int:
        if kernel not in states:
            states[kernel] = len(order)
            order.append(kernel)
        return states[kernel]

    number(frozenset([(0, 0)]))
    action: list[dict] = []
    goto: list[dict] = []
    at = 0
    while at < len(order):
        kernel = order[at]
        moves: dict[str, set] = defaultdict(set)
        reduces: dict[str, list] = defaultdict(list)
        names: set[str] = set()
        for p, dot in kernel:
            body = productions[p][1]
            if dot == len(body):
                for t in follow[productions[p][0]]:
                    reduces[t].append(-p - 1)
            else:
                moves[body[dot]].add((p, dot + 1))
                if body[dot] in by_name:
                    names |= opens[body[dot]]
        for n in names:
            for p in by_name[n]:
                moves[productions[p][1][0]].add((p, 1))
        row: dict[str, tuple] = {t: tuple(sorted(r)) for t, r in reduces.items()}
        jumps = {}
        for s, items in moves.items():
            to = number(frozenset(items))
            if s in by_name:
                jumps[s] = to
            else:
                row[s] = row.get(s, ()) + (to,)
        action.append(row)
        goto.append(jumps)
        at += 1
    return {"action": action, "goto": goto, "sizes": [(n, len(b)) for n, b in productions], "empty": empty_file}


def _paths(node: list, length: int, link: tuple | None) -> list[list]:
    """Ends of the paths of ``length`` links down from ``node``; with ``link``, only of those that use it."""
    ends = {(id(node), link is None): node}
    for _ in range(length):
        below: dict = {}
        for (_, used), at in ends.items():
            for base in at[1]:
                below[id(base), used or at is link[0] and base is link[1]] = base
        ends = below
    return [at for (_, used), at in ends.items() if used]


class Recogniser:
    """Follows every action of the tables over a graph-structured stack; with ``inserts``, a missing ``;`` may be put in
    before a token on a new line, before ``}`` and at the end, where nothing else continues; with ``either``, a line end is read
    both as a ``;`` and as nothing."""

    def __init__(self, tables: dict, inserts: bool = False, either: bool = False):
        self.action, self.goto, self.sizes, self.empty, self.inserts = tables["action"], tables["goto"], tables["sizes"], tables["empty"], inserts
        self.either = either

    def _step(self, frontier: dict[int, list], kind: str) -> dict[int, list]:
        action, goto, sizes = self.action, self.goto, self.sizes
        if len(frontier) == 1:  # while there is one stack and one action, no graph is needed
            node = next(iter(frontier.values()))
            while True:
                acts = action[node[0]].get(kind)
                if acts is None:
                    return {}
                if len(acts) > 1:
                    break
                act = acts[0]
                if act >= 0:
                    return {act: [act, [node]]}
                name, length = sizes[-act - 1]
                base = node
                for _ in range(length):
                    if len(base[1]) > 1:
                        base = None
                        break
                    base = base[1][0]
                if base is None:
                    break
                if name == "$start":
                    return {-1: base} if kind == END else {}
                to = goto[base[0]].get(name)
                if to is None:
                    return {}
                node = [to, [base]]
            frontier = {node[0]: node}
        active = {s: [s, list(n[1])] for s, n in frontier.items()}
        todo: list[tuple] = [(n, None) for n in active.values()]
        accepted = False
        while todo:
            node, link = todo.pop()
            for act in action[node[0]].get(kind, ()):
                if act >= 0:
                    continue
                name, length = sizes[-act - 1]
                for base in _paths(node, length, link):
                    if name == "$start":
                        accepted = True
                        continue
                    to = goto[base[0]].get(name)
                    if to is None:
                        continue
                    known = active.get(to)
                    if known is None:
                        active[to] = known = [to, [base]]
                        todo.append((known, None))
                    elif not any(b is base for b in known[1]):
                        known[1].append(base)
                        todo.extend((n, (known, base)) for n in list(active.values()))
        if kind == END:
            return {-1: [-1, []]} if accepted else {}
        shifted: dict[int, list] = {}
        for node in active.values():
            for act in action[node[0]].get(kind, ()):
                if act >= 0:
                    if act in shifted:
                        shifted[act][1].append(node)
                    else:
                        shifted[act] = [act, [node]]
        return shifted

    def first_error(self, tokens: list[tuple]) -> int | None:
        """Number of the first token (kind, position, on a new line) after which nothing can be repaired; None if all parses."""
        if not tokens:
            return None if self.empty else 0
        frontier = {0: [0, []]}
        for i, (kind, _, fresh) in enumerate([*tokens, (END, 0, True)]):
            after = self._step(frontier, kind)
            if self.either and fresh:
                middle = self._step(frontier, ";")
                for state, node in (self._step(middle, kind) if middle else {}).items():
                    if state in after:
                        after[state][1].extend(b for b in node[1] if not any(b is known for known in after[state][1]))
                    else:
                        after[state] = node
            if not after and self.inserts and (fresh or kind in ("}", END)):
                middle = self._step(frontier, ";")
                after = self._step(middle, kind) if middle else {}
            if not after:
                return i
            frontier = after
        return None
