"""Definitions and references of Python sources by the standard library's syntax tree."""

from __future__ import annotations

import ast
from functools import lru_cache


@lru_cache(maxsize=1)
def _tree(text: str) -> tuple[ast.Module | None, str | None]:
    """The syntax tree, or what is wrong with the source; kept for the next question about the same text."""
    try:
        return ast.parse(text), None
    except (SyntaxError, ValueError, RecursionError) as error:
        return None, f"{type(error).__name__}: {error}"


def syntax_error(text: str) -> str | None:
    return _tree(text)[1]


def definitions(text: str) -> list[tuple]:
    """(node_type, name, start_line, end_line, content, parent_name, docstring) of functions, classes and their methods.

    Functions inside functions are not entered; decorators do not count into the range; a broken source has none.
    """
    tree = _tree(text)[0]
    if tree is None:
        return []
    lines, out = text.split("\n"), []

    def walk(body: list, owner: str | None) -> None:
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if owner else "function"
                content = "\n".join(lines[node.lineno - 1 : node.end_lineno])
                out.append((kind, node.name, node.lineno, node.end_lineno, content, owner, ast.get_docstring(node, clean=True)))
                if isinstance(node, ast.ClassDef):
                    walk(node.body, node.name)
            else:
                for part in ("body", "orelse", "finalbody", "handlers"):
                    inner = getattr(node, part, None) or []
                    walk([x for h in inner for x in (h.body if isinstance(h, ast.ExceptHandler) else [h])], owner)

    walk(tree.body, None)
    return out


def _dotted(node: ast.AST) -> str:
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        names.append(node.id)
    elif not names:
        return ""
    return ".".join(reversed(names))


def _type_names(node: ast.AST | None) -> list[str]:
    if node is None:
        return []
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        try:
            return _type_names(ast.parse(node.value, mode="eval").body)
        except SyntaxError:
            return []
    if isinstance(node, ast.Name | ast.Attribute):
        return [_dotted(node)]
    return [n for child in ast.iter_child_nodes(node) for n in _type_names(child)]


def references(text: str) -> list[tuple]:
    """(name, ref_type, line, parent_symbol): calls, annotated types, base classes and imports with their enclosing symbol.

    A broken source has none."""
    tree = _tree(text)[0]
    if tree is None:
        return []
    out: list[tuple] = []

    def visit(node: ast.AST, scope: str | None) -> None:
        inner = scope
        if isinstance(node, ast.ClassDef):
            out.extend((_dotted(b), "inheritance", node.lineno, scope) for b in node.bases if _dotted(b))
            inner = f"{scope}.{node.name}" if scope else node.name
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            args = node.args
            every = [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]
            out.extend((t, "type_annotation", node.lineno, scope) for a in every for t in _type_names(a.annotation))
            out.extend((t, "type_annotation", node.lineno, scope) for t in _type_names(node.returns))
            inner = f"{scope}.{node.name}" if scope else node.name
        elif isinstance(node, ast.Call):
            name = _dotted(node.func)
            if name:
                out.append((name, "call", node.lineno, scope))
        elif isinstance(node, ast.AnnAssign):
            out.extend((t, "type_annotation", node.lineno, scope) for t in _type_names(node.annotation))
        elif isinstance(node, ast.Import):
            out.extend((a.name, "import", node.lineno, scope) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            out.append((module, "import", node.lineno, scope))
            out.extend((f"{module}.{a.name}" if not module.endswith(".") else module + a.name, "import", node.lineno, scope) for a in node.names if a.name != "*")
        for child in ast.iter_child_nodes(node):
            visit(child, inner)

    visit(tree, None)
    return out
