import pytest

from codeloom.config import Settings, load_settings
from codeloom.engine import Engine
from codeloom.parse import braces, python
from codeloom.parse.files import import_lines, parse_files

PY = '''"""Module."""
import os
from .b import helper


class Base:
    pass


class Box(Base):
    """Holds things."""

    def put(self, thing: Thing) -> int:
        """Puts one in."""
        return helper(thing)


def run(box):
    box.put(1)
    return os.path.join("a", "b")
'''


def test_python_parsing():
    assert [(d[0], d[1], d[2], d[3], d[5], d[6]) for d in python.definitions(PY)] == [("class", "Base", 6, 7, None, None), ("class", "Box", 10, 15, None, "Holds things."), ("method", "put", 13, 15, "Box", "Puts one in."), ("function", "run", 18, 20, None, None)]
    refs = set(python.references(PY))
    assert {("os", "import", 2, None), (".b", "import", 3, None), (".b.helper", "import", 3, None), ("Base", "inheritance", 10, None), ("Thing", "type_annotation", 13, "Box"), ("helper", "call", 15, "Box.put"), ("box.put", "call", 19, "run"), ("os.path.join", "call", 20, "run")} <= refs
    assert python.definitions("def (") == [] == python.references("def (")


def test_brace_parsing():
    js = "import { a } from './x';\n/** Says. */\nfunction f(b) {\n  return a(b);\n}\nconst g = (c) => {\n  return f(c);\n};\nclass K extends Base {\n  // m\n  m(x) {\n    if (x) { f(x); }\n    return /[{(]/g;\n  }\n}\n"
    assert [(d[0], d[1], d[2], d[3], d[5]) for d in braces.definitions(js, "javascript")] == [("function", "f", 3, 5, None), ("function", "g", 6, 8, None), ("class", "K", 9, 15, None), ("method", "m", 11, 14, "K")]
    assert {("./x", "import", 1, None), ("Base", "inheritance", 9, None), ("a", "call", 4, "f"), ("f", "call", 12, "K.m")} <= set(braces.references(js, "javascript"))
    go = "package p\nimport \"x/y\"\ntype T struct {\n\ta int\n}\nfunc (t *T) M(n Other) int {\n\treturn y.F(n)\n}\nfunc F() {}\n"
    assert [(d[0], d[1], d[5]) for d in braces.definitions(go, "go")] == [("class", "T", None), ("method", "M", "T"), ("function", "F", None)]
    java = "package a;\nimport b.C;\npublic class D extends E implements G {\n  D() { super(); }\n  public int h(C c) throws X {\n    return new K(c).z();\n  }\n  enum Q { R }\n}\n"
    assert [(d[0], d[1], d[5]) for d in braces.definitions(java, "java")] == [("class", "D", None), ("method", "D", "D"), ("method", "h", "D"), ("class", "Q", None)]
    assert {("b.C", "import", 2, None), ("E", "inheritance", 3, None), ("G", "inheritance", 3, None), ("K", "call", 6, "D.h")} <= set(braces.references(java, "java"))
    cpp = '#include "q.h"\nstruct S : public B {\n  int m(int a) { return f(a); }\n};\nstatic int f(int a) {\n  return a;\n}\n'
    assert [(d[0], d[1], d[5]) for d in braces.definitions(cpp, "cpp")] == [("class", "S", None), ("method", "m", "S"), ("function", "f", None)]
    assert [d[1] for d in braces.definitions(cpp, "c")] == ["m", "f"] or [d[1] for d in braces.definitions(cpp, "c")] == ["f"]


def test_import_lines():
    assert import_lines("# c\nimport a\n\nfrom b import c\nx = 1\nimport d", "python") == ["import a", "from b import c"]
    assert import_lines("import a from 'b'\nconst c = require('d')\nconst e = require('f'); // require(\nlet x", "javascript")[0] == "import a from 'b'"
    assert import_lines('package p\nimport (\n\t"a/b"\n\tx "c"\n)\n', "go") == ["a/b", "c"]
    assert import_lines("import x;", "java") == []


def test_parse_files_dirty(spark):
    rows = [("a.py", "Python", PY, 1), ("b.xx", "other", "x", 1), ("c.py", "python", None, 1), ("d.py", "python", "def (", 1)]
    got = {r.file_path: len(r.nodes) for r in parse_files(spark.createDataFrame(rows, "file_path string, language string, content string, nodes int")).collect()}
    assert got == {"a.py": 4, "b.xx": 0, "c.py": 0, "d.py": 0}


def test_settings():
    s = load_settings(environment={"CODELOOM_CHUNK_LINES": "20", "CODELOOM_GRAPH_ENABLED": "no", "CODELOOM_API_KEY": "x"})
    assert (s.chunk_lines, s.graph_enabled, s.shown()["api_key"]) == (20, False, "***")
    with pytest.raises(ValueError):
        Settings(chunk_overlap=50)


def test_index_update_search(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "pkg").mkdir(parents=True)
    (tree / "pkg" / "a.py").write_text(PY)
    (tree / "pkg" / "b.py").write_text("def helper(x):\n    return x\n")
    (tree / "notes.md").write_text("alpha beta\n")
    engine = Engine(spark, str(tmp_path / "store"))
    assert tuple(engine.index(str(tree)).first()) == (3, 6, 0)
    assert "notes.md" in {r.file_path for r in engine.search("alpha beta", mode="grep").collect()}
    assert engine.search("helper", limit=3).count() == 3
    assert {r.artifact_type for r in engine.tables.read("points").select("artifact_type").distinct().collect()} == {"chunk", "function_summary", "class_summary", "file_summary"}
    nodes, edges = engine.get_graph("pkg.a.run", "callees", 1)
    assert edges.count() >= 0 and nodes.count() >= 0
    package = engine.get_context("helper").first()
    assert any(s.fqn == "pkg.b.helper" for s in package.symbols) and package.total_tokens <= 8192
    (tree / "pkg" / "b.py").write_text("def helper(x, y):\n    return y\n")
    (tree / "notes.md").unlink()
    (tree / "new.py").write_text("def fresh():\n    pass\n")
    assert {r.state: r.n_files for r in engine.update(str(tree)).collect()} == {"same": 1, "modified": 1, "deleted": 1, "new": 1}
    assert {r.state for r in engine.update(str(tree)).collect()} == {"same"}
    assert {r.file_path for r in engine.tables.read("files").collect()} == {"pkg/a.py", "pkg/b.py", "new.py"}
    assert engine.status().first().n_files == 3 and engine.repositories().count() == 1
    engine.reset()
    assert not engine.tables.exists("files")
