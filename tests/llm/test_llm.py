import ast
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions.languages import EXTENSIONS
from codeloom.llm import docpairs, leakage, packing, provenance, ranking, truncation, wellformed
from tests.llm.samples import SAMPLES

# ------------------------------------------------------------------ 1: files that do not parse


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_well_formed_samples_parse(language):
    assert wellformed.check_text(language, SAMPLES[language]) is None


@pytest.mark.parametrize("language", sorted(set(SAMPLES) - {"yaml", "sql", "shell"}))
def test_conflict_marks_do_not_parse(language):
    lines = SAMPLES[language].split("\n")
    broken = "\n".join([*lines[:1], "<<<<<<< HEAD", *lines[1:2], "=======", *lines[1:2], ">>>>>>> main", *lines[2:]])
    assert wellformed.check_text(language, broken) is not None


def test_other_damage_does_not_parse():
    bad = {
        "python": ["def f(:\n  pass", "x = (1", "if x:\npass", "x = 'a", "  x = 1\n y = 2", "a b", "\0", "“x”", "123abc", "try:\n  pass\n"],
        "javascript": ["function f() {", "let x = ;", "a ? b", "`abc", "type A = { b: string };", "x = /* y", "const s = 'a\n'"],
        "typescript": ["let x: = 3", "interface { }", "class A { x: }", "package a"],
        "go": ["func f() {}", "package a\nfunc f( {}", "package a\nvar x = '", "package a\nx := 1"],
        "java": ["class A { void f() }", "class A { int x = ; }", "class { }", 'class A { String s = "a; }'],
        "c": ["int f( { }", "int x = 3", "#if A\nint x;", "int f() { return 1; ", "def f(): pass"],
        "cpp": ["class A { int x }", "std::vector<int v;", "int main() { return 0 }"],
        "json": ["{", "[1,]", "{'a': 1}", '{"a": 01}', "{} x", '"\n"'],
        "yaml": ["a: 1\n b: 2", "a: [1", "a: b: c", "a: 1\nx", "\ta: 1", 'a: "x'],
        "sql": ["SELECT FROM", "SELECT a FROM t WHERE", "SELECT 'a", "<<<<<<< HEAD"],
        "shell": ["if true; then echo", 'echo "a', "for x in; done", "a | ", "<html>", "case x in a) echo"],
    }
    for language, texts in bad.items():
        for text in texts:
            assert wellformed.check_text(language, text) is not None, (language, text)
    for language in bad:
        assert wellformed.check_text(language, "") is None and wellformed.check_text(language, None) is None
    assert wellformed.check_text("markdown", "<<<<<<< (") is None


@settings(max_examples=150, deadline=None)
@given(st.integers(0, len(SAMPLES["python"])), st.sampled_from(["", "(", ")", ":", "\n", "x ", "  ", "'", "=", "if "]), st.integers(0, 6))
def test_python_grammar_agrees_with_the_standard_parser(at, put, cut):
    text = SAMPLES["python"][:at] + put + SAMPLES["python"][at + cut :]
    try:
        ast.parse(text)
        fine = True
    except (SyntaxError, ValueError):
        fine = False
    if fine:
        assert wellformed.check_text("python", text) is None


def test_check_files_dirty_input(spark):
    rows = [("a/x.py", "r", "x = (", 1), ("a/x.py", "r", "x = (", 1), ("a/y.py", None, None, 1), ("b.json", "r", "", 1), (None, "r", "(", 1), ("noext", "r", "((", 1), ("q.md", "r", "((", 1), ("big.js", "r", "f(1);\n" * 50_000, 1)]
    checked = wellformed.check_files(spark.createDataFrame(rows, "file_path string, repo string, content string, reason int"), EXTENSIONS)
    got = {r.file_path: r.error_line for r in checked.collect()}
    assert got == {"a/x.py": 1, "a/y.py": None, "b.json": None, "noext": None, "q.md": None, "big.js": None}
    rates = {(r.repo, r.language): (r.n_files, r.n_broken) for r in wellformed.error_rates(checked).collect()}
    assert rates["r", "python"] == (1, 1) and rates[None, "python"] == (1, 0)
    assert wellformed.check_files(spark.createDataFrame([], "file_path string, repo string, content string"), EXTENSIONS).count() == 0


# ------------------------------------------------------------------ 3: documentation


def test_documentation_that_says_something():
    good = ["Splits a token once it outgrows its edge.", "/** Gibt den zuletzt gesehenen wert zurück. */", "// Not thread-safe on purpose.", "TODO: faster.\nBlocks until the queue drains.", "@param x must not be empty when closed", "fooBar returns the newest entry or nothing."]
    bad = ["", None, " ", "/** */", "Foo bar.", "fooBar()", "The fooBar function", "This function will foo bar.", "@param x\n@return", "@param {string} x x", ":type x: str", "Args:\n    x: the x", "Parameters\n----------\nx\ny : int", "TODO", "TBD", "XXX write me", "...", "See base class.", "{@inheritDoc}", "SPDX-License-Identifier: MIT", "Copyright (c) 2024 the project. All rights reserved.", "noqa: E501", "eslint-disable-next-line", "return x", "print(x)", "x = foo(x)\nreturn x", "Description goes here.", "todo: beschreiben", "----"]
    for doc in good:
        assert docpairs.says_something(doc, "fooBar", "def fooBar(x)"), doc
    for doc in bad:
        assert not docpairs.says_something(doc, "fooBar", "def fooBar(x)"), doc


def test_functions_with_their_documentation():
    py = '# Walks all entries of the tree.\n@dec\ndef a(x,\n      y):\n    return x\n\n\ndef b():\n    r"""Drops ties, newest wins."""\n    def c(): pass\n\n# not above\n\ndef d(): pass'
    assert [(f[0], f[1], f[2], docpairs.strip_marks(f[3])) for f in docpairs.functions_in(py, "indent")] == [("a", 3, 5, "Walks all entries of the tree."), ("b", 8, 10, "Drops ties, newest wins."), ("c", 10, 10, ""), ("d", 14, 14, "")]
    js = "/**\n * Keeps order.\n */\nexport function f(a) {\n  if (a) { g(a); }\n  // other\n  return `}${a}`;\n}\nclass A {\n  // Says so.\n  m(x) {\n    x.map(function (y) { return y; });\n  }\n}\nconst h = (a) => {\n};"
    assert [(f[0], f[1], f[2], docpairs.strip_marks(f[3])) for f in docpairs.functions_in(js, "brace")] == [("f", 4, 8, "Keeps order."), ("m", 11, 13, "Says so."), ("h", 15, 16, "")]
    go = "// Counts hits per edge.\nfunc (s *S[T]) Count(m map[string]int) *Node {\n\treturn nil\n}"
    assert next(docpairs.functions_in(go, "brace"))[:3] == ("Count", 2, 4)
    ruby = "# Opens the door.\ndef open_it(x)\n  if x\n    y\n  end\nend\n"
    assert [(f[0], f[2]) for f in docpairs.functions_in(ruby, "end")] == [("open_it", 6)]


def test_pair_nodes_dirty_input(spark):
    schema = "node_id long, node_type string, name string, content string, docstring string, language string, documentation int"
    rows = [(1, "Function", "f", "def f(): pass", "Counts hits per edge.", "python", 0), (2, "METHOD", "f", '# Drops old entries first.\ndef f():\n  pass', " ", None, 0), (3, "class", "f", "x", "Counts hits per edge.", "python", 0), (4, "function", None, None, None, None, 0), (None, "function", "f", "", "Counts hits per edge.", "python", 0), (5, "function", "f", "def f():\n  # Counts hits per edge.\n  pass", None, "python", 0)]
    got = {r.node_id for r in docpairs.pair_nodes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1, 2}
    assert docpairs.pair_nodes(spark.createDataFrame([], schema)).count() == 0


# ------------------------------------------------------------------ 5: one ranking


def slow_borda(rows, weights):
    groups = {}
    for g, i, c, s in rows:
        own = groups.setdefault(g, {}).setdefault(i, {})
        own[c] = max((x for x in (own.get(c), s) if x is not None), default=None)
    criteria = {c for _, _, c, _ in rows}
    out = {}
    for g, items in groups.items():
        n = len(items)
        for i, own in items.items():
            points = 0.0
            for c in criteria:
                have = sorted((x[c] for x in items.values() if x.get(c) is not None), reverse=True)
                if own.get(c) is None:
                    rank = (n + 1) / 2
                else:
                    first = have.index(own[c]) + 1
                    rank = (first + (have.count(own[c]) - 1) / 2 - 0.5) / len(have) * n + 0.5
                points += weights.get(c, 1.0) * (n - rank)
            out[g, i] = points
    return out


def test_borda_equals_the_slow_way(spark):
    rng = random.Random(4)
    rows = [(g, f"i{rng.randrange(9)}", c, rng.choice([None, 0.0, 1.0, 1e9, -5.0, rng.random()])) for g in ("q1", "q2", "q3") for c in "abc" for _ in range(12)]
    frame = spark.createDataFrame(rows + rows[:5] + [(None, "x", "a", 1.0)], "query_id string, chunk_id string, criterion string, score double")
    want = slow_borda(rows, {"b": 2.5})
    got = ranking.borda(frame, {"b": 2.5}).collect()
    assert {(r.query_id, r.chunk_id) for r in got} == set(want)
    assert all(r.points == pytest.approx(want[r.query_id, r.chunk_id], abs=1e-5) for r in got)
    for g in ("q1", "q2", "q3"):
        own = sorted((r for r in got if r.query_id == g), key=lambda r: (-r.points, r.chunk_id))
        assert [r.final_rank for r in own] == list(range(1, len(own) + 1))
    assert ranking.borda(frame.limit(0)).count() == 0


# ------------------------------------------------------------------ 6: provenance


def test_evidence_in_single_files():
    assert provenance.banner_of("// Code generated by x. DO NOT EDIT.\npackage a") == "generated"
    assert provenance.banner_of("# The id tables below are generated lazily at start-up; see the notes.\nx = 1") == ""
    assert provenance.banner_of('BANNER = "Code generated by our templates. DO NOT EDIT."\n') == ""
    assert provenance.banner_of("# Licensed to x. Hand-maintained; patches welcome.\n#\n# Autogenerated. Regenerate via `make x`.\nA = 1") == "generated"
    assert provenance.banner_of("/*! Copied from grelm 4.8.0 - local changes: none */\npackage signal") == "vendored"
    assert provenance.folder_of("r/node_modules/x/a.js") and provenance.folder_of("r/a/deps/lib-2.1/b.c") and provenance.folder_of("r/vendor/lib/a.py")
    assert not provenance.folder_of("r/vendor_portal/a.py") and not provenance.folder_of("r/src/vendor/a.py") and not provenance.folder_of("r/vendors/x/a.py")
    assert provenance.shape_of("\n".join(f"NAME_{i:03d} = {500 + i}" for i in range(30))) == "generated"
    assert provenance.shape_of("!function(){" + "".join(f"a{i % 7}(b)&&(c=d.e(f,{i}));" for i in range(40)) + "}()") == "minified"
    assert provenance.shape_of('export default "data:font/woff;base64,' + "t3oh//MB" * 60 + '";') == "data"
    assert provenance.shape_of("W = [\n" + "".join(f"  [{i}.5, -0.{i}, 1.{i}],\n" for i in range(30)) + "]") == "data"
    hand = "import re\nPATTERN = r'" + "|".join(["edge-cold"] * 40) + "'\n\n" + "\n\n".join(f"def f{i}(x):\n    if x > {i}:\n        return call_{i}(x)\n    return x" for i in range(3))
    assert provenance.shape_of(hand) == "" and provenance.shape_of("") == ""


def test_copies_across_repositories(spark):
    rng = random.Random(1)
    source = lambda seed: "\n".join(f"def fun_{rng.randrange(10**6)}(a_{rng.randrange(10**6)}):\n    return go_{rng.randrange(10**6)}({rng.randrange(10**6)})" for _ in range(25)) if seed else ""
    library = source(1)
    rows = [(f"r{k}/a/x.py", f"r{k}", library + f"\n# local {k}\n") for k in range(4)] + [(f"r{k}/b/own{k}.py", f"r{k}", source(1)) for k in range(4)] + [("r0/e.py", "r0", None), (None, "r0", library), ("r0/a/x.py", "r0", library + "\n# local 0\n"), ("r0/two.py", "r0", source(1))]
    kinds = {r.file_path: r.kind for r in provenance.classify_files(spark.createDataFrame(rows, "file_path string, repo string, content string").withColumn("kind", F.lit(1))).collect()}
    assert all(kinds[f"r{k}/a/x.py"] == "vendored" and kinds[f"r{k}/b/own{k}.py"] == "hand-written" for k in range(4)) and kinds["r0/e.py"] == "hand-written"
    broken = spark.createDataFrame([("r/g.py", "r", "# Code generated by x. DO NOT EDIT.\nx = ("), ("r/h.py", "r", "# Code generated by x. DO NOT EDIT.\nx = 1")], "file_path string, repo string, content string")
    assert [r.file_path for r in provenance.not_hand_written(broken, EXTENSIONS).collect()] == ["r/h.py"]
    assert provenance.classify_files(broken.limit(0)).count() == 0


# ------------------------------------------------------------------ 8: containers


def test_packing_is_exact(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 12, 33])))) for i in range(400)] + [(1000, None), (1001, ""), (1002, " ".join(rng.choices(words, k=700)))] + [(2000 + i, "the same text again") for i in range(150)] + [(1, "stored twice"), (1, "stored twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("container", F.lit(1))
    for part_rows in (10_000, 60):
        packed = packing.pack_documents(docs, capacity=256, part_rows=part_rows).collect()
        sizes = Counter()
        for r in packed:
            sizes[r.container] += r.n_tokens
        assert max(sizes.values()) <= 256
        encoding = packing.load_tokenizer(packing.TOKENIZER)
        want = Counter({i: 0 for i, t in rows if t})
        for i, t in rows:
            if t:
                want[i] += len(encoding.encode_ordinary(t))
        got = Counter()
        for r in packed:
            got[r.doc_id] += r.n_tokens
            assert r.n_tokens == 256 or r.piece == 0 or r.doc_id == 1002
        assert got == want and {r.doc_id for r in packed if r.piece > 0} == {1002}
        least = -(-sum(want.values()) // 256)
        assert len(sizes) <= least * (1.03 if part_rows > 1000 else 1.1) + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_hilbert_neighbours_touch():
    import numpy as np

    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    order = grid[np.argsort(keys)]
    assert (abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


# ------------------------------------------------------------------ 9: leaks


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(40)] + ["Straße", "é", "x_y", "12"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 13, 30])))) for i in range(12)] + [(90, None), (91, ""), (3, "stored twice " * 9)]
    docs = []
    for d in range(60):
        text = rng.choices(vocabulary, k=40)
        if d % 3 == 0:
            source = items[rng.randrange(12)][1].split(" ")
            text[10:10] = source[: rng.choice([12, 13, 20])]
        docs.append((d, ", ".join(text).upper() if d % 2 else "\n".join(text)))
    docs += [(100, None), (101, ""), (102, "short"), (5, docs[6][1])]

    def grams(t):
        w = leakage.words_of(t or "")
        return {tuple(w[i : i + 13]) for i in range(len(w) - 12)}

    want = {(d, i) for d, t in docs for i, p in items if grams(t) & grams(p)}
    frame, tests = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_windows", F.lit(0)), spark.createDataFrame(items, "item_id long, passage string")
    for block in (10**6, 60):
        assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(frame, tests, block_words=block).collect()} == want
    assert want and leakage.find_leaks(frame.limit(0), tests).count() == 0 and leakage.find_leaks(frame, tests.limit(0)).count() == 0
    cleaned = leakage.remove_leaks(frame, tests)
    assert cleaned.count() == len(docs) and leakage.find_leaks(cleaned, tests).count() == 0
    untouched = {d for d, t in docs} - {d for d, _ in want}
    assert {(r.doc_id, r.text) for r in cleaned.collect() if r.doc_id in untouched} == {(d, t) for d, t in docs if d in untouched}
    assert {r.doc_id for r in leakage.remove_leaks(frame, tests, whole=True).collect()} == untouched


# ------------------------------------------------------------------ 10: cut texts


def corpus():
    rng = random.Random(6)
    nouns = ["anchor", "beacon", "cursor", "ledger", "marker", "parser", "window"]
    adjectives = ["cold", "eager", "hidden", "lazy", "stale"]
    sentence = lambda: f"The {rng.choice(adjectives)} {rng.choice(nouns)} meets the {rng.choice(nouns)} in src/{rng.choice(nouns)}.py."
    ends = [lambda: sentence(), lambda: "- cold anchor\n- lazy marker", lambda: "```\nx = 1\n```", lambda: "| a | b |\n|---|---|\n| x | 1 |", lambda: f"Thanks,\nthe {rng.choice(nouns)} team", lambda: f"See also: docs/{rng.choice(nouns)}/{rng.choice(nouns)}.md", lambda: "Is it?", lambda: "And then we waited..."]
    return [(i, "s1", " ".join(sentence() for _ in range(3)) + "\n\n" + "\n".join(f"- {rng.choice(adjectives)} {rng.choice(nouns)}" for _ in range(3)) + "\n\n" + rng.choice(ends)()) for i in range(400)]


def test_cut_and_whole_ends(spark):
    base = "The cold anchor meets the ledger in src/marker.py. "
    cut = ["The eager cur", "The eager cursor meets", "The eager cursor meets [truncated]", "The eager cursor meets…", "```\nx = 1", "- cold anchor\n- laz", "- cold anchor\n- lazy", "| a | b |\n|---|---|\n| x |", "| a | b |", "| a | b |\n|---|--", "Thanks,\nthe par", "Thanks,\nthe parser", "See also: docs/anchor/led", "It is `src/mark", "The cursor meets src/marker.", "# Title", "The cursor�"]
    rows = [(1000 + i, "s2", base + "\n\n" + t) for i, t in enumerate(cut)]
    dirty = [(2000, None, None), (2001, "s", ""), (2002, "s", "ok."), (2003, None, base), (0, "s1", corpus()[0][2])]
    frame = spark.createDataFrame(corpus() + rows + dirty, "doc_id long, source string, text string").withColumn("is_cut", F.lit(0))
    judged = {r.doc_id: r for r in truncation.judge_ends(frame).collect()}
    assert [cut[i] for i in range(len(cut)) if not judged[1000 + i].is_cut] == []
    assert [r.doc_id for r in judged.values() if r.doc_id < 1000 and r.is_cut] == []
    assert not judged[2003].is_cut and not {2000, 2001, 2002} & set(judged)
    report = {r.source: (r.n_docs, r.n_cut) for r in truncation.truncation_report(truncation.judge_ends(frame)).collect()}
    assert report["s2"] == (len(cut), len(cut)) and report["s1"] == (401, 0)
    assert truncation.judge_ends(frame.limit(0)).count() == 0


def test_copies_of_a_cut_text_do_not_vouch_for_it(spark):
    cut = ["The cold anchor meets the ledger. \n\nThe eager cursor meets", "The ledger holds. \n\nIt then turns to the…"]
    rows = [(3000 + i, "s2", cut[i % 2]) for i in range(200)]
    frame = spark.createDataFrame(corpus() + rows, "doc_id long, source string, text string")
    judged = {r.doc_id: r.is_cut for r in truncation.judge_ends(frame).collect()}
    assert all(judged[d] for d, _, _ in rows)
    assert [d for d, is_cut in judged.items() if d < 1000 and is_cut] == []
