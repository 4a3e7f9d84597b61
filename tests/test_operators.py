import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codeloom.functions import vectors
from codeloom.operators import chunking, context, graph, metrics, resolve, retrieval, store
from codeloom.plans import reference
from codeloom.sources import exchange, files
from codeloom.streaming import debounce


def edges_of(spark, pairs, kind="call"):
    return spark.createDataFrame([(a, b, kind, False, 1.0, "f", 1) for a, b in pairs], "source_id string, target_id string, edge_type string, inferred boolean, confidence double, file_path string, line int")


# ------------------------------------------------------------------ graph


def test_reach_depth_and_direction(spark):
    e = edges_of(spark, [(f"n{i}", f"n{i + 1}") for i in range(6)] + [("n3", "n0")])
    assert {(r.symbol_id, r.distance) for r in graph.reach(e, "n0", 3).collect()} == {("n1", 1), ("n2", 2), ("n3", 3)}
    assert {r.symbol_id for r in graph.reach(e, "n0", 2, backward=True).collect()} == {"n3", "n2"}
    assert graph.reach(e, "nowhere", 3).count() == 0
    assert graph.induced_edges(e, "n0", 3).count() == 4


def slow_pagerank(pairs, rounds):
    nodes = sorted({x for p in pairs for x in p})
    out = {n: [b for a, b in pairs if a == n] for n in nodes}
    rank = {n: 1 / len(nodes) for n in nodes}
    for _ in range(rounds):
        lost = sum(rank[n] for n in nodes if not out[n]) / len(nodes)
        rank = {n: 0.15 / len(nodes) + 0.85 * (lost + sum(rank[a] / len(out[a]) for a in nodes if n in out[a])) for n in nodes}
    return rank


def test_pagerank_known_graphs(spark):
    cases = [[("A", "B"), ("B", "C")], [("A", "D"), ("B", "D"), ("C", "D")], [("A", "B"), ("B", "C"), ("C", "A")], [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E")]]
    for pairs in cases:
        got = {r.symbol_id: r.score for r in graph.pagerank(edges_of(spark, pairs + pairs[:1]), iterations=20, tolerance=0).collect()}
        want = slow_pagerank(pairs, 20)
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
        assert math.isclose(sum(got.values()), 1, abs_tol=1e-9)
    assert graph.pagerank(edges_of(spark, [])).count() == 0


def test_cycles_and_order(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("x", "x"), ("c", "d"), ("p", "q")], "import")
    assert {r.cycle for r in graph.cycles(e).collect()} == {"a > b > c", "a > b"}
    assert {(r.symbol_id, r.level) for r in graph.topological_levels(e).collect()} == {("p", 0), ("q", 1)}
    diamond = edges_of(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "import")
    assert [r.symbol_id for r in graph.topological_order(diamond).orderBy("position").collect()] == ["a", "b", "c", "d"]
    assert {(r.symbol_id, r.level) for r in graph.topological_levels(diamond).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    rng = random.Random(8)
    dag = edges_of(spark, [(f"v{i:02d}", f"v{rng.randrange(i + 1, 31):02d}") for i in range(30) for _ in range(2)] + [("v30", "loop"), ("loop", "loop2"), ("loop2", "loop")], "import")
    want = {tuple(r) for r in graph.topological_levels(dag).collect()}
    for limit in (0, 8, 20):
        assert {tuple(r) for r in graph.topological_levels(dag, local_edges=limit).collect()} == want
    assert len(want) == 31
    assert graph.cycles(edges_of(spark, [])).count() == 0 and graph.topological_levels(edges_of(spark, [])).count() == 0


def slow_cycles(pairs):
    """Every simple path from its smallest symbol that closes."""
    out, todo = set(), [[a] for a in {a for a, _ in pairs}]
    while todo:
        path = todo.pop()
        for a, b in pairs:
            if a == path[-1] and b == path[0] and len(path) > 1:
                out.add((" > ".join(path), len(path)))
            elif a == path[-1] and b > path[0] and b not in path:
                todo.append([*path, b])
    return out


def test_cycles_of_any_length(spark):
    ring = [(f"r{i:02d}", f"r{(i + 1) % 12:02d}") for i in range(12)]
    rng = random.Random(3)
    dense = list({(f"d{rng.randrange(9)}", f"d{rng.randrange(9)}") for _ in range(30)})
    pairs = [*ring, ("r04", "r00"), *dense, ("d3", "r02"), ("r05", "x"), ("x", "y"), ("y", "x"), ("y", "z")]
    want = slow_cycles([p for p in pairs if p[0] != p[1]])
    assert max(n for _, n in want) == 12 and len(want) > 20
    for local in (graph.LOCAL_EDGES, 0):
        assert sorted(map(tuple, graph.cycles(edges_of(spark, pairs, "import"), local_edges=local).collect())) == sorted(want)
        assert sorted(map(tuple, graph.cycles(edges_of(spark, pairs, "import"), 4, local_edges=local).collect())) == sorted(w for w in want if w[1] <= 4)


def slow_order(pairs):
    left, out = {x for p in pairs for x in p}, []
    while ready := sorted(x for x in left if not any(b == x and a in left for a, b in pairs)):
        out.append(ready[0])
        left.discard(ready[0])
    return out


def test_order_of_many_components(spark, tmp_path):
    rng = random.Random(11)
    names = [f"s{i:02d}" for i in range(40)]
    rng.shuffle(names)
    pairs = [(names[i], names[j]) for i in range(40) for j in range(i + 1, 40) if i % 5 == j % 5 and rng.random() < 0.3]
    pairs = list({*pairs, ("b", "a"), ("z", "c"), ("loop", "loop2"), ("loop2", "loop"), ("loop2", "behind")})
    want = slow_order(pairs)
    assert len(want) > 30 and "behind" not in want
    for local in (graph.LOCAL_EDGES, 0):
        assert [r.symbol_id for r in graph.topological_order(edges_of(spark, pairs, "import"), local_edges=local).orderBy("position").collect()] == want
    assert {tuple(r) for r in graph.topological_order(edges_of(spark, pairs, "import"), local_edges=0).select("position").collect()} == {(i + 1,) for i in range(len(want))}
    edges_of(spark, pairs, "import").write.parquet(str(tmp_path / "graph_edges.parquet"))
    assert [r.symbol_id for r in reference.import_order(spark, str(tmp_path)).orderBy("position").collect()] == want


def test_inferred_edges_can_be_left_out(spark):
    e = edges_of(spark, [("a", "b")]).unionByName(edges_of(spark, [("b", "c")], "inferred"))
    assert graph.reach(graph.clean_edges(e), "a", 5).count() == 2
    assert graph.reach(graph.clean_edges(e, include_inferred=False), "a", 5).count() == 1


def test_resolution_steps(spark):
    symbols = spark.createDataFrame([("m.a.run",), ("m.b.run",), ("m.a.only",), ("p.q.z",), ("m.a.local.run",)], "fqn string")
    refs = spark.createDataFrame([("m.a.run", "m/a.py"), ("only", "x.py"), ("run", "m/a.py"), ("run", "k.py"), ("none", "m/a.py"), (" only ", "x.py"), (None, "x.py")], "name string, file_path string")
    got = [(r.name, r.file_path, r.target_fqn, r.step) for r in resolve.resolve_names(refs, symbols).collect()]
    assert ("m.a.run", "m/a.py", "m.a.run", "exact") in got and ("only", "x.py", "m.a.only", "suffix") in got and (" only ", "x.py", "m.a.only", "suffix") in got
    assert ("run", "m/a.py", "m.a.run", "module") in got and ("run", "k.py", None, None) in got and (None, "x.py", None, None) in got


# ------------------------------------------------------------------ retrieval


def test_rank_fusion_formula(spark):
    lists = spark.createDataFrame([("l1", "a", 2.0), ("l1", "b", 1.0), ("l2", "b", 9.0), ("l2", "a", 8.0), ("l3", "c", 1.0)], "list_id string, item_id string, score double")
    got = {r.item_id: r.fused for r in retrieval.rank_fusion(lists).collect()}
    assert got["a"] == pytest.approx(1 / 61 + 1 / 62) == got["b"] and got["c"] == pytest.approx(1 / 61)


def test_merge_hits(spark):
    schema = "chunk_id string, file_path string, start_line int, end_line int, content string, score double"
    v = spark.createDataFrame([("v1", "a", 1, 10, "", 0.8), ("v2", "a", 20, 30, "", 0.4)], schema)
    t = spark.createDataFrame([("t1", "a", 2, 5, "", 1.0), ("t2", "a", 9, 12, "", 1.0), ("t3", "b", 2, 5, "", 0.5)], schema)
    got = {r.chunk_id: r.score for r in retrieval.merge_hits(v, t).collect()}
    assert got == {"v1": 0.8, "v2": 0.4, "t2": pytest.approx(0.8), "t3": pytest.approx(0.4)}
    assert {r.chunk_id for r in retrieval.merge_hits(v.limit(0), t).collect()} == {"t1", "t2", "t3"}
    assert [r["rank"] for r in retrieval.api_rows(retrieval.merge_hits(v, t)).collect()] == [1, 2, 3, 4]


def test_vector_search_and_index(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) + 3 * (i % 4 == d) for d in range(8)], "chunk", f"f{i % 3}.py") for i in range(400)]
    points = spark.createDataFrame(rows, "chunk_id int, vector array<double>, artifact_type string, file_path string")
    query = rows[0][1]
    want = sorted(rows, key=lambda r: (-sum(a * b for a, b in zip(r[1], query, strict=True)) / math.dist(r[1], [0] * 8), r[0]))[:10]
    assert [r.chunk_id for r in retrieval.vector_search(points, query, 10).collect()] == [w[0] for w in want]
    assert all(r.file_path == "f1.py" for r in retrieval.vector_search(points, query, 10, "f1*").collect())
    index = retrieval.VectorIndex(points, cells=8, sample=200)
    assert index.points.count() == 400
    found = hits = 0
    for q in range(0, 400, 50):
        exact = {r.chunk_id for r in retrieval.vector_search(points, rows[q][1], 10).collect()}
        hits += len(exact & {r.chunk_id for r in index.search(rows[q][1], 10).collect()})
        found += 10
    assert hits / found >= 0.9
    assert retrieval.similar_to(points, 7, 5).where("chunk_id = 7").count() == 0


def test_line_queries_read_carriage_returns(spark, tmp_path):
    text = "x\r\nGiving up after it\r\nReturns the limit held\rdef an_edge(\nnothing left to do\r\n"
    spark.createDataFrame([("a.py", text), ("b.py", None)], "file_path string, content string").write.parquet(str(tmp_path / "processed_files.parquet"))
    want = {"grep_substring": 2, "grep_case_sensitive": 3, "grep_all_terms": 3, "grep_regex": 4}
    for name, line in want.items():
        assert [tuple(r) for r in reference.QUERIES[name](spark, str(tmp_path)).collect()] == [("a.py", line)], name
    top = reference.grep_context_top(spark, str(tmp_path)).collect()
    assert [(r.start_line, r.match_line, r.end_line, r.content.split("\n")[-1]) for r in top] == [(2, 5, 5, "nothing left to do")]


def test_search_modes(spark):
    files_ = spark.createDataFrame([("a.py", "alpha beta\ngamma\n"), ("tests/b.py", "alpha\n")], "file_path string, content string")
    embed = vectors.hash_embedder(16)
    points = files_.select(F.col("file_path").alias("chunk_id"), "file_path", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "content", F.lit("chunk").alias("artifact_type"), embed("content").alias("vector"))
    for mode in retrieval.MODES:
        got = retrieval.search(points, files_, "alpha -path:tests", lambda q: vectors.hash_vector(q, 16), mode)
        assert all("tests" not in r.file_path for r in got.collect())
    with pytest.raises(ValueError):
        retrieval.search(points, files_, "x", lambda q: [0.0], "other")


# ------------------------------------------------------------------ store


def test_upsert_and_diff(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "k string, v int")
    assert {tuple(r) for r in store.upsert(old, new, ["k"], [F.col("v")]).collect()} == {("a", 1), ("b", 3), ("c", 1)}
    scan = spark.createDataFrame([("n", "1"), ("s", "2"), ("m", "3")], "file_path string, content_hash string")
    stored = spark.createDataFrame([("s", "2"), ("m", "0"), ("d", "9")], "file_path string, content_hash string")
    assert {tuple(r) for r in store.diff_files(scan, stored).collect()} == {("n", "new"), ("s", "same"), ("m", "modified"), ("d", "deleted")}
    assert tuple(store.file_stats(spark.createDataFrame([], "chunk_count int, line_count int")).first()) == (0, 0, 0)


def test_folder_store_swaps_whole_tables(spark, tmp_path):
    s = store.FolderStore(spark, str(tmp_path / "store"))
    assert not s.exists("t")
    s.write("t", spark.range(3))
    s.upsert("t", spark.range(2, 5), ["id"])
    assert sorted(r.id for r in s.read("t").collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(Exception):  # noqa: B017
        s.write("t", spark.range(1).select(F.raise_error(F.lit("lost")).alias("id")))
    assert s.read("t").count() == 5
    s.drop("t")
    assert not s.exists("t")


def test_nearest_root(spark):
    paths = spark.createDataFrame([("a/b/c.py",), ("a/x.py",), ("z.py",), ("ab/q.py",)], "file_path string")
    roots = spark.createDataFrame([("a",), ("a/b",)], "root_path string")
    assert {tuple(r) for r in store.nearest_root(paths, roots).collect()} == {("a/b/c.py", "a/b"), ("a/x.py", "a")}


def test_graph_export_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A", "class", "f.py", 1, 2, "python")], exchange.NODE)
    e = edges_of(spark, [("a", "b")])
    scores = spark.createDataFrame([("a", "call", 0.5, datetime(2025, 1, 1))], exchange.SCORE)
    exchange.export_graph(nodes, e, scores, str(tmp_path / "g"))
    back = exchange.import_graph(spark, str(tmp_path / "g"))
    assert back["nodes"].collect() == nodes.collect() and back["pagerank"].collect() == scores.collect()
    assert sorted(map(tuple, back["edges"].collect())) == sorted(map(tuple, e.select(back["edges"].columns).collect()))
    with pytest.raises(ValueError):
        exchange.import_graph(spark, "x", "other")
    (tmp_path / "q.json").write_text('{"queries": [{"query": "a", "relevant_files": ["x", "y"]}]}')
    assert tuple(exchange.read_evaluation(spark, str(tmp_path / "q.json")).first()) == ("a", ["x", "y"])


def test_scan_tree(spark, tmp_path):
    root = tmp_path / "home" / "tree"
    for name, data in {"a.py": b"x = 1\n", "b.txt": b"no", "bin.py": b"a\0b", "latin.py": b"\xff\xfe", "sub/c.js": b"let a", "sub/skip.js": b"1", ".env": b"S=1", "node_modules/m.js": b"1", ".gitignore": b"skip.js\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    got = {r.file_path: (r.language, r.line_count) for r in files.scan_tree(spark, str(root)).collect()}
    assert got == {"a.py": ("python", 2), "sub/c.js": ("javascript", 1)}


# ------------------------------------------------------------------ chunks and context


def test_fixed_chunks_cover_all_lines(spark):
    texts = ["", "a", "\n".join(map(str, range(50))), "\n".join(map(str, range(51))), "\n".join(map(str, range(149)))]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("none", None)], "file_path string, content string")
    closed = sorted(map(tuple, chunking.fixed_chunks(rows).collect()))
    assert closed == sorted(map(tuple, chunking.fit_chunks(rows, limit=10**6).collect()))
    for i, t in enumerate(texts):
        own = [c for c in closed if c[0] == str(i)]
        assert {n for _, a, b, _ in own for n in range(a, b + 1)} == set(range(1, t.count("\n") + 2))
    small = chunking.fit_chunks(rows, limit=10).collect()
    assert all(len(r.content) <= 40 or r.start_line == r.end_line for r in small)


def test_symbol_chunks_split_at_good_lines(spark):
    body = "def f():\n" + "\n".join(f"    a{i} = {i}" + ("\n" if i % 9 == 8 else "") for i in range(80))
    node = spark.createDataFrame([("f.py", "function", "f", None, 5, 5 + body.count("\n"), body, "Says much.", "python")], "file_path string, node_type string, name string, parent_name string, start_line int, end_line int, content string, docstring string, language string")
    parts = chunking.symbol_chunks(node, limit=100).orderBy("part").collect()
    assert len(parts) > 1 and parts[0].content.startswith("Says much.\n---\ndef f()") and all(p.content.startswith("# Context: function f\n") for p in parts[1:])
    bare = [parts[0].content.split("---\n", 1)[1]] + [p.content.split("\n", 1)[1] for p in parts[1:]]
    assert "\n".join(bare) == body and all(b.endswith("\n") for b in bare[:-1])
    assert [p.start_line for p in parts[1:]] == [p.end_line + 1 for p in parts[:-1]] and parts[0].start_line == 5
    assert chunking.symbol_chunks(node, limit=10_000).count() == 1


def test_summaries(spark):
    schema = "node_id int, file_path string, node_type string, name string, parent_name string, start_line int, content string, docstring string, language string"
    rows = [(1, "x/m.py", "class", "A", None, 1, "class A(B, C[T]):\n  pass", "Doc one.\nstill.\n\nLater.", "python"), (2, "x/m.py", "method", "run", "A", 2, "def run(self, a, b=2) -> int:\n  pass", None, "python"), (2, "x/m.py", "method", "run", "A", 2, "def run(self, a, b=2) -> int:\n  pass", None, "python"), (3, "x/m.py", "function", "go", None, 9, "def go():\n  pass", '"""Goes."""', "python")]
    nodes = spark.createDataFrame(rows, schema)
    assert {r.node_id: r.content for r in chunking.function_summaries(nodes.dropDuplicates()).collect()} == {2: "Function `run` takes parameters (a, b) and returns int.", 3: "Function `go`. Goes."}
    assert chunking.class_summaries(nodes).first().content == "Class `A` extends B, C. Methods: run. Doc one. still."
    imports = spark.createDataFrame([("x/m.py", ["import os.path", "from a.b import c", "import os", "x"])], "file_path string, imports array<string>")
    assert chunking.file_summaries(nodes, imports).first().content == "File `m.py` (python). Imports: os, a. Contains classes: A; functions: go."


def test_budget_keeps_the_important(spark):
    rows = [("low", "x" * 400, "", [], [], 0.1), ("high", "y" * 400, "", [], [], 0.9), ("mid", "line\n" * 200, "sum", ["c"] * 3, [], 0.5)]
    described = spark.createDataFrame(rows, "fqn string, source_code string, summary string, callers array<string>, callees array<string>, pagerank double")
    got = context.apply_budget(described, 200).collect()
    assert [r.fqn for r in got] == ["high", "mid"] and got[1].is_cut and got[1].callers == [] and sum(r.tokens for r in got) <= 200
    assert [r.fqn for r in context.apply_budget(described, 10_000).collect()] == ["high", "mid", "low"]
    assert context.apply_budget(described.limit(0), 10).count() == 0


def test_metrics(spark):
    results = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1)], "query_id int, item_id string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "z"), (2, "q"), (1, "b")], "query_id int, item_id string")
    assert {r.query_id: r.recall_at_5 for r in metrics.recall_at(results, relevant).collect()} == {1: 0.5, 2: 0.0}
    assert {r.query_id: r.rr for r in metrics.reciprocal_ranks(results, relevant).collect()} == {1: 0.5, 2: 0.0}
    assert tuple(metrics.latency_summary(spark.createDataFrame([], "v double"), "v").first()) == (0, 0.0, 0.0, 0.0)


# ------------------------------------------------------------------ events


def event_rows(spark, rows):
    start = datetime(2025, 1, 1)
    return spark.createDataFrame([(k, p, o, start + timedelta(seconds=t), "r") for k, p, o, t in rows], debounce.EVENT)


def test_merge_of_events(spark):
    rows = [("created", "a.py", None, 0), ("deleted", "a.py", None, 1), ("created", "b.py", None, 0), ("modified", "b.py", None, 1), ("deleted", "c.py", None, 0), ("created", "c.py", None, 1), ("moved", "new.py", "old.py", 0), ("moved", "only.py", None, 0), ("modified", "d.py", None, 0), ("deleted", "d.py", None, 2)]
    got = {r.file_path: r.state for r in debounce.merge_events(event_rows(spark, rows)).collect()}
    assert got == {"b.py": "created", "c.py": "modified", "new.py": "created", "old.py": "deleted", "only.py": "created", "d.py": "deleted"}


def test_event_filter(spark):
    rows = [("moved", "a.py", "a.txt", 0), ("moved", "b.txt", "b.py", 0), ("created", "c.txt", None, 0), ("modified", "d.py", None, 0), ("other", "e.py", None, 0)]
    got = {(r.event_type, r.file_path) for r in debounce.accept_events(event_rows(spark, rows), [".py"]).collect()}
    assert got == {("created", "a.py"), ("deleted", "b.py"), ("modified", "d.py")}


def test_stream_of_sessions(spark, tmp_path):
    rows = [("created", "a.py", None, 0), ("modified", "a.py", None, 1), ("modified", "b.py", None, 10), ("deleted", "z.py", None, 100)]
    event_rows(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(debounce.EVENT).parquet(str(tmp_path / "in"))
    seen = []
    debounce.watch(debounce.debounced_stream(stream), lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"), once=True).awaitTermination(120)
    states = sorted((c.file_path, c.state) for r in seen for c in r.changes)
    assert ("a.py", "created") in states and ("b.py", "modified") in states
