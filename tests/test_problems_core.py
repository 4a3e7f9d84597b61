import random
from datetime import datetime

from pyspark.sql import functions as F

from codeloom.operators import hierarchy, incremental, references
from codeloom.operators.skew import hot_keys, join_split_hot


def brute_forest(parent):
    out = {}
    for k in parent:
        seen, at, d = set(), k, 0
        while parent.get(at) and at not in seen:
            seen.add(at)
            at, d = parent[at], d + 1
        out[k] = ("", -1) if at in seen else (at, d)
    return out


def random_forest(n, seed):
    rng = random.Random(seed)
    parent = {}
    for i in range(n):
        parent[f"n{i:04d}"] = None if rng.random() < 0.1 else f"n{rng.randrange(n):04d}" if rng.random() < 0.1 else f"n{max(0, i - rng.randrange(1, 4)):04d}"
    return parent


def test_hierarchy_equals_brute_force_at_any_fragmentation(spark):
    for seed, n in ((1, 300), (2, 40)):
        parent = random_forest(n, seed)
        links = spark.createDataFrame(list(parent.items()), "child string, parent string")
        want = brute_forest(parent)
        for fragments, rows in ((1, 10_000), (5, 10_000), (4, 20)):
            got = hierarchy.resolve_hierarchy(links, fragments=fragments, fragment_rows=rows).collect()
            assert {r["key"]: (r["root"], r["depth"]) for r in got} == want
            for r in got:
                if r["endless"]:
                    assert r["path"] == []
                else:
                    assert len(r["path"]) == r["depth"] + 1 and r["path"][0] == r["root"] and r["path"][-1] == r["key"]
                    assert all(parent[b] == a for a, b in zip(r["path"], r["path"][1:], strict=False))


def test_hierarchy_without_locality_ends_by_doubling(spark):
    rng = random.Random(3)
    names = [f"k{rng.randrange(10**9):09d}" for _ in range(200)]
    links = spark.createDataFrame([(names[i], names[i - 1]) for i in range(1, 200)] + [("loop_a", "loop_b"), ("loop_b", "loop_a")], "child string, parent string")
    got = {r["key"]: r for r in hierarchy.resolve_hierarchy(links, fragments=20, fragment_rows=12).collect()}
    assert all(got[n]["depth"] == i and got[n]["root"] == names[0] for i, n in enumerate(names))
    assert got["loop_a"]["endless"] and got["loop_b"]["depth"] == -1


def test_a_long_cycle_without_locality_carries_no_paths(spark):
    ring = [(f"{i * 7919 % 60:03d}", f"{(i + 1) * 7919 % 60:03d}") for i in range(60)]
    tail = [("x1", "x0"), ("x2", "x1"), ("y1", "000")]
    got = {r["key"]: r for r in hierarchy.resolve_hierarchy(spark.createDataFrame(ring + tail, "child string, parent string"), fragment_rows=4).collect()}
    assert all(got[a]["endless"] and got[a]["path"] == [] for a, _ in ring) and got["y1"]["endless"]
    assert got["x2"]["path"] == ["x0", "x1", "x2"] and got["x2"]["depth"] == 2


def test_hierarchy_with_a_parent_of_many(spark):
    links = spark.range(30_000).select(F.concat(F.lit("c"), "id").alias("child"), F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("p"), (F.col("id") % 500).cast("string"))).alias("parent")).unionByName(spark.createDataFrame([("hub", "top")], "child string, parent string"))
    got = hierarchy.resolve_hierarchy(links, fragment_rows=3_000)
    assert got.where("root = 'top' and depth = 2 and size(path) = 3").count() == 10_000 and got.count() == 30_000 + 500 + 2


def test_hierarchy_dirty_and_empty_inputs(spark):
    schema = "child string, parent string, key string, depth int"
    rows = [("b", "a", "x", 1), ("b", "a", "x", 1), ("c", "", "x", None), (None, "a", "x", 2), ("", "a", "x", 2), ("d", "d", "x", 3), ("e", "z", "y", 0), ("e", "b", "y", 0)]
    got = {r["key"]: (r["root"], r["depth"]) for r in hierarchy.resolve_hierarchy(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("c", 0), "d": ("", -1), "e": ("a", 2), "z": ("z", 0)}
    assert hierarchy.resolve_hierarchy(spark.createDataFrame([], schema)).count() == 0


def test_descendants(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x")], "child string, parent string")
    got = {tuple(r) for r in hierarchy.descendants(hierarchy.resolve_hierarchy(links)).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}


def stamp(day):
    return datetime(2025, 1, day)


def test_work_list_cases(spark):
    files = spark.createDataFrame(
        [("new", "aa"), ("same", "AA"), ("same", "AA"), ("changed", "bb"), ("nullpast", "cc"), ("nullnow", None), ("marked", "dd"), ("overtaken", "ee"), (None, "ff")], "file_path string, content_hash string"
    ).withColumn("indexed_at", F.lit(1))
    past = spark.createDataFrame(
        [("same", " sha256:aa", stamp(1)), ("changed", "bb", stamp(1)), ("changed", "xx", stamp(2)), ("nullpast", "cc", stamp(1)), ("nullpast", None, stamp(2)), ("nullnow", None, stamp(1)), ("marked", "dd", stamp(3)), ("overtaken", "ee", stamp(5)), ("gone", "zz", stamp(1))],
        "file_path string, content_hash string, indexed_at timestamp",
    )
    marks = spark.createDataFrame([("1", '["marked", "overtaken"]', stamp(4)), ("2", "broken", stamp(9)), ("3", None, stamp(9)), ("4", "[]", stamp(9))], "batch_id string, file_paths string, created_at timestamp")
    todo = incremental.work_list(files, past, marks)
    assert {r["file_path"] for r in todo.collect()} == {"new", "changed", "nullpast", "nullnow", "marked"}
    assert incremental.work_list(files, past.limit(0), marks.limit(0)).count() == 7
    assert incremental.work_list(files.limit(0), past, marks).count() == 0


def test_incremental_run_is_exactly_once(spark, tmp_path):
    run = incremental.IncrementalRun(spark, str(tmp_path / "run"))
    schema = "file_path string, content_hash string, size_bytes bigint"
    first = spark.createDataFrame([("a", "1", 1), ("b", "2", 2)], schema)
    process = lambda rows: rows.select("file_path", F.upper("content_hash").alias("out"))

    def broken(rows):
        process(rows).write.mode("overwrite").parquet(f"{run.root}/data/batch_id={run.batch_id_of(rows)}")
        raise RuntimeError("executor lost")

    try:
        run.run(first, broken)
    except RuntimeError:
        pass
    assert run.output() is None and run.pending(first).count() == 2
    assert run.run(first, process) and run.run(first, process) is None
    second = spark.createDataFrame([("a", "1", 1), ("b", "9", 2), ("c", "3", 3)], schema)
    assert {r["file_path"] for r in run.pending(second).collect()} == {"b", "c"}
    run.run(second, process)
    assert sorted((r["file_path"], r["out"]) for r in run.output().collect()) == [("a", "1"), ("b", "2"), ("b", "9"), ("c", "3")]
    assert run.pending(second).count() == 0


def test_orphans_and_cascade(spark):
    nodes = spark.createDataFrame([("a", stamp(1), None), ("b", stamp(1), stamp(2)), ("c", stamp(9), None), ("d", stamp(1), stamp(2)), ("d", stamp(3), None)], "symbol_id string, created_at timestamp, deleted_at timestamp")
    index = spark.createDataFrame([("s1", " a ", stamp(5)), ("s2", "b", stamp(5)), ("s3", "", stamp(5)), ("s4", "gone", None)], "fqn string, graph_node_id string, updated_at timestamp")
    edges = spark.createDataFrame([(1, "s1", "a", stamp(5)), (2, "s2", "a", stamp(5)), (3, "s3", "c", stamp(5)), (4, "s1", "rt", stamp(5)), (5, "s1", None, stamp(5)), (6, "s4", "d", None)], "id bigint, source_id string, target_id string, seen_at timestamp")
    tables = {"graph_nodes": nodes, "symbol_index": index, "graph_edges": edges}
    P, K = references.ParentKey, references.ForeignKey
    parents = [P("graph_nodes", "symbol_id", "created_at", "deleted_at"), P("symbol_index", "fqn")]
    keys = [K("graph_edges", "target_id", "graph_nodes", "id", "seen_at"), K("symbol_index", "graph_node_id", "graph_nodes", "fqn", "updated_at"), K("graph_edges", "source_id", "symbol_index", "id", "seen_at", cascade_only=True)]
    known = spark.createDataFrame([("rt",)], "ref string")
    got = {(r["ref_table"], r["ref_key"], r["cause"], r["kind"]) for r in references.orphan_cascade(tables, parents, keys, known).collect()}
    assert got == {
        ("graph_edges", "3", "late", "direct"),
        ("symbol_index", "s2", "deleted", "direct"),
        ("symbol_index", "s4", "missing", "direct"),
        ("graph_edges", "2", "orphaned parent", "inherited"),
        ("graph_edges", "6", "orphaned parent", "inherited"),
    }
    report = references.orphan_report(references.orphan_cascade(tables, parents, keys, known)).collect()
    assert sum(r["n_refs"] for r in report) == 5 and {r["month"] for r in report} == {"2025-01", None}
    none = references.orphan_cascade({k: v.limit(0) for k, v in tables.items()}, parents, keys, known)
    assert none.count() == 0


def test_hot_key_join_equals_plain_join(spark):
    left = spark.range(2000).select((F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50))).alias("k"), "id")
    left = left.unionByName(spark.createDataFrame([(None, 1)], "k string, id bigint"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k49", 3)], "k string, v int")
    assert hot_keys(left, "k", share=0.1, least=10) == ["hot"]
    for how in ("left", "inner", "left_semi", "left_anti"):
        a = sorted(map(repr, join_split_hot(left, right, "k", how, share=0.1, least=10).collect()))
        assert a == sorted(map(repr, left.join(right, "k", how).collect()))
