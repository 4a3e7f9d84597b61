from pyspark.sql import functions as F

from codeloom.engine import Engine


def tree_of(folder):
    (folder / "pkg").mkdir(parents=True)
    (folder / "pkg" / "__init__.py").write_text("")
    (folder / "pkg" / "a.py").write_text("import os\nfrom pkg.b import helper\n\n\ndef run(x):\n    return helper(x)\n")
    (folder / "pkg" / "b.py").write_text("def helper(x):\n    return x\n")
    (folder / "pkg" / "broken.py").write_text("def (\n")
    return str(folder)


def test_left_markers_roll_back_and_other_collections_stay(spark, tmp_path):
    first, second = tree_of(tmp_path / "one"), tree_of(tmp_path / "two")
    engine = Engine(spark, str(tmp_path / "store"))
    assert engine.index(first).first().n_failed == 1
    engine.index(second)
    assert engine.unfinished().count() == 0 and engine.repositories().count() == 2
    collection = engine._collection(first)
    before = {n: engine.tables._current(n, engine._collection(second)) for n in ("points", "files", "edges")}
    points = engine.tables.read("points", collection).count()
    engine.tables.begin(f"{collection}-dead", spark.createDataFrame([("pkg/b.py",), ("pkg/gone.py",)], "file_path string"))
    assert engine.unfinished(first).count() == 2 and engine.unfinished(second).count() == 0
    states = {r.state: r.n_files for r in engine.update(first).collect()}
    # a file that does not parse has no hash on record, so it is taken up again
    assert states == {"same": 2, "new": 1, "modified": 1} and engine.unfinished().count() == 0
    assert engine.tables.read("points", collection).count() == points
    assert engine.tables.read("files", collection).groupBy("file_path").count().where("count > 1").count() == 0
    assert before == {n: engine.tables._current(n, engine._collection(second)) for n in before}
    engine.forget(first)
    assert engine.repositories().count() == 1 and engine.tables.read("files").count() == 4


def test_answers_with_a_budget_and_failing_backends(spark, tmp_path):
    root = tree_of(tmp_path / "one")
    engine = Engine(spark, str(tmp_path / "store"))
    engine.index(root)
    whole = engine.get_context("helper").first()
    assert not whole.partial_results and whole.left_out == [] and any(s.fqn == "pkg.b.helper" for s in whole.symbols)
    engine._by_graph = lambda query, depth: 1 / 0
    part = engine.get_context("helper").first()
    assert part.partial_results and part.left_out == ["graph"] and any(s.fqn == "pkg.b.helper" for s in part.symbols)
    slow = F.udf(lambda x: __import__("time").sleep(30) or x, "double")
    engine._by_graph = lambda query, depth: spark.range(1).select(F.lit("x").alias("item_id"), slow(F.col("id").cast("double")).alias("score"))
    late = engine.get_context("helper", backends=("graph",), seconds=3).first()
    assert late.partial_results and late.left_out == ["graph"] and late.total_tokens == 0 and late.symbols == []
    hits = engine.enriched_search("return helper", mode="grep").collect()
    # a text hit begins with its lines of context, which lie outside the function here
    assert {(r.file_path, r.fqn) for r in hits} == {("pkg/a.py", "pkg.a")} and hits[0].pagerank >= 0
    inner = engine.enriched_search("helper", mode="summary").where("fqn = 'pkg.a.run'").collect()
    assert inner and inner[0].callees == ["pkg.b.helper"]
    around = engine.file_context(["pkg/b.py"]).first()
    assert "pkg.b.helper" in around.symbols and around.dependents == ["pkg/a.py"]
    row = engine.status(root).first()
    assert row.n_files == 4 and row.languages == {"python": 4} and row.n_points == engine.tables.read("points").count() and row.n_point_files >= 3
