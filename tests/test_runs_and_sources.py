import os

import pytest
from pyspark.sql import functions as F

from codeloom.operators import context, incremental, retrieval, store
from codeloom.parse.files import parse_files
from codeloom.session import within_time
from codeloom.sources import files

LISTING = "file_path string, content_hash string, size_bytes long"


def _listing(spark, folder, rows):
    spark.createDataFrame(rows, LISTING).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def test_a_listing_that_grows_while_a_batch_runs(spark, tmp_path):
    folder = str(tmp_path / "listing")
    _listing(spark, folder, [("a", "1", 1)])
    run = incremental.IncrementalRun(spark, str(tmp_path / "run"))

    def process(rows):
        spark.createDataFrame([("b", "2", 2)], LISTING).write.mode("append").parquet(folder)  # arrives during the run
        return rows.select("file_path")

    fresh = lambda: spark.read.parquet(folder)
    assert run.run(fresh(), process)
    assert [r[0] for r in run.output().collect()] == ["a"]
    assert [r[0] for r in run.pending(fresh()).select("file_path").collect()] == ["b"]
    assert run.run(fresh(), lambda rows: rows.select("file_path")) and run.run(fresh(), lambda rows: rows.select("file_path")) is None
    assert sorted(r[0] for r in run.output().collect()) == ["a", "b"] and run.markers() == []


@pytest.mark.parametrize("stage", ["process", "data", "manifest"])
def test_a_run_that_dies_is_rolled_back_and_repeated(spark, tmp_path, stage, monkeypatch):
    rows = spark.createDataFrame([("a", "1", 1), ("b", "sha256:2", 2)], LISTING)
    run = incremental.IncrementalRun(spark, str(tmp_path / "run"))
    if stage == "process":
        with pytest.raises(ZeroDivisionError):
            run.run(rows, lambda r: 1 / 0)
    else:
        writer = type(rows.write)
        real = writer.parquet

        def dying(self, path, *args, **kwargs):
            real(self, path, *args, **kwargs)
            if f"/{stage}/" in path:
                if stage == "manifest":  # the commit mark itself is lost
                    os.remove(f"{path}/_SUCCESS")
                raise OSError("executor lost")

        monkeypatch.setattr(writer, "parquet", dying)
        with pytest.raises(OSError):
            run.run(rows, lambda r: r.select("file_path"))
        monkeypatch.undo()
    assert len(run.markers()) == 1 and run.output() is None
    assert run.pending(rows).count() == 2
    assert run.run(rows, lambda r: r.select("file_path")) and run.markers() == []
    assert sorted(r[0] for r in run.output().collect()) == ["a", "b"]


def test_sizes_count_beside_digests(spark):
    listing = spark.createDataFrame([("a", "1", 5), ("b", "1", 5), ("c", "1", None)], LISTING)
    past = spark.createDataFrame([("a", "1", 5), ("b", "1", 6), ("c", "1", 7)], LISTING).withColumn("indexed_at", F.current_timestamp())
    assert [r[0] for r in incremental.work_list(listing, past, size="size_bytes").collect()] == ["b"]
    assert incremental.work_list(listing, past).count() == 0


def test_links_never_lead_outside(spark, tmp_path):
    root, outside = tmp_path / "tree", tmp_path / "outside"
    (root / "pkg" / "_inner").mkdir(parents=True)
    outside.mkdir()
    (outside / "secret.py").write_text("SECRET = 1\n")
    (root / "pkg" / "__init__.py").write_text("a = 1\n")
    (root / "pkg" / "_inner" / "x.py").write_text("b = 1\n")
    (root / "real.py").write_text("c = 1\n")
    os.symlink(outside / "secret.py", root / "linked_file.py")
    os.symlink(outside, root / "linked_folder")
    os.symlink(outside / "secret.py", root / "pkg" / "deep_link.py")
    os.symlink(root / "gone.py", root / "broken.py")
    os.symlink(root / "real.py", root / "inside.py")
    os.symlink(root / "pkg", root / "again")
    os.symlink(root, root / "pkg" / "cycle")
    os.symlink(root / "again", root / "pkg" / "_inner" / "back")
    got = {r.file_path: r.content for r in files.scan_tree(spark, str(root)).collect()}
    assert set(got) == {"pkg/__init__.py", "pkg/_inner/x.py", "real.py", "inside.py", "again/__init__.py", "again/_inner/x.py"}
    assert not any("SECRET" in c for c in got.values())
    by_uri = {r.file_path for r in files.scan_tree(spark, f"file://{root}/pkg/_inner").collect()}
    assert "x.py" in by_uri
    (tmp_path / "empty").mkdir()
    assert files.scan_tree(spark, str(tmp_path / "empty")).count() == 0


def test_versions_of_a_part(spark, tmp_path):
    s = store.FolderStore(spark, str(tmp_path / "store"))
    s.write("t", spark.range(3), "a")
    s.write("t", spark.range(10, 12).withColumn("more", F.lit("x")), "b")
    held = s.read("t")
    s.write("t", spark.range(1), "a")
    assert sorted(r.id for r in held.collect()) == [0, 1, 2, 10, 11]  # a plan over the version before still reads
    assert sorted(r.id for r in s.read("t").collect()) == [0, 10, 11] and s.read("t", "a").count() == 1
    s.begin("b1", spark.createDataFrame([("x.py",)], "file_path string"))
    assert [tuple(r)[:2] for r in s.unfinished().collect()] == [("b1", "x.py")]
    s.finish("b1")
    assert s.unfinished().count() == 0


def test_exclusions_come_before_the_cut(spark):
    texts = spark.createDataFrame([(f"tests/t{i}.py", "needle here\n") for i in range(30)] + [("src/z.py", "needle there\n")], "file_path string, content string")
    points = spark.createDataFrame([(f"p{i}", f"tests/t{i}.py", 1, 1, "x", "chunk", [1.0, 0.0]) for i in range(30)] + [("pz", "src/z.py", 5, 6, "x", "chunk", [0.5, 0.5])], "chunk_id string, file_path string, start_line int, end_line int, content string, artifact_type string, vector array<double>")
    for mode in ("grep", "vector", "hybrid"):
        found = retrieval.search(points, texts, "needle -path:tests", lambda q: [1.0, 0.0], mode, candidates=5).collect()
        assert {r.file_path for r in found} == {"src/z.py"}


def test_a_side_that_fails_leaves_the_other(spark):
    texts = spark.createDataFrame([("a.py", "needle\n")], "file_path string, content string")
    points = spark.createDataFrame([("p", "b.py", 1, 1, "x", "chunk", [1.0, 0.0])], "chunk_id string, file_path string, start_line int, end_line int, content string, artifact_type string, vector array<double>")

    def broken(query):
        raise ConnectionError("no embedder")

    assert [r.file_path for r in retrieval.search(points, texts, "needle", broken, isolated=True).collect()] == ["a.py"]
    with pytest.raises(ConnectionError):
        retrieval.search(points, texts, "needle", broken)
    slow = F.udf(lambda x: __import__("time").sleep(20) or x, "long")
    done, lost = within_time(spark, {"fast": lambda: spark.range(2), "slow": lambda: spark.range(1).select(slow("id"))}, seconds=4)
    assert done["fast"].count() == 2 and lost == {"slow": "out of time"}


def test_answers_of_a_scorer(spark):
    hits = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "chunk_id string, score double")
    answer = spark.createDataFrame([('{"results": [{"index": 2, "relevance_score": 0.9}, {"index": 0, "relevance_score": 0.1}, {"index": 7, "relevance_score": 1.0}]}',), ('{"data": [{"index": 1, "score": 0.5}]}',)], "answer string")
    parsed = answer.select(retrieval.read_rerank_answer(F.col("answer")).alias("a")).collect()
    rows = lambda a: spark.createDataFrame([(x.position, x.score) for x in a], "position int, score double")
    assert [r.chunk_id for r in retrieval.rerank_by_response(hits, rows(parsed[0].a), 5).collect()] == ["c", "a"]
    assert [r.chunk_id for r in retrieval.rerank_by_response(hits, rows(parsed[1].a), 5).collect()] == ["b"]
    assert [r.chunk_id for r in retrieval.rerank_by_response(hits, rows([]), 2).collect()] == ["a", "b"]


def test_symbols_of_hits_and_files(spark):
    symbols = spark.createDataFrame([("m.a.run",), ("m.b.run",), ("run",), ("m.b.stop",)], "fqn string")
    ids = spark.createDataFrame([("m.b.run",), ("stop",), ("run",), ("none",), (None,)], "item_id string")
    assert {r.item_id: r.fqn for r in context.match_symbols(ids, symbols).collect()} == {"m.b.run": "m.b.run", "stop": "m.b.stop", "run": "run", "none": None, None: None}
    nodes = spark.createDataFrame([("m.a", "a.py"), ("m.a.f", "a.py"), ("m.b", "b.py")], "symbol_id string, file_path string")
    edges = spark.createDataFrame([("m.b", "m.a.f", "call", "b.py"), ("m.a", "os", "import", "a.py"), ("m.a.f", "m.a", "call", "a.py"), ("m.b", "m.a ", "Import", "b.py")], "source_id string, target_id string, edge_type string, file_path string").withColumn("inferred", F.lit(False))
    got = {r.file_path: r for r in context.file_context(spark.createDataFrame([("a.py",), ("b.py",), ("c.py",)], "file_path string"), nodes, edges).collect()}
    assert (got["a.py"].symbols, got["a.py"].imports, got["a.py"].dependents) == (["m.a", "m.a.f"], ["os"], ["b.py"])
    assert (got["b.py"].imports, got["b.py"].dependents, got["c.py"].symbols) == (["m.a"], [], [])


def test_broken_sources_say_so(spark):
    rows = spark.createDataFrame([("a.py", "python", "def ("), ("b.py", "python", "x = 1"), ("c.py", "python", None)], "file_path string, language string, content string")
    got = {r.file_path: r.error for r in parse_files(rows).collect()}
    assert got["a.py"].startswith("SyntaxError") and got["b.py"] is None and got["c.py"] is None
