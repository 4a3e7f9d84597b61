import json
import time

import pytest
from pyspark.sql import functions as F

from codeloom.commands import Command, format_command, parse_command
from codeloom.config import Settings, load_settings, save_settings
from codeloom.functions import languages
from codeloom.operators import enrich, metrics
from codeloom.parse import files as parsing
from codeloom.parse.braces import comment_score, definitions
from codeloom.sources.ignore import rule_counts
from codeloom.sources.paths import map_path, read_mappings, resolve_runtime_path
from codeloom.streaming.service import TreePoller, WatchService


def test_polled_events(tmp_path):
    root, state = tmp_path / "tree", tmp_path / "state"
    root.mkdir()
    poller = TreePoller(str(root), str(state))
    assert poller.poll() == 0
    (root / "a.py").write_text("a = 1\n")
    (root / "b.py").write_text("bb = 22\n")
    assert poller.poll() == 2 and poller.poll() == 0
    (root / "a.py").rename(root / "c.py")
    (root / "b.py").unlink()
    assert TreePoller(str(root), str(state)).poll() == 2  # a new process goes on from the picture
    rows = [json.loads(line) for file in sorted((state / "events").iterdir()) for line in file.read_text().splitlines()]
    assert [(r["event_type"], r["file_path"], r["old_path"]) for r in rows[2:]] == [("moved", "c.py", "a.py"), ("deleted", "b.py", None)]


def test_watching_counts_errors_and_goes_on(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "old.py").write_text("x = 1\n")
    calls = []

    def update():
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("first one fails")

    service = WatchService(spark, str(root), str(tmp_path / "state"), update, gap=0.5, poll_seconds=0.2)
    service.start()
    with pytest.raises(RuntimeError):
        service.start()
    for n, name in enumerate(("a.py", "b.py"), 1):
        (root / name).write_text("y = 2\n" * n)
        end = time.monotonic() + 60
        while len(calls) < n and time.monotonic() < end:
            time.sleep(0.2)
    assert len(calls) >= 2
    (root / "late.py").write_text("z = 3\n")
    service.stop()
    assert service.stats()["errors"] == 1 and "first one fails" in service.stats()["last_error"]
    assert service.stats()["pending"] == 0 and not service.stats()["running"] and service.stats()["events"] == 3
    with pytest.raises(ValueError):
        WatchService(spark, str(root / "none"), str(tmp_path), update)


def test_command_lines():
    assert parse_command('Search "two words" next --limit=5 -mode=grep path=src/*') == Command("search", ["two words", "next"], {"limit": "5", "mode": "grep", "path": "src/*"})
    assert parse_command("   ") == Command() and parse_command("x =5 -- ---a=1").args == ["=5", "--", "---a=1"]
    command = Command("index", ["/a b/c", "it's"], {"k": "v w", "a": ""})
    assert parse_command(format_command(command)) == command
    with pytest.raises(ValueError):
        parse_command('search "open')


def test_paths_of_another_machine(tmp_path):
    mappings = read_mappings(r"D:\\=/host/d; /Users/alice=/host/alice;/=/hostfs")
    assert map_path(r"d:\\Work\\A.py", mappings) == "/host/d/Work/A.py"
    assert map_path("/Users/alice/x.py", mappings) == "/host/alice/x.py" and map_path("/Users/alicex", mappings) == "/hostfs/Users/alicex"
    assert resolve_runtime_path("a/b.py", str(tmp_path)) == f"{tmp_path.resolve()}/a/b.py" and resolve_runtime_path("/x") == "/x"
    for bad in ("", "  ", r"C:\\x"):
        with pytest.raises(ValueError):
            resolve_runtime_path(bad)
    with pytest.raises(ValueError):
        read_mappings("a=")
    assert read_mappings(None) == []


def test_registries(spark, tmp_path):
    before = dict(languages.EXTENSIONS)
    try:
        languages.register_language("Zig", ["zig", ".ZON"])
        row = spark.createDataFrame([("a.zon",), ("b.py",)], "p string").select(languages.detect_language(F.col("p")).alias("l")).collect()
        assert [r.l for r in row] == ["zig", "python"]
        languages.unregister_language("zig")
        assert ".zig" not in languages.EXTENSIONS
        (tmp_path / "r.json").write_text('{"one": [".x"]}')
        languages.load_registry(str(tmp_path / "r.json"))
        assert languages.EXTENSIONS == {".x": "one"}
    finally:
        languages.EXTENSIONS.clear()
        languages.EXTENSIONS.update(before)
    parsing.register_parser("zig", lambda text: [("function", "f", 1, 1, text, None, None)], lambda text: [])
    try:
        got = parsing.parse_files(spark.createDataFrame([("a.zig", "zig", "fn f() {}")], "file_path string, language string, content string")).first()
        assert got.nodes[0].name == "f" and got.error is None
    finally:
        parsing.PARSERS.pop("zig")


def test_comments_of_declarations():
    assert comment_score("// x", 1, "f") == pytest.approx(0.7) and comment_score("/** f */", 1, "f") == pytest.approx(1.0) and comment_score("// x", 2, "f") == pytest.approx(0.6)
    assert comment_score("// x", 3, "f") == comment_score("// x", 0, "f") == 0.0
    head = ",\n".join(f"    final LongNameOfAType<With, Parameters{i}> parameter{i}" for i in range(120))
    text = "class A {\n  /** Does it. */\n  void far(\n" + head + ") {\n  }\n}\n"
    assert [(d[0], d[1], d[6]) for d in definitions(text, "java")][1] == ("method", "far", "/** Does it. */")


def test_enrichment_by_a_function(spark):
    symbols = spark.createDataFrame([(f"s{i}", "text " + ("boom" if i == 3 else str(i))) for i in range(25)] + [("none", None), ("blank", " ")], "symbol_id string, content string").coalesce(1)

    def call(texts):
        if any("boom" in t for t in texts):
            raise ConnectionError
        return [t.upper() for t in texts]

    got = {r.symbol_id: r.llm_summary for r in enrich.summarize(symbols, call).collect()}
    assert got["s12"] == "TEXT 12" and got["s1"] is None and got["none"] is None and got["blank"] is None and len(got) == 27
    assert enrich.summarize(symbols, None).where("llm_summary is not null").count() == 0

    def edges(texts):
        return ['[{"target": " t ", "confidence": 0.5}, {"target": "low", "confidence": 0.4}, {"target": ""}, {"target": "sure", "type": "call"}, 7]' if t.endswith("1") else "no json" for t in texts]

    found = enrich.infer_edges(symbols, edges).where("source_id = 's11'").collect()
    assert {(r.target_id, r.edge_type, r.confidence) for r in found} == {("t", "inferred", 0.5), ("sure", "call", 1.0)}
    assert enrich.infer_edges(symbols, None).count() == 0


def test_samples_settings_and_rules(spark, tmp_path):
    samples = metrics.Samples()
    with samples.timed("embed"):
        pass
    samples.record("store", 5)
    assert {r.kind: r.n for r in metrics.latency_summary(samples.rows(spark), "value", "kind").collect()} == {"embed": 1, "store": 1}
    samples.reset()
    assert samples.rows(spark).count() == 0
    save_settings(Settings(chunk_lines=30, api_key="secret"), str(tmp_path / "s.json"))
    back = load_settings(str(tmp_path / "s.json"), {})
    assert back.chunk_lines == 30 and back.api_key == "" and "secret" not in (tmp_path / "s.json").read_text()
    assert rule_counts({"": "*.x\n# c\n", "a": "b\nc\n"}, False) == {".": 1, "a": 2}
