import random

from pyspark.sql import functions as F

from codeloom.functions.languages import EXTENSIONS
from codeloom.llm import packing, provenance, queries, ranking, wellformed

FILES = "file_path string, repo string, content string"


def kinds(spark, rows, index=None):
    return {r.file_path: (r.kind, r.evidence) for r in provenance.classify_files(spark.createDataFrame(rows, FILES), index).collect()}


def own_source(seed, n=25):
    rng = random.Random(seed)
    return "\n".join(f"def fun_{rng.randrange(10**6)}(a_{rng.randrange(10**6)}):\n    return go_{rng.randrange(10**6)}({rng.randrange(10**6)})" for _ in range(n))


def test_banners_after_long_comments():
    licence = "\n".join(f"// line {i} of the licence of this project" for i in range(15))
    assert provenance.banner_of(licence + "\n// Code generated by x. DO NOT EDIT.\npackage a") == "generated"
    assert provenance.banner_of("\n".join(f"# note {i}" for i in range(6)) + "\n# Autogenerated. Regenerate via `make x`.\nA = 1") == "generated"
    assert provenance.banner_of("x = 1\n# Code generated by x. DO NOT EDIT.") == ""


def test_repetition_by_hand_is_no_machine_made_file(spark):
    asserts = "\n".join(f"    assert parse(\"{i}\") == {i}" for i in range(29))
    made = "\n".join(f"export const glyphSummary{i:03d} = {567 + i};" for i in range(29))
    table = "TABLE = [\n" + "\n".join(f"    [{i}, {i * 7 % 11}, {i * 3 % 5}]," for i in range(60)) + "\n]\n"
    blob = 'export default "' + "t3oh//MB" * 90 + '";'
    packed = "!function(){" + "".join(f"a{i % 7}(b)&&(c=d.e(f,{i}));" for i in range(40)) + "}()"
    dump = "\n".join(f"INSERT INTO t VALUES ({i}, {i * i}, 'v{i}');" for i in range(40))
    got = kinds(spark, [("r/t.py", "r", "def test_parse():\n" + asserts), ("r/g.js", "r", made), ("r/d.py", "r", table), ("r/b.js", "r", blob), ("r/m.js", "r", packed), ("r/v.py", "r", 'VERSION = "1.0"'), ("r/own.py", "r", own_source(5, 4)), ("r/c.json", "r", table[8:])])
    assert got["r/t.py"][0] == got["r/v.py"][0] == got["r/own.py"][0] == got["r/c.json"][0] == "hand-written"
    assert (got["r/g.js"], got["r/d.py"], got["r/b.js"], got["r/m.js"]) == tuple((k, "fingerprints: pattern") for k in ("generated", "data", "data", "minified"))
    assert provenance.marks_of(dump)[1] >= provenance.PATTERN_SHARE


def test_copies_in_any_language_and_of_any_length(spark):
    short = "set -eu\nfor f in one two three; do cp \"$f\" \"$1/$f\" || exit 3; done\necho finished with $1\n"
    rows = [(f"r{k}/tools/x.sh", f"r{k}", short) for k in range(3)] + [("r0/own.sh", "r0", short.replace("one", "own").replace("exit 3", "exit 4"))]
    rows += [(f"r{k}/__init__.py", f"r{k}", "import a\n") for k in range(5)]  # too little to recognise
    got = kinds(spark, rows)
    assert all(got[f"r{k}/tools/x.sh"] == ("vendored", "fingerprints: copies") for k in range(3))
    assert got["r0/own.sh"][0] == "hand-written" and got["r1/__init__.py"][0] == "hand-written"


def test_copies_known_from_the_record_of_indexed_files(spark):
    import hashlib

    text = own_source(8)
    digest = hashlib.sha256(text.encode()).hexdigest()
    index = spark.createDataFrame([("a", "sha256:" + digest.upper()), ("b", digest), ("b", digest), (None, None)], "repo string, content_hash string")
    assert kinds(spark, [("c/x.py", "c", text)], index)["c/x.py"] == ("vendored", "content hash")
    assert kinds(spark, [("b/x.py", "b", text)], index)["b/x.py"][0] == "hand-written"  # two repositories only


def test_folders_that_may_hold_libraries(spark):
    rows = [("r0/external/api/a.py", "r0", own_source(1)), ("r1/api/b.py", "r1", own_source(2)), ("r1/external/api/c.py", "r1", own_source(3))]
    rows += [("r0/vendor/grelm/a.py", "r0", own_source(4)), ("r1/third_party/grelm/b.py", "r1", own_source(6)), ("r2/external/lonely/x.py", "r2", own_source(7)), ("r2/deps/lib-2.1/x.c", "r2", "int a;")]
    got = kinds(spark, rows)
    assert got["r0/external/api/a.py"][0] == got["r1/external/api/c.py"][0] == got["r2/external/lonely/x.py"][0] == "hand-written"
    assert got["r0/vendor/grelm/a.py"] == got["r1/third_party/grelm/b.py"] == got["r2/deps/lib-2.1/x.c"] == ("vendored", "folder")


def test_packing_rounds_stay_small(spark):
    texts = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.concat(F.lit("word"), F.lit(" ")), 100), F.repeat(F.lit("x "), (F.col("id") % 13).cast("int"))).alias("text"))
    packed = packing.pack_documents(texts, capacity=256, part_rows=60)
    got = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in got) == 600 and max(r.used for r in got) <= 256
    by_round = {}
    for r in got:
        name = r.container.split("-")
        by_round[(name[0], name[1])] = by_round.get((name[0], name[1]), 0) + r.n
    assert max(by_round.values()) <= 150  # no task takes much more than its share
    assert sum(r.used for r in got) >= 0.75 * 256 * (len(got) - 1)


def test_a_perfect_order_of_symbols_scores_one(spark):
    order = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, symbol_id string, final_rank int")
    labels = spark.createDataFrame([("q", "a", 3), ("q", "b", 2), ("q", "c", 1)], "query_id string, symbol_id string, grade int")
    assert ranking.ndcg(order, labels).first().ndcg == 1.0


def test_grammar_needs_no_exact_parser(spark):
    import json

    for text in ('{"a": [1, 2.5e3, null], "b": {"c": "\\u00e9"}}', "[", "[1,]", '{"a" 1}', "1 2", '"x', "{}"):
        try:
            json.loads(text)
            fine = True
        except ValueError:
            fine = False
        assert (wellformed.check_text("json", text) is None) == fine
    assert EXTENSIONS[".json"] == "json" and "p8_checks" in queries.QUERIES
