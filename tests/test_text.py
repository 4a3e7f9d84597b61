import fnmatch

import duckdb  # noqa: F401
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import text, vectors
from codeloom.functions.languages import detect_language
from codeloom.operators import text_search
from codeloom.sources.ignore import is_denied, is_ignored, is_system_folder, parse_rule, rules_of


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, int) else 'int'}" for k, v in values.items()))
    return row.select(column).first()[0]


def test_glob_regex_equals_fnmatch(spark):
    patterns = ["*.py", "src/**/a?.ts", "a[b-d]*", "a[!b]c", "*[x", "a.b+c", "*vendor*"]
    paths = ["a.py", "src/x/ab.ts", "src/ab.ts", "abz", "azz", "axc", "abc", "q[x", "a.b+c", "aXb+c", "lib/vendor/x.js", ""]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    for pattern in patterns:
        got = {r.p for r in rows.where(text.matches_glob(F.col("p"), pattern)).collect()}
        assert got == {p for p in paths if fnmatch.fnmatchcase(p, pattern)}, pattern


def test_query_modifiers_agree(spark):
    for q in ["parse go -path:tests", "a path:x file:y exclude: exclude:z b", "", "path:*.py", "-path:a exclude:b c  d"]:
        clean, include, excludes = text.parse_query(q)
        got = one(spark, text.query_parts(F.col("q")), q=q)
        assert (got["clean"], got["include"], list(got["excludes"])) == (clean, include, excludes)


def slow_fuzzy(pattern, line):
    """The score written the long way round."""
    if len(pattern) == 1:
        return float(pattern in line)
    places, at = [], 0
    for c in pattern:
        at = line.find(c, at)
        if at < 0:
            return 0.0
        places.append(at)
        at += 1
    starts = [p == 0 or line[p - 1] in text.SEPARATORS or line[p - 1].islower() and line[p].isupper() or line[p - 1].isdigit() and line[p].isalpha() for p in places]
    score = len(pattern) + 2 * (places[0] == 0) + 2 * starts[0] + 0.5 * sum(starts[1:])
    steps = [b - a - 1 for a, b in zip(places, places[1:], strict=False)]
    score += sum(s == 0 for s in steps) - 0.05 * sum(steps) - 0.01 * places[0]
    return max(0.0, min(1.0, score / (len(pattern) + 4 + 1.5 * (len(pattern) - 1))))


@settings(max_examples=200, deadline=None)
@given(st.text("abC_1 ", min_size=1, max_size=6), st.text("abC_1 x", max_size=25))
def test_fuzzy_value(pattern, line):
    assert text.fuzzy_value(pattern, line, line) == pytest.approx(slow_fuzzy(pattern, line))


def test_fuzzy_known_scores():
    line = "const x = useEffect(() => {"
    assert round(text.fuzzy_value("useefct", line.lower(), line), 4) == 0.715
    assert text.fuzzy_value("useefct", "nothing here", "nothing here") == 0.0


def test_lines_and_tokens(spark):
    assert one(spark, text.lines_of(F.col("t")), t="a\r\nb\rc\n") == ["a", "b", "c"]
    assert one(spark, text.lines_of(F.col("t")), t="") == []
    assert one(spark, text.line_count(F.col("t")), t="a\nb\n") == 3
    assert one(spark, text.char_tokens(F.col("t")), t="abcde") == 2
    assert one(spark, text.word_tokens(F.col("t")), t="  a  b\nc ") == 3
    with pytest.raises(ValueError):
        text.token_counter("none")


def keep_lines(t, limit):
    if -(-len(t) // 4) <= limit:
        return t
    used, out = 0, []
    for line in t.split("\n") if limit > 0 else []:
        cost = -(-(len(line) + bool(out)) // 4)
        if used + cost > limit:
            break
        used += cost
        out.append(line)
    return "\n".join(out)


def test_truncate_lines(spark):
    texts = ["", "abc", "aaaa\nbbbb\ncccc", "x" * 50, "\n\n\n\n\n\n\n\n\n", "ab\ncdef\n" * 9, "é" * 7 + "\nzz"]
    for limit in (0, 1, 2, 5):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.truncate_lines(F.col("t"), limit).alias("s")).collect()
        assert all(r.s == keep_lines(r.t, limit) for r in rows)


def test_source_slice(spark):
    assert one(spark, text.source_slice(F.col("t"), F.lit(2), F.lit(3)), t="a\nb\nc\nd") == "b\nc"
    assert one(spark, text.source_slice(F.col("t"), F.lit(3), F.lit(99)), t="a\nb\nc") == "c"
    assert one(spark, text.source_slice(F.col("t"), F.lit(9), F.lit(10)), t="a") == ""
    assert one(spark, text.source_slice(F.lit(None).cast("string"), F.lit(1), F.lit(2)), t="a") == ""


def test_documentation_marks(spark):
    cases = [("/** Hello */", "javascript", "Hello"), ("/**\n * A\n *\n *\n *\n * B\n */", "java", "A\n\nB"), ("// L1\n// L2", "go", "L1\nL2"), ("/// x\n/// y", "cpp", "x\ny"), ('"""doc"""', "python", "doc"), ("// x", "none", "x"), ("plain", "none", "plain"), (None, "go", "")]
    for doc, language, want in cases:
        row = spark.createDataFrame([(doc, language)], "d string, l string").select(text.normalize_doc(F.col("d"), F.col("l")), text.embed_text(F.col("d"), F.lit("code"), F.col("l"))).first()
        assert row[0] == want and row[1] == (f"{want}\n---\ncode" if want else "code")


def test_names(spark):
    assert one(spark, text.module_of(F.col("p")), p="src/aa/b.c/d.py") == "aa.b.c.d"
    assert one(spark, text.fqn_of(F.col("p"), F.lit("f"), F.lit(None).cast("string")), p="a/b.py") == "a.b.f"
    name = one(spark, text.collection_name(F.col("p")), p="/home/My Repo--x/")
    assert name.startswith("codebase_my_repo_x_") and len(name.rsplit("_", 1)[1]) == 8
    assert one(spark, detect_language(F.col("p")), p="x/.hidden/a.PYI") == "python"
    assert one(spark, detect_language(F.col("p")), p="x.d/noext") == "unknown"
    assert text.resolve_filter("src/*.py", "/r") == "/r/src/*.py" and text.resolve_filter("*.py", "/r") == "*.py"


def test_search_modes(spark):
    files = spark.createDataFrame([("a.py", "foo bar\nbar foo\nfoo\n"), ("b.js", "hello world\nHELLO   WORLD\n"), ("n", None)], "file_path string, content string")
    assert text_search.search_lines(files, "foo bar", all_terms=True).count() == 2
    assert text_search.search_lines(files, "foo bar").count() == 1
    assert text_search.search_lines(files, r"hello\s+world", mode="regex").count() == 2
    assert text_search.search_lines(files, "HELLO", case_sensitive=True).count() == 1
    assert text_search.search_lines(files, " ").count() == 0 and text_search.search_lines(files.limit(0), "a").count() == 0
    assert text_search.search_lines(files, "foo", limit=0).count() == 0
    hit = text_search.search_lines(files, "bar foo", context_lines=1).first()
    assert (hit.start_line, hit.end_line, hit.match_line, hit.content) == (1, 3, 2, "foo bar\nbar foo\nfoo")
    assert text_search.search_lines(files, "hlo wrld", mode="fuzzy", fuzzy_min_score=0.4).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        text_search.search_lines(files, "(", mode="regex")
    with pytest.raises(ValueError):
        text_search.search_lines(files, "x", mode="other")


def test_vectors(spark):
    v = vectors.hash_vector("x", 70)
    assert len(v) == 70 and abs(sum(x * x for x in v) - 1) < 1e-9 and v == vectors.hash_vector("x", 70)
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0], [1.0])], "a array<double>, b array<double>, z array<double>, s array<double>")
    got = row.select(vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("z")), vectors.cosine(F.col("a"), F.col("s")), vectors.unit(F.col("a")), vectors.unit(F.col("z"))).first()
    assert got[0] == pytest.approx(0.96) and got[1] == 0 and got[2] == 0 and got[3] == [0.6, 0.8] and got[4] == [0, 0]


def test_ignore_rules(spark):
    assert parse_rule("# c") is None and parse_rule("") is None and parse_rule("a[") is None and parse_rule("x\\") is None
    rules = rules_of({"": "*.log\n!keep.log\n/top\nout/\ndocs/*.md\n", "sub": "local\n/tied\na/**/z\n"}, defaults=False)
    paths = {"a.log": True, "d/a.log": True, "d/keep.log": False, "top": True, "d/top": False, "out/x": True, "d/out/x/y": True, "out": False, "docs/a.md": True, "docs/b/a.md": False, "sub/x/local": True, "local": False, "sub/tied": True, "sub/x/tied": False, "sub/a/z": True, "sub/a/b/c/z": True}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", is_ignored(F.col("p"), rules).alias("i")).collect()
    assert {r.p: r.i for r in rows} == paths
    denied = {"a/.env": True, "k.pem": True, ".ssh/x": True, "env": False, "a/.env.local": True, "pem": False}
    rows = spark.createDataFrame([(p,) for p in denied], "p string").select("p", is_denied(F.col("p")).alias("i")).collect()
    assert {r.p: r.i for r in rows} == denied
    assert is_system_folder("/etc/x") and not is_system_folder("/home/x")
