"""Queries of the engine's own operators over the project's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text, vectors
from codeloom.functions.languages import EXTENSIONS, detect_language
from codeloom.operators import chunking, context, enrich, graph, metrics, resolve, retrieval, store, text_search
from codeloom.parse import files as parsing
from codeloom.session import cut_lineage, read_table
from codeloom.sources.ignore import is_ignored, rules_of
from codeloom.streaming import debounce

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return register


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "processed_files").where("file_path is not null").dropDuplicates(["file_path"])


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "ast_nodes").dropDuplicates(["node_id"])


# ------------------------------------------------------------------ files and their metadata

_LANGUAGE_CASE = "CASE lower(regexp_extract(file_path, '[^/](\\.[^./]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in EXTENSIONS.items()) + " ELSE 'unknown' END"


@query(f"SELECT DISTINCT file_path, {_LANGUAGE_CASE} AS language, length(content) - length(replace(content, chr(10), '')) + 1 AS n_lines, sha256(content) AS digest, CAST(strlen(content) AS BIGINT) AS n_bytes FROM processed_files")
def file_metadata(spark, sf_dir):
    rows = read_table(spark, sf_dir, "processed_files").select("file_path", "content").distinct()
    return rows.select("file_path", detect_language(F.col("file_path")).alias("language"), text.line_count(F.col("content")).cast("bigint").alias("n_lines"), F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("bigint").alias("n_bytes"))


@query("SELECT lower(coalesce(language, 'unknown')) AS language, count(*) AS n_files FROM indexed_files GROUP BY 1")
def language_breakdown(spark, sf_dir):
    return store.language_counts(read_table(spark, sf_dir, "indexed_files"))


@query("SELECT count(*) AS n_files, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS n_chunks, CAST(coalesce(sum(line_count), 0) AS BIGINT) AS n_lines FROM indexed_files")
def index_stats(spark, sf_dir):
    return store.file_stats(read_table(spark, sf_dir, "indexed_files"))


_STALE = """WITH l AS (SELECT file_path, max(indexed_at) AS indexed_at FROM indexed_files GROUP BY 1), p AS (SELECT DISTINCT file_path, modified_time FROM processed_files),
s AS (SELECT file_path, round(modified_time - epoch_us(indexed_at) / 1e6, 3) AS stale_seconds FROM p JOIN l USING (file_path) WHERE round(modified_time - epoch_us(indexed_at) / 1e6, 3) > 0)"""


def _dated(spark, sf_dir) -> DataFrame:
    """The files as they are now with the time they were last indexed."""
    last = read_table(spark, sf_dir, "indexed_files").groupBy("file_path").agg(F.max("indexed_at").alias("indexed_at"))
    return read_table(spark, sf_dir, "processed_files").select("file_path", "modified_time").distinct().join(last, "file_path")


@query(_STALE + "SELECT file_path, stale_seconds FROM s")
def stale_files(spark, sf_dir):
    return store.stale_files(_dated(spark, sf_dir))


@query(_STALE + """, t AS (SELECT * FROM s ORDER BY stale_seconds DESC, file_path LIMIT 5)
SELECT (SELECT count(*) FROM s) AS n_stale, (SELECT string_agg(file_path || '=' || CAST(round(stale_seconds / 3600, 2) AS VARCHAR), '; ' ORDER BY stale_seconds DESC, file_path || '=' || CAST(round(stale_seconds / 3600, 2) AS VARCHAR)) FROM t) AS most_stale""")
def staleness_summary(spark, sf_dir):
    return store.staleness_summary(_dated(spark, sf_dir))


@query("""WITH l AS (SELECT lower(coalesce(language, 'unknown')) AS g, count(*) AS n FROM indexed_files GROUP BY 1)
SELECT count(*) AS n_files, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS n_chunks, CAST(coalesce(sum(line_count), 0) AS BIGINT) AS n_lines, (SELECT string_agg(g || '=' || n, ',' ORDER BY g) FROM l) AS languages FROM indexed_files""")
def combined_stats(spark, sf_dir):
    stats = store.combined_stats(read_table(spark, sf_dir, "indexed_files"))
    return stats.withColumn("languages", F.array_join(F.transform(F.map_entries("languages"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


@query("""SELECT DISTINCT file_path FROM (SELECT file_path FROM indexed_files UNION SELECT unnest(from_json(file_paths, '["VARCHAR"]')) FROM pending_batches) WHERE file_path IS NOT NULL""")
def pending_merged(spark, sf_dir):
    named = read_table(spark, sf_dir, "pending_batches").select(F.explode(F.from_json("file_paths", "array<string>")).alias("file_path"))
    return store.merge_pending(read_table(spark, sf_dir, "indexed_files"), named)


@query("SELECT file_path, indexed_at FROM indexed_files WHERE indexed_at < TIMESTAMP '2025-06-01 00:00:00'")
def age_filter(spark, sf_dir):
    return store.older_than(read_table(spark, sf_dir, "indexed_files"), F.lit("2025-06-01 00:00:00").cast("timestamp")).select("file_path", "indexed_at")


@query("SELECT DISTINCT file_path, content_hash FROM indexed_files WHERE starts_with(file_path, 'ordered-tally-1000/src/')")
def hashes_under_root(spark, sf_dir):
    return store.under_root(read_table(spark, sf_dir, "indexed_files"), "ordered-tally-1000/src").select("file_path", "content_hash").distinct()


@query("""WITH roots AS (SELECT DISTINCT repo AS r FROM processed_files UNION SELECT DISTINCT repo || '/src' FROM processed_files)
SELECT f.file_path, max_by(r.r, length(r.r)) AS root_path FROM (SELECT DISTINCT file_path FROM processed_files) f JOIN roots r ON f.file_path = r.r OR starts_with(f.file_path, r.r || '/') GROUP BY 1""")
def nearest_root(spark, sf_dir):
    files = read_table(spark, sf_dir, "processed_files")
    roots = files.select(F.explode(F.array("repo", F.concat("repo", F.lit("/src")))).alias("root_path"))
    return store.nearest_root(files, roots)


_LATEST = "SELECT file_path, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY indexed_at DESC, content_hash DESC NULLS LAST) AS n FROM indexed_files) WHERE n = 1"


@query(f"""WITH was AS ({_LATEST}), now AS (SELECT DISTINCT file_path, lower(content_hash) AS h FROM processed_files)
SELECT coalesce(n.file_path, w.file_path) AS file_path, CASE WHEN w.file_path IS NULL THEN 'new' WHEN n.file_path IS NULL THEN 'deleted' WHEN n.h IS NOT DISTINCT FROM regexp_replace(lower(w.content_hash), '^sha256:', '') THEN 'same' ELSE 'modified' END AS state
FROM now n FULL JOIN was w ON n.file_path = w.file_path""")
def incremental_diff(spark, sf_dir):
    scan = read_table(spark, sf_dir, "processed_files").select("file_path", F.lower("content_hash").alias("content_hash")).distinct()
    past = store.latest_by(read_table(spark, sf_dir, "indexed_files"), ["file_path"], [F.col("indexed_at"), F.col("content_hash")])
    return store.diff_files(scan, past.withColumn("content_hash", F.regexp_replace(F.lower("content_hash"), "^sha256:", "")))


@query("SELECT file_path, max(indexed_at) AS indexed_at FROM indexed_files GROUP BY 1")
def upsert_latest(spark, sf_dir):
    past = read_table(spark, sf_dir, "indexed_files")
    early = F.lit("2025-09-01").cast("timestamp")
    old = store.latest_by(past.where(F.col("indexed_at") < early), ["file_path"], [F.col("indexed_at")])
    return store.upsert(old, past.where(F.col("indexed_at") >= early), ["file_path"], [F.col("indexed_at")]).select("file_path", "indexed_at")


@query("SELECT symbol_id, file_path FROM graph_nodes WHERE file_path NOT IN (SELECT file_path FROM processed_files WHERE file_path IS NOT NULL AND repo = 'ordered-tally-1000')")
def delete_by_file(spark, sf_dir):
    gone = read_table(spark, sf_dir, "processed_files").where("repo = 'ordered-tally-1000'").select("file_path")
    nodes, _, _ = graph.drop_file(read_table(spark, sf_dir, "graph_nodes"), read_table(spark, sf_dir, "graph_edges"), read_table(spark, sf_dir, "symbol_index"), gone)
    return nodes.select("symbol_id", "file_path")


@query("""SELECT batch_id, created_at, len(from_json(file_paths, '["VARCHAR"]')) AS n_files, len(from_json(chunk_ids, '["VARCHAR"]')) AS n_chunks FROM pending_batches""")
def pending_batches(spark, sf_dir):
    return store.pending_batches(read_table(spark, sf_dir, "pending_batches")).select("batch_id", "created_at", F.size("file_paths").cast("bigint").alias("n_files"), F.size("chunk_ids").cast("bigint").alias("n_chunks"))


@query("""SELECT file_path, indexed_at FROM indexed_files WHERE file_path NOT IN (SELECT unnest(from_json(file_paths, '["VARCHAR"]')) FROM pending_batches)""")
def rolled_back(spark, sf_dir):
    return store.roll_back(read_table(spark, sf_dir, "indexed_files"), read_table(spark, sf_dir, "pending_batches")).select("file_path", "indexed_at")


@query("SELECT repo, 'codebase_' || trim(regexp_replace(lower(repo), '[^a-z0-9]+', '_', 'g'), '_') || '_' || substr(sha256(repo), 1, 8) AS collection FROM (SELECT DISTINCT repo FROM processed_files WHERE repo IS NOT NULL)")
def collection_names(spark, sf_dir):
    return read_table(spark, sf_dir, "processed_files").where("repo is not null").select("repo").distinct().select("repo", text.collection_name(F.col("repo")).alias("collection"))


_MODULE = "replace(regexp_replace(regexp_replace(file_path, '^src/', ''), '\\.[^.]*$', ''), '/', '.')"


@query(f"SELECT DISTINCT node_id, concat_ws('.', {_MODULE}, CASE WHEN lower(node_type) = 'method' THEN parent_name END, name) AS fqn FROM ast_nodes")
def symbol_fqns(spark, sf_dir):
    nodes = read_table(spark, sf_dir, "ast_nodes")
    return nodes.select("node_id", text.fqn_of(F.col("file_path"), F.col("name"), F.when(F.lower("node_type") == "method", F.col("parent_name"))).alias("fqn")).distinct()


# ------------------------------------------------------------------ predicates


@query("SELECT DISTINCT file_path FROM processed_files WHERE file_path GLOB '*/src/*_[a-m]*.py'")
def glob_filter(spark, sf_dir):
    return read_table(spark, sf_dir, "processed_files").where(text.matches_glob(F.col("file_path"), "*/src/*_[a-m]*.py")).select("file_path").distinct()


@query("SELECT DISTINCT file_path FROM processed_files WHERE NOT contains(file_path, '/tests/') AND NOT (file_path GLOB '*vendor*.js*')")
def path_exclusions(spark, sf_dir):
    return read_table(spark, sf_dir, "processed_files").where(~text.excluded(F.col("file_path"), ["/tests/", "vendor*.js"])).select("file_path").distinct()


@query("""WITH q AS (SELECT DISTINCT query_id, query_text || ' path:src/*.py  -path:tests exclude: file:' || backend || ' exclude:fixtures' AS t FROM search_results WHERE query_text IS NOT NULL),
s AS (SELECT query_id, t, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') AS w FROM q)
SELECT query_id, array_to_string(list_filter(w, lambda x: NOT regexp_matches(x, '^(path|file|-path|exclude):')), ' ') AS clean,
  regexp_extract(list_filter(w, lambda x: regexp_matches(x, '^(path|file):'))[-1], '^[^:]*:(.*)$', 1) AS include,
  array_to_string(list_filter(list_transform(list_filter(w, lambda x: regexp_matches(x, '^(-path|exclude):')), lambda x: regexp_extract(x, '^[^:]*:(.*)$', 1)), lambda x: x <> ''), ',') AS excludes FROM s""")
def query_modifiers(spark, sf_dir):
    queries = read_table(spark, sf_dir, "search_results").where("query_text is not null").select("query_id", "query_text", "backend").distinct()
    full = F.concat("query_text", F.lit(" path:src/*.py  -path:tests exclude: file:"), "backend", F.lit(" exclude:fixtures"))
    parts = queries.select("query_id", full.alias("t")).distinct().select("query_id", text.query_parts(F.col("t")).alias("p"))
    return parts.select("query_id", "p.clean", "p.include", F.array_join("p.excludes", ",").alias("excludes"))


_IGNORED = [
    ("p SIMILAR TO '(.*/)?[.][^/]*'", True),
    ("regexp_matches(p, '^(.*/)?[$][^/]*$')", True),
    ("regexp_matches(p, '^(.*/)?(__pycache__|[^/]*[.]pyc|[^/]*[.]egg-info|[.]venv|venv|[.]tox|[.]pytest_cache|[.]uv_cache|[.]ruff_cache|[.]hypothesis|node_modules|dist|build)$')", True),
    ("regexp_matches(p, '^(.*/)?[^/]*[.]min[.]js$')", True),
    ("p = 'ordered-tally-1000/gen' AND is_folder", True),
    ("regexp_matches(p, '^(.*/)?static$') AND is_folder", True),
    ("regexp_matches(p, '^(.*/)?keep[.]js$')", False),
    ("regexp_matches(p, '^loose-bucket-1001/src/(.*/)?vendor$') AND is_folder", True),
    ("regexp_matches(p, '^loose-bucket-1001/(.*/)?[^/]*[.]json$')", True),
    ("regexp_matches(p, '^loose-bucket-1001/(.*/)?[^/]*index[^/]*[.]json$')", False),
]
_IGNORED_CASE = "CASE " + " ".join(f"WHEN {test} THEN {str(verdict).lower()}" for test, verdict in reversed(_IGNORED)) + " ELSE false END"


@query(f"""WITH f AS (SELECT DISTINCT file_path, string_split(file_path, '/') AS s FROM processed_files WHERE file_path IS NOT NULL),
a AS (SELECT file_path, array_to_string(s[1:i], '/') AS p, i < len(s) AS is_folder FROM (SELECT file_path, s, unnest(range(1, len(s) + 1)) AS i FROM f))
SELECT file_path FROM a GROUP BY 1 HAVING bool_or({_IGNORED_CASE})""")
def ignored_paths(spark, sf_dir):
    rules = rules_of({"": "*.min.js\n/ordered-tally-1000/gen/\nstatic/\n!keep.js\n", "loose-bucket-1001": "src/**/vendor/\n*.json\n!*index*.json\n"})
    return _files(spark, sf_dir).where(is_ignored(F.col("file_path"), rules)).select("file_path")


# ------------------------------------------------------------------ text search

_LINES = "SELECT file_path, content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM (SELECT DISTINCT file_path, content FROM processed_files WHERE content IS NOT NULL AND NOT contains(content, chr(13)))"
_TEXTS = f"SELECT file_path, line, string_split(content, chr(10))[line] AS t FROM ({_LINES})"


def _line_hits(spark, sf_dir, query_text, mode, case_sensitive=False, all_terms=False):
    rows = read_table(spark, sf_dir, "processed_files").select("file_path", "content").distinct()
    lines = text_search.explode_lines(rows)
    return lines.where(text_search.line_test(F.col("text"), query_text, mode, case_sensitive, all_terms)).select("file_path", "line")


@query(f"SELECT file_path, CAST(line AS INTEGER) AS line FROM ({_TEXTS}) WHERE contains(lower(t), 'giving up after')")
def grep_substring(spark, sf_dir):
    return _line_hits(spark, sf_dir, "Giving up AFTER", "substring")


@query(f"SELECT file_path, CAST(line AS INTEGER) AS line FROM ({_TEXTS}) WHERE contains(t, 'Returns the')")
def grep_case_sensitive(spark, sf_dir):
    return _line_hits(spark, sf_dir, "Returns the", "substring", case_sensitive=True)


@query(f"SELECT file_path, CAST(line AS INTEGER) AS line FROM ({_TEXTS}) WHERE contains(lower(t), 'held') AND contains(lower(t), 'limit')")
def grep_all_terms(spark, sf_dir):
    return _line_hits(spark, sf_dir, "limit held", "substring", all_terms=True)


@query(f"SELECT file_path, CAST(line AS INTEGER) AS line FROM ({_TEXTS}) WHERE regexp_matches(t, '(?i)\\bdef\\s+\\w+_(edge|shard)\\(')")
def grep_regex(spark, sf_dir):
    return _line_hits(spark, sf_dir, r"\bdef\s+\w+_(edge|shard)\(", "regex")


@query(f"""WITH hits AS (SELECT file_path, line, t FROM ({_TEXTS}) WHERE contains(t, 'nothing left to') ORDER BY file_path, line LIMIT 20),
f AS (SELECT DISTINCT file_path, content FROM processed_files), n AS (SELECT file_path, content, len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END AS total FROM f)
SELECT h.file_path, CAST(greatest(1, line - 3) AS INTEGER) AS start_line, CAST(least(total, line + 3) AS INTEGER) AS end_line, CAST(line AS INTEGER) AS match_line, array_to_string(string_split(content, chr(10))[greatest(1, line - 3):least(total, line + 3)], chr(10)) AS content, CAST(1 AS DOUBLE) AS score FROM hits h JOIN n USING (file_path)""")
def grep_context_top(spark, sf_dir):
    """The first 20 hits with three lines around them: the report a search returns."""
    rows = read_table(spark, sf_dir, "processed_files").select("file_path", "content").distinct()
    return text_search.search_lines(rows, "nothing left to", case_sensitive=True).drop("chunk_id")


def _fuzzy_sql(pattern: str, limit: int) -> str:
    """The greedy match, one step a character; a line drops out where a character is missing."""
    n, steps = len(pattern), [f"f0 AS (SELECT file_path, line, t, lower(t) AS l, 0 AS pos, CAST({len(pattern)} AS DOUBLE) AS total FROM ({_TEXTS}) WHERE length(t) BETWEEN 1 AND 2000)"]
    for k, c in enumerate(pattern.lower()):
        here, before = "substr(t, p, 1)", "substr(t, p - 1, 1)"
        begins = f"CASE WHEN p = 1 OR {before} IN ({', '.join(_quoted(x) for x in text.SEPARATORS)}) OR (regexp_matches({before}, '\\p{{Ll}}') AND regexp_matches({here}, '\\p{{Lu}}')) OR (regexp_matches({before}, '\\p{{Nd}}') AND regexp_matches({here}, '\\p{{L}}')) THEN 1 ELSE 0 END"
        gain = f"2.0 * CAST(p = 1 AS INTEGER) + 2.0 * {begins} - 0.01 * (p - 1)" if k == 0 else f"0.5 * {begins} + CASE WHEN p = pos + 1 THEN 1.0 ELSE -0.05 * (p - pos - 1) END"
        steps.append(f"f{k + 1} AS (SELECT file_path, line, t, l, p AS pos, total + CAST({gain} AS DOUBLE) AS total FROM (SELECT *, pos + strpos(substr(l, pos + 1), {_quoted(c)}) AS p FROM f{k} WHERE strpos(substr(l, pos + 1), {_quoted(c)}) > 0))")
    most = n + 4.0 + 1.5 * (n - 1)
    return f"WITH {', '.join(steps)}, s AS (SELECT file_path, line, least(1.0, greatest(0.0, total / {most})) AS score FROM f{n}) SELECT file_path, CAST(line AS INTEGER) AS match_line, round(score, 6) AS score FROM s WHERE score >= 0.6 ORDER BY round(score, 9) DESC, file_path, line LIMIT {limit}"


def _quoted(c: str) -> str:
    return f"chr({ord(c)})"


@query(_fuzzy_sql("restorBckt", 20))
def fuzzy_top(spark, sf_dir):
    """The 20 best fuzzy hits over every line of every file."""
    return text_search.search_lines(_files(spark, sf_dir), "restorBckt", mode="fuzzy", limit=20).select("file_path", "match_line", F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ vectors and merging


def _points(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("artifact_type"))


def _probe(dimension: int = 64) -> list[float]:
    return vectors.hash_vector("how does the index stay fresh", dimension)


def _probe_sql() -> str:
    return "[" + ", ".join(repr(v) for v in _probe()) + "]::DOUBLE[]"


def _queries(spark, sf_dir) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return _points(spark, sf_dir).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")


def _topk_sql(condition: str, limit: int) -> str:
    return f"""WITH q AS (SELECT DISTINCT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 6) AS score FROM q, (SELECT DISTINCT vec_id, embedding, label FROM embeddings) e WHERE {condition})
SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM s) WHERE n <= {limit}"""


@query(_topk_sql("true", 20))
def vector_topk(spark, sf_dir):
    """Every query of the set against all vectors."""
    return retrieval.vector_search_many(_points(spark, sf_dir), _queries(spark, sf_dir), 20)


@query(_topk_sql("e.label IN (1, 3)", 20))
def vector_filtered_topk(spark, sf_dir):
    return retrieval.vector_search_many(_points(spark, sf_dir).where(F.col("artifact_type").isin(1, 3)), _queries(spark, sf_dir), 20)


@query(_topk_sql("e.vec_id <> q.query_id", 10))
def similar_chunks(spark, sf_dir):
    return retrieval.vector_search_many(_points(spark, sf_dir), _queries(spark, sf_dir), 10, itself=False)


@query(f"SELECT vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], {_probe_sql()}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_probe_sql()}) DESC, vec_id LIMIT 20")
def vector_topk_of_text(spark, sf_dir):
    """The 20 vectors nearest to the embedded text of one question."""
    return retrieval.vector_search(_points(spark, sf_dir), _probe(), 20).select("chunk_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id AS chunk_id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first_value, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS squares FROM embeddings")
def unit_vectors(spark, sf_dir):
    rows = _points(spark, sf_dir)
    return rows.select("chunk_id", F.round(vectors.unit(F.col("vector"))[0], 6).alias("first_value"), F.round(vectors.dot(F.col("vector"), F.col("vector")), 4).alias("squares"))


@query("SELECT count(*) AS n_queries, true AS is_enough FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id % 50 = 0)")
def vector_index_recall(spark, sf_dir):
    """Recall of the inverted-file index (fitted on a bounded sample, every vector indexed) for the query set: 0.9 or more."""
    points, queries = _points(spark, sf_dir), _queries(spark, sf_dir)
    found = retrieval.VectorIndex(points).search_many(queries, 10, itself=False)
    exact = retrieval.vector_search_many(points, queries, 10, itself=False)
    return retrieval.search_recall(found, exact).select("n_queries", (F.col("recall") >= 0.9).alias("is_enough"))


@query()
def vector_index_topk(spark, sf_dir):
    return retrieval.VectorIndex(_points(spark, sf_dir)).search_many(_queries(spark, sf_dir), 10, itself=False)


@query("SELECT count(*) AS n_points, count(DISTINCT label) AS n_point_files FROM embeddings")
def vector_statistics(spark, sf_dir):
    return retrieval.vector_stats(_points(spark, sf_dir).withColumn("file_path", F.col("artifact_type").cast("string")))


@query("SELECT DISTINCT file_path FROM search_results WHERE trim(file_path) <> ''")
def distinct_point_files(spark, sf_dir):
    return retrieval.distinct_files(read_table(spark, sf_dir, "search_results"))


@query("""WITH c AS (SELECT query_id, chunk_id, max(score) AS score FROM search_results WHERE backend = 'vector' AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2),
o AS (SELECT query_id || '/' || chunk_id AS chunk_id, row_number() OVER (ORDER BY score DESC, query_id || '/' || chunk_id) - 1 AS i FROM c)
SELECT chunk_id, CAST(1.0 / (1 + i) AS DOUBLE) AS score FROM o WHERE i % 3 = 0 ORDER BY i DESC""".replace("1.0 / (1 + i)", "round(i / 7.0, 6)"))
def reranked_by_answer(spark, sf_dir):
    """All vector hits in the order of an answer that scores every third position, the last ones best."""
    rows = read_table(spark, sf_dir, "search_results").where("backend = 'vector' and score is not null and not isnan(score)")
    hits = rows.groupBy(F.concat_ws("/", "query_id", "chunk_id").alias("chunk_id")).agg(F.max("score").alias("score"))
    n = hits.count()
    answer = spark.range(0, n + 9, 3).select(F.col("id").cast("int").alias("position"), F.round(F.col("id") / 7.0, 6).alias("score"))
    return retrieval.rerank_by_response(hits, answer, n).select("chunk_id", "score")


@query("SELECT DISTINCT node_id, name AS kept, lower(language) AS language FROM ast_nodes WHERE name IS NOT NULL AND language IS NOT NULL")
def extra_payload(spark, sf_dir):
    """Payload entries beside the columns of a point."""
    nodes = read_table(spark, sf_dir, "ast_nodes").where("name is not null and language is not null")
    payload = F.create_map(F.lit("file_path"), F.coalesce("file_path", F.lit("")), F.lit("content"), F.coalesce("content", F.lit("")), F.lit("function_name"), F.col("name"), F.lit("language"), F.lower("language"))
    more = nodes.select("node_id", retrieval.extra_payload(payload).alias("m"))
    return more.where(F.size("m") == 2).select("node_id", F.col("m")["function_name"].alias("kept"), F.col("m")["language"].alias("language")).distinct()


def _hits(spark, sf_dir, backend: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "search_results").where((F.col("backend") == backend) & F.col("score").isNotNull() & ~F.isnan("score"))
    return rows.select(F.concat_ws("/", "query_id", "chunk_id").alias("chunk_id"), F.concat_ws("/", "query_id", "file_path").alias("file_path"), "start_line", "end_line", F.lit("").alias("content"), F.col("score").cast("double").alias("score"))


def _hits_sql(backend: str) -> str:
    return f"SELECT query_id || '/' || chunk_id AS chunk_id, query_id || '/' || file_path AS file_path, start_line, end_line, CAST(score AS DOUBLE) AS score FROM search_results WHERE backend = '{backend}' AND score IS NOT NULL AND NOT isnan(score)"


@query(f"SELECT chunk_id, file_path, start_line, end_line, score FROM (SELECT *, row_number() OVER (PARTITION BY file_path, start_line, end_line ORDER BY score DESC, chunk_id) AS n FROM ({_hits_sql('vector')} UNION ALL {_hits_sql('text')})) WHERE n = 1")
def dedup_location(spark, sf_dir):
    return retrieval.dedup_location(_hits(spark, sf_dir, "vector").unionByName(_hits(spark, sf_dir, "text"))).drop("content")


@query(f"SELECT t.chunk_id, t.file_path, t.start_line, t.end_line FROM ({_hits_sql('fuzzy')}) t WHERE NOT EXISTS (SELECT 1 FROM ({_hits_sql('rerank')}) v WHERE v.file_path = t.file_path AND t.start_line >= v.start_line AND t.end_line <= v.end_line)")
def contained_hits_dropped(spark, sf_dir):
    return retrieval.drop_contained(_hits(spark, sf_dir, "fuzzy"), _hits(spark, sf_dir, "rerank")).select("chunk_id", "file_path", "start_line", "end_line")


@query(f"SELECT chunk_id, round(score * (SELECT max(score) FROM ({_hits_sql('vector')})) / (SELECT max(score) FROM ({_hits_sql('text')})), 6) AS score FROM ({_hits_sql('text')})")
def scaled_scores(spark, sf_dir):
    return retrieval.scale_scores(_hits(spark, sf_dir, "text"), _hits(spark, sf_dir, "vector")).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"""WITH v AS ({_hits_sql('vector')}), t AS ({_hits_sql('text')}), s AS (SELECT * REPLACE (score * (SELECT max(score) FROM v) / (SELECT max(score) FROM t) AS score) FROM t),
k AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.file_path = s.file_path AND s.start_line >= v.start_line AND s.end_line <= v.end_line)),
u AS (SELECT *, 'vector' AS source, 0 AS o FROM v UNION ALL SELECT *, 'text', 1 FROM k)
SELECT chunk_id, file_path, start_line, end_line, round(score, 6) AS score, source FROM (SELECT *, row_number() OVER (PARTITION BY file_path, start_line, end_line ORDER BY score DESC, o, chunk_id) AS n FROM u) WHERE n = 1""")
def hybrid_merge(spark, sf_dir):
    merged = retrieval.merge_hits(_hits(spark, sf_dir, "vector"), _hits(spark, sf_dir, "text"))
    return merged.select("chunk_id", "file_path", "start_line", "end_line", F.round("score", 6).alias("score"), "source")


@query("""WITH b AS (SELECT query_id, backend, chunk_id, max(CASE WHEN NOT isnan(score) THEN score END) AS s FROM search_results WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, backend ORDER BY s DESC NULLS LAST, chunk_id) AS n FROM b)
SELECT query_id, chunk_id, round(sum(1.0 / (60 + n)), 9) AS fused, count(*) AS n_lists FROM r GROUP BY 1, 2""")
def rank_fusion(spark, sf_dir):
    rows = read_table(spark, sf_dir, "search_results").where("query_id is not null and chunk_id is not null").withColumn("score", F.when(~F.isnan(F.col("score").cast("double")), F.col("score").cast("double")))
    return retrieval.rank_fusion(rows, list_id="backend", item="chunk_id", group="query_id").select("query_id", "chunk_id", F.round("fused", 9).alias("fused"), "n_lists")


@query()
def hybrid_search(spark, sf_dir):
    """A whole search: vectors of all function chunks, text of all files, modifiers, merge and cut."""
    nodes = _nodes(spark, sf_dir).where("content is not null")
    embed = vectors.hash_embedder(64)
    points = nodes.select(F.col("node_id").cast("string").alias("chunk_id"), "file_path", "start_line", "end_line", "content", F.lit("chunk").alias("artifact_type"), embed(F.col("content")).alias("vector"))
    found = retrieval.search(points, _files(spark, sf_dir), "nothing left to -path:tests", lambda q: vectors.hash_vector(q, 64), limit=20)
    return found.select("chunk_id", "file_path", "start_line", "end_line", F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ graph

_EDGES = "SELECT trim(source_id) AS s, trim(target_id) AS t, lower(trim(edge_type)) AS k FROM graph_edges WHERE trim(source_id) <> '' AND trim(target_id) <> ''"
_START = f"(SELECT s FROM (SELECT s, count(DISTINCT t) AS n FROM ({_EDGES}) GROUP BY s) ORDER BY n DESC, s LIMIT 1)"
_HUB = f"(SELECT t FROM (SELECT t, count(DISTINCT s) AS n FROM ({_EDGES}) WHERE k = 'import' GROUP BY t) ORDER BY n DESC, t LIMIT 1)"


def _start(spark, sf_dir) -> str:
    """The symbol with the most successors: the argument of the traversal queries."""
    counts = graph.clean_edges(read_table(spark, sf_dir, "graph_edges")).groupBy("source_id").agg(F.count_distinct("target_id").alias("n"))
    return counts.orderBy(F.col("n").desc(), "source_id").first()[0]


def _reach_sql(a: str, b: str, start: str, depth: int) -> str:
    steps = [f"l0 AS (SELECT {start} AS x), e AS (SELECT DISTINCT {a} AS a, {b} AS b FROM ({_EDGES}))"]
    seen = "SELECT x FROM l0"
    for d in range(1, depth + 1):
        steps.append(f"l{d} AS (SELECT DISTINCT b AS x FROM e WHERE a IN (SELECT x FROM l{d - 1}) AND b NOT IN ({seen}))")
        seen += f" UNION ALL SELECT x FROM l{d}"
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT x AS symbol_id, {d} AS distance FROM l{d}" for d in range(1, depth + 1))


@query(_reach_sql("s", "t", _START, 3))
def graph_callees(spark, sf_dir):
    return graph.reach(graph.clean_edges(read_table(spark, sf_dir, "graph_edges")), _start(spark, sf_dir), 3)


@query(_reach_sql("t", "s", _HUB, 2))
def graph_callers(spark, sf_dir):
    edges = graph.clean_edges(read_table(spark, sf_dir, "graph_edges"))
    hub = edges.where("edge_type = 'import'").groupBy("target_id").agg(F.count_distinct("source_id").alias("n")).orderBy(F.col("n").desc(), "target_id").first()[0]
    return graph.reach(edges, hub, 2, backward=True)


@query(f"WITH r AS ({_reach_sql('s', 't', _START, 2)}), i AS (SELECT symbol_id AS x FROM r UNION SELECT {_START}) SELECT DISTINCT s AS source_id, t AS target_id, k AS edge_type FROM ({_EDGES}) WHERE s IN (SELECT x FROM i) AND t IN (SELECT x FROM i)")
def graph_induced_edges(spark, sf_dir):
    return graph.induced_edges(read_table(spark, sf_dir, "graph_edges"), _start(spark, sf_dir), 2).select("source_id", "target_id", "edge_type").distinct()


@query(f"WITH r AS ({_reach_sql('s', 't', _START, 1)}), n AS (SELECT symbol_id, max(symbol_name) AS symbol_name FROM graph_nodes GROUP BY 1) SELECT symbol_id, symbol_name, distance FROM n JOIN r USING (symbol_id)")
def graph_neighbour_nodes(spark, sf_dir):
    nodes = read_table(spark, sf_dir, "graph_nodes").groupBy("symbol_id").agg(F.max("symbol_name").alias("symbol_name"))
    return graph.neighbours(nodes, read_table(spark, sf_dir, "graph_edges"), _start(spark, sf_dir)).select("symbol_id", "symbol_name", "distance")


def _pagerank_sql(rounds: int, d: float = 0.85) -> str:
    parts = [f"e AS MATERIALIZED (SELECT DISTINCT s, t FROM ({_EDGES}))", "v AS (SELECT s AS x FROM e UNION SELECT t FROM e)", "g AS (SELECT s, count(*) AS o FROM e GROUP BY s)", "n AS (SELECT count(*) AS n FROM v)", "r0 AS MATERIALIZED (SELECT x, 1.0::DOUBLE / n AS p FROM v, n)"]
    for i in range(1, rounds + 1):
        q = f"r{i - 1}"
        parts.append(f"r{i} AS MATERIALIZED (SELECT v.x, (1 - {d}) / n + {d} * (coalesce(i.p, 0) + coalesce((SELECT sum(p) FROM {q} WHERE x NOT IN (SELECT s FROM g)), 0) / n) AS p FROM v CROSS JOIN n LEFT JOIN (SELECT e.t AS x, sum({q}.p / g.o) AS p FROM e JOIN {q} ON {q}.x = e.s JOIN g ON g.s = e.s GROUP BY e.t) i ON i.x = v.x)")
    return "WITH " + ", ".join(parts) + f" SELECT x AS symbol_id, round(p, 9) AS score FROM r{rounds}"


@query(_pagerank_sql(5))
def pagerank_five_rounds(spark, sf_dir):
    return graph.pagerank(read_table(spark, sf_dir, "graph_edges"), iterations=5, tolerance=0).select("symbol_id", F.round("score", 9).alias("score"))


@query(_pagerank_sql(30))
def pagerank_thirty_rounds(spark, sf_dir):
    return graph.pagerank(read_table(spark, sf_dir, "graph_edges"), iterations=30, tolerance=0).select("symbol_id", F.round("score", 9).alias("score"))


@query()
def pagerank_converged(spark, sf_dir):
    return graph.pagerank(read_table(spark, sf_dir, "graph_edges")).select("symbol_id", F.round("score", 9).alias("score"))


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT s, t FROM ({_EDGES}) WHERE k = 'inherits' AND s <> t), w AS (
  SELECT [s, t] AS p, t AS z FROM e WHERE s < t UNION ALL SELECT list_append(p, e.t), e.t FROM w JOIN e ON e.s = w.z WHERE e.t > p[1] AND NOT list_contains(p, e.t))
SELECT array_to_string(p, ' > ') AS cycle, CAST(len(p) AS INTEGER) AS length FROM w JOIN e ON e.s = w.z AND e.t = p[1]""")
def inheritance_cycles(spark, sf_dir):
    return graph.cycles(read_table(spark, sf_dir, "graph_edges"), edge_type="inherits")


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT s, t FROM ({_EDGES}) WHERE k = 'inherits' AND s <> t), v AS (SELECT s AS x FROM e UNION SELECT t FROM e),
c AS (SELECT x, x AS z FROM v UNION SELECT c.x, e.t FROM c JOIN e ON e.s = c.z),
o AS (SELECT DISTINCT a.s AS x FROM e a JOIN c ON c.x = a.t AND c.z = a.s),
bad AS (SELECT DISTINCT c.z FROM c JOIN o ON o.x = c.x),
w AS (SELECT x AS z, 0 AS d FROM v WHERE x NOT IN (SELECT t FROM e) UNION SELECT e.t, d + 1 FROM w JOIN e ON e.s = w.z WHERE e.t NOT IN (SELECT z FROM bad))
SELECT z AS symbol_id, CAST(max(d) AS INTEGER) AS level FROM w GROUP BY 1""")
def inheritance_levels(spark, sf_dir):
    return graph.topological_levels(read_table(spark, sf_dir, "graph_edges"), "inherits")


@query()
def import_order(spark, sf_dir):
    """All imports in topological order."""
    return graph.topological_order(read_table(spark, sf_dir, "graph_edges"), "import")


@query("SELECT DISTINCT id FROM graph_edges WHERE confidence >= 0.5 AND coalesce(inferred, false)")
def confident_edges(spark, sf_dir):
    """Inferred edges of enough confidence."""
    return enrich.confident(read_table(spark, sf_dir, "graph_edges").where("coalesce(inferred, false)"), 0.5).select("id").distinct()


@query(f"""WITH p AS (SELECT DISTINCT s, t FROM ({_EDGES}) WHERE k IN ('call', 'inferred')), o AS (SELECT s AS x, count(*) AS n FROM p GROUP BY 1), i AS (SELECT t AS x, count(*) AS n FROM p GROUP BY 1)
SELECT coalesce(o.x, i.x) AS symbol_id, coalesce(i.n, 0) AS n_callers, coalesce(o.n, 0) AS n_callees FROM o FULL JOIN i ON o.x = i.x""")
def symbol_degrees(spark, sf_dir):
    return graph.degrees(read_table(spark, sf_dir, "graph_edges"))


@query("""WITH f AS (SELECT symbol_id, max(struct_pack(c := created_at, n := symbol_name, p := file_path)) AS f FROM graph_nodes GROUP BY 1)
SELECT DISTINCT e.id, e.source_id, e.target_id, a.f.n AS source_name, a.f.p AS source_file, b.f.n AS target_name, b.f.p AS target_file FROM graph_edges e LEFT JOIN f a ON a.symbol_id = e.source_id LEFT JOIN f b ON b.symbol_id = e.target_id""")
def edge_endpoints(spark, sf_dir):
    edges = read_table(spark, sf_dir, "graph_edges").select("id", "source_id", "target_id").distinct()
    return graph.with_endpoints(edges, read_table(spark, sf_dir, "graph_nodes")).select("id", "source_id", "target_id", "source_name", "source_file", "target_name", "target_file")


@query("""WITH r AS (SELECT DISTINCT id, file_path, array_to_string(string_split(trim(target_id), '.')[-2:], '.') AS name FROM graph_edges WHERE trim(target_id) <> ''),
f AS (SELECT DISTINCT fqn FROM symbol_index WHERE fqn <> ''), s AS (SELECT k, count(*) AS n, min(fqn) AS fqn FROM (SELECT fqn, unnest(list_transform(range(2, len(string_split(fqn, '.')) + 1), lambda i: array_to_string(string_split(fqn, '.')[i:], '.'))) AS k FROM f) GROUP BY 1 HAVING count(*) = 1)
SELECT r.id, r.name, coalesce(a.fqn, s.fqn, m.fqn) AS target_fqn, CASE WHEN a.fqn IS NOT NULL THEN 'exact' WHEN s.fqn IS NOT NULL THEN 'suffix' WHEN m.fqn IS NOT NULL THEN 'module' END AS step
FROM r LEFT JOIN f a ON a.fqn = r.name LEFT JOIN s ON s.k = r.name LEFT JOIN f m ON m.fqn = concat_ws('.', replace(regexp_replace(regexp_replace(r.file_path, '^src/', ''), '\\.[^.]*$', ''), '/', '.'), r.name)""")
def reference_resolution(spark, sf_dir):
    edges = read_table(spark, sf_dir, "graph_edges").where("trim(target_id) != ''")
    parts = F.split(F.trim("target_id"), r"\.")
    short = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2), ".")
    refs = edges.select("id", "file_path", short.alias("name")).distinct()
    return resolve.resolve_names(refs, read_table(spark, sf_dir, "symbol_index")).select("id", "name", "target_fqn", "step")


_COMMON = "(SELECT n FROM (SELECT string_split(fqn, '.')[-1] AS n, count(DISTINCT fqn) AS c FROM symbol_index WHERE fqn <> '' GROUP BY 1) ORDER BY c DESC, n LIMIT 1)"


def _common_name(spark, sf_dir) -> str:
    """The last part that most symbols share: the argument of the look-up."""
    names = read_table(spark, sf_dir, "symbol_index").where("fqn != ''").groupBy(F.element_at(F.split("fqn", r"\."), -1).alias("n")).agg(F.count_distinct("fqn").alias("c"))
    return names.orderBy(F.col("c").desc(), "n").first()[0]


@query(f"SELECT DISTINCT fqn, file_path FROM symbol_index WHERE fqn = {_COMMON} OR ends_with(fqn, '.' || {_COMMON})")
def symbols_by_name(spark, sf_dir):
    return store.symbols_by_name(read_table(spark, sf_dir, "symbol_index"), _common_name(spark, sf_dir)).select("fqn", "file_path").distinct()


_CALLED = "(SELECT file_path FROM (SELECT s.file_path, count(*) AS c FROM symbol_index s JOIN graph_edges e ON trim(e.target_id) = s.fqn WHERE s.file_path <> '' GROUP BY 1) ORDER BY c DESC, file_path LIMIT 1)"


@query(f"""WITH o AS (SELECT DISTINCT fqn, start_line, end_line, symbol_type FROM symbol_index WHERE file_path = {_CALLED}), r AS (SELECT trim(target_id) AS fqn, count(DISTINCT (file_path, line)) AS n FROM graph_edges GROUP BY 1)
SELECT o.fqn, o.start_line, o.end_line, o.symbol_type, CAST(coalesce(r.n, 0) AS INTEGER) AS n_references FROM o LEFT JOIN r USING (fqn)""")
def symbols_in_file(spark, sf_dir):
    """Symbols of the file whose symbols are named most often, with their references."""
    symbols, edges = read_table(spark, sf_dir, "symbol_index"), read_table(spark, sf_dir, "graph_edges")
    named = symbols.where("file_path != ''").join(edges.select(F.trim("target_id").alias("fqn")), "fqn").groupBy("file_path").agg(F.count(F.lit(1)).alias("c"))
    path = named.orderBy(F.col("c").desc(), "file_path").first()[0]
    return store.symbols_in_file(symbols, edges, path).select("fqn", "start_line", "end_line", "symbol_type", F.size("references").alias("n_references"))


@query("""WITH i AS (SELECT DISTINCT string_split(trim(symbol_id), '.')[-1] AS item_id FROM search_results UNION SELECT DISTINCT trim(symbol_id) FROM search_results), f AS (SELECT DISTINCT fqn FROM symbol_index WHERE fqn <> ''),
s AS (SELECT string_split(fqn, '.')[-1] AS k, min(fqn) AS fqn FROM f GROUP BY 1)
SELECT i.item_id, coalesce(f.fqn, s.fqn) AS fqn FROM i LEFT JOIN f ON f.fqn = i.item_id LEFT JOIN s ON s.k = i.item_id""")
def hits_to_entries(spark, sf_dir):
    """Ids of results, whole and by their last part, to symbol entries."""
    ids = read_table(spark, sf_dir, "search_results").select(F.trim("symbol_id").alias("item_id"))
    both = ids.unionByName(ids.select(F.element_at(F.split("item_id", r"\."), -1).alias("item_id"))).distinct()
    return context.match_symbols(both, read_table(spark, sf_dir, "symbol_index")).select("item_id", "fqn")


@query("""WITH n AS (SELECT DISTINCT file_path, trim(symbol_id) AS s FROM graph_nodes WHERE deleted_at IS NULL AND file_path <> '' AND trim(symbol_id) <> ''),
e AS (SELECT trim(source_id) AS a, trim(target_id) AS b, lower(trim(edge_type)) AS k, file_path FROM graph_edges WHERE trim(source_id) <> '' AND trim(target_id) <> ''),
p AS (SELECT DISTINCT file_path FROM processed_files WHERE file_path <> '')
SELECT p.file_path, (SELECT count(*) FROM n WHERE n.file_path = p.file_path) AS n_symbols, coalesce((SELECT string_agg(DISTINCT b, ',' ORDER BY b) FROM e WHERE k = 'import' AND e.file_path = p.file_path), '') AS imports,
  coalesce((SELECT string_agg(DISTINCT e.file_path, ',' ORDER BY e.file_path) FROM n JOIN e ON e.b = n.s WHERE n.file_path = p.file_path AND e.file_path <> '' AND e.file_path <> p.file_path), '') AS dependents FROM p""")
def file_contexts(spark, sf_dir):
    """Symbols, imports and dependents of every file."""
    found = context.file_context(read_table(spark, sf_dir, "processed_files"), read_table(spark, sf_dir, "graph_nodes"), read_table(spark, sf_dir, "graph_edges"))
    return found.select("file_path", F.size("symbols").cast("bigint").alias("n_symbols"), F.array_join("imports", ",").alias("imports"), F.array_join("dependents", ",").alias("dependents"))


@query("SELECT trim(symbol_id) AS symbol_id, round(max(struct_pack(c := computed_at, s := score)).s, 12) AS pagerank FROM pagerank_scores WHERE graph_type = 'call' AND score IS NOT NULL GROUP BY 1")
def newest_pagerank(spark, sf_dir):
    return context.newest_scores(read_table(spark, sf_dir, "pagerank_scores")).select("symbol_id", F.round("pagerank", 12).alias("pagerank"))


@query()
def graph_built_from_sources(spark, sf_dir):
    """Nodes, edges and symbols of all sources, parsed and resolved anew, counted by kind."""
    parsed = cut_lineage(parsing.parse_files(_files(spark, sf_dir).withColumn("language", detect_language(F.col("file_path")))))
    nodes, edges, symbols = resolve.build_graph(parsing.definitions_of(parsed), parsing.references_of(parsed))
    kinds = nodes.select(F.concat(F.lit("node "), "symbol_type").alias("kind")).unionByName(edges.select(F.concat(F.lit("edge "), "edge_type").alias("kind"))).unionByName(symbols.select(F.when(F.col("unresolved"), "symbol stub").otherwise("symbol").alias("kind")))
    return metrics.count_by(kinds, "kind")


@query("""WITH l AS (SELECT DISTINCT file_path, content FROM processed_files WHERE content IS NOT NULL), t AS (SELECT file_path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line, unnest(string_split(content, chr(10))) AS x FROM l),
r AS (SELECT file_path, line, CASE WHEN regexp_matches(file_path, '\\.java$') THEN regexp_extract(x, '^\\s*import\\s+(?:static\\s+)?([\\w.]+(?:\\.\\*)?)\\s*;', 1) WHEN regexp_matches(file_path, '\\.(c|h|cpp|cc|cxx|hpp|hxx)$') THEN regexp_extract(x, '^\\s*#\\s*include\\s*[<"]([^>"]+)[>"]', 1) ELSE '' END AS name FROM t)
SELECT file_path, CAST(line AS INTEGER) AS line, name FROM r WHERE name <> ''""")
def import_references(spark, sf_dir):
    """What Java, C and C++ sources import, by the reference extractors."""
    sources = _files(spark, sf_dir).where(F.col("file_path").rlike(r"\.(java|c|h|cpp|cc|cxx|hpp|hxx)$")).withColumn("language", detect_language(F.col("file_path")))
    return parsing.references_of(parsing.parse_files(sources)).where("ref_type = 'import'").select("file_path", "line", "name")


@query("""SELECT file_path, lower(node_type) AS node_type, name, count(DISTINCT node_id) AS n FROM ast_nodes WHERE file_path IN (SELECT file_path FROM processed_files) AND NOT (lower(node_type) = 'class' AND regexp_matches(file_path, '\\.[ch]$')) GROUP BY 1, 2, 3""")
def parsed_definitions(spark, sf_dir):
    """Functions, methods and classes found by parsing the files that have rows in ast_nodes."""
    known = read_table(spark, sf_dir, "ast_nodes").select("file_path").distinct()
    sources = _files(spark, sf_dir).join(known, "file_path", "left_semi").withColumn("language", detect_language(F.col("file_path")))
    found = parsing.definitions_of(parsing.parse_files(sources))
    return found.groupBy("file_path", "node_type", "name").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ tokens, chunks, summaries


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS INTEGER) AS by_chars, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS by_words FROM documents WHERE text IS NOT NULL")
def token_counts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", text.char_tokens(F.col("text")).alias("by_chars"), text.word_tokens(F.col("text")).alias("by_words"))


@query("""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, list_transform(range(1, len(ls) + 1), lambda i: CAST(ceil((length(ls[i]) + CASE WHEN i = 1 THEN 0 ELSE 1 END) / 4.0) AS INTEGER)) AS cost FROM l),
k AS (SELECT *, list_transform(range(1, len(ls) + 1), lambda i: list_sum(cost[1:i])) AS upto FROM c)
SELECT doc_id, CASE WHEN ceil(length(text) / 4.0) <= 100 THEN text ELSE array_to_string(ls[1:len(list_filter(upto, lambda u: u <= 100))], chr(10)) END AS short FROM k""")
def truncated_texts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", text.truncate_lines(F.col("text"), 100).alias("short"))


@query("""WITH f AS (SELECT file_path, string_split(content, chr(10)) AS l FROM (SELECT DISTINCT file_path, content FROM processed_files WHERE content IS NOT NULL)),
w AS (SELECT file_path, l, unnest(range(0, CAST(greatest(1, ceil((len(l) - 50) / 48.0) + 1) AS BIGINT))) AS i FROM f)
SELECT file_path, CAST(i * 48 + 1 AS INTEGER) AS start_line, CAST(least(i * 48 + 50, len(l)) AS INTEGER) AS end_line, array_to_string(l[i * 48 + 1:least(i * 48 + 50, len(l))], chr(10)) AS content FROM w""")
def fixed_chunks(spark, sf_dir):
    return chunking.fixed_chunks(read_table(spark, sf_dir, "processed_files").select("file_path", "content").distinct())


@query("""WITH RECURSIVE f AS (SELECT file_path, min(content) AS content FROM processed_files WHERE file_path IS NOT NULL AND content IS NOT NULL GROUP BY 1),
l AS (SELECT file_path, string_split(content, chr(10)) AS ls FROM f), n AS (SELECT *, len(ls) AS total, list_transform(ls, lambda x: length(x) + 1) AS size FROM l),
o AS (SELECT *, list_transform(range(0, total + 1), lambda i: coalesce(list_sum(size[1:i]), 0)) AS off FROM n),
w AS (
  SELECT file_path, 0 AS a, greatest(1, CAST(len(list_filter(off[1:least(51, total + 1)], lambda x: x <= off[1] + 481)) AS BIGINT) - 1) AS b FROM o
  UNION ALL
  SELECT file_path, g, least(total, greatest(g + 1, g + CAST(len(list_filter(off[g + 1:least(g + 51, total + 1)], lambda x: x <= off[g + 1] + 481)) AS BIGINT) - 1))
  FROM (SELECT w.file_path, CASE WHEN w.b - 2 > w.a THEN w.b - 2 ELSE w.b END AS g, o.off, o.total FROM w JOIN o USING (file_path) WHERE w.b < o.total)
)
SELECT w.file_path, CAST(a + 1 AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line, sha256(array_to_string(ls[a + 1:b], chr(10))) AS digest FROM w JOIN o USING (file_path)""")
def token_limited_chunks(spark, sf_dir):
    return chunking.fit_chunks(_files(spark, sf_dir), limit=120).select("file_path", "start_line", "end_line", F.sha2("content", 256).alias("digest"))


@query()
def symbol_chunks(spark, sf_dir):
    """Chunks of all symbols with a limit low enough that many are split at good lines."""
    return chunking.symbol_chunks(_nodes(spark, sf_dir), limit=120).select("file_path", "chunk_type", "name", "part", "n_parts", "start_line", "end_line", F.sha2("content", 256).alias("digest"))


_DEFS = "WITH n AS (SELECT DISTINCT node_id, file_path, name, parent_name, start_line, content, docstring, lower(language) AS language, lower(trim(node_type)) AS t FROM ast_nodes WHERE file_path IS NOT NULL AND name IS NOT NULL)"


@query(f"""{_DEFS}, g AS (SELECT file_path, max(language) AS language, list(name ORDER BY coalesce(start_line, 0), node_id) FILTER (t = 'class') AS c, list(name ORDER BY coalesce(start_line, 0), node_id) FILTER (t = 'function') AS f FROM n GROUP BY 1),
s AS (SELECT file_path, 'File `' || string_split(file_path, '/')[-1] || '` (' || coalesce(language, 'unknown') || ').' || CASE WHEN c IS NULL AND f IS NULL THEN '' ELSE ' Contains ' || array_to_string(list_filter([CASE WHEN c IS NOT NULL THEN 'classes: ' || array_to_string(c, ', ') END, CASE WHEN f IS NOT NULL THEN 'functions: ' || array_to_string(f, ', ') END], lambda x: x IS NOT NULL), '; ') || '.' END AS x, CAST(coalesce(len(f), 0) AS INTEGER) AS n_functions, CAST(coalesce(len(c), 0) AS INTEGER) AS n_classes FROM g)
SELECT file_path, CASE WHEN length(x) <= 2048 THEN x ELSE ' [truncated]' END AS content, n_functions, n_classes FROM s""")
def file_summaries(spark, sf_dir):
    return chunking.file_summaries(read_table(spark, sf_dir, "ast_nodes"))


_PARAGRAPH = r"""array_to_string(list_transform(string_split(string_split_regex(trim(regexp_replace(regexp_replace(trim(coalesce(docstring, '')), '^("{3}|['']{3})', ''), '("{3}|['']{3})$', '')), '\n[ \t]*\n')[1], chr(10)), lambda x: trim(x)), ' ')"""
_SHORT = "CASE WHEN length(x) <= 2048 THEN x ELSE ' [truncated]' END"


@query(rf"""WITH n AS (SELECT DISTINCT node_id, name, coalesce(content, '') AS content, docstring FROM ast_nodes WHERE lower(trim(node_type)) IN ('function', 'method') AND name IS NOT NULL),
p AS (SELECT node_id, name, list_filter(list_transform(string_split(regexp_extract(content, '(?:def|function)\s+' || name || '\s*\(([^)]*)\)', 1), ','), lambda a: trim(string_split(trim(a), '=')[1])), lambda a: a NOT IN ('', 'self', 'cls')) AS ps,
  trim(regexp_extract(string_split(content, chr(10))[1], '\)\s*->\s*([^:]+):', 1)) AS r, {_PARAGRAPH} AS d FROM n),
t AS (SELECT node_id, 'Function `' || name || '`' || CASE WHEN len(ps) > 0 THEN ' takes parameters (' || array_to_string(ps, ', ') || ')' ELSE '' END || CASE WHEN r <> '' THEN ' and returns ' || r ELSE '' END || '.' || CASE WHEN d <> '' THEN ' ' || d ELSE '' END AS x FROM p)
SELECT node_id, {_SHORT} AS content FROM t""")
def function_summaries(spark, sf_dir):
    return chunking.function_summaries(_nodes(spark, sf_dir)).select("node_id", "content")


@query(rf"""WITH n AS (SELECT DISTINCT node_id, file_path, name, parent_name, start_line, coalesce(content, '') AS content, docstring, lower(trim(node_type)) AS t FROM ast_nodes),
m AS (SELECT file_path, parent_name AS name, list(name ORDER BY coalesce(start_line, 0), node_id) AS ms FROM n WHERE t = 'method' AND parent_name IS NOT NULL GROUP BY 1, 2),
p AS (SELECT node_id, name, ms, list_filter(list_transform(string_split(regexp_extract(content, 'class\s+' || name || '\s*\(([^)]+)\)', 1), ','), lambda b: trim(string_split(trim(b), '[')[1])), lambda b: b <> '') AS bs, {_PARAGRAPH} AS d
  FROM n LEFT JOIN m USING (file_path, name) WHERE t = 'class' AND name IS NOT NULL),
t AS (SELECT node_id, 'Class `' || name || '`' || CASE WHEN len(bs) > 0 THEN ' extends ' || array_to_string(bs, ', ') ELSE '' END || '.' || CASE WHEN len(ms) > 0 THEN ' Methods: ' || array_to_string(ms, ', ') || '.' ELSE '' END || CASE WHEN d <> '' THEN ' ' || d ELSE '' END AS x FROM p)
SELECT node_id, {_SHORT} AS content FROM t""")
def class_summaries(spark, sf_dir):
    return chunking.class_summaries(read_table(spark, sf_dir, "ast_nodes")).select("node_id", "content")


@query(r"""WITH n AS (SELECT DISTINCT node_id, docstring AS d, content, lower(language) AS g FROM ast_nodes WHERE content IS NOT NULL),
v AS (SELECT *, ltrim(d) AS h, regexp_replace(regexp_replace(regexp_replace(d, '(?m)^\s*/\*\*?', '', 'g'), '(?m)\*/\s*$', '', 'g'), '(?m)^[ \t]*\*[ \t]?', '', 'g') AS block, regexp_replace(d, '(?m)^\s*///[ \t]?', '', 'g') AS triple,
  regexp_replace(d, '(?m)^\s*//[ \t]?', '', 'g') AS double, regexp_replace(regexp_replace(trim(d), '^("{3}|['']{3})', ''), '("{3}|['']{3})$', '') AS quoted FROM n),
c AS (SELECT node_id, content, CASE WHEN g IN ('javascript', 'typescript', 'java') THEN block WHEN g IN ('c', 'cpp') THEN CASE WHEN starts_with(h, '///') THEN triple ELSE block END WHEN g = 'go' THEN double WHEN g = 'python' THEN quoted
  WHEN starts_with(h, '/*') THEN block WHEN starts_with(h, '///') THEN triple WHEN starts_with(h, '//') THEN double WHEN regexp_matches(h, '^("{3}|['']{3})') THEN quoted ELSE d END AS x FROM v),
p AS (SELECT node_id, content, coalesce(regexp_replace(regexp_replace(regexp_replace(x, '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), '') AS x FROM c)
SELECT node_id, CAST(length(CASE WHEN x <> '' THEN x || chr(10) || '---' || chr(10) || content ELSE content END) AS INTEGER) AS n_chars, CAST(length(x) AS INTEGER) AS doc_chars FROM p""")
def embedding_texts(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).where("content is not null")
    full = text.embed_text(F.col("docstring"), F.col("content"), F.lower("language"))
    return nodes.select("node_id", F.length(full).alias("n_chars"), F.length(text.normalize_doc(F.col("docstring"), F.lower("language"))).alias("doc_chars"))


# ------------------------------------------------------------------ context


@query()
def context_package(spark, sf_dir):
    """The package around a symbol: itself and its callees within two steps, cut to 8192 tokens."""
    edges = read_table(spark, sf_dir, "graph_edges")
    start = _start(spark, sf_dir)
    ids = graph.reach(graph.clean_edges(edges), start, 2).select(F.col("symbol_id").alias("fqn")).unionByName(spark.createDataFrame([(start,)], "fqn string"))
    described = context.describe_symbols(ids, read_table(spark, sf_dir, "symbol_index"), _files(spark, sf_dir), edges, read_table(spark, sf_dir, "pagerank_scores"))
    packed = context.apply_budget(described)
    return packed.select("position", "fqn", F.round("pagerank", 9).alias("pagerank"), "tokens", "is_cut", F.size("callers").alias("n_callers"), F.size("callees").alias("n_callees"))


@query("""WITH h AS (SELECT DISTINCT query_id, chunk_id, file_path, start_line FROM search_results), n AS (SELECT symbol_id, file_path, start_line, end_line FROM graph_nodes WHERE deleted_at IS NULL)
SELECT h.query_id, h.chunk_id, h.file_path, h.start_line, min_by(n.symbol_id, struct_pack(a := n.end_line - n.start_line, b := n.symbol_id)) AS fqn FROM h LEFT JOIN n ON n.file_path = h.file_path AND h.start_line BETWEEN n.start_line AND n.end_line GROUP BY ALL""")
def hits_to_symbols(spark, sf_dir):
    hits = read_table(spark, sf_dir, "search_results").select("query_id", "chunk_id", "file_path", "start_line").distinct()
    return context.enclosing_symbols(hits, read_table(spark, sf_dir, "graph_nodes"))


# ------------------------------------------------------------------ metrics

_RANKED = "SELECT query_id, trim(symbol_id) AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC NULLS LAST, trim(symbol_id)) AS rank FROM search_results WHERE backend = 'rerank' AND NOT isnan(coalesce(score, 0)) GROUP BY query_id, trim(symbol_id)"


def _ranked(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "search_results").where("backend = 'rerank' and not isnan(coalesce(score, 0))")
    best = rows.groupBy("query_id", F.trim("symbol_id").alias("item_id")).agg(F.max("score").alias("score"))
    return metrics.rank_within(best, "query_id", [F.col("score").desc_nulls_last(), F.col("item_id")])


def _relevant(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "relevance_labels").where("grade >= 1").select("query_id", F.trim("symbol_id").alias("item_id"))


_TRUTH = "SELECT DISTINCT query_id, trim(symbol_id) AS item_id FROM relevance_labels WHERE grade >= 1"


@query(f"""WITH r AS ({_RANKED}), t AS ({_TRUTH}) SELECT t.query_id, round(count(*) FILTER (r.rank <= 5) / count(*), 6) AS recall_at_5, round(count(*) FILTER (r.rank <= 10) / count(*), 6) AS recall_at_10, round(count(*) FILTER (r.rank <= 20) / count(*), 6) AS recall_at_20 FROM t LEFT JOIN r ON r.query_id = t.query_id AND r.item_id = t.item_id GROUP BY 1""")
def recall_at_k(spark, sf_dir):
    return metrics.recall_at(_ranked(spark, sf_dir), _relevant(spark, sf_dir))


@query(f"WITH r AS ({_RANKED}), t AS ({_TRUTH}) SELECT t.query_id, round(coalesce(1 / min(r.rank), 0), 6) AS rr FROM t LEFT JOIN r ON r.query_id = t.query_id AND r.item_id = t.item_id GROUP BY 1")
def reciprocal_ranks(spark, sf_dir):
    return metrics.reciprocal_ranks(_ranked(spark, sf_dir), _relevant(spark, sf_dir))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return metrics.latency_summary(read_table(spark, sf_dir, "events"), "value", "event_type")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def events_by_type(spark, sf_dir):
    return metrics.count_by(read_table(spark, sf_dir, "events"), "event_type")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 1000")
def last_samples(spark, sf_dir):
    """The sample log keeps 1000 rows: that is its feature."""
    return metrics.last_samples(read_table(spark, sf_dir, "events").select("event_id", "ts"), "ts", key="event_id")


@query("""WITH f AS (SELECT DISTINCT file_path FROM processed_files WHERE error IS NOT NULL), a AS (SELECT count(DISTINCT file_path) AS n FROM processed_files)
SELECT (SELECT n FROM a) AS n_files, (SELECT count(*) FROM f) AS n_failed, (SELECT string_agg(file_path, ', ' ORDER BY file_path) FROM (SELECT file_path FROM f ORDER BY file_path LIMIT 10)) AS first_failed, greatest(0, (SELECT count(*) FROM f) - 10) AS n_more""")
def failed_files(spark, sf_dir):
    return metrics.failures(read_table(spark, sf_dir, "processed_files"))


# ------------------------------------------------------------------ events


def _file_events(spark, sf_dir) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type").isin("view", "click"), "modified").when(F.col("event_type") == "error", "deleted").otherwise("moved")
    path = F.concat(F.lit("f"), F.col("user_id") % 500, F.lit(".py"))
    old = F.when(kind == "moved", F.concat(F.lit("f"), F.col("event_id") % 500, F.lit(".py")))
    return events.select(kind.alias("event_type"), path.alias("file_path"), old.alias("old_path"), "ts", "event_id", F.concat(F.lit("root"), F.col("user_id") % 7).alias("root"))


_FILE_EVENTS = "SELECT CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'modified' WHEN 'click' THEN 'modified' WHEN 'error' THEN 'deleted' ELSE 'moved' END AS k, 'f' || (user_id % 500) || '.py' AS p, 'f' || (event_id % 500) || '.py' AS o, ts, event_id, 'root' || (user_id % 7) AS root FROM events"


@query(f"""WITH e AS ({_FILE_EVENTS}), g AS (SELECT root, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY root ORDER BY ts) + INTERVAL 600 SECOND THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT root, ts, sum(fresh) OVER (PARTITION BY root ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT root, min(ts) AS session_start, max(ts) + INTERVAL 600 SECOND AS session_end, count(*) AS n_events FROM s GROUP BY root, n""")
def debounce_sessions(spark, sf_dir):
    return debounce.sessions(_file_events(spark, sf_dir), "600 seconds")


@query(f"""WITH e AS ({_FILE_EVENTS}), x AS (SELECT root, p, ts, event_id, 1 AS st, CASE WHEN k = 'moved' THEN 'created' ELSE k END AS k FROM e UNION ALL SELECT root, o, ts, event_id, 0, 'deleted' FROM e WHERE k = 'moved'),
l AS (SELECT root, p, list(k ORDER BY ts, event_id, st) AS ks FROM x GROUP BY 1, 2),
f AS (SELECT root, p, list_reduce(list_prepend('', ks), lambda s, k: CASE k WHEN 'created' THEN CASE s WHEN 'deleted' THEN 'modified' WHEN '' THEN 'created' ELSE s END WHEN 'modified' THEN CASE s WHEN 'created' THEN s ELSE 'modified' END ELSE CASE s WHEN 'created' THEN '' ELSE 'deleted' END END) AS state FROM l)
SELECT root, p AS file_path, state FROM f WHERE state <> ''""")
def merged_events(spark, sf_dir):
    return debounce.merge_events(_file_events(spark, sf_dir), ["root"], ["event_id"])
