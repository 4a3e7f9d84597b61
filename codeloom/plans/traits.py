"""Queries of column functions, result rows, exchange and events, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text, vectors
from codeloom.functions.languages import extension_of
from codeloom.operators import graph, retrieval, store
from codeloom.plans.reference import _FILE_EVENTS, _file_events, _hits, _hits_sql
from codeloom.session import cut_lineage, read_table
from codeloom.sources import exchange
from codeloom.sources.ignore import is_denied
from codeloom.streaming import debounce

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLE[function.__name__] = sql
        return function

    return register


# ------------------------------------------------------------------ lines, documentation, paths


@query("""WITH f AS (SELECT file_path, string_split(min(content), chr(10)) AS l FROM processed_files WHERE content IS NOT NULL GROUP BY 1), n AS (SELECT DISTINCT node_id, file_path, start_line, end_line FROM ast_nodes WHERE start_line IS NOT NULL AND end_line IS NOT NULL)
SELECT node_id, sha256(CASE WHEN least(end_line, len(l)) >= greatest(start_line, 1) THEN array_to_string(l[greatest(start_line, 1):least(end_line, len(l))], chr(10)) ELSE '' END) AS digest FROM n JOIN f USING (file_path)""")
def source_slices(spark, sf_dir):
    """The lines of every node, cut from its file."""
    files = read_table(spark, sf_dir, "processed_files").where("content is not null").groupBy("file_path").agg(F.min("content").alias("content"))
    nodes = read_table(spark, sf_dir, "ast_nodes").select("node_id", "file_path", "start_line", "end_line").where("start_line is not null and end_line is not null").distinct()
    return nodes.join(files, "file_path").select("node_id", F.sha2(text.source_slice(F.col("content"), F.col("start_line"), F.col("end_line")), 256).alias("digest"))


@query(r"""WITH f AS (SELECT DISTINCT file_path, content FROM processed_files WHERE content IS NOT NULL), l AS (SELECT file_path, unnest(string_split(content, chr(10))) AS x FROM f)
SELECT file_path, count(*) FILTER (regexp_matches(x, '^\s*(def\s+|class\s+|if\s+|elif\s+|else\s*:|for\s+|while\s+|try\s*:|except|finally\s*:|with\s+|return\s|yield\s|raise\s|@)')) AS n_statements,
  CAST(sum(length(x) - length(regexp_replace(x, '^\s+', ''))) AS BIGINT) AS indented FROM l GROUP BY 1""")
def line_traits(spark, sf_dir):
    """Per file the lines that begin a statement, and the depth of all lines together."""
    files = read_table(spark, sf_dir, "processed_files").select("file_path", "content").where("content is not null").distinct()
    lines = files.select("file_path", F.explode(F.split("content", "\n")).alias("x"))
    return lines.groupBy("file_path").agg(F.count_if(text.starts_statement(F.col("x"))).alias("n_statements"), F.sum(text.indentation(F.col("x"))).alias("indented"))


@query(r"SELECT DISTINCT node_id, regexp_replace(regexp_replace(docstring, '(?m)[ \t]+$', '', 'g'), '^\n+|\n+$', '', 'g') AS pretty FROM ast_nodes WHERE docstring IS NOT NULL")
def pretty_docs(spark, sf_dir):
    nodes = read_table(spark, sf_dir, "ast_nodes").where("docstring is not null")
    return nodes.select("node_id", text.pretty_doc(F.col("docstring")).alias("pretty")).distinct()


_SOME_PATHS = "SELECT DISTINCT CASE WHEN line_count % 2 = 0 THEN '/' || file_path ELSE file_path END AS p FROM indexed_files WHERE file_path IS NOT NULL AND line_count IS NOT NULL"


def _some_paths(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "indexed_files").where("file_path is not null and line_count is not null")
    return rows.select(F.when(F.col("line_count") % 2 == 0, F.concat(F.lit("/"), "file_path")).otherwise(F.col("file_path")).alias("p")).distinct()


@query(f"SELECT p, CASE WHEN starts_with(p, '/') THEN p ELSE '/base/' || p END AS resolved FROM ({_SOME_PATHS})")
def resolved_paths(spark, sf_dir):
    return _some_paths(spark, sf_dir).select("p", text.resolve_path(F.col("p"), "/base/").alias("resolved"))


@query(f"SELECT p FROM ({_SOME_PATHS}) WHERE lower(regexp_extract(p, '[^/](\\.[^./]+)$', 1)) IN ('.py', '.ts', '.go')")
def extension_filter(spark, sf_dir):
    return _some_paths(spark, sf_dir).where(extension_of(F.col("p")).isin(".py", ".ts", ".go"))


_RISKY = "SELECT DISTINCT replace(replace(replace(file_path, '.json', '.pem'), '/vendor/', '/.ssh/'), '.yaml', '/.env.local') AS p FROM processed_files WHERE file_path IS NOT NULL"


@query(f"SELECT p FROM ({_RISKY}) WHERE regexp_matches(p, '(^|/)([.]ssh|[^/]*[.]pem|[.]env[.][^/]*)(/|$)')")
def sensitive_paths(spark, sf_dir):
    """Paths with a denied component, on names made to hold some."""
    paths = read_table(spark, sf_dir, "processed_files").where("file_path is not null").select(F.replace(F.replace(F.replace("file_path", F.lit(".json"), F.lit(".pem")), F.lit("/vendor/"), F.lit("/.ssh/")), F.lit(".yaml"), F.lit("/.env.local")).alias("p"))
    return paths.distinct().where(is_denied(F.col("p")))


@query("SELECT DISTINCT id, CASE k WHEN 'import' THEN 'import' WHEN 'inheritance' THEN 'inherits' ELSE 'call' END AS edge_type FROM (SELECT id, CASE lower(trim(edge_type)) WHEN 'inherits' THEN 'inheritance' WHEN 'inferred' THEN 'type_annotation' ELSE lower(trim(edge_type)) END AS k FROM graph_edges)")
def edge_types(spark, sf_dir):
    """Edge types of reference types."""
    kind = F.lower(F.trim("edge_type"))
    rows = read_table(spark, sf_dir, "graph_edges").select("id", F.when(kind == "inherits", "inheritance").when(kind == "inferred", "type_annotation").otherwise(kind).alias("k"))
    return rows.select("id", text.edge_type_of(F.col("k")).alias("edge_type")).distinct()


@query("""WITH d AS (SELECT DISTINCT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, list_transform(range(0, 32), lambda i: (16 * (strpos('0123456789abcdef', substr(h, 2 * i + 1, 1)) - 1) + strpos('0123456789abcdef', substr(h, 2 * i + 2, 1)) - 1) / 127.5 - 1.0) AS v FROM d)
SELECT doc_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first_value, round(v[32] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS last_value FROM b""")
def hash_embeddings(spark, sf_dir):
    """The stand-in embedding of every text, in as many dimensions as a digest has bytes."""
    docs = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").distinct()
    made = docs.select("doc_id", vectors.hash_embedder(32)(F.col("text")).alias("v"))
    return made.select("doc_id", F.round(F.col("v")[0], 6).alias("first_value"), F.round(F.col("v")[31], 6).alias("last_value"))


# ------------------------------------------------------------------ rows of a result


@query(f"SELECT CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, file_path, start_line, end_line, round(score, 4) AS score, 'unknown' AS language FROM (SELECT * FROM ({_hits_sql('vector')}) ORDER BY score DESC, chunk_id LIMIT 50)")
def api_rows(spark, sf_dir):
    """The first 50 hits as an interface returns them."""
    return retrieval.api_rows(retrieval.finish(_hits(spark, sf_dir, "vector"), 50))


@query(f"SELECT chunk_id, score FROM ({_hits_sql('text')}) ORDER BY score DESC, chunk_id LIMIT 10")
def default_limit(spark, sf_dir):
    """A limit of 0 means the default of 10."""
    return retrieval.finish(_hits(spark, sf_dir, "text"), 0).select("chunk_id", "score")


@query(f"SELECT chunk_id, CAST(length(file_path) AS DOUBLE) AS score FROM ({_hits_sql('rerank')}) ORDER BY length(file_path) DESC, chunk_id LIMIT 30")
def reranked_by_scorer(spark, sf_dir):
    """All hits ordered anew by a scorer, here the length of their path, and cut."""
    hits = _hits(spark, sf_dir, "rerank").withColumn("content", F.col("file_path"))
    return retrieval.rerank(hits, lambda c: F.length(c).cast("double"), 30).select("chunk_id", "score")


@query(f"SELECT chunk_id, score FROM ({_hits_sql('rerank')}) ORDER BY score DESC, chunk_id LIMIT 30")
def reranked_by_none(spark, sf_dir):
    return retrieval.rerank(_hits(spark, sf_dir, "rerank"), None, 30).select("chunk_id", "score")


# ------------------------------------------------------------------ store, graph and exchange


@query("""WITH e AS (SELECT trim(source_id) AS source_id, trim(target_id) AS target_id, lower(trim(edge_type)) AS edge_type, seen_at, id FROM graph_edges WHERE trim(source_id) <> '' AND trim(target_id) <> '')
SELECT source_id, target_id, edge_type, max(id) AS id FROM (SELECT *, rank() OVER (PARTITION BY source_id, target_id, edge_type ORDER BY seen_at DESC NULLS LAST) AS n FROM e) WHERE n = 1 GROUP BY ALL""")
def upserted_edges(spark, sf_dir):
    """Edges put in by key in two batches, the younger over the older."""
    edges = graph.clean_edges(read_table(spark, sf_dir, "graph_edges")).select("source_id", "target_id", "edge_type", "seen_at", "id")
    keys, order, young = ["source_id", "target_id", "edge_type"], [F.col("seen_at"), F.col("id")], F.coalesce(F.col("seen_at") >= F.lit("2025-09-01").cast("timestamp"), F.lit(False))
    old = store.latest_by(edges.where(~young), keys, order)
    return store.upsert(old, edges.where(young), keys, order).select("source_id", "target_id", "edge_type", "id")


@query("""WITH r AS (SELECT repo AS index_id, min(indexed_at) AS created_at, max(indexed_at) AS updated_at FROM indexed_files WHERE repo IS NOT NULL GROUP BY 1) SELECT index_id, created_at, updated_at, 'c-' || index_id AS collection_name FROM r""")
def upserted_repositories(spark, sf_dir):
    """Registry rows replaced by key: the first creation and the known collection stay."""
    dated = read_table(spark, sf_dir, "indexed_files").where("repo is not null").groupBy(F.col("repo").alias("index_id")).agg(F.min("indexed_at").alias("a"), F.max("indexed_at").alias("b"))
    old = dated.select("index_id", F.col("a").alias("created_at"), F.col("a").alias("updated_at"), F.concat(F.lit("c-"), "index_id").alias("collection_name"))
    new = dated.select("index_id", F.col("b").alias("created_at"), F.col("b").alias("updated_at"), F.lit(None).cast("string").alias("collection_name"))
    return store.upsert_repositories(old, new)


@query("""WITH e AS (SELECT DISTINCT source_id, target_id, edge_type, coalesce(inferred, false) AS inferred, coalesce(confidence, 1.0) AS confidence, coalesce(file_path, '') AS file_path, coalesce(line, 0) AS line FROM graph_edges)
SELECT source_id, target_id, edge_type, inferred, confidence, file_path, CAST(line AS INTEGER) AS line FROM e""")
def exported_edges(spark, sf_dir):
    """Edges written as JSON and read back, missing fields as their defaults."""
    nodes, edges, scores = (read_table(spark, sf_dir, t) for t in ("graph_nodes", "graph_edges", "pagerank_scores"))
    cut_lineage(spark.range(1))  # names the shared folder
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/export-{uuid.uuid4().hex}"
    exchange.export_graph(nodes, edges, scores, folder)
    return exchange.import_graph(spark, folder)["edges"].distinct()


@query("SELECT DISTINCT fqn, summary, start_line FROM symbol_index WHERE fqn IS NOT NULL")
def summaries_as_json(spark, sf_dir):
    """Rows to JSON and back."""
    rows = read_table(spark, sf_dir, "symbol_index").where("fqn is not null").select("fqn", "summary", "start_line").distinct()
    return exchange.summaries_from_json(exchange.summaries_to_json(rows), "fqn string, summary string, start_line int")


# ------------------------------------------------------------------ events

_GOOD = "NOT regexp_matches({0}, '^f[0-9]*7[.]py$')"


@query(f"""WITH e AS (SELECT event_id, k, p, CASE WHEN k = 'moved' THEN o END AS o FROM ({_FILE_EVENTS})), g AS (SELECT *, {_GOOD.format('p')} AS a, coalesce({_GOOD.format('o')}, false) AS b FROM e)
SELECT event_id, CASE WHEN k = 'moved' AND NOT b THEN 'created' WHEN k = 'moved' AND NOT a THEN 'deleted' ELSE k END AS event_type, CASE WHEN k = 'moved' AND NOT a THEN o ELSE p END AS file_path FROM g WHERE a OR (k = 'moved' AND b)""")
def accepted_events(spark, sf_dir):
    """Events on wanted files that are not ignored; a move over the border becomes a creation or a deletion."""
    events = debounce.accept_events(_file_events(spark, sf_dir), [".py"], lambda c: c.rlike("^f[0-9]*7[.]py$"))
    return events.select("event_id", "event_type", "file_path")


@query(f"""SELECT event_id, p AS file_path, CASE WHEN k = 'moved' THEN 'created' ELSE k END AS event FROM ({_FILE_EVENTS}) UNION ALL SELECT event_id, o, 'deleted' FROM ({_FILE_EVENTS}) WHERE k = 'moved'""")
def split_moves(spark, sf_dir):
    return debounce.split_moves(_file_events(spark, sf_dir)).select("event_id", "file_path", "event")
