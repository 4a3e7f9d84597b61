"""Queries of the training-text problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import docpairs, leakage, packing, provenance, ranking, truncation, wellformed
from codeloom.functions.languages import EXTENSIONS
from codeloom.operators.skew import join_split_hot
from codeloom.session import cut_lineage, read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = wellformed.check_files(read_table(spark, sf_dir, "processed_files"), EXTENSIONS)
    return checked.where("reason is not null").select("file_path").distinct()


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of files that do not parse, per repository and language."""
    return wellformed.error_rates(wellformed.check_files(read_table(spark, sf_dir, "processed_files"), EXTENSIONS))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.pair_nodes(read_table(spark, sf_dir, "ast_nodes")).select("node_id").distinct()


def p3_file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented functions of all source files, with the lines they span and the size of their documentation."""
    pairs = docpairs.pair_files(read_table(spark, sf_dir, "processed_files"), EXTENSIONS)
    return pairs.select("file_path", "name", "start_line", "end_line", F.length("code").alias("code_chars"), F.length("documentation").alias("doc_chars"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, index = read_table(spark, sf_dir, "processed_files"), read_table(spark, sf_dir, "indexed_files")
    return provenance.not_hand_written(files, EXTENSIONS, index).select("file_path").distinct()


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of files of each kind per repository, and by what evidence."""
    kinds = provenance.classify_files(read_table(spark, sf_dir, "processed_files"), read_table(spark, sf_dir, "indexed_files"))
    return kinds.groupBy("repo", "kind", "evidence").agg(F.count_distinct("file_path").alias("n_files"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, chunk_id, symbol_id, criterion, score): backends, newest PageRank of the symbol, confidence of its edges."""
    hits = read_table(spark, sf_dir, "search_results").withColumn("symbol_id", F.trim("symbol_id"))
    chunks = hits.select("query_id", "chunk_id", "symbol_id").distinct()
    ranks = read_table(spark, sf_dir, "pagerank_scores").where("score is not null").withColumn("symbol_id", F.trim("symbol_id"))
    newest = ranks.groupBy("symbol_id").pivot("graph_type", ["call", "import"]).agg(F.max(F.struct("computed_at", "score"))["score"])
    edges = read_table(spark, sf_dir, "graph_edges").where("confidence between 0 and 1")
    ends = edges.select(F.explode(F.array_distinct(F.array(F.trim("source_id"), F.trim("target_id")))).alias("symbol_id"), "confidence").where("symbol_id != ''")
    trust = ends.groupBy("symbol_id").agg(F.round(F.avg("confidence"), 9).alias("confidence"))
    joined = join_split_hot(join_split_hot(chunks, newest, "symbol_id"), trust, "symbol_id")
    derived = joined.select("query_id", "chunk_id", "symbol_id", F.expr("stack(3, 'pagerank_call', call, 'pagerank_import', import, 'confidence', confidence) as (criterion, score)"))
    return hits.select("query_id", "chunk_id", "symbol_id", F.col("backend").alias("criterion"), F.col("score").cast("double")).unionByName(derived)


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ranking of the chunks of every query from all backends, PageRank and edge confidence."""
    return ranking.borda(_scores(spark, sf_dir))


def p5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean NDCG at 10 of the ranking over the labelled queries."""
    chunks = read_table(spark, sf_dir, "search_results").select("query_id", "chunk_id", F.trim("symbol_id").alias("symbol_id")).distinct()
    ranked = ranking.borda(_scores(spark, sf_dir)).join(chunks, ["query_id", "chunk_id"])
    best = ranked.groupBy("query_id", "symbol_id").agg(F.min("final_rank").alias("best_chunk"), F.lit(1).alias("one"))
    # symbols are ranked without gaps, as the ideal order is
    dense = ranking.running_total(best, ["query_id"], [F.col("best_chunk"), F.col("symbol_id")], "one", "before")
    scored = ranking.ndcg(dense.withColumn("final_rank", F.col("before") + 1), read_table(spark, sf_dir, "relevance_labels").withColumn("symbol_id", F.trim("symbol_id")))
    return scored.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("ndcg"), 4).alias("mean_ndcg"))


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in one context package of 8192 tokens."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents")).select("container", "doc_id", "piece", "first_token", "n_tokens")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(packing.pack_documents(read_table(spark, sf_dir, "documents")))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packages, counted: every text once and whole, none over capacity, pieces without gaps."""
    documents = read_table(spark, sf_dir, "documents")
    packed = cut_lineage(packing.pack_documents(documents))
    texts = documents.where("length(text) > 0").select("doc_id")
    pieces = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("first_token").alias("first"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.sum("n_tokens").alias("tokens"), F.max("piece").alias("last"))
    faults = pieces.agg(
        F.count(F.lit(1)).alias("n_packed"),
        F.count_if((F.col("first") != 0) | (F.col("end") != F.col("tokens")) | (F.col("n") != F.col("last") + 1)).alias("n_with_gaps"),
        F.count_if((F.col("n") > 1) & (F.col("tokens") <= 8192)).alias("n_divided_in_vain"),
    )
    bins = packed.groupBy("container").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > 8192).alias("n_over_capacity"), (F.sum("used") >= 0.9 * 8192 * (F.count(F.lit(1)) - 1)).alias("is_full"))
    lost = texts.join(packed.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n_lost"))
    return faults.crossJoin(bins).crossJoin(lost)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked test items with the number of documents and of shared windows."""
    leaks = leakage.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))
    return leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_windows").alias("n_windows"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judge_ends(read_table(spark, sf_dir, "documents")).where("is_cut").select("doc_id").distinct()


def p10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.truncation_report(truncation.judge_ends(read_table(spark, sf_dir, "documents")))


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p6_found": p6_found, "p3_found": p3_found, "p3_file_pairs": p3_file_pairs, "p6_kinds": p6_kinds, "p5_ranking": p5_ranking, "p5_quality": p5_quality, "p8_packing": p8_packing, "p8_fill": p8_fill, "p8_checks": p8_checks, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found, "p10_report": p10_report}

_GRAMS = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents
), passages AS (
  SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{Nd}]+') AS w FROM eval_items
), d AS (
  SELECT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM texts WHERE len(w) >= 13)
), e AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM passages WHERE len(w) >= 13)
)"""

_BORDA = """
WITH hits AS (
  SELECT query_id, chunk_id, trim(symbol_id) AS symbol_id, backend, CAST(score AS DOUBLE) AS score FROM search_results
), newest AS (
  SELECT trim(symbol_id) AS symbol_id, 'pagerank_' || graph_type AS criterion, max(struct_pack(a := computed_at, s := score)).s AS score
  FROM pagerank_scores WHERE score IS NOT NULL AND graph_type IN ('call', 'import') GROUP BY 1, 2
), ends AS (
  SELECT id, trim(source_id) AS symbol_id, confidence FROM graph_edges WHERE confidence BETWEEN 0 AND 1
  UNION SELECT id, trim(target_id), confidence FROM graph_edges WHERE confidence BETWEEN 0 AND 1
), copies AS (
  SELECT id, count(*) AS n FROM graph_edges GROUP BY 1
), trust AS (
  SELECT symbol_id, 'confidence' AS criterion, round(sum(confidence * n) / sum(n), 9) AS score FROM ends JOIN copies USING (id) WHERE symbol_id <> '' GROUP BY 1
), raw AS (
  SELECT query_id, chunk_id, backend AS criterion, score FROM hits
  UNION ALL SELECT DISTINCT h.query_id, h.chunk_id, n.criterion, n.score FROM hits h JOIN newest n USING (symbol_id)
  UNION ALL SELECT DISTINCT h.query_id, h.chunk_id, t.criterion, t.score FROM hits h JOIN trust t USING (symbol_id)
), best AS (
  SELECT query_id, chunk_id, criterion, max(CASE WHEN NOT isnan(score) THEN score END) AS score FROM raw
  WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2, 3
), sizes AS (
  SELECT query_id, count(DISTINCT chunk_id) AS n FROM hits WHERE chunk_id IS NOT NULL GROUP BY 1
), ranked AS (
  SELECT b.query_id, b.chunk_id, s.n, count(*) OVER (PARTITION BY b.query_id, criterion) AS m,
    rank() OVER (PARTITION BY b.query_id, criterion ORDER BY score DESC) + (count(*) OVER (PARTITION BY b.query_id, criterion, score) - 1) / 2 AS r
  FROM best b JOIN sizes s USING (query_id) WHERE score IS NOT NULL
), sums AS (
  SELECT query_id, chunk_id, sum(n * (0.5 - (r - 0.5) / m)) AS g, count(*) AS n_scores FROM ranked GROUP BY 1, 2
), every AS (
  SELECT DISTINCT query_id, chunk_id FROM best
), points AS (
  SELECT e.query_id, e.chunk_id, coalesce(s.n_scores, 0) AS n_scores,
    round(coalesce(s.g, 0.0) + (SELECT count(DISTINCT criterion) FROM (SELECT criterion FROM best UNION SELECT unnest(['pagerank_call', 'pagerank_import', 'confidence']))) * (z.n - 1) / 2, 6) AS points
  FROM every e LEFT JOIN sums s USING (query_id, chunk_id) JOIN sizes z USING (query_id)
)
SELECT query_id, chunk_id, n_scores, points, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, chunk_id) AS final_rank FROM points"""

ORACLE: dict[str, str] = {
    "p5_ranking": _BORDA,
    "p5_quality": f"""
WITH ranking AS ({_BORDA}
), symbols AS (
  SELECT DISTINCT query_id, chunk_id, trim(symbol_id) AS symbol_id FROM search_results
), best AS (
  SELECT query_id, symbol_id, min(final_rank) AS c FROM ranking JOIN symbols USING (query_id, chunk_id) GROUP BY 1, 2
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c, symbol_id) AS r FROM best
), grades AS (
  SELECT query_id, trim(symbol_id) AS symbol_id, max(grade) AS g FROM relevance_labels GROUP BY 1, 2
), ideal AS (
  SELECT query_id, sum((pow(2.0, g) - 1) / log2(r + 1)) AS ideal
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, symbol_id) AS r FROM grades) WHERE r <= 10 GROUP BY 1
), got AS (
  SELECT query_id, sum((pow(2.0, g) - 1) / log2(r + 1)) AS dcg FROM placed JOIN grades USING (query_id, symbol_id) WHERE r <= 10 GROUP BY 1
)
SELECT count(*) AS n_queries, round(avg(round(coalesce(dcg, 0.0) / ideal, 6)), 4) AS mean_ndcg FROM ideal LEFT JOIN got USING (query_id) WHERE ideal > 0""",
    "p8_checks": """
SELECT count(DISTINCT doc_id) AS n_packed, CAST(0 AS BIGINT) AS n_with_gaps, CAST(0 AS BIGINT) AS n_divided_in_vain, CAST(0 AS BIGINT) AS n_over_capacity, true AS is_full, CAST(0 AS BIGINT) AS n_lost
FROM documents WHERE length(text) > 0""",
    "p9_found": _GRAMS + "SELECT DISTINCT d.doc_id, e.item_id FROM d JOIN e USING (g)",
    "p9_items": _GRAMS + "SELECT item_id, count(DISTINCT doc_id) AS n_docs, CAST(count(*) AS BIGINT) AS n_windows FROM d JOIN e USING (g) GROUP BY 1",
}
