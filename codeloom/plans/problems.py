"""Queries of the general data problems (2, 4, 7) over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import hierarchy, incremental, references
from codeloom.operators.skew import join_split_hot
from codeloom.session import read_table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, past, markers = (read_table(spark, sf_dir, t) for t in ("processed_files", "indexed_files", "pending_batches"))
    return incremental.work_list(files, past, markers).select("file_path").distinct()


def _inherits(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read_table(spark, sf_dir, "graph_edges").where(F.lower(F.trim("edge_type")) == "inherits")
    return edges.select(F.trim("source_id").alias("child"), F.trim("target_id").alias("parent"))


def _nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent) of node ids: each node and the class of its file that its parent_name names (the smallest id of several)."""
    nodes = read_table(spark, sf_dir, "ast_nodes")
    place = lambda name: F.struct(F.col("file_path"), F.col(name).alias("name"))
    classes = nodes.where(F.lower(F.trim("node_type")) == "class").where("node_id is not null and name is not null and file_path is not null")
    owner = classes.groupBy(place("name").alias("place")).agg(F.min("node_id").alias("parent"))
    inner = nodes.where("node_id is not null and parent_name is not null and file_path is not null").select(F.col("node_id").alias("child"), place("parent_name").alias("place")).distinct()
    # a class with very many members: its place is hashed, so that hot places can be told apart by value
    hashed = lambda rows: rows.withColumn("at", F.xxhash64("place"))
    joined = join_split_hot(hashed(inner), hashed(owner).groupBy("at").agg(F.collect_list(F.struct("place", "parent")).alias("owners")), "at", "inner")
    joined = joined.select("child", F.filter("owners", lambda o: o["place"] == F.col("place")).alias("o")).where("size(o) > 0").select("child", F.col("o")[0]["parent"].alias("parent"))
    return joined.select(F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent"))


def _forest(spark: SparkSession, sf_dir: str, with_path: bool) -> tuple[DataFrame, DataFrame]:
    """(links, resolved) of both kinds; a key carries its kind in front so that both are solved in one go."""
    both = None
    for kind, links in (("inherits", _inherits(spark, sf_dir)), ("nesting", _nesting(spark, sf_dir))):
        tag = lambda c, kind=kind: F.when(F.col(c) != "", F.concat(F.lit(kind + "|"), F.col(c))).alias(c)
        part = links.select(tag("child"), tag("parent"))
        both = part if both is None else both.unionByName(part)
    return both, hierarchy.resolve_hierarchy(both, with_path=with_path)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, solved = _forest(spark, sf_dir, with_path=False)
    children = links.select(F.col("child").alias("key")).where("key is not null").distinct()
    bare = lambda c: F.expr(f"substring({c}, instr({c}, '|') + 1)")
    return solved.join(children, "key", "left_semi").select(F.substring_index("key", "|", 1).alias("tree_kind"), bare("key").alias("child_key"), bare("root").alias("root_key"), F.col("depth").alias("node_depth"))


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full path, depth, root and number of descendants of every node of both forests."""
    _, solved = _forest(spark, sf_dir, with_path=True)
    below = hierarchy.descendants(solved).groupBy("key").agg(F.count(F.lit(1)).alias("n_descendants"))
    return solved.join(below, "key", "left").select(
        "key", "root", F.col("depth").alias("node_depth"), F.array_join(F.col("path"), " > ").alias("full_path"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"), F.col("endless").alias("is_endless")
    )


NODES = references.ParentKey("graph_nodes", "symbol_id", "created_at", "deleted_at")
SYMBOLS = references.ParentKey("symbol_index", "fqn")
EDGE_TARGET = references.ForeignKey("graph_edges", "target_id", "graph_nodes", "id", "seen_at")
SYMBOL_NODE = references.ForeignKey("symbol_index", "graph_node_id", "graph_nodes", "fqn", "updated_at")
EDGE_SOURCE = references.ForeignKey("graph_edges", "source_id", "symbol_index", "id", "seen_at", cascade_only=True)


def _orphans(spark: SparkSession, sf_dir: str, keys: list[references.ForeignKey], parents: list[references.ParentKey]) -> DataFrame:
    names = {k.table for k in keys} | {p.table for p in parents}
    tables = {t: read_table(spark, sf_dir, t) for t in sorted(names)}
    known = read_table(spark, sf_dir, "builtin_symbols").select(F.col("symbol_id").alias("ref"))
    return references.orphan_cascade(tables, parents, keys, known)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direct orphans of the whole cascade, in which edges out of orphaned symbols are inherited ones."""
    direct = _orphans(spark, sf_dir, [EDGE_TARGET, SYMBOL_NODE, EDGE_SOURCE], [NODES, SYMBOLS]).where("kind = 'direct'")
    return direct.select("ref_table", "ref_key", "cause").distinct()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, month, kind and cause; edges out of symbols whose own node is orphaned count as inherited."""
    return references.orphan_report(_orphans(spark, sf_dir, [EDGE_TARGET, SYMBOL_NODE, EDGE_SOURCE], [NODES, SYMBOLS]))


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_paths": p4_paths, "p7_found": p7_found, "p7_report": p7_report}

_FOREST = """
WITH RECURSIVE links AS (
  SELECT 'inherits' AS tree_kind, trim(source_id) AS child, min(nullif(trim(target_id), '')) AS parent
  FROM graph_edges WHERE lower(trim(edge_type)) = 'inherits' AND trim(source_id) <> '' GROUP BY 1, 2
  UNION ALL
  SELECT 'nesting', CAST(a.node_id AS VARCHAR), CAST(min(c.node_id) AS VARCHAR)
  FROM ast_nodes a JOIN ast_nodes c ON lower(trim(c.node_type)) = 'class' AND c.file_path = a.file_path AND c.name = a.parent_name
  GROUP BY a.node_id
), tops AS (
  SELECT tree_kind, child AS top FROM links WHERE parent IS NULL
  UNION SELECT tree_kind, parent FROM links l WHERE parent IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM links o WHERE o.tree_kind = l.tree_kind AND o.child = l.parent)
), ends AS (
  SELECT tree_kind, top AS child, top AS at, 0 AS d FROM tops
  UNION ALL SELECT e.tree_kind, l.child, e.at, e.d + 1 FROM ends e JOIN links l ON l.tree_kind = e.tree_kind AND l.parent = e.child
)"""

ORACLE = {
    "p2_found": """
WITH last AS (
  SELECT file_path, max(indexed_at) AS at FROM indexed_files GROUP BY 1
), seen AS (
  SELECT l.file_path, l.at, max(nullif(regexp_replace(lower(trim(i.content_hash)), '^sha256:', ''), '')) AS h
  FROM last l JOIN indexed_files i ON i.file_path = l.file_path AND i.indexed_at = l.at GROUP BY 1, 2
), marked AS (
  SELECT p AS file_path, max(created_at) AS at
  FROM (SELECT unnest(from_json(file_paths, '["VARCHAR"]')) AS p, created_at FROM pending_batches) GROUP BY 1
)
SELECT DISTINCT f.file_path FROM processed_files f
LEFT JOIN seen s ON s.file_path = f.file_path LEFT JOIN marked m ON m.file_path = f.file_path
WHERE s.file_path IS NULL OR s.h IS NULL OR s.h IS DISTINCT FROM nullif(regexp_replace(lower(trim(f.content_hash)), '^sha256:', ''), '') OR m.at > s.at""",
    "p4_found": _FOREST
    + """
SELECT l.tree_kind, l.child AS child_key, coalesce(e.at, '') AS root_key, CAST(coalesce(e.d, -1) AS INTEGER) AS node_depth
FROM links l LEFT JOIN ends e ON e.tree_kind = l.tree_kind AND e.child = l.child""",
    "p7_found": """
WITH states AS (
  SELECT trim(symbol_id) AS ref, bool_and(deleted_at IS NOT NULL) AS gone, min(created_at) AS first_at
  FROM graph_nodes WHERE trim(symbol_id) <> '' GROUP BY 1
), refs AS (
  SELECT 'graph_edges' AS ref_table, CAST(id AS VARCHAR) AS ref_key, trim(target_id) AS ref, seen_at AS at FROM graph_edges
  UNION ALL SELECT 'symbol_index', fqn, trim(graph_node_id), updated_at FROM symbol_index
), judged AS (
  SELECT r.ref_table, r.ref_key,
    CASE WHEN s.ref IS NULL THEN 'missing' WHEN s.gone THEN 'deleted' WHEN s.first_at > r.at THEN 'late' END AS cause
  FROM refs r LEFT JOIN states s ON s.ref = r.ref
  WHERE r.ref <> '' AND r.ref NOT IN (SELECT trim(symbol_id) FROM builtin_symbols)
)
SELECT DISTINCT ref_table, ref_key, cause FROM judged WHERE cause IS NOT NULL""",
    "p7_report": """
WITH states AS (
  SELECT trim(symbol_id) AS ref, bool_and(deleted_at IS NOT NULL) AS gone, min(created_at) AS first_at
  FROM graph_nodes WHERE trim(symbol_id) <> '' GROUP BY 1
), refs AS (
  SELECT 'graph_edges' AS ref_table, CAST(id AS VARCHAR) AS ref_key, trim(target_id) AS ref, seen_at AS day FROM graph_edges
  UNION ALL SELECT 'symbol_index', fqn, trim(graph_node_id), updated_at FROM symbol_index
), direct AS (
  SELECT r.ref_table, r.ref_key, r.day,
    CASE WHEN s.ref IS NULL THEN 'missing' WHEN s.gone THEN 'deleted' WHEN s.first_at > r.day THEN 'late' END AS cause
  FROM refs r LEFT JOIN states s ON s.ref = r.ref
  WHERE r.ref <> '' AND r.ref NOT IN (SELECT trim(symbol_id) FROM builtin_symbols)
), found AS (
  SELECT ref_table, ref_key, day, 'direct' AS kind, cause, cause AS root_cause FROM direct WHERE cause IS NOT NULL
), dead AS (
  SELECT trim(ref_key) AS fqn, min(cause) AS cause FROM found WHERE ref_table = 'symbol_index' GROUP BY 1
), heirs AS (
  SELECT 'graph_edges', CAST(e.id AS VARCHAR), e.seen_at, 'inherited', 'orphaned parent', d.cause
  FROM graph_edges e JOIN dead d ON d.fqn = trim(e.source_id)
  WHERE CAST(e.id AS VARCHAR) NOT IN (SELECT ref_key FROM found WHERE ref_table = 'graph_edges' AND ref_key IS NOT NULL)
)
SELECT ref_table, strftime(day, '%Y-%m') AS month, kind, cause, root_cause, count(DISTINCT ref_key) AS n_refs
FROM (SELECT * FROM found UNION ALL SELECT * FROM heirs) GROUP BY ALL""",
    "p4_paths": _FOREST
    + """
, keyed AS (
  SELECT tree_kind || '|' || child AS k, tree_kind || '|' || parent AS p FROM links WHERE parent IS NOT NULL
  UNION SELECT tree_kind || '|' || child, NULL FROM links WHERE parent IS NULL
  UNION SELECT tree_kind || '|' || parent, NULL FROM links l WHERE parent IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM links o WHERE o.tree_kind = l.tree_kind AND o.child = l.parent)
), down AS (
  SELECT k, k AS root, 0 AS d, k AS full_path FROM keyed WHERE p IS NULL
  UNION ALL SELECT c.k, w.root, w.d + 1, w.full_path || ' > ' || c.k FROM down w JOIN keyed c ON c.p = w.k
), above AS (
  SELECT k, k AS a FROM down UNION ALL SELECT x.k, c.p FROM above x JOIN keyed c ON c.k = x.a WHERE c.p IS NOT NULL
), sizes AS (
  SELECT a, count(*) - 1 AS n FROM above GROUP BY a
)
SELECT c.k AS "key", coalesce(w.root, '') AS root, CAST(coalesce(w.d, -1) AS INTEGER) AS node_depth, coalesce(w.full_path, '') AS full_path,
  coalesce(s.n, 0) AS n_descendants, w.k IS NULL AS is_endless
FROM keyed c LEFT JOIN down w ON w.k = c.k LEFT JOIN sizes s ON s.a = c.k""",
}
