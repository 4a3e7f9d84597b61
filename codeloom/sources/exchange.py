"""JSON in and out: graphs, evaluation sets, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.store import upsert

NODE = "symbol_id string, symbol_name string, symbol_type string, file_path string, start_line int, end_line int, language string"
EDGE = "source_id string, target_id string, edge_type string, inferred boolean, confidence double, file_path string, line int"
SCORE = "symbol_id string, graph_type string, score double, computed_at timestamp"
KEYS = {"nodes": ["symbol_id"], "edges": ["source_id", "target_id", "edge_type"], "pagerank": ["symbol_id", "graph_type"]}
SCHEMAS = {"nodes": NODE, "edges": EDGE, "pagerank": SCORE}


def export_graph(nodes: DataFrame, edges: DataFrame, scores: DataFrame, folder: str, version: int = 1) -> None:
    """One folder of JSON lines per relation and one row of metadata; parts are written in parallel, nothing is gathered."""
    for name, rows in (("nodes", nodes), ("edges", edges), ("pagerank", scores)):
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        rows.select(*columns).write.mode("overwrite").json(f"{folder}/{name}")
    meta = nodes.sparkSession.createDataFrame([(version,)], "schema_version int").withColumn("exported_at", F.current_timestamp())
    meta.write.mode("overwrite").json(f"{folder}/meta")


def import_graph(spark: SparkSession, folder: str, mode: str = "replace", current: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Relations of an export; ``merge`` puts them over the current ones by key, ``replace`` forgets those.

    Missing fields get their defaults: language unknown, not inferred, confidence 1, no file, line 0.
    """
    if mode not in ("replace", "merge"):
        raise ValueError(f"unknown mode {mode!r}")
    out = {name: spark.read.schema(schema).json(f"{folder}/{name}") for name, schema in SCHEMAS.items()}
    out["nodes"] = out["nodes"].na.fill({"language": "unknown"})
    out["edges"] = out["edges"].na.fill({"inferred": False, "confidence": 1.0, "file_path": "", "line": 0})
    if mode == "merge" and current:
        out = {name: upsert(current[name], rows, KEYS[name]) if name in current else rows for name, rows in out.items()}
    return out


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """(query, relevant_files) from a JSON file of an array, or of an object with a ``queries`` array."""
    one = "query string, relevant_files array<string>"
    whole = spark.read.option("multiLine", True).schema(f"queries array<struct<{one.replace(' string', ':string', 1).replace(' array', ':array')}>>, {one}").json(path)
    listed = whole.where("queries is not null").select(F.explode("queries").alias("q")).select("q.query", "q.relevant_files")
    return listed.unionByName(whole.where("query is not null").select("query", "relevant_files"))


def summaries_to_json(summaries: DataFrame) -> DataFrame:
    return summaries.select(F.to_json(F.struct(*summaries.columns)).alias("json"))


def summaries_from_json(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json("json", schema).alias("s")).select("s.*")
