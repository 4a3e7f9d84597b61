"""References to symbols and the graph they make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import edge_type_of, fqn_of, module_of
from codeloom.operators.skew import join_split_hot


def resolve_names(references: DataFrame, symbols: DataFrame, name: str = "name", path: str = "file_path") -> DataFrame:
    """``references`` with target_fqn and step: an exact fqn, else the only fqn that ends in ``.name``, else the name inside
    the reference's own module, else null.

    The suffix test is an equi-join: every fqn is listed under each of its suffixes once and suffixes with several fqns are
    dropped before the join. A name that a third of all references use is joined without being shuffled.
    """
    fqns = symbols.select("fqn").where("fqn != ''").distinct()
    parts = F.split("fqn", r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    suffixes = fqns.where(F.size(parts) > 1).select("fqn", F.explode(tails).alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("fqn").alias("_suffix")).where("_n = 1").drop("_n")
    exact = fqns.select(F.col("fqn").alias("_key"), F.col("fqn").alias("_exact"))
    rows = references.withColumn("_key", F.trim(F.col(name)))
    rows = join_split_hot(rows, exact, "_key", "left")
    rows = join_split_hot(rows, suffixes, "_key", "left").drop("_key")
    rows = rows.withColumn("_key", F.concat_ws(".", module_of(F.col(path)), F.trim(F.col(name))))
    rows = join_split_hot(rows, exact.withColumnRenamed("_exact", "_own"), "_key", "left").drop("_key")
    step = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_suffix").isNotNull(), "suffix").when(F.col("_own").isNotNull(), "module")
    return rows.withColumns({"target_fqn": F.coalesce("_exact", "_suffix", "_own"), "step": step}).drop("_exact", "_suffix", "_own")


def build_graph(definitions: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, symbols) from definitions (file_path, language, node_type, name, parent_name, start_line, end_line) and
    references (file_path, name, ref_type, line, parent_symbol).

    Definitions come first, then references resolve against them; an unresolved one makes a stub symbol. Each file has a
    module node. A reference's source is its module, with the enclosing symbol where there is one.
    """
    fqn = fqn_of(F.col("file_path"), F.col("name"), F.when(F.col("node_type") == "method", F.col("parent_name")))
    own = definitions.select(fqn.alias("symbol_id"), F.col("name").alias("symbol_name"), F.col("node_type").alias("symbol_type"), "file_path", "start_line", "end_line", "language")
    modules = definitions.groupBy("file_path").agg(F.max("end_line").alias("end_line"), F.max("language").alias("language"))
    modules = modules.select(module_of(F.col("file_path")).alias("symbol_id"), F.element_at(F.split("file_path", "/"), -1).alias("symbol_name"), F.lit("module").alias("symbol_type"), "file_path", F.lit(1).alias("start_line"), "end_line", "language")
    nodes = own.unionByName(modules).dropDuplicates(["symbol_id"])
    symbols = nodes.select(F.col("symbol_id").alias("fqn"), "file_path", "start_line", "end_line", F.lit("unknown").alias("symbol_type"), F.col("symbol_id").alias("graph_node_id"), F.lit(False).alias("unresolved"))
    found = resolve_names(references, symbols)
    source = F.when(F.col("parent_symbol") != "", F.concat_ws(".", module_of(F.col("file_path")), "parent_symbol")).otherwise(module_of(F.col("file_path")))
    target = F.coalesce("target_fqn", F.trim("name"))
    edges = found.select(source.alias("source_id"), target.alias("target_id"), edge_type_of(F.col("ref_type")).alias("edge_type"), F.lit(False).alias("inferred"), F.lit(1.0).alias("confidence"), "file_path", "line", F.col("target_fqn").isNull().alias("_open"))
    stubs = edges.where("_open").groupBy(F.col("target_id").alias("fqn")).agg(F.min("file_path").alias("file_path"), F.min("line").cast("int").alias("start_line"))
    stubs = stubs.select("fqn", "file_path", "start_line", F.col("start_line").alias("end_line"), F.lit("unknown").alias("symbol_type"), F.lit("").alias("graph_node_id"), F.lit(True).alias("unresolved"))
    edges = edges.drop("_open").groupBy("source_id", "target_id", "edge_type").agg(*[F.first(c).alias(c) for c in ("inferred", "confidence")], F.min("file_path").alias("file_path"), F.min("line").alias("line"))
    return nodes, edges, symbols.unionByName(stubs)
