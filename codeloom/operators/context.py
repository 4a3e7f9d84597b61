"""Context packages: symbols with source, neighbours and importance, cut to a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import char_tokens, source_slice, truncate_lines
from codeloom.operators import graph
from codeloom.operators.skew import join_split_hot


def newest_scores(scores: DataFrame, graph_type: str = "call") -> DataFrame:
    """(symbol_id, pagerank): the newest non-null score of each symbol."""
    rows = scores.where((F.col("graph_type") == graph_type) & F.col("score").isNotNull())
    return rows.groupBy(F.trim("symbol_id").alias("symbol_id")).agg(F.max(F.struct("computed_at", "score"))["score"].alias("pagerank"))


def describe_symbols(ids: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(fqn, source_code, summary, callers, callees, pagerank) of the symbols in ``ids`` (column fqn).

    Callers and callees are distinct direct neighbours in order of name. ``ids`` is a result list or a set of symbols; edges
    are reduced to those that touch it before anything is gathered, and a hub's neighbours are the one list its row needs.
    """
    wanted = ids.select("fqn").distinct()
    own = join_split_hot(symbols, wanted, "fqn", "left_semi")
    newest = F.max(F.struct("updated_at", "file_path", "start_line", "end_line", "summary")) if "updated_at" in symbols.columns else F.first(F.struct("file_path", "start_line", "end_line", "summary"))
    rows = wanted.join(own.groupBy("fqn").agg(newest.alias("s")), "fqn", "left").withColumn("file_path", F.col("s.file_path"))
    # only texts of the files that are needed move
    needed = files.join(rows.select("file_path").distinct(), "file_path", "left_semi").groupBy("file_path").agg(F.max("content").alias("content"))
    rows = rows.join(needed, "file_path", "left").select("fqn", source_slice(F.col("content"), F.col("s.start_line"), F.col("s.end_line")).alias("source_code"), F.coalesce("s.summary", F.lit("")).alias("summary"))
    calls = graph.clean_edges(edges).where(F.col("edge_type").isin("call", "inferred")).select("source_id", "target_id").distinct()
    into = join_split_hot(calls.withColumnRenamed("target_id", "fqn"), wanted, "fqn", "left_semi").groupBy("fqn").agg(F.array_sort(F.collect_set("source_id")).alias("callers"))
    out = join_split_hot(calls.withColumnRenamed("source_id", "fqn"), wanted, "fqn", "left_semi").groupBy("fqn").agg(F.array_sort(F.collect_set("target_id")).alias("callees"))
    none = F.array().cast("array<string>")
    ranked = rows.join(into, "fqn", "left").join(out, "fqn", "left").join(newest_scores(scores).withColumnRenamed("symbol_id", "fqn"), "fqn", "left")
    return ranked.select("fqn", "source_code", "summary", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"), F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"))


def symbol_tokens() -> Column:
    """Tokens of a described symbol: source, summary and every neighbour's name."""
    names = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + char_tokens(x))
    return char_tokens(F.col("source_code")) + char_tokens(F.col("summary")) + names("callers") + names("callees")


def apply_budget(described: DataFrame, max_tokens: int = 8192) -> DataFrame:
    """The symbols that fit, most important first (ties by fqn), and a shortened form of the first that does not.

    That one loses its neighbours, then lines of its source, then its summary, until it fits; if nothing helps it drops out.
    Everything after it drops out.
    """
    priced = described.withColumn("tokens", symbol_tokens())
    # at most max_tokens symbols of a token or more can fit, so a distributed top-k finds all that matter, and the one after
    costly = priced.where("tokens > 0").orderBy(F.col("pagerank").desc(), "fqn").limit(max(0, max_tokens) + 1)
    order = Window.orderBy(F.col("pagerank").desc(), F.col("fqn"))
    rows = costly.unionByName(priced.where("tokens = 0")).withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("position", F.row_number().over(order))
    fits = rows.where(F.col("upto") <= max_tokens).withColumn("is_cut", F.lit(False))
    over = rows.where(F.col("upto") > max_tokens).orderBy("position").limit(1).withColumn("room", max_tokens - (F.col("upto") - F.col("tokens")))
    none = F.array().cast("array<string>")
    bare = char_tokens(F.col("source_code")) + char_tokens(F.col("summary"))
    shorter = truncate_lines(F.col("source_code"), F.greatest(F.lit(0), F.col("room") - char_tokens(F.col("summary")) - 10).cast("int"))
    second = char_tokens(shorter) + char_tokens(F.col("summary")) <= F.col("room")
    brief = truncate_lines(F.col("summary"), F.greatest(F.lit(0), F.col("room") - 10).cast("int"))
    source = F.when(bare <= F.col("room"), F.col("source_code")).when(second, shorter).otherwise(F.lit(""))
    text = F.when((bare <= F.col("room")) | second, F.col("summary")).otherwise(brief)
    cut = over.withColumns({"_source": source, "_text": text}).withColumns({"source_code": F.col("_source"), "summary": F.col("_text"), "callers": none, "callees": none, "is_cut": F.lit(True)})
    cut = cut.withColumn("tokens", symbol_tokens()).where(F.col("tokens") <= F.col("room")).drop("_source", "_text", "room")
    return fits.unionByName(cut).drop("upto").orderBy("position")


def assemble(ids: DataFrame, symbols: DataFrame, files: DataFrame, nodes: DataFrame, edges: DataFrame, scores: DataFrame, max_tokens: int = 8192) -> DataFrame:
    """One row: the packed symbols as an array of structs, and the package's metadata."""
    packed = apply_budget(describe_symbols(ids, symbols, files, edges, scores), max_tokens)
    item = F.struct("position", "fqn", "source_code", "summary", "callers", "callees", "pagerank", "tokens", "is_cut")
    return packed.agg(F.array_sort(F.collect_list(item)).alias("symbols"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.min("pagerank").alias("least_pagerank"), F.max("pagerank").alias("most_pagerank"))


def enclosing_symbols(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """``hits`` with the fqn of the smallest node whose lines hold the hit's first line, so that text and graph results share
    one space of ids; null where none does. Equi-join on the file with a range condition; hits are a result list, so the
    nodes of other files drop out by a semi-join first."""
    spans = nodes.where("deleted_at is null" if "deleted_at" in nodes.columns else "true").join(hits.select("file_path").distinct(), "file_path", "left_semi")
    spans = spans.select(F.col("file_path").alias("_p"), F.col("symbol_id").alias("fqn"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    joined = hits.join(spans, (F.col("file_path") == F.col("_p")) & F.col("start_line").between(F.col("_a"), F.col("_b")), "left")
    return joined.groupBy(*hits.columns).agg(F.min_by("fqn", F.struct(F.col("_b") - F.col("_a"), "fqn")).alias("fqn"))


def match_symbols(ids: DataFrame, symbols: DataFrame, column: str = "item_id") -> DataFrame:
    """``ids`` with the fqn each stands for: the symbol of that very name, else the smallest one whose last part it is."""
    names = symbols.where("fqn != ''").select("fqn").distinct()
    short = names.groupBy(F.element_at(F.split("fqn", r"\."), -1).alias("_short")).agg(F.min("fqn").alias("_by_short"))
    exact = names.select(F.col("fqn").alias("_exact"), F.col("fqn").alias("_key"))
    rows = join_split_hot(ids.withColumn("_key", F.trim(F.col(column))), exact, "_key", "left").withColumnRenamed("_key", "_short")
    return join_split_hot(rows, short, "_short", "left").withColumn("fqn", F.coalesce("_exact", "_by_short")).drop("_short", "_exact", "_by_short")


def enrich_hits(hits: DataFrame, nodes: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Search hits with their enclosing symbol's fqn, summary, callers, callees and pagerank; one join for all of them.

    Hits in no symbol keep their row with nulls.
    """
    placed = enclosing_symbols(hits, nodes)
    described = describe_symbols(placed.where("fqn is not null").select("fqn"), symbols, files, edges, scores).drop("source_code")
    return placed.join(described, "fqn", "left").select(*hits.columns, "fqn", "summary", "callers", "callees", "pagerank")


def file_context(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, symbols, imports, dependents) of each path: the symbols it defines, what its import edges name, and the
    other files that refer to one of its symbols. Lists are sorted and hold each name once; a path without any has empty
    lists. Only edges that touch the paths are gathered.
    """
    wanted = paths.select("file_path").where("file_path != ''").distinct()
    live = nodes.where("deleted_at is null" if "deleted_at" in nodes.columns else "true")
    own = live.join(wanted, "file_path", "left_semi").select("file_path", F.trim("symbol_id").alias("symbol_id")).where("symbol_id != ''").distinct()
    clean = graph.clean_edges(edges)
    imports = clean.where("edge_type = 'import'").join(wanted, "file_path", "left_semi").groupBy("file_path").agg(F.array_sort(F.collect_set("target_id")).alias("imports"))
    into = clean.select(F.col("target_id").alias("symbol_id"), F.col("file_path").alias("_from")).where("_from != ''")
    single = own.groupBy("symbol_id").agg(F.collect_set("file_path").alias("_to"))
    reached = join_split_hot(into, single, "symbol_id", "inner").select(F.explode("_to").alias("file_path"), "_from").where("file_path != _from")
    dependents = reached.groupBy("file_path").agg(F.array_sort(F.collect_set("_from")).alias("dependents"))
    symbols = own.groupBy("file_path").agg(F.array_sort(F.collect_set("symbol_id")).alias("symbols"))
    none = F.array().cast("array<string>")
    out = wanted.join(symbols, "file_path", "left").join(imports, "file_path", "left").join(dependents, "file_path", "left")
    return out.select("file_path", *[F.coalesce(c, none).alias(c) for c in ("symbols", "imports", "dependents")])
