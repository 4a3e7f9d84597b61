"""Vector search, merging and fusing of result lists, re-ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import excluded, matches_glob, parse_query
from codeloom.functions.vectors import cosine, norm, unit
from codeloom.operators.text_search import search_lines
from codeloom.session import within_time

MODES = ("hybrid", "vector", "grep", "fuzzy", "summary")


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def vector_search(points: DataFrame, query: list[float], limit: int = 10, file_filter: str | None = None, artifact_types: list[str] | None = None, vector: str = "vector", key: str = "chunk_id", exclude: list[str] | None = None) -> DataFrame:
    """``points`` with a score column: the ``limit`` rows of highest cosine to ``query``, ties by key.

    Filters come before the cut, so that it never yields less than there is. Points of another dimension or without length
    score 0. Exact: one scan, one top-k per task, ``limit`` rows to the final merge.
    """
    if file_filter:
        points = points.where(matches_glob(F.col("file_path"), file_filter))
    if exclude:
        points = points.where(~excluded(F.col("file_path"), exclude))
    if artifact_types:
        points = points.where(F.col("artifact_type").isin(artifact_types))
    return points.withColumn("score", cosine(F.col(vector), literal_vector(query))).orderBy(F.col("score").desc(), F.col(key)).limit(limit)


def assert_dimension(points: DataFrame, dimension: int, vector: str = "vector") -> DataFrame:
    """``points`` unchanged; reading a vector of another length fails the query."""
    return points.where(F.coalesce(F.assert_true(F.size(vector) == dimension, F.lit("vector of another dimension")).isNull(), F.lit(True)))


def similar_to(points: DataFrame, chunk: object, limit: int = 10, vector: str = "vector", key: str = "chunk_id") -> DataFrame:
    """The ``limit`` points nearest to the stored vector of ``chunk``, itself left out; nothing if there is no such chunk."""
    own = points.where(F.col(key) == chunk).select(F.col(vector).alias("_query")).limit(1)
    return points.where(F.col(key) != chunk).crossJoin(F.broadcast(own)).withColumn("score", cosine(F.col(vector), F.col("_query"))).drop("_query").orderBy(F.col("score").desc(), F.col(key)).limit(limit)


#: Query vectors that travel to the workers at once.
QUERY_BLOCK = 4096


def _unit_rows(vectors: list, width: int):
    """Matrix of unit rows; vectors of another length, without length, or null become zero rows, which score 0."""
    import numpy as np

    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width:
            row = np.asarray(v, dtype=float)
            size = np.sqrt((row * row).sum())
            if size > 0 and np.isfinite(size):
                out[i] = row / size
    return out


def vector_search_many(points: DataFrame, queries: DataFrame, limit: int = 10, vector: str = "vector", key: str = "chunk_id", itself: bool = True, cells: tuple[str, object, int] | None = None) -> DataFrame:
    """(query_id, key, score): for each row (query_id, vector) of ``queries`` the ``limit`` points of highest cosine, ties by key.

    Scores are compared with 6 digits. The queries go to the points in blocks of ``QUERY_BLOCK``; every batch of points meets a
    block in one matrix product and hands on its best ``limit`` a query, so points are never shuffled and a hot cell or
    source spreads like any other rows. With ``itself`` off a point of a query's own id is left out. Null query ids or vectors
    find nothing. ``cells`` (column of the points, centres, probes) restricts each query to its nearest cells.
    """
    import numpy as np
    import pandas as pd

    wanted = queries.select("query_id", "vector").where("query_id is not null and vector is not null").dropDuplicates(["query_id"])
    kinds = dict(wanted.dtypes)["query_id"], dict(points.dtypes)[key]
    schema = f"query_id {kinds[0]}, {key} {kinds[1]}, score double"
    columns = [key, vector] + ([cells[0]] if cells else [])
    chosen = points.select(*columns).where(F.col(key).isNotNull())
    blocks = -(-wanted.count() // QUERY_BLOCK)
    found = points.sparkSession.createDataFrame([], schema)
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        ids, width = [r["query_id"] for r in rows], max(len(r["vector"]) for r in rows)
        sent = points.sparkSession.sparkContext.broadcast((ids, _unit_rows([r["vector"] for r in rows], width)))

        def scan(batches, sent=sent, width=width):
            ids, matrix = sent.value
            near = np.argsort(-(matrix @ cells[1].T), axis=1)[:, : cells[2]] if cells and len(cells[1]) else None
            for batch in batches:
                keys, scores = batch[key].to_numpy(), np.round(_unit_rows(batch[vector].tolist(), width) @ matrix.T, 6)
                if near is not None:
                    own = batch[cells[0]].to_numpy()
                out = []
                for q, name in enumerate(ids):
                    mine = scores[:, q]
                    at = np.arange(len(mine)) if near is None else np.flatnonzero(np.isin(own, near[q]))
                    if not itself:
                        at = at[keys[at] != name]
                    if len(at) > limit:
                        least = np.partition(mine[at], len(at) - limit)[len(at) - limit]
                        at = at[mine[at] >= least]
                    best = sorted(zip((-mine[at]).tolist(), keys[at].tolist(), strict=True))[:limit]
                    out += [(name, k, -s + 0.0) for s, k in best]
                yield pd.DataFrame(out, columns=["query_id", key, "score"])

        found = found.unionByName(chosen.mapInPandas(scan, schema))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    return found.distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


class VectorIndex:
    """Inverted-file index: centroids from a bounded sample of ``sample`` vectors, every vector assigned to one of them.

    A search probes the nearest cells and ranks their members exactly; how many follows from the sample: the fewest that find
    ``recall`` of the true neighbours of ``QUERY_SAMPLE`` of its vectors. Cells may be of any size: ranking is a filter and a
    top-k, so a cell that holds a third of all vectors still spreads over all tasks.
    """

    QUERY_SAMPLE = 256

    def __init__(self, points: DataFrame, cells: int = 16, sample: int = 20_000, seed: int = 7, vector: str = "vector", key: str = "chunk_id", rounds: int = 8, recall: float = 0.95):
        import numpy as np

        self.vector, self.key = vector, key
        spread = points.where(norm(F.col(vector)) > 0).select(unit(F.col(vector)).alias("u"), F.xxhash64(F.lit(seed), F.col(key)).alias("h"))
        rows = np.array([r["u"] for r in spread.orderBy("h").limit(sample).collect()])
        rng = np.random.default_rng(seed)
        centres = rows[rng.choice(len(rows), size=min(cells, len(rows)), replace=False)] if len(rows) else rows
        for _ in range(rounds if len(rows) else 0):
            owner = (rows @ centres.T).argmax(axis=1)
            for c in range(len(centres)):
                if (owner == c).any():
                    mean = rows[owner == c].mean(axis=0)
                    centres[c] = mean / (np.linalg.norm(mean) or 1.0)
        self.centres = centres
        self.probes = self._enough(rows, recall)
        self.points = points.withColumn("cell", self._nearest(F.col(vector)))

    def _enough(self, rows, recall: float, k: int = 10) -> int:
        """Fewest cells that hold ``recall`` of the ``k`` nearest sample vectors of the first vectors of the sample."""
        import numpy as np

        if len(rows) < 2:
            return max(1, len(self.centres))
        asked = rows[: self.QUERY_SAMPLE]
        scores = asked @ rows.T
        scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        nearest = np.argsort(-scores, axis=1)[:, : min(k, len(rows) - 1)]
        owner = (rows @ self.centres.T).argmax(axis=1)
        order = np.argsort(-(asked @ self.centres.T), axis=1)
        place = np.argsort(order, axis=1)  # how many cells come before each cell, by query
        needed = np.sort(np.take_along_axis(place, owner[nearest], axis=1).ravel()) + 1
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])

    def _nearest(self, v: Column) -> Column:
        if not len(self.centres):
            return F.lit(0)
        scores = F.array(*[F.aggregate(F.zip_with(v, literal_vector(c.tolist()), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x) for c in self.centres])
        return F.array_position(scores, F.array_max(scores)).cast("int") - 1

    def search(self, query: list[float], limit: int = 10, probes: int | None = None) -> DataFrame:
        import numpy as np

        near = [int(i) for i in np.argsort(-(self.centres @ np.array(query)))[: probes or self.probes]] if len(self.centres) else [0]
        return vector_search(self.points.where(F.col("cell").isin(near)), query, limit, vector=self.vector, key=self.key)


    def search_many(self, queries: DataFrame, limit: int = 10, probes: int | None = None, itself: bool = True) -> DataFrame:
        """As ``vector_search_many`` over the ``probes`` nearest cells of each query; with all cells it is exact."""
        return vector_search_many(self.points, queries, limit, self.vector, self.key, itself, ("cell", self.centres, probes or self.probes))


def search_recall(found: DataFrame, exact: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: number of queries and the share of the exact hits that were found."""
    hits = exact.select("query_id", key).join(found.select("query_id", key).withColumn("_hit", F.lit(1)), ["query_id", key], "left")
    return hits.agg(F.count_distinct("query_id").alias("n_queries"), F.round(F.avg(F.coalesce("_hit", F.lit(0))), 6).alias("recall"))


# ------------------------------------------------------------------ merging


def dedup_location(results: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """One row per (file_path, start_line, end_line): the highest score, ties by ``tie`` columns (chunk_id)."""
    best = Window.partitionBy("file_path", "start_line", "end_line").orderBy(F.col("score").desc(), *[F.col(c) for c in (tie or ["chunk_id"])])
    return results.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def drop_contained(text_hits: DataFrame, vector_hits: DataFrame) -> DataFrame:
    """Text hits that lie in no vector hit of the same file (range anti-join with the file as equality key)."""
    inside = vector_hits.select("file_path", F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    return text_hits.join(inside, (text_hits["file_path"] == inside["file_path"]) & (text_hits["start_line"] >= F.col("_a")) & (text_hits["end_line"] <= F.col("_b")), "left_anti")


def scale_scores(text_hits: DataFrame, vector_hits: DataFrame) -> DataFrame:
    """Text scores times (greatest vector score / greatest text score); unchanged where either side is empty or not above 0."""
    tops = vector_hits.agg(F.max("score").alias("_v")).crossJoin(text_hits.agg(F.max("score").alias("_t")))
    factor = F.when((F.col("_v") > 0) & (F.col("_t") > 0), F.col("_v") / F.col("_t")).otherwise(F.lit(1.0))
    return text_hits.crossJoin(F.broadcast(tops)).withColumn("score", F.col("score") * factor).drop("_v", "_t")


def merge_hits(vector_hits: DataFrame, text_hits: DataFrame, scale: bool = True) -> DataFrame:
    """Vector hits and those text hits that add something, one row per location."""
    columns = ["chunk_id", "file_path", "start_line", "end_line", "content", "score"]
    vector_hits, text_hits = vector_hits.select(columns), text_hits.select(columns)
    scaled = scale_scores(text_hits, vector_hits) if scale else text_hits
    both = vector_hits.withColumn("source", F.lit("a-vector")).unionByName(drop_contained(scaled, vector_hits).withColumn("source", F.lit("b-text")))
    return dedup_location(both, ["source", "chunk_id"]).withColumn("source", F.substring("source", 3, 10))


def rank_fusion(lists: DataFrame, k: int = 60, list_id: str = "list_id", item: str = "item_id", score: str = "score", group: str | None = None) -> DataFrame:
    """(group?, item, fused, n_lists): reciprocal ranks 1 / (k + rank) summed over the lists (of one query, or per ``group``).

    Ranks follow the score within a list, ties by item; of an item that a list holds several times the best row counts, null
    scores rank last. Order results by (fused descending, item). Lists are bounded by the limit of the search that made them.
    """
    keys = [group] if group else []
    best = lists.groupBy(*keys, list_id, item).agg(F.max(score).alias("_s"))
    ranked = best.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, list_id).orderBy(F.col("_s").desc_nulls_last(), F.col(item))))
    return ranked.groupBy(*keys, item).agg(F.sum(1.0 / (k + F.col("_r"))).alias("fused"), F.count(F.lit(1)).alias("n_lists"))


def finish(results: DataFrame, limit: int = 10, key: str = "chunk_id") -> DataFrame:
    """The final order: score descending, ties by key, cut at ``limit`` (0 means the default of 10)."""
    return results.orderBy(F.col("score").desc(), F.col(key)).limit(limit or 10)


def api_rows(results: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows as an interface returns them: rank from 1, score with 4 digits, language ``unknown`` where missing."""
    language = F.coalesce("language", F.lit("unknown")) if "language" in results.columns else F.lit("unknown")
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(key)))
    return results.select(rank.alias("rank"), "file_path", "start_line", "end_line", F.round("score", 4).alias("score"), language.alias("language"))


def rerank(results: DataFrame, scorer: Callable[[Column], Column] | None, top_k: int, text: str = "content", key: str = "chunk_id") -> DataFrame:
    """Results ordered anew by ``scorer(text column)``, cut at ``top_k``; without a scorer the order stays."""
    return finish(results.withColumn("score", scorer(F.col(text))) if scorer else results, top_k, key)


def rerank_by_response(candidates: DataFrame, response: DataFrame, top_k: int, key: str = "chunk_id") -> DataFrame:
    """Candidates in the order of a scorer's answer: ``response`` (position, score), position 0 being the best candidate.

    Positions outside the list, null scores and repeated positions (the best score counts) are dropped; an empty answer
    leaves the order as it was. Candidates are a result list.
    """
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(key))) - 1
    placed = candidates.withColumn("_place", place)
    given = response.where(F.col("score").isNotNull()).groupBy(F.col("position").cast("int").alias("_place")).agg(F.max("score").alias("_new"))
    chosen = placed.join(given, "_place", "left")
    answered = chosen.agg(F.count("_new").alias("_n"))
    kept = chosen.crossJoin(F.broadcast(answered)).where("_n = 0 or _new is not null")
    return finish(kept.withColumn("score", F.coalesce("_new", "score").cast("double")).drop("_place", "_new", "_n"), top_k, key)


def read_rerank_answer(answer: Column) -> Column:
    """array<struct<position, score>> of a JSON answer with its rows under ``results`` or ``data`` and their scores under
    ``relevance_score`` or ``score``; null for other text."""
    row = "array<struct<index:int,relevance_score:double,score:double>>"
    parsed = F.from_json(answer, f"struct<results:{row},data:{row}>")
    rows = F.coalesce(parsed["results"], parsed["data"])
    return F.transform(rows, lambda r: F.struct(r["index"].alias("position"), F.coalesce(r["relevance_score"], r["score"]).alias("score")))


def extra_payload(payload: Column, core: tuple[str, ...] = ("chunk_id", "file_path", "start_line", "end_line", "content", "artifact_type")) -> Column:
    """The entries of a payload map that have no column of their own."""
    return F.map_filter(payload, lambda k, _: ~k.isin(*core))


def vector_stats(points: DataFrame) -> DataFrame:
    """One row: number of stored vectors and of the distinct files they come from (blank paths are none)."""
    path = F.when(F.trim("file_path") != "", F.col("file_path"))
    return points.agg(F.count(F.lit(1)).alias("n_points"), F.count_distinct(path).alias("n_point_files"))


def distinct_files(points: DataFrame) -> DataFrame:
    return points.where(F.trim("file_path") != "").select("file_path").distinct()


def store_points(old: DataFrame | None, new: DataFrame, dimension: int) -> DataFrame:
    """Stored vectors with ``new`` in place of those of equal chunk_id; without an artifact_type a point is a chunk."""
    kind = F.coalesce("artifact_type", F.lit("chunk")) if "artifact_type" in new.columns else F.lit("chunk")
    ready = assert_dimension(new.withColumn("artifact_type", kind), dimension).dropDuplicates(["chunk_id"])
    return ready if old is None else old.join(ready.select("chunk_id"), "chunk_id", "left_anti").unionByName(ready, allowMissingColumns=True)


def search(points: DataFrame, files: DataFrame, query: str, embed: Callable[[str], list[float]], mode: str = "hybrid", limit: int = 10, artifact_types: list[str] | None = None, candidates: int = 20, scorer: Callable[[Column], Column] | None = None, recall: int = 5, isolated: bool = False, seconds: float | None = None, **text_options) -> DataFrame:
    """Search in one of five modes over points (vectors) and files (text), with path modifiers in the query.

    Path filters and exclusions come before any cut, so that excluded files never push wanted hits out. With a ``scorer`` the
    vector side takes ``recall`` times the candidates and text scores are not scaled. The text side is left out where only
    other artifacts than chunks are asked for. With ``isolated`` the sides of a hybrid search run at once, and one that fails,
    or is not done after ``seconds``, leaves the other's hits; only if none is left the search fails.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    clean, include, exclude = parse_query(query)
    clean = clean or query
    if mode == "summary":
        artifact_types = artifact_types or ["function_summary", "class_summary", "file_summary"]
    wanted = candidates * recall if scorer else candidates
    columns = ["chunk_id", "file_path", "start_line", "end_line", "content", "score"]
    vector = lambda: vector_search(points, embed(clean), wanted, include, artifact_types, exclude=exclude).select(columns)
    text = lambda m: search_lines(files, clean, m, candidates, file_filter=include, exclude=exclude, **text_options).select(columns)
    if mode in ("vector", "summary"):
        found = vector()
    elif mode in ("grep", "fuzzy"):
        found = text("substring" if mode == "grep" else "fuzzy")
    elif artifact_types and "chunk" not in artifact_types:
        found = vector()
    elif isolated:
        sides, lost = within_time(points.sparkSession, {"vector": vector, "text": lambda: text("substring")}, seconds)
        if not sides:
            raise RuntimeError(f"no side of the search answered: {lost}")
        found = merge_hits(sides["vector"], sides["text"], scale=scorer is None).select(columns) if len(sides) == 2 else next(iter(sides.values()))
    else:
        found = merge_hits(vector(), text("substring"), scale=scorer is None).select(columns)
    return rerank(found, scorer, limit)
