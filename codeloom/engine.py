"""The library's front: index a tree, keep it fresh, search it, ask its graph. All answers are DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.config import Settings
from codeloom.functions import text, vectors
from codeloom.operators import chunking, context, graph, resolve, retrieval, store
from codeloom.operators.store import FolderStore
from codeloom.parse import files as parsing
from codeloom.session import cut_lineage, ship_package, within_time
from codeloom.sources.files import scan_tree

_DIRECTIONS = {"callers": "callers", "dependents": "callers", "callees": "callees", "dependencies": "callees"}


class Engine:
    """Tables of any number of indexed trees under one folder; ``embed`` turns a text column into vectors.

    The stand-in embedder needs no model; pass ``vectors.batched_embedder(call, dimension)`` for a real one, and a matching
    ``embed_query``. A re-ranking scorer is a function of a text column.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None, embed: Callable[[Column], Column] | None = None, embed_query: Callable[[str], list[float]] | None = None, scorer: Callable[[Column], Column] | None = None):
        ship_package(spark)
        self.spark, self.tables, self.settings = spark, FolderStore(spark, folder), settings or Settings()
        self.embed = embed or vectors.hash_embedder(self.settings.dimension)
        self.embed_query = embed_query or (lambda q: vectors.hash_vector(q, self.settings.dimension))
        self.scorer = scorer

    # -------------------------------------------------------------- writing

    def _process(self, files: DataFrame, collection: str) -> dict[str, DataFrame]:
        """Rows of every table that the given files make; each file is parsed once."""
        s = self.settings
        parsed = cut_lineage(parsing.parse_files(files))
        nodes = parsing.definitions_of(parsed)
        chunks = chunking.symbol_chunks(nodes, s.max_chunk_tokens)
        plain = files.join(nodes.select("file_path").distinct(), "file_path", "left_anti")
        fixed = chunking.fit_chunks(plain, s.chunk_lines, s.chunk_overlap, s.max_chunk_tokens).select("file_path", F.lit("fixed").alias("chunk_type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("parent_name"), F.lit(0).alias("part"), F.lit(1).alias("n_parts"), "start_line", "end_line", "content")
        ids = chunking.chunk_id(F.lit(collection), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.concat_ws("/", "chunk_type", "name", "part"))
        chunks = chunks.unionByName(fixed).select(ids.alias("chunk_id"), "file_path", "start_line", "end_line", "content", F.lit("chunk").alias("artifact_type"), "chunk_type", "name")
        keyed = nodes.withColumn("node_id", F.xxhash64("file_path", "start_line", "name"))
        span = keyed.select("node_id", "start_line", "end_line").dropDuplicates(["node_id"])
        small = [(chunking.function_summaries(keyed, s.max_summary_tokens), "function_summary"), (chunking.class_summaries(keyed, s.max_summary_tokens), "class_summary")]
        summaries = chunking.file_summaries(keyed, parsed.select("file_path", "imports"), s.max_summary_tokens).select(F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), "file_path", F.element_at(F.split("file_path", "/"), -1).alias("name"), "content", F.lit("file_summary").alias("artifact_type"))
        for rows, kind in small:
            summaries = summaries.unionByName(rows.join(span, "node_id").select("start_line", "end_line", "file_path", "name", "content", F.lit(kind).alias("artifact_type")))
        made = summaries.select(F.sha2(F.concat_ws("|", F.lit(collection), "artifact_type", "file_path", "name", "start_line"), 256).alias("chunk_id"), "file_path", "start_line", "end_line", "content", "artifact_type", F.lit("summary").alias("chunk_type"), "name")
        points = retrieval.assert_dimension(chunks.unionByName(made).dropDuplicates(["chunk_id"]).withColumn("vector", self.embed(F.col("content"))), s.dimension).withColumn("collection", F.lit(collection))
        counts = chunks.groupBy("file_path").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
        meta = files.join(counts, "file_path", "left").join(parsed.select("file_path", "error"), "file_path", "left")
        meta = meta.select("file_path", "content", F.when(F.col("error").isNull(), F.col("content_hash")).alias("content_hash"), "language", "line_count", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.current_timestamp().alias("indexed_at"), "modified_time", "error", F.lit(collection).alias("collection"))
        out = {"files": meta, "points": points}
        if self.settings.graph_enabled:
            references = parsing.references_of(parsed)
            made_nodes, edges, symbols = resolve.build_graph(nodes, references)
            tag = F.lit(collection).alias("collection")
            out |= {"nodes": made_nodes.select("*", tag), "edges": edges.select("*", tag), "symbols": symbols.select("*", F.lit("").alias("summary"), tag)}
        return out

    def _collection(self, root: str) -> str:
        return self.spark.range(1).select(text.collection_name(F.lit(root))).first()[0]

    def _batch(self, collection: str, todo: DataFrame) -> str:
        """Leave a marker for the files of ``todo``; the identifier follows from their paths and hashes."""
        mark = todo.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("file_path", "content_hash")).alias("x")).first()
        batch = f"{collection}-{mark['n']}-{(mark['x'] or 0) & 0xFFFFFFFFFFFF:012x}"
        self.tables.begin(batch, todo)
        return batch

    def unfinished(self, root: str | None = None) -> DataFrame:
        """(batch_id, file_path, chunk_id, created_at) of batches that began and did not finish."""
        rows = self.tables.unfinished()
        return rows.where(F.col("batch_id").startswith(self._collection(root) + "-")) if root else rows

    def index(self, root: str) -> DataFrame:
        """Index a tree from scratch; one row with the number of files, chunks and failed files."""
        collection = self._collection(root)
        left = [r["batch_id"] for r in self.unfinished(root).select("batch_id").distinct().collect()]
        files = cut_lineage(scan_tree(self.spark, root, self.settings.file_extensions))
        batch = self._batch(collection, files)
        out = self._commit(self._process(files, collection), collection, root)
        for done in {batch, *left}:
            self.tables.finish(done)
        return out

    def _commit(self, rows: dict[str, DataFrame], collection: str, root: str, keep: dict[str, DataFrame] | None = None) -> DataFrame:
        """Write the parts of one collection; other collections are not touched."""
        for name in ("points", "nodes", "edges", "symbols", "files"):  # the record of what is indexed comes last
            if name in rows:
                new = rows[name].unionByName(keep[name], allowMissingColumns=True) if keep and name in keep else rows[name]
                self.tables.write(name, new, collection)
        if "edges" in rows:
            own, ranks = self.tables.read("edges", collection), None
            for kind in ("call", "import"):
                part = graph.pagerank(graph.clean_edges(own, kind)).select("symbol_id", F.lit(kind).alias("graph_type"), "score", F.current_timestamp().alias("computed_at"), F.lit(collection).alias("collection"))
                ranks = part if ranks is None else ranks.unionByName(part)
            self.tables.write("pagerank", ranks, collection)
        now = F.current_timestamp()
        repo = self.spark.range(1).select(F.lit(root).alias("index_id"), F.lit(root).alias("root_path"), F.lit(collection).alias("collection_name"), now.alias("created_at"), now.alias("updated_at"))
        self.tables.write("repositories", store.upsert_repositories(self.tables.read("repositories", collection), repo) if self.tables.exists("repositories", collection) else repo, collection)
        own = self.tables.read("files", collection)
        return own.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("n_chunks"), F.count_if(F.col("error").isNotNull()).alias("n_failed"))

    def update(self, root: str) -> DataFrame:
        """Process what is new or changed since the last index; one row with the number of files per state.

        The scan is frozen first, so what is processed is what is recorded. A marker names the batch's files until all its
        tables are written. Files that a left marker names are rolled back: their rows go, and they are taken up again.
        """
        collection = self._collection(root)
        if not self.tables.exists("files", collection):
            self.index(root)
            return self.tables.read("files", collection).groupBy(F.lit("new").alias("state")).agg(F.count(F.lit(1)).alias("n_files"))
        scan = cut_lineage(scan_tree(self.spark, root, self.settings.file_extensions))
        left = cut_lineage(self.unfinished(root).select("batch_id", "file_path"))
        stored = store.delete_keys(self.tables.read("files", collection), left, ["file_path"])
        states = cut_lineage(store.diff_files(scan, stored))
        todo = cut_lineage(scan.join(states.where("state in ('new', 'modified')").select("file_path"), "file_path", "left_semi"))
        batches = {r["batch_id"] for r in left.select("batch_id").distinct().collect()}
        if batches or not states.where("state != 'same'").isEmpty():
            gone = states.where("state in ('deleted', 'modified')").select("file_path").unionByName(left.select("file_path"))
            keep = {n: store.delete_keys(self.tables.read(n, collection), gone, ["file_path"]) for n in ("points", "nodes", "edges", "symbols", "files") if self.tables.exists(n, collection)}
            batches.add(self._batch(collection, todo))
            self._commit(self._process(todo, collection), collection, root, keep)
            for batch in batches:
                self.tables.finish(batch)
        return states.groupBy("state").agg(F.count(F.lit(1)).alias("n_files"))

    def reset(self) -> None:
        for name in ("points", "nodes", "edges", "symbols", "files", "pagerank", "repositories", "pending"):
            self.tables.drop(name)

    # -------------------------------------------------------------- asking

    def _own(self, name: str, root: str | None) -> DataFrame:
        return self.tables.read(name, self._collection(root)) if root else self.tables.read(name)

    def search(self, query: str, mode: str = "hybrid", limit: int = 0, root: str | None = None, artifact_types: list[str] | None = None, **options) -> DataFrame:
        """Hits of one of five modes; in hybrid mode the sides run at once, and one that fails leaves the other's hits."""
        s = self.settings
        found = retrieval.search(self._own("points", root), self._own("files", root), query, self.embed_query, mode, limit or s.default_limit, artifact_types, s.candidates, self.scorer, s.rerank_multiplier, isolated=True, **options)
        return retrieval.finish(found, limit or s.default_limit)

    def enriched_search(self, query: str, mode: str = "hybrid", limit: int = 0, root: str | None = None) -> DataFrame:
        """Hits with the symbol around them, its summary, neighbours and importance; hits without one keep bare rows."""
        hits = self.search(query, mode, limit, root).select("chunk_id", "file_path", "start_line", "end_line", "score")
        return context.enrich_hits(cut_lineage(hits), self._own("nodes", root), self._own("symbols", root), self._own("files", root), self._own("edges", root), self._own("pagerank", root))

    def file_context(self, paths: list[str], root: str | None = None) -> DataFrame:
        """Modules, imports and dependents of files."""
        return context.file_context(self.spark.createDataFrame([(p,) for p in paths], "file_path string"), self._own("nodes", root), self._own("edges", root))

    def similar(self, chunk_id: str, limit: int = 10) -> DataFrame:
        return retrieval.similar_to(self.tables.read("points"), chunk_id, limit)

    def get_graph(self, symbol: str, query_type: str = "callees", depth: int = 1, include_inferred: bool = True) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) around a symbol: callers, callees, dependents or dependencies."""
        direction = _DIRECTIONS[query_type]
        nodes, edges = self.tables.read("nodes"), self.tables.read("edges")
        return graph.neighbours(nodes, edges, symbol, depth, direction, include_inferred), graph.induced_edges(edges, symbol, depth, direction, include_inferred)

    def _by_search(self, query: str, depth: int) -> DataFrame:
        hits = self.search(query, limit=self.settings.candidates).select("chunk_id", "file_path", "start_line", "score")
        return context.enclosing_symbols(hits, self.tables.read("nodes")).where("fqn is not null").select(F.col("fqn").alias("item_id"), "score")

    def _by_symbols(self, query: str, depth: int) -> DataFrame:
        return store.symbols_by_name(self.tables.read("symbols"), query).select(F.col("fqn").alias("item_id"), F.lit(1.0).alias("score"))

    def _by_graph(self, query: str, depth: int) -> DataFrame:
        start = [r["fqn"] for r in store.symbols_by_name(self.tables.read("symbols"), query).select("fqn").distinct().orderBy("fqn").limit(self.settings.candidates).collect()]
        near = graph.reach(graph.clean_edges(self.tables.read("edges")), start, min(depth, self.settings.graph_depth)) if start else self.spark.createDataFrame([], "symbol_id string, distance int")
        return near.select(F.col("symbol_id").alias("item_id"), (1.0 / F.greatest(F.lit(1), F.col("distance"))).alias("score"))

    def get_context(self, query: str, depth: int = 1, max_tokens: int | None = None, backends: tuple[str, ...] = ("search", "graph", "symbols"), k: int = 60, seconds: float | None = None) -> DataFrame:
        """One package: results of the wanted backends fused by reciprocal ranks in one space of symbol ids, then assembled.

        The backends run at once. One that fails, or is not done after ``seconds`` (its jobs are cancelled), is left out:
        ``partial_results`` is then true and ``left_out`` names it. A backend that has nothing contributes nothing; without
        any result the package is empty.
        """
        known = {"search": self._by_search, "symbols": self._by_symbols} | ({"graph": self._by_graph} if self.settings.graph_enabled else {})
        wanted = [b for b in backends if b in known]
        if not wanted:
            raise ValueError("no known backend")
        lists, left_out = within_time(self.spark, {b: lambda b=b: known[b](query, depth) for b in wanted}, seconds)
        union = self.spark.createDataFrame([], "list_id string, item_id string, score double")
        for name, rows in lists.items():
            union = union.unionByName(rows.select(F.lit(name).alias("list_id"), "item_id", F.col("score").cast("double").alias("score")))
        fused = retrieval.rank_fusion(union, k).select(F.col("item_id").alias("fqn"))
        package = context.assemble(fused, *(self.tables.read(n) for n in ("symbols", "files", "nodes", "edges", "pagerank")), max_tokens or self.settings.context_tokens)
        return package.withColumns({"partial_results": F.lit(bool(left_out)), "left_out": F.array(*map(F.lit, sorted(left_out))).cast("array<string>")})

    def repositories(self) -> DataFrame:
        """Indexed roots, the last updated first."""
        return self.tables.read("repositories").orderBy(F.col("updated_at").desc())

    def status(self, root: str | None = None) -> DataFrame:
        files = self._own("files", root)
        """One row: counts of files, chunks and lines, files per language, staleness, and vectors with their distinct files."""
        return store.combined_stats(files).crossJoin(store.staleness_summary(files)).crossJoin(retrieval.vector_stats(self._own("points", root)))

    def forget(self, root: str) -> None:
        """Remove one indexed root and its registry row."""
        collection = self._collection(root)
        for name in ("points", "nodes", "edges", "symbols", "files", "pagerank", "repositories"):
            self.tables.drop(name, collection)
