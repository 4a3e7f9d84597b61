"""The symbol graph: bounded traversal, induced edges, PageRank, cycles, topological order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.skew import hot_keys, join_split_hot
from codeloom.session import cut_lineage, settings

#: Edges of a graph per task of an iteration; small graphs run in few tasks.
EDGES_A_TASK = 100_000


def clean_edges(edges: DataFrame, edge_type: str | None = None, include_inferred: bool = True) -> DataFrame:
    """Edges with trimmed ends and types in lower case; those without an end are left out."""
    out = edges.withColumns({"source_id": F.trim("source_id"), "target_id": F.trim("target_id"), "edge_type": F.lower(F.trim("edge_type"))})
    out = out.where("source_id != '' and target_id != ''")
    if edge_type:
        out = out.where(F.col("edge_type") == edge_type)
    return out if include_inferred else out.where(~F.coalesce("inferred", F.lit(False)) & (F.col("edge_type") != "inferred"))


def reach(edges: DataFrame, start: str | list[str], depth: int, backward: bool = False) -> DataFrame:
    """(symbol_id, distance): what lies within ``depth`` steps of the start symbols, themselves left out.

    The frontier moves one join a step and never revisits (anti-join against what is seen), so that the work is bounded by
    the reached part of the graph, not by the number of walks. A hub is split over tasks by ``join_split_hot``.
    """
    a, b = ("target_id", "source_id") if backward else ("source_id", "target_id")
    links = edges.select(F.col(a).alias("symbol_id"), F.col(b).alias("next")).where("symbol_id is not null and next is not null").distinct()
    names = [start] if isinstance(start, str) else list(start)
    spark = edges.sparkSession
    seen = spark.createDataFrame([(n,) for n in names], "symbol_id string").select("symbol_id", F.lit(0).alias("distance"))
    frontier = seen
    for step in range(1, depth + 1):
        ahead = join_split_hot(links, frontier.select("symbol_id"), "symbol_id", "left_semi").select(F.col("next").alias("symbol_id")).distinct()
        frontier = cut_lineage(ahead.join(seen, "symbol_id", "left_anti").select("symbol_id", F.lit(step).alias("distance")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0")


def neighbours(nodes: DataFrame, edges: DataFrame, start: str | list[str], depth: int = 1, direction: str = "callees", include_inferred: bool = True) -> DataFrame:
    """Node rows within reach, with their distance; ids without a node row drop out."""
    found = reach(clean_edges(edges, include_inferred=include_inferred), start, depth, direction in ("callers", "dependents"))
    return nodes.dropDuplicates(["symbol_id"]).join(found, "symbol_id")


def induced_edges(edges: DataFrame, start: str, depth: int, direction: str = "callees", include_inferred: bool = True) -> DataFrame:
    """All edges whose both ends are the start or within reach of it, of any type, back edges included."""
    clean = clean_edges(edges, include_inferred=include_inferred)
    inside = reach(clean, start, depth, direction in ("callers", "dependents")).select("symbol_id").unionByName(edges.sparkSession.createDataFrame([(start,)], "symbol_id string"))
    return clean.join(inside.withColumnRenamed("symbol_id", "source_id"), "source_id", "left_semi").join(inside.withColumnRenamed("symbol_id", "target_id"), "target_id", "left_semi")


def _mix(column: str, factors: list[float]):
    """Sum of the first values of an array column, each times its factor."""
    listed = ", ".join(f"{x!r}D" for x in factors)
    return F.expr(f"aggregate(zip_with(slice({column}, 1, {len(factors)}), array({listed}), (x, m) -> x * m), 0D, (s, x) -> s + x)")


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 50, tolerance: float = 1e-6, test_every: int = 10) -> DataFrame:
    """(symbol_id, score) over the ends of the edges; parallel edges count once, the mass of symbols without successors is
    spread over all, iteration ends with the first round whose scores change by less than ``tolerance`` in sum.

    The scores after k rounds are a combination of the powers u_j = (damping * links) ** j applied to the uniform vector, whose
    factors depend on the lost mass of each u_j only. So a round moves one vector along the links, which costs one shuffle
    of map-side combined sums and a checkpoint: links and vectors stay partitioned by symbol and sorted. The few numbers that
    mix the powers, and the test for convergence, are summed up once in ``test_every`` rounds. A source of very many links (``hot_keys``) is not kept
    in one task: its links stay spread and meet a broadcast of the hot sources, at most 100 rows. No edges give no rows.
    """
    spark = edges.sparkSession
    links = cut_lineage(edges.select(F.trim("source_id").alias("src"), F.trim("target_id").alias("dst")).where("src != '' and dst != ''").distinct())
    names = links.select(F.col("src").alias("symbol_id")).unionByName(links.select(F.col("dst").alias("symbol_id"))).distinct()
    degrees = links.groupBy(F.col("src").alias("symbol_id")).agg(F.count(F.lit(1)).alias("degree"))
    size = links.count()
    if size == 0:
        return names.select("symbol_id", F.lit(0.0).alias("score"))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // EDGES_A_TASK)))
    with settings(spark, {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.enabled": "false"}):
        hot = hot_keys(links, "src")
        is_hot = F.col("src").isin(hot) if hot else F.lit(False)
        cold = cut_lineage(links.where(~is_hot).repartition(parts, "src").sortWithinPartitions("src"))
        state = names.join(degrees, "symbol_id", "left").repartition(parts, "symbol_id").sortWithinPartitions("symbol_id")
        state = cut_lineage(state)
        n = state.count()
        state = state.select("symbol_id", "degree", F.array(F.lit(1.0 / n)).alias("powers"), F.lit(1.0 / n).alias("last"))
        factors, mixed, lost = [1.0], [[1.0]], []  # scores after k rounds = sum of mixed[k][j] * u_j
        for i in range(1, iterations + 1):
            share = state.where("degree > 0").selectExpr("symbol_id AS src", f"{damping!r}D * last / degree AS share")
            moved = cold.join(share, "src")
            if hot:
                moved = moved.unionByName(links.where(is_hot).join(F.broadcast(cut_lineage(share.where(is_hot).select("src", "share"))), "src"))
            gained = moved.groupBy(F.col("dst").alias("symbol_id")).agg(F.sum("share").alias("gain"))
            state = cut_lineage(state.join(gained, "symbol_id", "left").selectExpr("symbol_id", "degree", "concat(powers, array(coalesce(gain, 0D))) AS powers", "coalesce(gain, 0D) AS last"))
            if i % test_every and i != iterations:
                continue
            fresh = range(len(lost), i)
            sums = state.where("degree is null").agg(*[F.coalesce(F.sum(F.col("powers")[j]), F.lit(0.0)).alias(f"d{j}") for j in fresh]).first()
            lost += list(sums)
            for k in fresh:  # p(k + 1) = factor * u_0 + (links * p(k)), the latter being p(k) with every power one higher
                factors.append((1 - damping) + damping * sum(m * x for m, x in zip(mixed[k], lost, strict=False)))
                mixed.append([factors[-1], *mixed[k]])
            if tolerance > 0:
                moves = [[b - a for a, b in zip([*mixed[k], 0.0], mixed[k + 1], strict=True)] for k in fresh]
                steps = state.agg(*[F.sum(F.abs(_mix("powers", move))).alias(f"s{k}") for k, move in zip(fresh, moves, strict=True)]).first()
                done = next((k + 1 for k, step in zip(fresh, steps, strict=True) if step < tolerance), None)
                if done:
                    i = done
                    break
    return state.select("symbol_id", _mix("powers", mixed[i]).alias("score"))


#: A remaining graph of at most so many edges is levelled, or searched for cycles, in one task (about 300 bytes an edge).
LOCAL_EDGES = 250_000


def _cycles_locally(links: DataFrame) -> DataFrame:
    """(path) of every elementary cycle of ``links`` by Johnson's algorithm; paths leave the task as they are found."""
    import pandas as pd

    def within(ways: dict[str, list[str]], start: str) -> set[str]:
        seen, ahead = {start}, [start]
        while ahead:
            for t in ways.get(ahead.pop(), ()):
                if t > start and t not in seen:
                    seen.add(t)
                    ahead.append(t)
        return seen

    def circuits(ways: dict[str, list[str]], start: str):
        path, blocked, closed, waiting, stack = [start], {start}, set(), {}, [(start, list(ways[start]))]
        while stack:
            at, ahead = stack[-1]
            if ahead:
                t = ahead.pop()
                if t == start:
                    yield list(path)
                    closed.update(path)
                elif t not in blocked:
                    path.append(t)
                    stack.append((t, list(ways[t])))
                    closed.discard(t)
                    blocked.add(t)
                continue
            if at in closed:
                free = [at]
                while free:
                    if (x := free.pop()) in blocked:
                        blocked.discard(x)
                        free += waiting.pop(x, ())
            else:
                for t in ways[at]:
                    waiting.setdefault(t, set()).add(at)
            stack.pop()
            path.pop()

    def run(batches):
        ways: dict[str, list[str]] = {}
        back: dict[str, list[str]] = {}
        for batch in batches:
            for a, b in zip(batch["source_id"], batch["target_id"], strict=True):
                ways.setdefault(a, []).append(b)
                back.setdefault(b, []).append(a)
        out = []
        for start in sorted(ways.keys() & back.keys()):
            ring = within(ways, start) & within(back, start)
            if len(ring) == 1:
                continue
            for path in circuits({x: [t for t in ways[x] if t in ring] for x in ring}, start):
                out.append(path)
                if len(out) == 1000:
                    yield pd.DataFrame({"path": out})
                    out = []
        if out:
            yield pd.DataFrame({"path": out})

    return links.select("source_id", "target_id").coalesce(1).mapInPandas(run, "path array<string>")


def cycles(edges: DataFrame, most: int | None = None, edge_type: str | None = "import", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(cycle, length) of every elementary cycle of 2 symbols or more (of at most ``most``, if given), once each, smallest
    symbol first.

    Symbols that cannot lie on a cycle are peeled off first (no way in or no way out), which leaves little in a graph that is
    nearly free of cycles. One task searches what is left if that is at most ``local_edges`` edges; else paths grow by joins
    from their smallest symbol through larger ones only, until none is open.
    """
    links = cut_lineage(clean_edges(edges, edge_type).select("source_id", "target_id").where("source_id != target_id").distinct())
    size = links.count()
    while size > local_edges:
        kept = links.join(links.select(F.col("target_id").alias("source_id")).distinct(), "source_id", "left_semi")
        kept = cut_lineage(kept.join(kept.select(F.col("source_id").alias("target_id")).distinct(), "target_id", "left_semi").select("source_id", "target_id"))
        now = kept.count()
        links = kept
        if now == size:
            break
        size = now
    if size <= local_edges:
        found = _cycles_locally(links)
    else:
        back = links.select(F.col("source_id").alias("at"), F.col("target_id").alias("to"))
        paths = links.where("source_id < target_id").select(F.array("source_id", "target_id").alias("path"), F.col("target_id").alias("at"))
        found, length = paths.select("path").limit(0), 2
        while not paths.isEmpty():
            found = found.unionByName(cut_lineage(paths.join(back, "at").where(F.col("to") == F.col("path")[0]).select("path")))
            if length == most:
                break
            paths, length = cut_lineage(paths.join(back, "at").where((F.col("to") > F.col("path")[0]) & ~F.array_contains("path", F.col("to"))).select(F.concat("path", F.array("to")).alias("path"), F.col("to").alias("at"))), length + 1
    if most is not None:
        found = found.where(F.size("path") <= most)
    return found.select(F.array_join("path", " > ").alias("cycle"), F.size("path").alias("length"))


def _level_locally(links: DataFrame, base: int) -> DataFrame:
    """Levels of the symbols of ``links``, those without an incoming edge at ``base``; cyclic parts left out."""
    import pandas as pd

    def run(batches):
        ways: dict[str, list[str]] = {}
        waits: dict[str, int] = {}
        for batch in batches:
            for a, b in zip(batch["source_id"], batch["target_id"], strict=True):
                ways.setdefault(a, []).append(b)
                waits[b] = waits.get(b, 0) + 1
                waits.setdefault(a, 0)
        ready, level, out = [s for s, n in waits.items() if n == 0], base, []
        while ready:
            out += [(s, level) for s in ready]
            ahead = []
            for s in ready:
                for t in ways.get(s, ()):
                    waits[t] -= 1
                    if waits[t] == 0:
                        ahead.append(t)
            ready, level = ahead, level + 1
        yield pd.DataFrame(out, columns=["symbol_id", "level"])

    return links.select("source_id", "target_id").coalesce(1).mapInPandas(run, "symbol_id string, level int")


def topological_levels(edges: DataFrame, edge_type: str | None = "import", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(symbol_id, level): level 0 has no incoming edge, every other symbol lies one above its highest predecessor.

    Symbols on or behind a cycle have no level and are left out. Ordering by (level, symbol_id) is a topological order.
    Levels are peeled off by joins, two checkpoints each, until at most ``local_edges`` edges are left, which one task finishes.
    """
    links = cut_lineage(clean_edges(edges, edge_type).select("source_id", "target_id").where("source_id != target_id").distinct())
    if links.count() <= local_edges:
        return _level_locally(links, 0)
    targets = lambda rows: rows.select(F.col("target_id").alias("symbol_id")).distinct()
    free = cut_lineage(links.select(F.col("source_id").alias("symbol_id")).distinct().join(targets(links), "symbol_id", "left_anti"))
    done, level = free.select("symbol_id", F.lit(0).alias("level")), 0
    while not free.isEmpty():
        gone = free.withColumnRenamed("symbol_id", "source_id")
        rest = cut_lineage(links.join(gone, "source_id", "left_anti"))
        if rest.count() <= local_edges // 2 and links.count() <= local_edges:
            return done.unionByName(_level_locally(links, level).where(F.col("level") > level))
        level += 1
        free = cut_lineage(targets(links.join(gone, "source_id", "left_semi")).join(targets(rest), "symbol_id", "left_anti"))
        done, links = done.unionByName(free.select("symbol_id", F.lit(level).alias("level"))), rest
    return done


def components(links: DataFrame) -> DataFrame:
    """(symbol_id, component): the smallest symbol that each is connected with, directions aside.

    Alternates large and small stars, which ends after about a logarithm of the diameter; minima combine on the map side.
    """
    turned = lambda rows: rows.select(F.col("b").alias("a"), F.col("a").alias("b"))
    pairs = cut_lineage(links.select(F.greatest("source_id", "target_id").alias("a"), F.least("source_id", "target_id").alias("b")).where("a != b").distinct())
    state = None
    while True:
        both = pairs.unionByName(turned(pairs))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = cut_lineage(join_split_hot(both.where("b > a"), least, "a", "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_split_hot(large, least, "a", "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        pairs = cut_lineage(small.where("a != b").distinct())
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return pairs.select(F.col("a").alias("symbol_id"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("symbol_id"), F.col("b").alias("component")).distinct())


def _order(sources, targets) -> list[str]:
    """Always the smallest symbol that is ready next."""
    import heapq

    ways: dict[str, list[str]] = {}
    waits: dict[str, int] = {}
    for a, b in zip(sources, targets, strict=True):
        ways.setdefault(a, []).append(b)
        waits[b] = waits.get(b, 0) + 1
        waits.setdefault(a, 0)
    ready = [s for s, n in waits.items() if n == 0]
    heapq.heapify(ready)
    out = []
    while ready:
        s = heapq.heappop(ready)
        out.append(s)
        for t in ways.get(s, ()):
            waits[t] -= 1
            if waits[t] == 0:
                heapq.heappush(ready, t)
    return out


def topological_order(edges: DataFrame, edge_type: str | None = "import", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(position, symbol_id): always the smallest symbol that is ready next; cyclic parts left out.

    One task orders at most ``local_edges`` edges. More are ordered by connected component, one task each: the exact order of
    ONE connected graph is sequential by definition. The whole order takes from the components whichever holds the smallest
    ready symbol, so a symbol that follows a greater one of its component comes right after it; sorting by the greatest symbol
    so far of the component, then by place in it, is that merge.
    """
    import pandas as pd

    links = cut_lineage(clean_edges(edges, edge_type).select("source_id", "target_id").where("source_id != target_id").distinct())
    if links.count() <= local_edges:

        def whole(batches):
            kept = [b for b in batches if len(b)]
            if kept:
                out = _order(*(pd.concat([b[c] for b in kept]) for c in ("source_id", "target_id")))
                yield pd.DataFrame({"position": range(1, len(out) + 1), "symbol_id": out})

        return links.coalesce(1).mapInPandas(whole, "position bigint, symbol_id string")

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        from itertools import accumulate

        out = _order(pdf["source_id"], pdf["target_id"])
        return pd.DataFrame({"high": list(accumulate(out, max)), "place": range(len(out)), "symbol_id": out}).astype({"high": object, "place": "int64", "symbol_id": object})

    grouped = join_split_hot(links.withColumn("symbol_id", F.col("source_id")), components(links), "symbol_id", "inner")
    placed = grouped.select("component", "source_id", "target_id").groupBy("component").applyInPandas(order, "high string, place bigint, symbol_id string")
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(cut_lineage(placed).repartitionByRange(parts, "high", "place").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("high", "place"))
    return placed.withColumn("inside", inside).join(F.broadcast(offsets), "part").select((F.col("inside") + F.col("offset")).alias("position"), "symbol_id")


def degrees(edges: DataFrame) -> DataFrame:
    """(symbol_id, n_callers, n_callees): distinct direct neighbours by call and inferred edges."""
    pairs = clean_edges(edges).where(F.col("edge_type").isin("call", "inferred")).select("source_id", "target_id").distinct()
    out = pairs.groupBy(F.col("source_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("n_callees"))
    into = pairs.groupBy(F.col("target_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("n_callers"))
    return out.join(into, "symbol_id", "full").select("symbol_id", F.coalesce("n_callers", F.lit(0)).alias("n_callers"), F.coalesce("n_callees", F.lit(0)).alias("n_callees"))


def drop_file(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without what the files in ``paths`` define; edges into those files from others stay."""
    gone = paths.select("file_path").distinct()
    return tuple(t.join(gone, "file_path", "left_anti") for t in (nodes, edges, symbols))


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names and files of both ends, null where an end has no node row; a hot end is not shuffled."""
    facts = nodes.groupBy("symbol_id").agg(F.max(F.struct("created_at", "symbol_name", "file_path")).alias("f")) if "created_at" in nodes.columns else nodes.groupBy("symbol_id").agg(F.max(F.struct("symbol_name", "file_path")).alias("f"))
    out = edges
    for end in ("source", "target"):
        side = facts.select(F.col("symbol_id").alias(f"{end}_id"), F.col("f.symbol_name").alias(f"{end}_name"), F.col("f.file_path").alias(f"{end}_file"))
        out = join_split_hot(out, side, f"{end}_id", "left")
    return out
