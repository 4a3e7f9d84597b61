"""Parent-child links to full hierarchies by contraction of partition-local chains.

Every level range-partitions its nodes by key (neighbouring keys, such as symbols of one module, fall together), follows
parent links inside each partition to the *fragment exit* (the last local ancestor) and keeps of each fragment only its
exits. The exits form a smaller quotient forest with weighted links, which is solved the same way with fewer partitions
until it fits one; the answers are then expanded back, level by level. A chain that returns to itself is a cycle: found
inside a partition at some level, at the latest in the last one.

A node whose root is known leaves the forest, so only unsolved exits go up a level. Should keys have no locality (a level
keeps more than ``STUBBORN`` of its nodes), every link is followed twice before the next contraction (pointer doubling),
which bounds the number of levels by the logarithm of the depth: after as many doublings as the node count has binary digits
every chain has been followed further than there are nodes, so what is still open then runs in a cycle.

Roots, depths and cycles are settled first, with links that carry only a number of steps. Paths, which are as long as a node
is deep, are made afterwards and only for the part that ends, so nothing grows on a cycle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.skew import join_split_hot
from codeloom.session import cut_lineage

#: Most nodes that one partition of a level follows in memory (about 200 bytes each).
FRAGMENT_ROWS = 20_000
STUBBORN = 0.7

_FRAGMENT = "key string, exit string, exit_parent string, exit_steps bigint, exit_via array<string>, steps bigint, chain array<string>, root string, depth bigint, path array<string>, endless boolean"


def _contract(with_path: bool):
    """Follows links inside one partition. A node without a parent is solved: it carries root, depth, path and endless."""

    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [b for b in batches if len(b)]
        if not kept:
            return
        nodes = pd.concat(kept, ignore_index=True)
        key, steps = nodes["key"].tolist(), nodes["steps"].tolist()
        parent = [p if isinstance(p, str) else None for p in nodes["parent"]]
        root = [r if isinstance(r, str) else None for r in nodes["root"]]
        depth, endless = nodes["depth"].tolist(), nodes["endless"].tolist()
        via = [list(v) for v in nodes["via"]] if with_path else None
        path = [list(v) for v in nodes["path"]] if with_path else None
        del nodes, kept
        at = {k: i for i, k in enumerate(key)}
        up = [-1 if p is None else at.get(p, -1) for p in parent]
        exit_, dist, seen = [-1] * len(key), [0] * len(key), [0] * len(key)
        chain: list = [[] for _ in key] if with_path else []
        for start in range(len(key)):
            walk, i = [], start
            while exit_[i] < 0 and seen[i] != start + 1 and up[i] >= 0:
                seen[i] = start + 1
                walk.append(i)
                i = up[i]
            if exit_[i] < 0 and up[i] < 0:
                exit_[i] = i
            elif exit_[i] < 0:  # back at a node of this walk: the walk's tail from there on is a cycle
                while True:
                    j = walk.pop()
                    exit_[j], endless[j], parent[j], root[j] = j, True, None, ""
                    if j == i:
                        break
            for j in reversed(walk):
                p = up[j]
                exit_[j], dist[j] = exit_[p], dist[p] + steps[j]
                if with_path:
                    chain[j] = chain[p] + via[j] + [key[j]]
        size = 50_000
        for low in range(0, len(key), size):
            part = range(low, min(low + size, len(key)))
            out = exit_[low : low + size]
            yield pd.DataFrame(
                {
                    "key": key[low : low + size],
                    "exit": [key[e] for e in out],
                    "exit_parent": [parent[e] for e in out],
                    "exit_steps": [steps[e] for e in out],
                    "exit_via": [via[e] for e in out] if with_path else [[] for _ in out],
                    "steps": dist[low : low + size],
                    "chain": [chain[i] for i in part] if with_path else [[] for _ in out],
                    "root": [root[e] for e in out],
                    "depth": [depth[e] for e in out],
                    "path": [path[e] for e in out] if with_path else [[] for _ in out],
                    "endless": [bool(endless[e]) for e in out],
                }
            )

    return contract


def _empty():
    return F.array().cast("array<string>")


def _quotient(fragments: DataFrame) -> DataFrame:
    """The unsolved exits, each linked to the exit above its parent, or solved if that exit is."""
    exits = fragments.where("key = exit and exit_parent is not null").select("key", F.col("exit_parent").alias("p"), F.col("exit_steps").alias("s"), F.col("exit_via").alias("v"))
    above = fragments.select(F.col("key").alias("p"), "exit", "exit_parent", F.col("steps").alias("t"), "chain", "root", "depth", "path", "endless")
    solved = F.col("exit_parent").isNull()
    steps, via = F.col("s") + F.col("t"), F.concat("chain", "v")
    return join_split_hot(exits, above, "p", "inner").select(
        "key",
        F.when(~solved, F.col("exit")).alias("parent"),
        steps.alias("steps"),
        via.alias("via"),
        "root",
        F.when(solved, F.col("depth") + steps).otherwise(F.lit(0)).alias("depth"),
        F.when(solved, F.concat("path", via, F.array("key"))).otherwise(_empty()).alias("path"),
        (solved & F.col("endless")).alias("endless"),
    )


def _doubled(nodes: DataFrame) -> DataFrame:
    above = nodes.where("parent is not null").select(F.col("key").alias("parent"), F.col("parent").alias("p2"), F.col("steps").alias("s2"), F.col("via").alias("v2"))
    far = F.col("p2").isNotNull()
    return join_split_hot(nodes, above, "parent", "left").select(
        "key",
        F.coalesce("p2", "parent").alias("parent"),
        F.when(far, F.col("steps") + F.col("s2")).otherwise(F.col("steps")).alias("steps"),
        F.when(far, F.concat("v2", F.array("parent"), "via")).otherwise(F.col("via")).alias("via"),
        "root",
        "depth",
        "path",
        "endless",
    )


def _solve(nodes: DataFrame, with_path: bool, fragment_rows: int, fragments: int | None) -> DataFrame:
    """(key, root, depth, path, endless) of (key, parent) rows, one per key."""
    top = F.col("parent").isNull()
    nodes = nodes.select(
        "key", "parent", F.lit(1).cast("bigint").alias("steps"), _empty().alias("via"), F.when(top, F.col("key")).alias("root"), F.lit(0).cast("bigint").alias("depth"), F.when(top & F.lit(with_path), F.array("key")).otherwise(_empty()).alias("path"), F.lit(False).alias("endless")
    )
    nodes = cut_lineage(nodes)
    rows, levels, doublings = nodes.count(), [], 0
    most = max(1, rows).bit_length() + 1
    while True:
        parts = -(-max(rows, 1) // fragment_rows)
        if not levels:  # tasks grow with the square root of the input, as long as that leaves them small
            parts = fragments or max(parts, math.isqrt(rows) // 8, 1)
        placed = nodes.coalesce(1) if parts == 1 else nodes.repartitionByRange(parts, "key")
        frag = placed.mapInPandas(_contract(with_path), _FRAGMENT)
        levels.append(frag := cut_lineage(frag))
        if parts == 1 or doublings > most:
            break
        nodes = cut_lineage(_quotient(frag))
        now = nodes.count()
        if now == 0:
            break
        if nodes.where("parent is not null").count() > STUBBORN * rows:
            nodes, doublings = cut_lineage(_doubled(nodes)), doublings + 1
        rows = now
    solved = None
    for frag in reversed(levels):
        known = F.col("exit_parent").isNull()
        depth, path = F.col("depth") + F.col("steps"), F.concat("path", "chain")
        own = frag.where(known).select("key", "root", depth.alias("depth"), path.alias("path"), "endless")
        rest = frag.where(~known)
        if solved is None:  # the last level: what is still open there never ends
            open_ = rest.select("key", F.lit("").alias("root"), F.lit(0).cast("bigint").alias("depth"), _empty().alias("path"), F.lit(True).alias("endless"))
            solved = own.unionByName(open_)
            continue
        upper = solved.select(F.col("key").alias("exit"), "root", "depth", "path", "endless")
        lifted = join_split_hot(rest.select("key", "exit", "steps", "chain"), upper, "exit", "inner").select("key", "root", depth.alias("depth"), path.alias("path"), "endless")
        solved = own.unionByName(lifted)
    return solved


def resolve_hierarchy(links: DataFrame, child: str = "child", parent: str = "parent", with_path: bool = True, fragment_rows: int = FRAGMENT_ROWS, fragments: int | None = None) -> DataFrame:
    """(key, root, depth, path, endless) for every key that occurs as child or parent.

    ``path`` runs from the root to the key, both included (empty for endless keys and when ``with_path`` is off; a path has
    as many entries as the key is deep). Keys whose parents never end in a root get root ``''``, depth -1, endless true.
    Null or empty children are ignored; a null or empty parent makes the child a root. Repeated links count once; of several
    parents the smallest key is taken. An empty input gives an empty result. Extra columns are ignored.

    ``fragments`` forces the number of partitions of the first level (tests); otherwise it follows from the node count.
    """
    text = lambda c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
    pairs = links.select(text(child).alias("key"), text(parent).alias("parent")).where("key is not null")
    owners = pairs.select(F.col("parent").alias("key"), F.lit(None).cast("string").alias("parent")).where("key is not null")
    nodes = cut_lineage(pairs.unionByName(owners).groupBy("key").agg(F.min("parent").alias("parent")))
    solved = _solve(nodes, False, fragment_rows, fragments)
    if with_path:
        solved = cut_lineage(solved.select("key", "root", "depth", "endless"))
        ends = nodes.join(solved.where("not endless").select("key"), "key", "left_semi")  # closed: a parent ends where its child does
        paths = _solve(ends, True, fragment_rows, fragments).select("key", "path")
        solved = solved.join(paths, "key", "left")
    return solved.select(
        "key",
        F.when(F.col("endless"), F.lit("")).otherwise(F.col("root")).alias("root"),
        F.when(F.col("endless"), F.lit(-1)).otherwise(F.col("depth")).cast("int").alias("depth"),
        (F.coalesce("path", _empty()) if with_path else _empty()).alias("path"),
        "endless",
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """(key, descendant, distance): every key with each node below it, from resolved paths; endless nodes have none.

    One row per ancestor of each node, made by exploding its own path: no join, no group is gathered.
    """
    up = resolved.where(~F.col("endless")).select(F.col("key").alias("descendant"), "depth", F.posexplode("path").alias("at", "key"))
    return up.where("at < depth").select("key", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
