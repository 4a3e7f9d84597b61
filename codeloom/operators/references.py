"""References to records that do not exist: direct orphans, their causes, and what they drag along."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.skew import join_split_hot
from codeloom.session import cut_lineage


@dataclass(frozen=True)
class ForeignKey:
    """``table.column`` must name a key of ``parent``; ``key`` identifies the row, ``at`` dates the reference.

    With ``cascade_only`` the link hands orphanhood down but its own dangling values are not reported.
    """

    table: str
    column: str
    parent: str
    key: str
    at: str | None = None
    cascade_only: bool = False


@dataclass(frozen=True)
class ParentKey:
    """``column`` is the key of ``table``; a row lives from ``since`` until ``until`` is set. Either may be None."""

    table: str
    column: str
    since: str | None = None
    until: str | None = None


def _blank_to_null(column):
    text = F.trim(column.cast("string"))
    return F.when(text != "", text)


def key_states(parents: DataFrame, spec: ParentKey, known: DataFrame | None = None) -> DataFrame:
    """(ref, all_deleted, first_at, is_known), one row per trimmed key; map-side combined.

    ``known`` (column ``ref``) adds keys that always exist, such as those of a language runtime.
    """
    since = F.col(spec.since) if spec.since else F.lit(None)
    gone = F.col(spec.until).isNotNull() if spec.until else F.lit(False)
    rows = parents.select(_blank_to_null(F.col(spec.column)).alias("ref"), gone.alias("gone"), since.cast("timestamp").alias("first_at"), F.lit(False).alias("is_known"))
    if known is not None:
        rows = rows.unionByName(known.select(_blank_to_null(F.col("ref")).alias("ref"), F.lit(False).alias("gone"), F.lit(None).cast("timestamp").alias("first_at"), F.lit(True).alias("is_known")))
    return rows.where("ref is not null").groupBy("ref").agg(F.bool_and("gone").alias("all_deleted"), F.min("first_at").alias("first_at"), F.bool_or("is_known").alias("is_known"))


def direct_orphans(children: DataFrame, fk: ForeignKey, states: DataFrame) -> DataFrame:
    """(ref_table, ref_key, ref, ref_at, cause) for every row whose reference dangles; a row per stored reference.

    cause is ``missing`` (no such key), ``deleted`` (all rows of the key are deleted) or ``late`` (the key's first row is
    younger than the reference). Null and blank references dangle nowhere; a null date on either side is never late.
    A key named by a third of all references is joined without shuffling those rows (see ``join_split_hot``).
    """
    at = F.col(fk.at).cast("timestamp") if fk.at else F.lit(None).cast("timestamp")
    refs = children.select(F.col(fk.key).cast("string").alias("ref_key"), _blank_to_null(F.col(fk.column)).alias("ref"), at.alias("ref_at")).where("ref is not null")
    joined = join_split_hot(refs, states.withColumn("there", F.lit(True)), "ref", "left")
    cause = (
        F.when(F.coalesce("is_known", F.lit(False)), F.lit(None))
        .when(F.col("there").isNull(), F.lit("missing"))
        .when(F.col("all_deleted"), F.lit("deleted"))
        .when(F.col("first_at") > F.col("ref_at"), F.lit("late"))
    )
    return joined.select(F.lit(fk.table).alias("ref_table"), "ref_key", "ref", "ref_at", cause.alias("cause")).where("cause is not null")


def orphan_cascade(tables: dict[str, DataFrame], parents: list[ParentKey], keys: list[ForeignKey], known: DataFrame | None = None, max_rounds: int = 50) -> DataFrame:
    """(ref_table, ref_key, ref, ref_at, cause, root_cause, kind, round): direct orphans and the rows that refer to orphaned rows.

    A record (ref_table, ref_key) is *inherited* when its own reference exists but names an orphaned record of another
    listed table; rounds run down the foreign keys until nothing is added. Each round is one join of the frontier, one row per
    orphaned record, against the children not yet orphaned, and ends in a checkpoint. An inherited row's ``cause`` is
    ``orphaned parent``, and its ``root_cause`` that of the direct orphan it descends from (the smallest of several).
    ``max_rounds`` guards against a cycle of foreign keys; the anti-join already stops those, so reaching it is an error.
    """
    by_parent = {p.table: p for p in parents}
    checked = [fk for fk in keys if not fk.cascade_only]
    states = {p.table: cut_lineage(key_states(tables[p.table], p, known)) for p in parents if any(fk.parent == p.table for fk in checked)}
    found = None
    for fk in checked:
        part = direct_orphans(tables[fk.table], fk, states[fk.parent])
        found = part if found is None else found.unionByName(part)
    found = cut_lineage(found.select("*", F.col("cause").alias("root_cause"), F.lit("direct").alias("kind"), F.lit(0).alias("round")))
    frontier, everything = found, found
    owners = {fk.table: fk.key for fk in keys}
    for number in range(1, max_rounds + 1):
        grown = None
        for fk in keys:
            parent = by_parent.get(fk.parent)
            if parent is None or fk.parent not in owners or owners[fk.parent] != parent.column:
                continue
            dead = frontier.where(F.col("ref_table") == fk.parent).select(_blank_to_null(F.col("ref_key")).alias("ref"), "root_cause").groupBy("ref").agg(F.min("root_cause").alias("root_cause"))
            at = F.col(fk.at).cast("timestamp") if fk.at else F.lit(None).cast("timestamp")
            rows = tables[fk.table].select(F.lit(fk.table).alias("ref_table"), F.col(fk.key).cast("string").alias("ref_key"), _blank_to_null(F.col(fk.column)).alias("ref"), at.alias("ref_at")).where("ref is not null")
            hit = join_split_hot(rows, dead, "ref", "inner").select("ref_table", "ref_key", "ref", "ref_at", F.lit("orphaned parent").alias("cause"), "root_cause", F.lit("inherited").alias("kind"), F.lit(number).alias("round"))
            grown = hit if grown is None else grown.unionByName(hit)
        if grown is None:
            return everything
        frontier = cut_lineage(grown.join(everything.select("ref_table", "ref_key").distinct(), ["ref_table", "ref_key"], "left_anti"))
        if frontier.isEmpty():
            return everything
        everything = everything.unionByName(frontier)
    raise RuntimeError("orphans still spread after max_rounds")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(ref_table, month, kind, cause, root_cause, n_refs): orphans per table and month of the reference; undated ones under null."""
    return orphans.groupBy("ref_table", F.date_format("ref_at", "yyyy-MM").alias("month"), "kind", "cause", "root_cause").agg(F.count_distinct("ref_key").alias("n_refs"))
