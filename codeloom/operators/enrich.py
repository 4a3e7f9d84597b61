"""Summaries and edges from a language model that is passed in as a function; without one nothing changes.

The function travels to the workers and gets lists of texts; a batch it fails on falls back alone, and the job goes on.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols a call gets at once.
BATCH = 10


def _answers(call: Callable[[list[str]], list], texts: list[str], batch: int, fallback) -> Iterator:
    for low in range(0, len(texts), batch):
        part = texts[low : low + batch]
        try:
            got = list(call(part))
            if len(got) != len(part):
                raise ValueError("another number of answers than questions")
        except Exception:  # one failed batch must not end the job
            got = [fallback] * len(part)
        yield from got


def summarize(symbols: DataFrame, call: Callable[[list[str]], list[str]] | None, text: str = "content", batch: int = BATCH) -> DataFrame:
    """``symbols`` with a column llm_summary: what ``call`` says of each text, in batches; null where it fails, where the text
    is null or blank, and everywhere without a ``call``."""
    if call is None:
        return symbols.withColumn("llm_summary", F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        asked = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
        for i, answer in zip(asked, _answers(call, [texts.iloc[i] for i in asked], batch, None), strict=True):
            out.iloc[i] = answer
        return out

    return symbols.withColumn("llm_summary", run(F.col(text)))


def infer_edges(symbols: DataFrame, call: Callable[[list[str]], list[str]] | None, least: float = 0.5, source: str = "symbol_id", text: str = "content", batch: int = BATCH) -> DataFrame:
    """(source_id, target_id, edge_type, inferred, confidence) that ``call`` finds in the symbols' texts.

    Each answer is a JSON array of objects with target, and optionally type and confidence (1 where it is missing). Answers
    that are no such JSON, targets that are blank, and edges below ``least`` are left out; without a ``call`` there are none.
    """
    schema = "source_id string, target_id string, edge_type string, confidence double"
    rows = symbols.select(F.col(source).cast("string").alias("source_id"), F.col(text).alias("text")).where("source_id is not null and trim(text) != ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for name, answer in zip(frame["source_id"], _answers(call, frame["text"].tolist(), batch, "[]"), strict=True):
                out += [(name, t, k, c) for t, k, c in _edges_of(answer)]
            yield pd.DataFrame(out, columns=["source_id", "target_id", "edge_type", "confidence"])

    found = rows.mapInPandas(run, schema) if call else symbols.sparkSession.createDataFrame([], schema)
    return confident(found, least).withColumn("inferred", F.lit(True))


def _edges_of(answer: str | None) -> Iterator[tuple[str, str, float]]:
    try:
        found = json.loads(answer or "[]")
    except ValueError:
        return
    for edge in found if isinstance(found, list) else []:
        target = edge.get("target") if isinstance(edge, dict) else None
        sure = edge.get("confidence", 1.0) if isinstance(edge, dict) else None
        if isinstance(target, str) and target.strip() and isinstance(sure, int | float):
            yield target.strip(), str(edge.get("type") or "inferred"), float(sure)


def confident(edges: DataFrame, least: float = 0.5) -> DataFrame:
    """Edges whose confidence is ``least`` or more; null confidence is none."""
    return edges.where(F.col("confidence") >= least)
