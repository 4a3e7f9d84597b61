"""Vector functions over arrays of floats; the embedder is a stand-in that needs no model."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where the lengths differ or a norm is 0."""
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector divided by its length; a zero vector stays."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def hash_vector(text: str, dimension: int) -> list[float]:
    """Bytes of repeated SHA-256 digests, scaled to [-1, 1], normalised: equal texts get equal vectors."""
    digest, out = hashlib.sha256(text.encode()).digest(), []
    while len(out) < dimension:
        out += [b / 127.5 - 1.0 for b in digest]
        digest = hashlib.sha256(digest).digest()
    vector = np.array(out[:dimension])
    length = float(np.sqrt((vector**2).sum()))
    return (vector / length if length else vector).tolist()


def hash_embedder(dimension: int = 64):
    """Column function text -> vector with the stand-in above; a null text is an empty one."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_vector(t if isinstance(t, str) else "", dimension))

    return embed


def batched_embedder(embed_batch, dimension: int, batch_size: int = 100, retries: int = 3):
    """Column function around ``embed_batch(list of texts) -> list of vectors``.

    A batch that is refused as too large (``ValueError``) is halved, down to single texts, which then get a zero vector; any
    other error is tried again, waiting twice as long each time. A wrong number of vectors is an error.
    """

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        import time

        def run(part: list[str]) -> list[list[float]]:
            for attempt in range(retries + 1):
                try:
                    got = embed_batch(part)
                    if len(got) != len(part):
                        raise RuntimeError("the embedder returned another number of vectors")
                    return got
                except ValueError:
                    if len(part) == 1:
                        return [[0.0] * dimension]
                    half = len(part) // 2
                    return run(part[:half]) + run(part[half:])
                except Exception:
                    if attempt == retries:
                        raise
                    time.sleep(min(60.0, 2.0**attempt))
            raise AssertionError

        values = [t if isinstance(t, str) else "" for t in texts]
        out: list = []
        for i in range(0, len(values), batch_size):
            out += run(values[i : i + batch_size])
        return pd.Series(out)

    return embed
