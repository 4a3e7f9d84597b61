"""Evaluation passages in training text: a broadcast set of test n-grams against the token windows of every document.

The test set is stated and small (a few hundred items); it is taken in blocks of at most ``BLOCK_WORDS`` words, so what one
broadcast holds is bounded whatever the test set's size. Documents are scanned whole, in one narrow pass per block: no
shuffle before the found pairs. A window is first matched by a 64-bit rolling hash over word numbers, then verified word by
word.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a row that make a leak.
NGRAM = 13
#: Most words of test passages in one broadcast (about 150 bytes each on a worker).
BLOCK_WORDS = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits in lower case; all else, the underscore included, separates."""
    return [w.lower() for w in _WORD.findall(text)]


def _window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    if len(ids) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _BASE
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0x100000001B3) + mixed[k : k + len(out)]
    return out


class TestSet:
    """Vocabulary, window hashes and exact windows of one block of test passages."""

    def __init__(self, rows: list[tuple], n: int):
        self.n, self.words, self.exact = n, {}, {}
        hashes = []
        for item, passage in rows:
            ids = [self.words.setdefault(w, len(self.words)) for w in words_of(passage)]
            for i in range(len(ids) - n + 1):
                self.exact.setdefault(tuple(ids[i : i + n]), set()).add(item)
            hashes.append(_window_hashes(np.array(ids, np.int64), n))
        self.hashes = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)

    def hits(self, texts: list[str]) -> Iterator[tuple[int, int, set]]:
        """(text number, number of the window's first word, items) for every verified window."""
        flat, starts, get = [], [], self.words.get
        for text in texts:
            starts.append(len(flat))
            flat += [get(w, -1) for w in words_of(text)]
            flat.append(-1)
        ids = np.array(flat, np.int64)
        hashes = _window_hashes(ids, self.n)
        if not len(hashes) or not len(self.hashes):
            return
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        clean = unknown[self.n :] == unknown[: len(unknown) - self.n]
        at = np.searchsorted(self.hashes, hashes).clip(max=len(self.hashes) - 1)
        bounds = np.array(starts)
        for i in np.flatnonzero(clean & (self.hashes[at] == hashes)):
            items = self.exact.get(tuple(flat[i : i + self.n]))
            if items:
                t = int(np.searchsorted(bounds, i, side="right")) - 1
                yield t, int(i) - starts[t], items


def _blocks(items: DataFrame, item_id: str, passage: str, block_words: int):
    rows = items.select(F.col(item_id).alias("item"), F.col(passage).alias("passage")).where("item is not null and length(passage) > 0")
    total = rows.agg(F.sum(F.size(F.split("passage", r"\s+")))).first()[0] or 0
    blocks = -(-total // block_words)
    for b in range(blocks):
        yield [(r["item"], r["passage"]) for r in rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()]


_SETS: dict = {}


def _kept(name: str, shared) -> TestSet:
    """The test set of a broadcast block, made once per worker process; the one before is let go."""
    if name not in _SETS:
        _SETS.clear()
        _SETS[name] = TestSet(*shared.value)
    return _SETS[name]


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", n: int = NGRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_windows): every pair that shares at least ``n`` consecutive words, with the number of shared windows.

    Null and empty texts or passages, and those of fewer than ``n`` words, share nothing. Repeated documents under one id
    count once in the pairs (their windows add up); an item stored twice counts once. Extra columns are ignored.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("length(text) > 0")
    kinds = dict(docs.dtypes)["doc_id"], dict(items.dtypes)[item_id]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_windows bigint"
    context = documents.sparkSession.sparkContext
    found = documents.sparkSession.createDataFrame([], schema)
    for rows in _blocks(items, item_id, passage, block_words):
        shared, name = context.broadcast((rows, n)), uuid.uuid4().hex

        def scan(batches: Iterator[pd.DataFrame], shared=shared, name=name) -> Iterator[pd.DataFrame]:
            tests = _kept(name, shared)
            for batch in batches:
                counts: dict = {}
                ids = batch["doc_id"].tolist()
                for t, _, hit in tests.hits(batch["text"].tolist()):
                    for item in hit:
                        counts[ids[t], item] = counts.get((ids[t], item), 0) + 1
                yield pd.DataFrame({"doc_id": [k[0] for k in counts], "item_id": [k[1] for k in counts], "n_windows": list(counts.values())})

        found = found.unionByName(docs.mapInPandas(scan, schema))
    return found.groupBy("doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows"))


def remove_leaks(documents: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", passage: str = "passage", n: int = NGRAM, whole: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``documents`` without the leaked spans (or, with ``whole``, without the documents that hold any).

    A span runs from the first to the last word of windows that overlap or touch; what is removed is its text from the first
    word's start to the last word's end. All other columns and texts stay as they are; null texts stay null.
    """
    context = documents.sparkSession.sparkContext
    for rows in _blocks(items, item_id, passage, block_words):
        shared, name = context.broadcast((rows, n)), uuid.uuid4().hex

        def strip(batches: Iterator[pd.DataFrame], shared=shared, name=name) -> Iterator[pd.DataFrame]:
            tests = _kept(name, shared)
            for batch in batches:
                texts = [t if isinstance(t, str) else "" for t in batch[text]]
                spans: dict[int, list] = {}
                for t, first, _ in tests.hits(texts):
                    own = spans.setdefault(t, [])
                    if own and first <= own[-1][1]:
                        own[-1][1] = first + n
                    else:
                        own.append([first, first + n])
                if whole:
                    yield batch[[i not in spans for i in range(len(batch))]]
                    continue
                cleaned = batch[text].tolist()
                for t, own in spans.items():
                    words = list(_WORD.finditer(texts[t]))
                    for a, b in reversed(own):
                        cleaned[t] = cleaned[t][: words[a].start()] + cleaned[t][words[b - 1].end() :]
                yield batch.assign(**{text: pd.Series(cleaned, dtype=object, index=batch.index)})

        documents = documents.mapInPandas(strip, documents.schema)
    return documents
