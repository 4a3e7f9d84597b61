"""Filling fixed-capacity containers along a space-filling curve.

Each text is measured in tokens of a public tokenizer and projected: hashed word counts, times a fixed random sign matrix,
to ``DIMS`` numbers. Ranked to a grid by global quantiles these give a Hilbert key; texts are range-sorted by (key, id) and
packed with their neighbours: an item goes into the fullest of ``OPEN`` open containers that holds it. A container closes for
good once no item of the input could still fit, or once it is as full as the round asks. What a partition leaves underfilled
is packed again, in as many partitions as that takes; each round asks less, so that every round settles its share and the
last one, which closes all it has, is no larger a task than the others. Only (id, size, key) is ever sorted; texts are read
once.
"""

from __future__ import annotations

import base64
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut_lineage, ship_file, shipped

TOKENIZER = os.environ.get("CODELOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
DIMS, BITS, FEATURES = 3, 10, 512
#: Containers a task keeps open, and the fill from which a container is not packed again, by round.
OPEN, FULL = 48, (0.995, 0.98, 0.95, 0.9, 0.8, 0.0)
#: Rows that one packing task takes at most; the first round has a task per PART_ROOT square roots of the rows, if that is more.
PART_ROWS, PART_ROOT = 50_000, 32

_WORD = re.compile(r"\w+")
_LOADED: dict = {}


def load_tokenizer(path: str):
    """A tiktoken encoding of the vocabulary file, kept per worker process."""
    if path not in _LOADED:
        import tiktoken

        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        with open(shipped(path), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _LOADED[path] = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def _signs() -> np.ndarray:
    return np.random.default_rng(20240607).choice([-1.0, 1.0], size=(FEATURES, DIMS))


def project(text: str, signs: np.ndarray) -> np.ndarray:
    counts = np.zeros(FEATURES)
    seen: dict[str, int] = {}
    for word in _WORD.findall(text.lower()):
        seen[word] = seen.get(word, 0) + 1
    for word, n in seen.items():
        counts[zlib.crc32(word.encode()) % FEATURES] += 1 + np.log(n)
    norm = np.sqrt((counts**2).sum())
    return (counts / norm if norm else counts) @ signs


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points (rows of ``grid``) of ``bits`` bits a dimension."""
    x = grid.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def measure(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, v0, v1, ...) of every document with a text that is neither null nor empty."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("length(text) > 0")
    ship_file(documents.sparkSession, tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, signs = load_tokenizer(tokenizer), _signs()
        for batch in batches:
            texts = batch["text"].tolist()
            out = {"doc_id": batch["doc_id"], "n_tokens": [len(encoding.encode_ordinary(t)) for t in texts]}
            vectors = np.array([project(t, signs) for t in texts]).reshape(-1, DIMS)
            yield pd.DataFrame(out | {f"v{i}": vectors[:, i] for i in range(DIMS)})

    columns = ", ".join(f"v{i} double" for i in range(DIMS))
    return docs.mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, {columns}")


def _pack(capacity: int, enough: int, least: int, round_: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        place, made, full = TaskContext.get().partitionId(), 0, max(enough, capacity - least + 1)
        open_: list[list] = []  # [used, name, rows]
        done: list[tuple] = []

        def close(bin_: list) -> None:
            name = f"{round_}-{place}-{bin_[1]}" if bin_[0] >= enough or bin_[0] > capacity - least else None
            done.extend((*row, name) for row in bin_[2])

        for batch in batches:
            for row in batch[["doc_id", "piece", "first_token", "n_tokens", "curve"]].itertuples(index=False, name=None):
                size, best = row[3], None
                for bin_ in open_:
                    if bin_[0] + size <= capacity and (best is None or bin_[0] > best[0]):
                        best = bin_
                if best is None:
                    if len(open_) >= OPEN:
                        fullest = max(open_, key=lambda b: b[0])
                        open_.remove(fullest)
                        close(fullest)
                    best = [0, made, []]
                    made += 1
                    open_.append(best)
                best[0] += size
                best[2].append(row)
                if best[0] >= full:
                    open_.remove(best)
                    close(best)
            if len(done) > 50_000:
                yield pd.DataFrame(done, columns=["doc_id", "piece", "first_token", "n_tokens", "curve", "container"])
                done.clear()
        for bin_ in open_:
            close(bin_)
        if done:
            yield pd.DataFrame(done, columns=["doc_id", "piece", "first_token", "n_tokens", "curve", "container"])

    return pack


def pack_documents(documents: DataFrame, capacity: int = 8192, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, curve, container): every text, or piece of one, in exactly one container.

    Texts of at most ``capacity`` tokens are never divided; longer ones are cut into pieces of ``capacity`` tokens and one
    rest. Null and empty texts are left out. Equal texts lie next to each other; repeated rows are packed as often as they
    occur. An empty table gives an empty result. Extra columns are ignored.
    """
    sized = cut_lineage(measure(documents, doc_id, text, tokenizer))
    kind = dict(sized.dtypes)["doc_id"]
    rows = sized.count()
    cells = 1 << BITS
    points = [i / cells for i in range(1, cells)]
    if rows:
        cuts = sized.agg(*[F.percentile_approx(f"v{i}", points, 10_000).alias(f"v{i}") for i in range(DIMS)]).first()
        edges = [np.array(cuts[i]) for i in range(DIMS)]
    else:
        edges = [np.zeros(1)] * DIMS

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grid = np.stack([np.searchsorted(edges[i], batch[f"v{i}"].to_numpy(), side="right") for i in range(DIMS)], axis=1)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": batch["n_tokens"], "curve": hilbert_keys(grid, BITS)})

    keyed = sized.mapInPandas(place, f"doc_id {kind}, n_tokens bigint, curve bigint")
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity)).cast("bigint")))
    items = keyed.select("doc_id", piece.alias("piece"), "curve", F.col("n_tokens").alias("total"))
    items = items.select("doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("bigint").alias("n_tokens"), "curve")

    schema = f"doc_id {kind}, piece bigint, first_token bigint, n_tokens bigint, curve bigint, container string"
    packed, rest = None, cut_lineage(items)
    rows, least = rest.agg(F.count(F.lit(1)), F.coalesce(F.min("n_tokens"), F.lit(1))).first()
    for number, share in enumerate(FULL):
        parts = max(1, -(-rows // part_rows), math.isqrt(rows) // PART_ROOT if number == 0 else 1)
        enough = 0 if parts == 1 else math.ceil(share * capacity)
        placed = rest.repartitionByRange(parts, "curve", "doc_id", "piece").sortWithinPartitions("curve", "doc_id", "piece")
        out = cut_lineage(placed.mapInPandas(_pack(capacity, enough, least, number), schema))
        filled = out.where("container is not null")
        packed = filled if packed is None else packed.unionByName(filled)
        rest = out.where("container is null").drop("container")
        rows = rest.count() if enough else 0
        if not rows:
            break
    return packed


def packing_report(packed: DataFrame, capacity: int = 8192) -> DataFrame:
    """One row: number of containers, items, tokens, and the share of the capacity that holds tokens."""
    bins = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    return bins.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_items"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("fill"))
