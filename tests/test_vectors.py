import numpy as np
from pyspark.sql import functions as F

from codeloom.operators import retrieval

POINTS = "chunk_id long, vector array<double>, label int"


def brute(points, queries, k, itself=True):
    unit = lambda v: np.array(v) / np.linalg.norm(v) if np.linalg.norm(v) > 0 else np.array(v)
    out = set()
    for q, w in queries:
        scored = [(-round(float(unit(v) @ unit(w)) if v is not None and len(v) == len(w) else 0.0, 6), c) for c, v, _ in points if itself or c != q]
        out |= {(q, c, -s + 0.0) for s, c in sorted(scored)[:k]}
    return out


def rounded(rows):
    return {(r.query_id, r.chunk_id, round(r.score, 5)) for r in rows}


def test_query_sets_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = [(i, rng.normal(size=6).tolist(), i % 3) for i in range(120)]
    points += [(200 + i, points[7][1], 0) for i in range(12)] + [(300, [0.0] * 6, 1), (301, [1.0], 1), (302, None, 1)]  # ties, no length, another dimension, null
    frame = spark.createDataFrame(points, POINTS).repartition(5)
    queries = [(i, points[i][1]) for i in (0, 7, 50, 100)]
    asked = spark.createDataFrame([*queries, (7, points[7][1]), (None, points[1][1]), (9, None)], "query_id long, vector array<double>")
    for block in (4096, 2):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        for itself in (True, False):
            got = retrieval.vector_search_many(frame, asked, 5, itself=itself).collect()
            assert rounded(got) == {(q, c, round(s, 5)) for q, c, s in brute(points, queries, 5, itself)}
    assert retrieval.vector_search_many(frame.limit(0), asked, 5).count() == 0
    assert retrieval.vector_search_many(frame, asked.limit(0), 5).count() == 0


def test_index_with_a_cell_of_a_third(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=8)
    points = [(i, (centre + 0.05 * rng.normal(size=8)).tolist() if i % 3 == 0 else rng.normal(size=8).tolist(), 0) for i in range(600)]
    frame = spark.createDataFrame(points, POINTS)
    asked = frame.where(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), "vector")
    index = retrieval.VectorIndex(frame, cells=8)
    exact = retrieval.vector_search_many(frame, asked, 10, itself=False)
    assert retrieval.search_recall(index.search_many(asked, 10, itself=False), exact).first().recall >= 0.9
    assert rounded(index.search_many(asked, 10, probes=8, itself=False).collect()) == rounded(exact.collect())
    assert retrieval.VectorIndex(frame.limit(0)).search_many(asked, 3).count() == 0
