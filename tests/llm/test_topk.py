"""Exact top-k against all pairs."""

import numpy as np
import pytest

from gradeloom.llm import topk

SCHEMA = "vec_id long, embedding array<double>, score int, width int"


def brute(rows, queries, k):
    points = {}
    for vec, values, *_ in rows:
        if vec is not None and values is not None and all(v is not None and np.isfinite(v) for v in values):
            points[vec] = np.floor(np.array(values, dtype=float) * 64).astype(int)
    out = []
    for q in queries:
        if q not in points:
            continue
        scored = sorted(
            (-int(points[q] @ p), v) for v, p in points.items() if v != q and len(p) == len(points[q])
        )[:k]
        out += [(q, n, v, -s) for n, (s, v) in enumerate(scored, 1)]
    return sorted(out)


def test_ties_bad_vectors_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 150)
    monkeypatch.setattr(topk, "PAGE", 8)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).round(2).tolist(), 1, 1) for i in range(500)]
    rows += [(500 + i, rows[3][1], 1, 1) for i in range(40)] + [rows[10]] * 30
    rows += [(900, None, 1, 1), (901, [1.0, None], 1, 1), (902, [float("nan")] * 6, 1, 1),
             (903, [float("inf")] * 6, 1, 1), (None, [0.0] * 6, 1, 1), (904, [1.0, 2.0], 1, 1), (905, [], 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, df.filter("vec_id % 20 = 0 or vec_id > 900"), 20)
    queries = [v for v in range(906) if v % 20 == 0 or v > 900]
    assert sorted(map(tuple, got.collect())) == brute(rows, queries, 20)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], 1, 1), (20, [-1.0], 1, 1)], SCHEMA)
    assert sorted(map(tuple, topk.top_k(df, df).collect())) == [(0, 1, 20, -4096), (20, 1, 0, -4096)]
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_most_pages_of_clustered_vectors_are_put_aside():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16)) * 2_000
    points = np.floor(centres.repeat(100, axis=0) + rng.normal(size=(4_000, 16)) * 20)
    tree = topk.Tree(points)
    ids = tree.order
    for i in range(0, 4_000, 611):
        got = tree.search(points[i], ids, i, 5)
        scores = points @ points[i]
        want = sorted(((-s, v) for v, s in enumerate(scores) if v != i))[:5]
        assert [(v, s) for s, v in got] == [(v, -s) for s, v in want]


def test_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "PAGE", 4)
    rows = [(0, [1.0, 2.0], 1, 1), (20, [6e7, 1.0], 1, 1), (21, [-6.0, 3.0], 1, 1), (22, [5e6, 2.0], 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 20 = 0")).collect())) == brute(rows, [0, 20], 20)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-(2**24), 2**24, 5)).astype(float).tolist(), 1, 1) for i in range(60)]
    # One vector twice but for a last bit that doubles would lose.
    rows += [(60, [2.0**24] * 4 + [1 / 64], 1, 1), (61, [2.0**24] * 4 + [2 / 64], 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 20 = 0")).collect())) == brute(rows, [0, 20, 40, 60], 20)
    huge = spark.createDataFrame([(0, [1e18], 1, 1), (1, [1e18], 1, 1)], SCHEMA)
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(huge, huge).collect()
