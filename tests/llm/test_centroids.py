"""Centroid clustering against plain all-pairs distances in Python's whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from gradeloom.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, x int"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, k=8, rounds=10, dimensions=4, scale=1024, seed=3):
    kept = []
    for vec_id, values, *_ in rows:
        if values is not None and len(values) == dimensions and all(v is not None and math.isfinite(v) for v in values):
            whole = []
            for v in values:
                up, down = float(v).as_integer_ratio()
                whole.append(scale * up // down)
            name = f"{seed}:{'null' if vec_id is None else vec_id}"
            kept.append((hashlib.sha256(name.encode()).hexdigest(), list(values), vec_id, whole))
    middles = [w for _, _, _, w in sorted(kept, key=lambda r: r[:2])[:k]]

    def near(w):
        return min((sum((a - b) ** 2 for a, b in zip(w, m)), c) for c, m in enumerate(middles))

    for _ in range(rounds):
        groups = {}
        for *_, w in kept:
            groups.setdefault(near(w)[1], []).append(w)
        for c, own in groups.items():
            middles[c] = [sum(col) // len(own) for col in zip(*own)]
    found = [(vec_id, *near(w)) for _, _, vec_id, w in kept]
    total = sum(d for _, d, _ in found)
    per = {c: sum(d for _, d, e in found if e == c) for _, _, c in found}
    shas = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middles]
    return sorted(((v, c, d, per[c], total, shas[c]) for v, d, c in found), key=repr)


def clusters(spark, rows, **options):
    got = centroids.cluster_vectors(spark.createDataFrame(rows, SCHEMA), dimensions=4, **options)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=repr)


BAD = [(900, None, "", 0), (901, [1.0, None, 0.0, 0.0], "", 0), (902, [float("nan")] * 4, "", 0),
       (903, [float("-inf"), 0.0, 0.0, 0.0], "", 0), (904, [1.0, 2.0], "", 0), (905, [], "", 0), (906, [0.0] * 5, "", 0)]


def test_random_vectors_bad_ones_and_repeats(spark):
    rng = np.random.default_rng(11)
    rows = [(i, (rng.integers(-9, 9, 4) / 7).tolist(), "mine", 1) for i in range(300)]
    rows += [rows[5]] * 60 + [(None, [0.25, -0.5, 0.1, 0.0], "", 1)] * 2 + BAD
    assert clusters(spark, rows, rounds=4) == brute(rows, rounds=4)


def test_ties_go_to_the_smaller_number(spark):
    # A grid: many vectors lie exactly between centroids.
    rows = [(i, [float(i % 5), float(i // 5 % 5), 0.0, 0.0], "", 1) for i in range(100)]
    assert clusters(spark, rows, scale=2, rounds=2) == brute(rows, scale=2, rounds=2)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0], "", 1), (2, [-1.0, 0.3, 0.0, 0.0], "", 1), *BAD]
    got = clusters(spark, rows)
    assert got == brute(rows) and {r[1] for r in got} == {0, 1}
    assert clusters(spark, BAD) == []


def test_an_empty_centroid_stays(spark):
    # Equal vectors: all go to the first centroid, the others have none.
    rows = [(i, [0.5, 0.5, 0.5, 0.5], "", 1) for i in range(20)] + [(99, [3.0, 3.0, 3.0, 3.0], "", 1)]
    assert clusters(spark, rows) == brute(rows)


@pytest.mark.parametrize("size", [1e6, 1e9])
def test_large_components_are_exact(spark, size):
    rng = np.random.default_rng(12)
    rows = [(i, (rng.normal(size=4) * size).tolist(), "", 1) for i in range(40)]
    want = brute(rows, rounds=1)
    # Beyond 64 bits there is no number, but the clusters are the same.
    want = [(v, c, *(n if n < 2**63 else None for n in sums), s) for v, c, *sums, s in want]
    assert any(r[4] is None for r in want)
    assert clusters(spark, rows, rounds=1) == sorted(want, key=repr)


def test_any_double_becomes_a_whole_number():
    for value in (3.4e38, -1.7e308, 5e-324, -5e-324, 2.0**53 + 2, -0.1):
        up, down = value.as_integer_ratio()
        assert centroids.whole_numbers(np.array([[value, 2.0**70]]), 1024)[0][0] == 1024 * up // down
        if abs(value) < 1:
            assert centroids.whole_numbers(np.array([[value]]), 1024)[0][0] == 1024 * up // down


def test_sign_tests_equal_distances():
    rng = np.random.default_rng(13)
    for bound in (5, 2**11, 2**30, 2**70):
        middles = [[int(v) for v in rng.integers(-5, 6, 3)] for _ in range(6)]
        middles = [[v * (bound // 5) for v in m] for m in middles]
        points = [[int(v) * (bound // 5) // 2 for v in rng.integers(-10, 11, 3)] for _ in range(200)]
        x = np.array(points, dtype=object if bound > 2**40 else np.int64)
        number, distance = centroids.Bisectors(middles).nearest(x)
        want = [min((sum((a - b) ** 2 for a, b in zip(p, m)), c) for c, m in enumerate(middles)) for p in points]
        assert list(zip(map(int, distance), number.tolist())) == want
