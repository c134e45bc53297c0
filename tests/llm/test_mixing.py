"""Mixing: water-filling against a loop, samples near their targets."""

import random

from gradeloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, row int"


def filled(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        targets = {s: most * sizes[s] if s in capped else left * weight[s] / share for s in names}
        over = {s for s in names if s not in capped and targets[s] > most * sizes[s]}
        if not over:
            return targets
        capped |= over


def documents(n=3_000):
    rng = random.Random(10)
    sources = ["a"] * 60 + ["b"] * 25 + ["c"] * 2 + ["é"] * 5 + [None] * 8
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), rng.choice(sources), 1, 2) for i in range(n)]
    return rows + [(n, None, "a", 1, 2), (n + 1, "", None, 1, 2), (None, "x y", "b", 1, 2)]


def test_targets_and_samples(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(docs).collect()
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = filled(sizes, (5, 2, 1), 3)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + r.target)
        assert r.taken == r.repeats * r.size and r.repeats <= 3
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= 300
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    assert sorted(map(tuple, mixing.mix_sources(docs).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.repeats for r in got)


def test_no_words_and_no_rows(spark):
    wordless = spark.createDataFrame([(1, None, "a", 1, 1), (2, "", None, 1, 1)], SCHEMA)
    assert [(r.target, r.taken) for r in mixing.mix_sources(wordless).collect()] == [(0.0, 0)] * 2
    assert mixing.mix_sources(wordless.limit(0)).count() == 0
    assert mixing.mix_documents(wordless.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "a b c", "s", 1, 1), (1, "a b c", "s", 1, 1)], SCHEMA)
    assert [r.taken for r in mixing.mix_sources(one).collect()] == [3, 3]
