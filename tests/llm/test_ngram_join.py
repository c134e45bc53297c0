"""N-gram join against all pairs; blocks in parts; trees; components."""

import random

import numpy as np
import pytest

from gradeloom.llm import graph, ngram_join as nj
from gradeloom.llm.graph import components

SCHEMA = "doc_id long, text string, n int, set_id int"


def sets_of(rows):
    out = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        out.append({tuple(words[i : i + 4]) for i in range(max(len(words) - 3, 1))} if words else set())
    return out


def brute(rows):
    sets, parent = sets_of(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(
        [(r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows)], key=repr
    )


def sample():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(8):
        base = rng.choices(words, k=rng.choice([3, 6, 20, 60, 200]))
        for _ in range(20):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text += "common line that all share here".split()
            rows.append((n, " ".join(text) if rng.random() < 0.9 else " ".join(text).upper(), 1, 2))
            n += 1
    rows += [
        (None, None, 1, 2), (None, " ".join(base), 1, 2), (n, "", 1, 2), (n + 1, " \n", 1, 2),
        (5, rows[5][1], 1, 2), (5, rows[5][1], 1, 2), (n + 2, "A", 1, 2), (n + 3, "a", 1, 2),
        (n + 4, "long " * 50_000, 1, 2),
    ]
    return rows


@pytest.mark.parametrize("part", [128, 3])
def test_same_components_as_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(nj, "PART_SETS", part)
    rows = sample()
    found = nj.link_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = sample()
    kept = nj.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert kept[0].__fields__ == ["doc_id", "text", "n", "set_id"]
    want = {(c, None) for _, n, c in brute(rows) if n and c is not None}
    wordless = sum(not (r[1] or "").split() for r in rows)
    assert len(kept) == len(want) + wordless
    assert {r.doc_id for r in kept if (r.text or "").split()} == {c for c, _ in want}


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nj.link_documents(empty).count() == 0 and nj.keep_one(empty).count() == 0


def test_the_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**40, rng.integers(1, 300)).astype(np.uint64)) for _ in range(150)]
    for s in list(sets[:60]):
        kept = rng.random(len(s)) > 0.05
        sets.append(np.unique(np.r_[s[kept], rng.integers(0, 2**40, 3).astype(np.uint64)]))
    points = np.array([nj._count_vector(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = nj.RTree(points, sizes)
    for i, a in enumerate(sets):
        found = set(tree.search(points[i], int(sizes[i])).tolist())
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                assert j in found


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)}


def test_few_edges_are_written_in_few_parts(spark, monkeypatch):
    parts = []

    def cut(df):
        done = df.checkpoint()
        parts.append(done.rdd.getNumPartitions())
        return done

    monkeypatch.setattr(graph, "cut", cut)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components(spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long"))
        assert {r.root for r in found.collect()} == {0}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(parts) > 2 and set(parts[1:]) == {1}


def test_sets_move_as_compressed_words(spark, monkeypatch):
    moved, links = [], nj._links

    def noted(rows, sets, *rest, **more):
        moved.append(sets.agg({sets.columns[1]: "max"}).first()[0])
        return links(rows, sets, *rest, **more)

    monkeypatch.setattr(nj, "_links", noted)
    base = [f"word{i}" for i in range(1_000)]
    rows = [(i, " ".join([*base, f"end{i}"]), 1, 2) for i in range(5)]
    found = nj.link_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)
    assert 0 < len(moved[0]) < 998 * 8 / 2  # half the hashes of the shingles
