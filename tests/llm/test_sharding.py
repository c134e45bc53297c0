"""Shards: differencing, groups that stay together, slots."""

import zlib

import numpy as np

from gradeloom.llm.sharding import differenced, shard_documents


def test_differencing_beats_dealing_by_size():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 100_000, 400))[::-1]
    parts = np.zeros((400, 8), dtype=np.int64)
    parts[:, 0] = sizes
    sums = np.bincount(differenced(parts)[:, 0], weights=sizes, minlength=8)
    dealt = np.zeros(8)
    for s in sizes:
        dealt[np.argmin(dealt)] += s
    assert np.ptp(sums) < np.ptp(dealt)


def test_partial_partitions_keep_their_slots_apart():
    parts = np.array([[9, 5, 0], [8, 1, 1], [4, 4, 4]])
    shard = differenced(parts)
    assert all(sorted(row) == [0, 1, 2] for row in shard.tolist())
    assert differenced(np.zeros((0, 3), dtype=np.int64)).shape == (0, 3)


def check(rows, found):
    assert len(found) == len(rows)
    texts = {}
    for i, text, *_ in rows:
        texts.setdefault(i, set()).add(text or "")
    for r in found:
        assert any(r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode()) for t in texts[r.doc_id])
        assert r.law == "bytes" and 0 <= r.shard < 8 and r.grown_shard is None
    for s in range(8):
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))


def test_equal_texts_share_a_shard_of_near_equal_bytes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "x" * int(rng.integers(1, 900)) + str(i % 700)) for i in range(1_500)]
    rows += [(2_000 + i, "copied text") for i in range(60)]
    found = shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, found)
    assert len({r.shard for r in found if r.doc_id >= 2_000}) == 1
    sums = np.bincount([r.shard for r in found], weights=[r.size for r in found], minlength=8)
    assert np.ptp(sums) <= 0.001 * sums.mean()
    again = shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(again) == sorted(found)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, None, 1, 2), (1, "", 1, 2), (1, "a", 1, 2), (1, "a", 1, 2), (2, "é" * 50_000, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, text_key int")
    found = shard_documents(docs).collect()
    check(rows, found)
    assert len({r.shard for r in found if r.size == 1}) == 1
    assert shard_documents(docs.limit(0)).count() == 0
