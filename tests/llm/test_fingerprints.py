"""Fingerprints: edited texts, estimates against exact containment, edge cases."""

import hashlib
import random

from pyspark.sql import functions as F

from gradeloom.llm import fingerprints as fp


def shingles(text):
    words = text.split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for n, (i, text) in enumerate(order):
        text, after = text or "", order[(n + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[i] = (text, text[: len(text) - half] + after[:half], after)
    return out


def test_against_exact_values(spark, monkeypatch):
    monkeypatch.setattr(fp, "LEAST_STRETCHES", 7)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5_000)]
    rows = [(i * 3, " ".join(rng.choices(words, k=rng.choice([0, 1, 4, 9, 300, 2_000])))) for i in range(60)]
    rows += [(1, None), (2, "é\nü " * 50), (200, rows[5][1])]
    got = {r.doc_id: r for r in fp.fingerprint_documents(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, (text, edited, after) in expected(rows).items():
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingles(text), shingles(other)
            exact = 1.0 if a == b else len(a & b) / min(len(a), len(b)) if a and b else 0.0
            assert 0 <= near <= 1
            if min(len(a), len(b)) > 200:
                assert abs(near - exact) < 0.25
            if min(len(a), len(b)) < fp.LEAST_KEPT:
                assert near == exact
    assert got[15].fingerprint == got[200].fingerprint


def test_sketches_merge_and_measure_unequal_texts(spark):
    long = " ".join(f"a{i}" for i in range(20_000))
    part = " ".join(f"a{i}" for i in range(500, 1_500))
    other = " ".join(f"b{i}" for i in range(1_000))
    row = spark.createDataFrame([(long, part, other)], "x string, y string, z string").select(
        fp.containment(fp.sketch(F.col("x")), fp.sketch(F.col("y"))).alias("inside"),
        fp.containment(fp.sketch(F.col("x")), fp.sketch(F.col("z"))).alias("apart"),
        (fp.merged(fp.sketch(F.col("y")), fp.sketch(F.col("z")))
         == fp.sketch(F.concat_ws(" ", "y", F.lit("p q r s"), "z"))).alias("joined"),
        F.size(fp.sketch(F.col("x"))).alias("kept"),
    ).first()
    assert row.inside == 1.0 and row.apart == 0.0
    assert 0.2 < row.kept / 20_000 < 0.3


def test_one_row_repeats_null_ids_and_no_rows(spark):
    schema = "doc_id long, text string, sketch int, tie int"
    one = fp.fingerprint_documents(spark.createDataFrame([(7, "a b", 1, 1)], schema)).first()
    assert one.edited_sha256 == hashlib.sha256(b"a ba").hexdigest() or one.n_chars == 3
    assert one.near_next == 1.0
    rows = [(1, "x", 1, 1), (1, "x", 1, 1), (None, None, 1, 1), (None, "y z", 1, 1)]
    assert fp.fingerprint_documents(spark.createDataFrame(rows, schema)).count() == 4
    assert fp.fingerprint_documents(spark.createDataFrame([], schema)).count() == 0


def test_short_texts_inside_the_next_one(spark):
    rng = random.Random(8)
    rows = []
    for i in range(200):
        long = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 400]))]
        at = rng.randrange(20)
        rows += [(2 * i + 1, " ".join(long[at : at + 6])), (2 * i, " ".join(long))]
    got = {r.doc_id: r for r in fp.fingerprint_documents(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].near_next == 1.0 for i in range(1, 400, 2))
    assert len({r.fingerprint for r in got.values()}) == len(rows)


def test_a_sketch_is_exactly_the_hashes_below_the_threshold(spark):
    texts = [("",), (None,), ("a b c",), ("a b c d e f g",), (" ".join(f"x{i}" for i in range(500)),)]
    rows = spark.createDataFrame(texts, "t string").select(
        fp.sketch(F.col("t")).alias("kept"), fp.whole_set(F.col("t")).alias("whole")
    ).collect()
    for r in rows:
        assert r.kept == [h for h in r.whole if h < (1 << fp.BITS) // fp.SCALE]
