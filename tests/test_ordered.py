import random

from pyspark.sql import functions as F

from gradeloom.operators import ordered


def _sample(seed, n=120):
    rng = random.Random(seed)
    rows = [(rng.choice("aab"), i, rng.choice([None, None, rng.randrange(9)])) for i in range(n)]
    rng.shuffle(rows)
    return rows


def test_row_numbers_restart_per_key_and_follow_the_order(spark, rows):
    data = [(k, v) for k in ("big", "big2", "x") for v in range(40 if k == "big" else 7)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "k string, v int").repartition(5)
    got = rows(ordered.with_row_number(df, ["k"], [-F.col("v")], "n"), "k", "v", "n")
    size = {"big": 40, "big2": 7, "x": 7}
    assert got == sorted([(k, v, size[k] - v) for k, v in data], key=repr)


def test_row_numbers_keep_null_keys(spark, rows):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "k string, v int")
    got = rows(ordered.with_row_number(df, ["k"], [F.col("v")], "n"))
    assert got == sorted([(None, 1, 1), (None, 2, 2), ("a", 5, 1)], key=repr)


def test_scan_equals_a_sequential_walk_for_any_block_size(spark, rows):
    data = _sample(7)
    df = spark.createDataFrame(data, "k string, i long, v int")
    want, state = [], {}
    by_key = sorted(data, key=lambda r: (r[0], r[1]))
    for n, (k, i, v) in enumerate(by_key):
        last, total, prev = state.get(k, (None, 0, None))
        nxt = by_key[n + 1] if n + 1 < len(by_key) and by_key[n + 1][0] == k else None
        before = last
        last = v if v is not None else last
        total += v or 0
        want.append((k, i, last, before, total, prev, nxt[2] if nxt else None))
        state[k] = (last, total, v)
    for block in (1, 4, 1000):
        v = F.col("v")
        got = ordered.scan(
            df, ["k"], "i", last={"l": v}, before={"b": v}, total={"t": v},
            previous={"p": v}, following={"n": v}, block=block,
        )
        assert rows(got, "k", "i", "l", "b", "t", "p", "n") == sorted(want, key=repr)


def test_scan_without_keys(spark, rows):
    df = spark.range(10).withColumnRenamed("id", "i")
    got = rows(ordered.scan(df, [], "i", total={"t": F.col("i")}, block=3), "i", "t")
    assert got == [(i, i * (i + 1) // 2) for i in range(10)]


def test_texts_are_joined_in_order_across_blocks(spark, rows):
    data = [("a", i, "" if i % 4 == 0 else str(i)) for i in range(11)] + [("b", 0, ""), ("b", 1, None)]
    df = spark.createDataFrame(data, "k string, i long, t string").repartition(3)
    got = rows(ordered.ordered_text(df, ["k"], "i", "t", "text", block=3))
    assert got == [("a", "\n".join(str(i) for i in range(11) if i % 4)), ("b", "")]
