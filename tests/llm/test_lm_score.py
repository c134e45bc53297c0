"""Cross-entropy differences against plain counting."""

import math
from collections import Counter

import xxhash

from gradeloom.llm import lm_score as lm


def signed(word):
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >= 1 << 63 else h


def brute(docs, good, size, weight):
    tokens = [(d, (t or "").lower().encode().split()) for d, t in docs]
    seen = Counter(w for _, t in tokens for w in t)
    known = {w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], signed(x[0])))[:size]}
    one, before, two, total, rows = ([Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()], [0, 0], [])
    for d, t in tokens:
        ids = [w if w in known else None for w in t]
        c, history = int(d not in good), (["<s>"] + ids[:-1] if ids else [])
        one[c].update(ids)
        before[c].update(history)
        two[c].update(zip(history, ids))
        total[c] += len(ids)
        rows.append((d, c, ids, history))
    out = []
    for d, c, ids, history in rows:
        u, h, b, loss = Counter(ids), Counter(history), Counter(zip(history, ids)), []
        for k in (0, 1):
            own, s = int(k == c), 0.0
            for v, w in zip(history, ids):
                p = (one[k][w] - own * u[w] + 1) / (total[k] - own * len(ids) + len(known) + 1)
                s -= math.log((two[k][v, w] - own * b[v, w] + weight * p) / (before[k][v] - own * h[v] + weight))
            loss.append(s / len(ids) if ids else None)
        out.append((d, len(ids), *loss))
    return out


def test_against_counting(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_CHARS", 2_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    for size in (16_384, 50):
        got = {r.doc_id: r for r in lm.score_documents(docs, labels, size).collect()}
        for d, n, target, background in brute([tuple(r) for r in docs.collect()], good, size, lm.M):
            r = got[d]
            assert r.n_tokens == n
            if n:
                assert math.isclose(r.loss_target, target, rel_tol=1e-9)
                assert math.isclose(r.score, target - background, rel_tol=1e-6, abs_tol=1e-9)


def test_edges(spark):
    rows = [(None, None, 1), (1, "", 1), (1, "a b", 1), (2, "a a C", 1), (2, "a a C", 1), (3, "long " * 40_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, good int")
    labels = spark.createDataFrame([(2, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id int, quality int, toxic int")
    got = sorted(map(tuple, lm.score_documents(docs, labels).collect()), key=repr)
    assert [r[1] for r in got] == [0, 2, 3, 3, 40_000, 0]
    assert all((r[2] is None) == (r[1] == 0) for r in got)
    assert lm.score_documents(docs, labels.limit(0)).count() == len(rows)
    assert lm.score_documents(docs.limit(0), labels).count() == 0


def test_the_vocabulary_grows_with_the_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_CHARS", 20_000)
    words = [f"w{i * 7919 % 20_000}" for i in range(20_000)] * 2
    rows = [(i, " ".join([*words[i * 500 : i * 500 + 500], f"once{i}"])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 80, 3)], "doc_id int, quality int")
    got = {r.doc_id: r for r in lm.score_documents(docs, labels).collect()}
    for d, n, target, background in brute(rows, set(range(0, 80, 3)), 20_000, lm.M):
        assert got[d].n_tokens == n == 501
        assert math.isclose(got[d].loss_target, target, rel_tol=1e-9)
        assert math.isclose(got[d].loss_background, background, rel_tol=1e-9)


def test_texts_stay_where_they_are(spark, monkeypatch):
    plans, cut = [], lm.cut
    monkeypatch.setattr(
        lm, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1]
    )
    docs = spark.createDataFrame([(i, f"a{i % 3} b") for i in range(30)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id int, quality int")
    assert lm.score_documents(docs, labels).count() == 30
    assert "Exchange" not in plans[0]  # the chunks
    assert all("text" not in p for p in plans[1:])
