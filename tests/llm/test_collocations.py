"""Phrase mining against a plain count of all phrases; filters against dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeloom.llm import collocations as C
from gradeloom.llm import quotient as Q

SCHEMA = "doc_id long, text string, lang string, rank int, phrase string, n int"


def brute(rows, least, words=5, top=2000, ratio=100):
    counts, total = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            found = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(found)
            for i in range(len(found)):
                for n in range(1, min(words, len(found) - i) + 1):
                    counts.setdefault(lang, Counter())[tuple(found[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        f = {p: n for p, n in f.items() if n >= least}
        held = set()
        for p, n in f.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    part = p[i : i + size]
                    if 100 * n >= ratio * f[part]:
                        held.add(part)
        rows = []
        for p, a in f.items():
            if len(p) > 1 and p not in held:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                phrase = " ".join(p)
                rows.append((-score, -a, phrase.encode(), phrase, f[p[:k]], f[p[k:]]))
        for rank, (s, a, _, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase, -a, left, right, total[lang], -s))
    return sorted(out)


def texts(seed, n, words=12):
    rng = random.Random(seed)
    vocabulary = ["Tea", "tea", "straße", "É", "a-b", "x\x00y", "новый", "of", "the"] + [f"w{i}" for i in range(words)]
    fixed = ["in the middle of nowhere", "by and large", "the the the the the the"]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 40)):
            parts.append(rng.choice(fixed) if rng.random() < 0.2 else rng.choice(vocabulary))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!? ", "\x0b"]))
        out.append((i, "".join(parts), rng.choice(["en", "en", "en", "de", None, "und"]), 1, "p", 2))
    return out


@pytest.mark.parametrize("least, top, ratio", [(3, 2000, 100), (12, 7, 100), (4, 2000, 60)])
def test_random_texts(spark, monkeypatch, least, top, ratio):
    monkeypatch.setattr(C, "CHUNK_BYTES", 3_000)
    monkeypatch.setattr(C, "SLICE_BYTES", 50)
    rows = texts(least, 200)
    rows += [(900, None, "en", 1, "", 0), (901, "", "fr", 1, "", 0), (902, " .!\t", None, 1, "", 0)] + [rows[3]] * 9
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = C.mine_collocations(df, least=least, top=top, ratio=ratio, buckets=4)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, least, top=top, ratio=ratio)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 14


def test_a_hot_phrase_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE_BYTES", 10_000)
    rows = [(0, "red tape " * 60_000, "en", 1, "", 0), (1, "red tape. " * 500, "en", 1, "", 0), (2, "red herring " * 99, "de", 1, "", 0)]
    got = C.mine_collocations(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == brute(rows, 100)


def test_nothing_frequent_and_no_rows(spark):
    df = spark.createDataFrame([(1, "just a few words", "en", 1, "", 0)], SCHEMA)
    for some in (df, df.limit(0)):
        got = C.mine_collocations(some)
        assert got.collect() == [] and got.columns[0] == "lang"
    # Frequent words, but no frequent pair.
    df = spark.createDataFrame([(i, "one. two.", "en", 1, "", 0) for i in range(9)], SCHEMA)
    assert C.mine_collocations(df, least=5).collect() == []


def test_products_beyond_64_bits(spark):
    level1 = spark.createDataFrame(
        [(0, "en", "", 4 * 10**15), (1, "en", "big", 3 * 10**15), (2, "en", "deal", 10**15)],
        "number long, lang string, word string, n long",
    )
    level2 = spark.createDataFrame([(0, 1, 2, 10**15 - 1)], "number long, head long, tail long, n long")
    (row,) = C.scored_phrases([level1, level2]).collect()
    assert row.score == 1000 * (10**15 - 1) * 4 * 10**15 // (3 * 10**15 * 10**15)


@given(st.integers(1, 64), st.lists(st.integers(0, 2**64 - 1), max_size=50))
@settings(deadline=None)
def test_the_mix_is_undone(bits, numbers):
    keys = np.array([n % (1 << bits) for n in numbers], dtype=np.uint64)
    mixed = Q.permute(keys, bits)
    assert Q.restore(mixed, bits).tolist() == keys.tolist()
    assert all(n < 1 << bits for n in mixed.tolist())
    assert len(set(mixed.tolist())) == len(set(keys.tolist()))


@given(st.integers(0, 64), st.lists(st.dictionaries(st.integers(0, 2**64 - 1), st.integers(1, 2**31), max_size=60), min_size=1, max_size=4))
@settings(deadline=None)
def test_filters_lose_nothing(bits, parts):
    shards, total = [], Counter()
    for part in parts:
        own = {}
        for key, n in part.items():
            own[key % (1 << bits)] = n
        keys = sorted(own)
        shards.append((keys, Q.write_filter(np.array(keys, dtype=np.uint64), np.array([own[k] for k in keys], dtype=np.int64), bits)))
        total.update(own)
        back, counts = Q.read_filter(shards[-1][1])
        assert back.tolist() == keys and counts.tolist() == [own[k] for k in keys]
    keys, counts, places = Q.merge([f for _, f in shards])
    assert dict(zip(keys.tolist(), counts.tolist())) == total and keys.tolist() == sorted(total)
    for (own, _), place in zip(shards, places):
        assert keys[place].tolist() == own
