"""Byte-level BPE against the library, and back."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from gradeloom.llm import bpe, packed

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_round_trip_and_ids(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 3_000)
    coder = tiktoken.Encoding(
        "t", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={}
    )
    rng = random.Random(8)
    bits = ["the", " the", "'s", "\n\n", "  ", "é", "日本", "12345", "!!", "\t", "xyzzy", "<|endoftext|>", " ", "🙂"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 80))), 1) for i in range(120)]
    rows += [(1, rows[1][1], 1), (None, None, 1), (500, "", 1), (501, "a" * 20_000, 1), (502, "word " * 9_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int")
    got = sorted(map(tuple, bpe.round_trip(docs, PATH, PATTERN).collect()), key=repr)
    want = []
    for i, text, _ in rows:
        ids = coder.encode_ordinary(text or "")
        want.append((
            i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest(),
        ))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(docs.limit(0), PATH, PATTERN).count() == 0
    assert bpe.token_table(spark, PATH).count() == 50_256


def test_decoding_joins_the_token_table(spark):
    words = {i: w for w, i in bpe.read_ranks(PATH).items()}
    rng = random.Random(3)
    rows = [(i, [rng.randrange(50_256) for _ in range(rng.choice([0, 1, 7, 900]))], "x") for i in range(60)]
    rows += [(None, None, None), (61, [], "y"), (7, rows[7][1], "x"), (62, [5] * 45_000, None)]

    def table(rows):
        packed = [(i, None if t is None else np.array(t, dtype="<u4").tobytes(), p) for i, t, p in rows]
        return spark.createDataFrame(packed, "head long, ids binary, token string")

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = bpe.decode_documents(table(rows), PATH)
        assert out.columns == ["head", "ids", "token", "decoded"]
        got = sorted(((r[0], r[2], bytes(r[3])) for r in out.collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(i, p, b"".join(words[t] for t in ids or [])) for i, ids, p in rows]
    assert got == sorted(want, key=repr)
    assert bpe.decode_documents(table(rows).limit(0), PATH).count() == 0
    with pytest.raises(Exception, match="token table"):
        bpe.decode_documents(table([(1, [1, 60_000], "")]), PATH).collect()


def test_packed_codes_and_words():
    codes = np.array([0, 127, 128, 16_511, 16_512, 4_145_279, 4_145_280, 2**31, 5])
    streams = packed.expand(packed.squeeze(*packed.code_streams(codes)), *packed.CODE_TYPES)
    assert packed.codes_of(*streams).tolist() == codes.tolist()
    words = [b"", b"a", "é".encode(), b"a\nb"]
    assert packed.expand_words(packed.squeeze_words(words)) == words
    assert packed.runs(np.array([5, 0]), np.array([2, 3])).tolist() == [5, 6, 0, 1, 2]
