"""Token files against the tokenizers library, and codes against plain arrays."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gradeloom.llm import token_files as T
from gradeloom.llm.dac import TokenFile, best_widths, pack_file

MODEL = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start string, n_tokens int, ids string"
HARD = [
    None, "", " ", "\n", "a", "a ", " a", "a  b", "a   b", "a \n b", "a\n\n b", "it's we'll 'tis", "a  b", "a  b",
    "  x", "x​ y", "x\x1c y", "!\x1c z", "tab\t tab", "end \t", "<|endoftext|> x <|endoftext|>", "naïve café", "日本 語",
    "՘ ࢏1 ꟎", "🙂 🙂🙂", "a\x85 b", "a\r\n b\r\n", "x" * 5_000, "1 22 333 4,444.5", "﻿ b", "ab　 c 　d",
]


CODER = Tokenizer.from_file(MODEL)


def library(text, special_as_text=True):
    CODER.encode_special_tokens = special_as_text
    return CODER.encode(text or "", add_special_tokens=False).ids


def expected(rows, end=0):
    out, start = [], 0
    for doc_id, text, *_ in rows:
        ids = np.array(library(text) + ([] if end is None else [end]), dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def written(spark, rows, folder, end=0, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    T.write_token_files(df.repartition(3), MODEL, folder, end_id=end, **options)
    got = T.read_token_files(spark, folder).collect()
    return [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in sorted(got, key=lambda r: (r.start, r.doc_id or 0))]


def test_hard_texts_in_small_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SLICE_CHARS", 400)
    rng = random.Random(1)
    rows = [(i, t, "", 1, "") for i, t in enumerate(HARD)]
    chars = "ab c'1é.\n\t    "
    rows += [(100 + i, "".join(rng.choices(chars, k=rng.randint(0, 60))), "", 1, "") for i in range(300)]
    got = written(spark, rows, f"{tmp_path}/x", file_ids=500, shards=3)
    assert got == expected(rows)
    assert T.list_token_files(spark, f"{tmp_path}/x").count() > 8


def test_nulls_ties_and_repeats(spark, tmp_path):
    rows = [(None, "no id", "", 1, ""), (7, "b c d", "", 1, ""), (7, "another text", "", 1, "")]
    rows += [(3, "hot words here", "", 1, "")] * 500
    got = written(spark, rows, f"{tmp_path}/x", shards=4)
    assert [r[0] for r in got] == [None] + [3] * 500 + [7] * 2
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in expected(rows))
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got[:-1]]).tolist()


def test_no_rows_and_no_end(spark, tmp_path):
    assert written(spark, [], f"{tmp_path}/x") == []
    assert T.tokens_at(spark, f"{tmp_path}/x", spark.createDataFrame([(0,)], "place long")).collect() == [(0, None)]
    rows = [(1, "", "", 1, ""), (2, "two", "", 1, ""), (3, None, "", 1, "")]
    assert written(spark, rows, f"{tmp_path}/y", end=None) == expected(rows, None)


def test_any_token_of_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SLICE_CHARS", 400)
    rows = [(i, f"document {i} " + "word " * (i % 7), "", 1, "") for i in range(200)]
    written(spark, rows, f"{tmp_path}/x", file_ids=300, shards=2)
    flat = [t for r in rows for t in [*library(r[1]), 0]]
    places = [-1, 0, 1, len(flat) - 1, len(flat), *random.Random(2).sample(range(len(flat)), 150)]
    asked = spark.createDataFrame([(p,) for p in places * 2], "place long")
    got = {r.place: r.token for r in T.tokens_at(spark, f"{tmp_path}/x", asked).collect()}
    assert got == {p: flat[p] if 0 <= p < len(flat) else None for p in places}


@pytest.mark.parametrize("special_as_text", [True, False])
def test_units_give_the_ids_of_the_text(special_as_text):
    with open(MODEL, encoding="utf-8") as lines:
        coder = T.Coder(lines.read(), special_as_text)
    texts = [t or "" for t in HARD] + ["plain words, and plain again"] * 3
    for some in (texts, texts[-3:], [t for t in texts if "  " in t]):
        ids, counts = T._encode(coder, pa.array(some))
        ends = np.cumsum(counts)
        for text, a, b in zip(some, ends - counts, ends):
            assert ids[a:b].tolist() == library(text, special_as_text), text


def test_units_meet_the_library_without_separators_and_frequent_ones_stay(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 100)
    with open(MODEL, encoding="utf-8") as lines:
        coder = T.Coder(lines.read(), True)
    given, encode = [], coder._ids

    def counted(texts):
        found = encode(texts)
        given.extend(i for ids in found for i in ids)
        return found

    coder._ids = counted
    often, wanted = [f" often{i}.\nNext" for i in range(20)], 0
    for turn in range(6):
        units = [*often, *[f" rare{turn}x{i}don't" for i in range(60)]]
        flat, starts, sizes = coder.ids(units, np.array([3] * 20 + [1] * 60))
        for unit, start, size in zip(units, starts.tolist(), sizes.tolist()):
            assert flat[start : start + size].tolist() == library(unit), unit
        wanted += sum(len(library(u)) for u in (units if not turn else units[20:]))
    assert len(given) == wanted


ID_LISTS = st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=300), max_size=8)


@given(ID_LISTS, st.none() | st.lists(st.integers(1, 8), min_size=1, max_size=4))
@settings(deadline=None, max_examples=60)
def test_codes_are_directly_addressable(lists, widths):
    ids = np.array([i for part in lists for i in part], dtype="<u4")
    if widths and sum(widths) < 32:
        widths = [*widths, *[8] * 4]
    counts = np.array([len(part) for part in lists], dtype=np.int64)
    data = pack_file(ids, counts, pa.array([f"d{i}" for i in range(len(lists))], pa.string()), 3, 4, 5, widths)
    file = TokenFile(data + b"\n")
    assert (file.shard, file.piece, file.before, file.n_ids) == (3, 4, 5, len(ids))
    assert file.tokens(0, len(ids)).tolist() == ids.tolist()
    for place in range(0, len(ids), 7):
        assert file.token(place) == ids[place]
        assert file.tokens(place, place + 600).tolist() == ids[place : place + 600].tolist()
    for number, part in enumerate(lists):
        assert file.document(number).tolist() == part
    with pytest.raises(IndexError):
        file.token(len(ids))


def test_a_token_takes_few_bytes(tmp_path):
    rng = np.random.default_rng(4)
    ids = (rng.pareto(0.6, 200_000) * 5).clip(0, 50_256).astype("<u4")
    path = tmp_path / "ids"
    path.write_bytes(pack_file(ids, np.array([len(ids)]), pa.array([1])))
    with pa.OSFile(str(path)) as source:
        read = []

        class Counted:
            def read_at(self, size, offset):
                read.append(size)
                return source.read_at(size, offset)

        file = TokenFile(Counted())
        read.clear()
        assert [file.token(p) for p in range(0, 200_000, 9_999)] == ids[::9_999].tolist()
        assert sum(read) < 21 * 200
    assert path.stat().st_size < 2 * len(ids)


def test_widths_are_the_best():
    rng = np.random.default_rng(5)
    for high in (1, 2, 300, 5_000):
        ids = rng.integers(0, high, 500).astype("<u4")
        size = {}
        for widths in ([8, 8], [4, 4, 4, 4], [2, 6, 8], [5, 3, 8], best_widths(ids)):
            if sum(widths) >= int(ids.max()).bit_length():
                size[tuple(widths)] = len(pack_file(ids, np.array([500]), pa.array([1]), widths=widths))
        assert size[tuple(best_widths(ids))] <= min(size.values()) + 40
