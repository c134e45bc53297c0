"""Phrases whose words meet more often than chance, per language.

Counting goes up word by word. A phrase can only be frequent if its first words and its last
words are, so phrases of n words are sought where two frequent phrases of n - 1 words overlap.
Frequent words and phrases are numbered; a phrase of n words is packed as the numbers of its
two parts (for two words, the word ids), counted in a task and sent as a counting quotient
filter (:mod:`quotient`), one page for each range of quotients. Where the pages of a range
meet, they merge as sorted lists; what comes back to a task is, in the order of its own page,
the new number of each frequent phrase. No vocabulary is gathered or broadcast, a task holds a
bounded chunk of text, and a page range grows with the share of the input it stands for.

Chunks are written before they are counted, so later steps see the same rows when tasks are
run again.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..session import cut
from .common import partitions
from .packed import CODE_TYPES, Numbered, code_streams, codes_of, expand, expand_words, squeeze, squeeze_words
from .quotient import merge, permute, restore, write_filter

#: Bytes of text that one chunk gathers; a longer text is a chunk of its own.
CHUNK_BYTES = 16_000_000
#: Bytes of a text that are split into words at a time.
SLICE_BYTES = 4_000_000
#: Least number of page ranges.
LEAST_BUCKETS = 64
#: First picks of each language are made in so many parts.
PARTS = 64

_BREAK = b"."
# Characters that end a piece, and those between words.
_ENDS, _GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _ENDS + _GAPS,
    b"abcdefghijklmnopqrstuvwxyz" + _BREAK * len(_ENDS) + b" " * len(_GAPS),
)
_ROW = "chunk long, bucket int, lang string, data binary"
_BACK = f"{_ROW}, number long, word string, n long, head long, tail long"
_BACK_TYPES = (
    pa.int64(), pa.int32(), pa.string(), pa.binary(),
    pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(),
)


def _table(names: str, types: tuple, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(types)
    return pa.table({
        n.split()[0]: pa.array(c, t) for n, c, t in zip(names.split(", "), columns, types)
    })


def split_words(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text, lower case, with a break where a piece ends; a slice at a time."""
    raw = raw.translate(_TABLE)
    at = 0
    while at < len(raw):
        end = at + SLICE_BYTES
        if end < len(raw):
            gap = raw.find(b" ", end)
            end = len(raw) if gap < 0 else gap
        yield raw[at:end].replace(_BREAK, b" . ").split()
        at = end


def _chunked(buckets: int):
    """Texts to chunks: per language the words by place, and pages of its words and counts."""

    def close(streams: dict, chunk: int) -> pa.RecordBatch:
        rows = []
        for lang, (numbers, codes) in streams.items():
            raw = np.frombuffer(codes, dtype="<u4")
            words = list(numbers)
            counts = np.bincount(raw, minlength=len(words))
            total = len(raw) - int(counts[0])
            counts[0] = len(raw) + 1  # the break comes first, then the frequent words
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(words), dtype=np.int64)
            place[order] = np.arange(len(words))
            # The empty word stands for all words of the language.
            words = [words[i] for i in order[1:].tolist()] + [b""]
            counts = np.append(counts[order[1:]], total)
            where = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            by_bucket = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[by_bucket])) + 1
            rows.append((chunk, -1, lang, squeeze(where.astype("<u4"), *code_streams(place[raw]))))
            for part in np.split(by_bucket, cuts):
                held = squeeze_words([words[i] for i in part.tolist()])
                n = squeeze(*code_streams(counts[part]))
                size = np.array([len(held)], dtype="<u4").tobytes()
                rows.append((chunk, int(where[part[0]]), lang, size + held + n))
        return _table(_ROW, _BACK_TYPES[:4], rows).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, streams, size = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if lang not in streams:
                    streams[lang] = (Numbered({_BREAK: 0}), array("I"))
                numbers, codes = streams[lang]
                for words in split_words(raw):
                    codes.extend(map(numbers.__getitem__, words))
                codes.append(0)
                size += len(raw)
                if size >= CHUNK_BYTES:
                    yield close(streams, chunk)
                    chunk, streams, size = chunk + 1, {}, 0
        if streams:
            yield close(streams, chunk)

    return run


def _numbers_back(known: np.ndarray, places: np.ndarray) -> bytes:
    """For a page: place of each entry among the frequent ones plus 1, 0 for the others."""
    return squeeze(*code_streams(known[places]))


def _merged_words(least: int, buckets: int):
    """The words of one bucket over all chunks: the frequent ones get numbers."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        words, counts, langs, sizes = [], [], [], []
        for lang, data in zip(table.column("lang"), table.column("data")):
            data = data.as_py()
            end = 4 + int.from_bytes(data[:4], "little")
            words.append(pa.array(expand_words(data[4:end]), pa.binary()))
            counts.append(codes_of(*expand(data[end:], *CODE_TYPES)))
            langs.append(pa.repeat(lang, len(words[-1])))
            sizes.append(len(words[-1]))
        all_words = pa.table({
            "lang": pa.concat_arrays(langs), "word": pa.concat_arrays(words), "n": np.concatenate(counts),
        })
        groups = all_words.group_by(["lang", "word"], use_threads=False).aggregate([("n", "sum")])
        frequent = groups.filter(pc.greater_equal(groups["n_sum"], least)).sort_by([("lang", "ascending"), ("word", "ascending")])
        rows = [
            (None, bucket, lang, None, place * buckets + bucket, word.decode("utf-8", "replace"), n, None, None)
            for place, (lang, word, n) in enumerate(zip(*(frequent[c].to_pylist() for c in ("lang", "word", "n_sum"))))
        ]
        spans: dict = {}
        for place, lang in enumerate(frequent["lang"].to_pylist()):
            spans.setdefault(lang, [place, place])[1] = place + 1
        for chunk, lang, own in zip(table.column("chunk").to_pylist(), table.column("lang").to_pylist(), words):
            a, b = spans.get(lang, (0, 0))
            found = pc.index_in(own, value_set=frequent["word"].combine_chunks().slice(a, b - a))
            number = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            rows.append((chunk, bucket, lang, squeeze(*code_streams(np.where(number < 0, 0, number + a + 1))), *[None] * 5))
        return _table(_BACK, _BACK_TYPES, rows)

    return run


def _paired(level: int, bits: int, buckets: int):
    """Of one chunk and language: where two frequent phrases overlap, and how often each pair does.

    ``level`` is the number of words of the phrases that are counted; ``bits`` hold the
    number of any part.
    """
    width, part = 2 * bits, buckets.bit_length() - 1

    def run(table: pa.Table) -> pa.Table:
        chunk, lang = table.column("chunk")[0].as_py(), table.column("lang")[0].as_py()
        pages = sorted(zip(table.column("bucket").to_pylist(), table.column("data").to_pylist()))
        if len(pages) < 2:
            return _table(_ROW, _BACK_TYPES[:4], [])
        numbers = []
        for bucket, data in pages[1:]:
            known = codes_of(*expand(data, *CODE_TYPES))
            numbers.append(np.where(known > 0, (known - 1) * buckets + bucket, -1))
        numbers = np.concatenate(numbers)
        if level == 2:
            where, *codes = expand(pages[0][1], "<u4", *CODE_TYPES)
            by_word = np.empty(len(where) + 1, dtype=np.int64)
            by_word[0] = -1  # the break
            by_word[1 + np.argsort(where, kind="stable")] = numbers
            found = by_word[codes_of(*codes)]
            places = np.flatnonzero(found >= 0)
            found = found[places]
        else:
            gaps, *codes = expand(pages[0][1], "<u4", *CODE_TYPES)
            found = numbers[codes_of(*codes)]
            frequent = found >= 0
            places, found = np.cumsum(gaps, dtype=np.int64)[frequent], found[frequent]
        pairs = np.flatnonzero(np.diff(places) == 1)
        if not len(pairs):
            return _table(_ROW, _BACK_TYPES[:4], [])
        found = found.astype(np.uint64)
        packed = found[pairs] << np.uint64(bits) | found[pairs + 1]
        keys, codes, counts = np.unique(permute(packed, width), return_inverse=True, return_counts=True)
        state = squeeze(np.diff(places[pairs], prepend=0).astype("<u4"), *code_streams(codes))
        rows = [(chunk, -1, lang, state)]
        where = (keys >> np.uint64(width - part)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(keys)]
        low = np.uint64((1 << (width - part)) - 1)
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows.append((chunk, int(where[a]), lang, write_filter(keys[a:b] & low, counts[a:b], width - part)))
        return _table(_ROW, _BACK_TYPES[:4], rows)

    return run


def _merged_phrases(least: int, bits: int, buckets: int, last: bool):
    """The filters of one range of quotients, merged; the frequent phrases get numbers."""
    width, part = 2 * bits, buckets.bit_length() - 1

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, totals, places = merge([d.as_py() for d in table.column("data")])
        frequent = totals >= least
        keys, totals = keys[frequent], totals[frequent]
        packed = restore(np.uint64(bucket << (width - part)) | keys, width)
        n = len(packed)
        out = pa.table({
            "chunk": pa.nulls(n, pa.int64()), "bucket": pa.array([bucket] * n, pa.int32()),
            "lang": pa.nulls(n, pa.string()), "data": pa.nulls(n, pa.binary()),
            "number": np.arange(n, dtype=np.int64) * buckets + bucket,
            "word": pa.nulls(n, pa.string()), "n": totals.astype(np.int64),
            "head": (packed >> np.uint64(bits)).astype(np.int64),
            "tail": (packed & np.uint64((1 << bits) - 1)).astype(np.int64),
        })
        if last:
            return out
        known = np.where(frequent, np.cumsum(frequent), 0)
        back = [
            (chunk, bucket, lang, squeeze(*code_streams(known[own])), *[None] * 5)
            for chunk, lang, own in zip(table.column("chunk").to_pylist(), table.column("lang").to_pylist(), places)
        ]
        return pa.concat_tables([out, _table(_BACK, _BACK_TYPES, back)])

    return run


def _per_bucket(pages: DataFrame, run, buckets: int) -> DataFrame:
    tasks = max(partitions(pages.sparkSession), buckets // 8)
    return cut(
        pages.filter("bucket >= 0").repartition(tasks, "bucket").groupBy("bucket").applyInArrow(run, _BACK)
    )


def frequent_phrases(docs: DataFrame, least: int = 100, words: int = 5, buckets: int | None = None) -> list[DataFrame]:
    """Exact counts of all phrases of 1, 2, ... ``words`` words that occur ``least`` times.

    One table per length: ``number, n`` and, for single words, ``lang, word`` (the empty word
    counts all words of the language); for longer phrases ``head`` and ``tail``, the numbers
    of the phrases without the last and without the first word.
    """
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.col("text").cast("string").alias("text"),
    )
    if not buckets:
        buckets = max(LEAST_BUCKETS, partitions(docs.sparkSession), rows.rdd.getNumPartitions())
    buckets = 1 << (buckets - 1).bit_length()
    pages = cut(rows.mapInArrow(_chunked(buckets), _ROW))
    merged = _per_bucket(pages, _merged_words(least, buckets), buckets)
    levels = []
    for level in range(2, words + 2):
        found = merged.filter("chunk is null")
        levels.append(found.select(*(["number", "lang", "word", "n"] if level == 2 else ["number", "head", "tail", "n"])))
        highest = found.agg(F.max("number")).first()[0]
        if level > words or highest is None:
            break
        bits = max(highest.bit_length(), buckets.bit_length())
        if 2 * bits > 64:
            raise OverflowError(f"{highest} numbers of phrases: a pair of them needs more than 64 bits")
        back = merged.filter("chunk is not null").select("chunk", "bucket", "lang", "data")
        states = pages.filter("bucket < 0")
        pages = cut(
            states.unionByName(back).groupBy("chunk", "lang").applyInArrow(_paired(level, bits, buckets), _ROW)
        )
        merged = _per_bucket(pages, _merged_phrases(least, bits, buckets, level == words), buckets)
    return levels


def scored_phrases(levels: list[DataFrame], ratio: int = 100) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the phrases that no longer one stands for.

    The lowest-scoring cut of a phrase counts. A phrase goes if ``100 * f >= ratio * a`` for
    the count ``f`` of a longer one that holds it; a phrase one word longer then does, too.
    """
    singles = levels[0].filter("word != ''")
    totals = levels[0].filter("word = ''").select("lang", F.col("n").alias("_n"))
    none = F.array().cast("array<bigint>")
    known = singles.select(
        "number", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n",
        none.alias("firsts"), none.alias("rests"),
    )
    phrases = []
    for level in levels[1:]:
        heads = known.select(
            F.col("number").alias("head"), "lang", F.col("phrase").alias("_phrase"),
            F.concat("firsts", F.array("n")).alias("firsts"),
        )
        tails = known.select(
            F.col("number").alias("tail"), "last", F.concat(F.array("n"), "rests").alias("rests")
        )
        known = cut(
            level.join(heads, "head").join(tails, "tail")
            .withColumn("phrase", F.concat_ws(" ", "_phrase", "last")).drop("_phrase")
        )
        phrases.append(known)
    kept = []
    for own, longer in zip(phrases, [*phrases[1:], None]):
        if longer is not None:
            ends = longer.select(F.explode(F.array("head", "tail")).alias("number"), F.col("n").alias("_f"))
            longest = ends.groupBy("number").agg(F.max("_f").alias("_f"))
            own = own.join(longest, "number", "left").filter(f"_f is null or 100 * _f < {ratio} * n")
        kept.append(own.select("lang", "phrase", F.col("n").alias("a"), "firsts", "rests"))
    if not kept:
        return singles.limit(0).selectExpr(
            "lang", "word as phrase", "n as a", "n as l", "n as r", "n", "n as score"
        )
    union = kept[0]
    for other in kept[1:]:
        union = union.unionByName(other)
    # All factors are decimals of 38 digits, so no product wraps.
    cuts = F.expr("""array_min(transform(arrays_zip(firsts, rests), (x, i) -> struct(
        (1000BD * cast(a as decimal(19,0)) * cast(_n as decimal(19,0)))
            div (cast(x.firsts as decimal(19,0)) * cast(x.rests as decimal(19,0))) as score,
        i as k, x.firsts as l, x.rests as r)))""")
    return lookup(union, totals, ["lang"], "phrase", written=True).withColumn("_cut", cuts).select(
        "lang", "phrase", "a", "_cut.l", "_cut.r", F.col("_n").alias("n"), "_cut.score"
    )


def mine_collocations(
    docs: DataFrame, least: int = 100, words: int = 5, top: int = 2000, ratio: int = 100,
    buckets: int | None = None,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    ``docs`` needs ``lang`` and ``text``; other columns, also of these results' names, are
    ignored. A-Z count as a-z; ``.,;:!?`` and line ends end a piece, spaces and tabs part
    words, and phrases of 2 to ``words`` words lie within a piece. Every occurrence counts,
    overlapping ones too. ``a`` is a phrase's count, ``l`` and ``r`` those of its parts at
    the cut with the least ``floor(1000 a n / (l r))``, ``n`` all words of the language.

    A null language is ``und``, a null text is empty, repeated rows count as often as they
    come, an empty table has no phrases. Equal scores are ordered by ``a``, then by phrase.
    Numbers of phrases may have 32 bits; more fails the job. A text must fit in a task.
    """
    scored = scored_phrases(frequent_phrases(docs, least, words, buckets), ratio)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each part of a language, then the first of those: a bounded number of rows.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = scored.withColumn("_part", part).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))
    ).filter(F.col("_rank") <= top)
    return first.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")
    ).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 100, words: int = 5, top: int = 2000, ratio: int = 100) -> str:
    """The same in SQL: all phrases of all pieces are made and counted."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents),
        lists AS (
            SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w != '') AS w FROM pieces),
        starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists WHERE len(w) > 0),
        grams AS (
            SELECT lang, len AS len, array_to_string(w[i : i + len - 1], ' ') AS phrase
            FROM starts, range(1, {words + 1}) AS t(len) WHERE i + len - 1 <= len(w)),
        f AS MATERIALIZED (SELECT lang, len, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {least}),
        totals AS (SELECT lang, sum(len(w)) AS n FROM lists GROUP BY lang),
        cand AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE len > 1),
        cuts AS (
            SELECT c.lang, c.phrase, c.len, c.a, k, x.a AS l, y.a AS r, t.n,
                   (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
            FROM (SELECT *, unnest(range(1, len)) AS k FROM cand) c
            JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 :], ' ')
            JOIN totals t ON t.lang = c.lang),
        held AS (
            SELECT DISTINCT lang, array_to_string(w[i : i + n - 1], ' ') AS phrase, n, a AS f FROM (
                SELECT lang, w, a, n, unnest(range(1, len - n + 2)) AS i
                FROM (SELECT *, unnest(range(2, len)) AS n FROM cand))),
        lowest AS (
            SELECT lang, phrase, any_value(a) AS a, any_value(n) AS n,
                   min(struct_pack(s := score, k := k, l := l, r := r)) AS best FROM cuts GROUP BY lang, phrase),
        kept AS (
            SELECT * FROM lowest o WHERE NOT EXISTS (
                SELECT 1 FROM held h WHERE h.lang = o.lang AND h.phrase = o.phrase AND 100 * h.f >= {ratio} * o.a))
        SELECT lang, rank, phrase, a, l, r, n, score FROM (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY best.s DESC, a DESC, phrase) AS rank,
                   phrase, a, best.l AS l, best.r AS r, CAST(n AS BIGINT) AS n, CAST(best.s AS BIGINT) AS score
            FROM kept) WHERE rank <= {top}"""


ORACLE = oracle()
