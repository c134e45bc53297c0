"""Personal data: base spans against plain regular expressions, learnt spans, masking."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from gradeloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMA = "doc_id long, text string, text_key int, learnt int"


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_base_spans_of_random_texts(spark):
    rng = random.Random(3)
    bits = ["1", "23", "456", ".", "@", "a", "b-c", " ", "-", "+", "(", ")", "  ", "x.y", "4111 1111 1111 1111",
            "12.3.4.5", "é", "256", "+1 (234) 555-6789", "%", "\n", "4532015112830366", "🙂", "a@b.co"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 30))), 1, 1) for i in range(1_500)]
    rows += [(1, rows[1][1], 1, 1), (None, None, 1, 1), (9_000, "a" * 50_000 + "@" + "1 " * 30_000, 1, 1)]
    texts = {}
    for i, text, *_ in rows:
        texts.setdefault(i, text)
    got = pii.find_personal_data(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        counts = [want.count(f"{k}:") for k in PATTERNS]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.find_personal_data(empty).count() == 0 and pii.mask_personal_data(empty).count() == 0


def learnable():
    rows = [(i, f"some words here reach: +1 (23{i % 10}) 555-10{i:02d} and then the {i}", 1, 1) for i in range(20)]
    return rows + [(100, "say reach: 555 867 5309 then the 123 4567 end", 1, 1), (101, "the 7654321 is it", 1, 1),
                   (102, None, 1, 1)]


def test_a_trusted_context_finds_unseen_numbers(spark):
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(learnable(), SCHEMA)).collect()}
    assert got[100].spans == "phone:11:23" and got[100].n_phone == 0
    assert got[101].spans == "" and got[102].spans == ""
    assert got[3].spans == base(learnable()[3][1])


def test_masked_rows_keep_their_columns(spark):
    docs = spark.createDataFrame(learnable() + [(103, "x a@b.co, 10.0.0.1", 7, 8)], SCHEMA)
    got = {r.doc_id: r for r in pii.mask_personal_data(docs).collect()}
    assert got[100].text == "say reach: [PHONE] then the 123 4567 end"
    assert got[102].text is None and got[101].text == "the 7654321 is it"
    assert tuple(got[103]) == (103, "x [EMAIL], [IP]", 7, 8)


def test_a_pattern_without_enough_seeds_is_trusted_in_a_later_round(spark):
    seeds = [f"+1 (23{i % 10}) 555-{1000 + i}" for i in range(203)]
    numbers = [f"555 {i + 100} {i + 2000}" for i in range(40)]
    texts = [f"so reach: {s} then" for s in seeds[:200]] + [f"so reach: {n} then" for n in numbers]
    texts += [f"so Tel {n} then" for n in seeds[200:] + numbers] + ["so Tel 867 111 5309 then"]
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    assert got[len(texts) - 1] == "phone:7:19"


def test_touching_contexts_are_scored_by_their_own_occurrences(spark):
    texts = [f"so tel:+1 (234) 555-{1000 + i} then" for i in range(20)] + ["so tel:555 867 5309 then"]
    texts += [f"so # +1 (235) 555-{1000 + i} then" for i in range(5)] + [f"so #{1234567 + i} then" for i in range(50)]
    texts += [f"so phone= +1 (236) 555-{1000 + i} then" for i in range(20)] + ["so phone=555 867 5310 then"]
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    assert got[20] == "phone:7:19"
    assert all(got[i] == "" for i in range(26, 76)) and got[len(texts) - 1] == ""


def test_totals_cover_all_that_precedes(spark):
    rng = random.Random(5)
    bits = ["1", "23", ".", "@", "a", "b-c", " ", " ", "-", "+", "(", ")", "x.y", "4111 1111 1111 1111", "12.3.4.5",
            "é", "+1 (234) 555-6789", "%", "_", "\n", "a@b.co", "5558675309", "#", "y" * 90]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 30)))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.select("text", "doc_id").withColumnRenamed("doc_id", "text_key")
    found = pii._context_rows(texts.withColumn("_base", pii.base_spans(texts["text"])))
    most = found.groupBy("pattern", "rank").agg({"*": "count"}).collect()
    totals = {r.pattern: r.total for r in pii._occurrences(docs).collect()}
    assert len(most) > 100 and all(totals.get(p, 0) >= n for p, rank, n in most if rank is not None)
    assert all(p in totals for p, *_ in most)


def plain_before(text, start):
    head = text[:start]
    words = re.findall(r"[^\x20\x09-\x0D]+", head)
    if not words:
        return ""
    return words[-1][-pii.REACH:] + (" " if re.search(r"[\x20\x09-\x0D]\Z", head) else "")


def test_contexts_of_any_length(spark):
    rng = random.Random(5)
    texts = []
    for size in (0, 1, 79, 80, 81, 159, 160, 161, 3_999, 4_001, 9_000):
        word = "".join(rng.choice("abc-é") for _ in range(size))
        for gap in ("", " ", "\n" * 90, " " * 4_100, "\u0085"):
            texts += [f"{word}{gap}@", f"see {word}{gap}@", f" {word}{gap}@"]
    rows = [(t, len(t) - 1) for t in texts]
    got = spark.createDataFrame(rows, "t string, at int").select(
        "t", "at", pii._before(F.col("t"), F.col("at")).alias("p")).collect()
    for r in got:
        assert r.p == plain_before(r.t, r.at), (len(r.t), r.at)


def test_occurrences_of_long_words(spark):
    rng = random.Random(6)
    docs = [" ".join("".join(rng.choice("ab1-2.") for _ in range(n)) for n in (1, 2, 30, 999, 1_000, 1_001, 1_002, 2_500))]
    docs += ["id-7 id-8 id-7", "plain words", "", None]
    want = {}
    for text in docs:
        for word in (text or "").split():
            want[word[-pii.REACH:] + " "] = want.get(word[-pii.REACH:] + " ", 0) + 1
            for i in range(1, len(word)):
                if re.match(pii.PLACE, word[i - 1 : i + 1]):
                    want[word[:i][-pii.REACH:]] = want.get(word[:i][-pii.REACH:], 0) + 1
    got = pii._occurrences(spark.createDataFrame([(t,) for t in docs], "text string")).collect()
    assert {r.pattern: r.total for r in got} == want


def test_a_context_of_more_than_80_characters_is_learnt(spark):
    word = "Kontonummer" * 9
    rows = [(i, f"{word} +1 555 010 {1000 + i}", 1, 1) for i in range(30)] + [(99, f"{word} 0171 555 2233", 1, 1)]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[99] == f"phone:{len(word) + 1}:{len(rows[-1][1])}"
