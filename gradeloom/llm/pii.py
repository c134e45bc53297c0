"""Personal data by bootstrapped contextual extraction (built-in functions only).

Base patterns find e-mail addresses, IP addresses, card and phone numbers; these spans are
seeds. The word before a seed is a lexical pattern, and so is the part of a word that touches
it; standing apart and touching are different patterns with occurrences of their own. Patterns and the identifier-like strings
they precede (seeds and unknown ones) form a graph that Spark scores in rounds:

* a pattern scores, for each kind, the share of *all its occurrences in the corpus* that
  precede an instance of the kind, weighted by the instances' scores, and only if it
  precedes enough different instances of some score;
* an unknown instance scores ``1 - product(1 - pattern score)`` over its confident patterns,
  which lets the next round trust further patterns that precede it.

Unknown strings after a confident pattern become spans of the pattern's kind. A frequent
ordinary word never gets confident, because most of its occurrences precede ordinary words.
All of the graph is grouped by (pattern, instance) before anything is joined, so a frequent
word is a row for each different string that follows it, not for each occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..session import cut
from .common import GAP, sha

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Runs start where no character of the same class stands
# before, or where the last match ended, and are possessive: same matches in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without this character or pattern hold no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

# Unknown identifier-like strings: written-out or unfinished addresses, and digit groups.
UNKNOWN_AT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9.-]*[A-Za-z0-9]"
UNKNOWN_DIGITS = r"(?<![0-9A-Za-z])[(]?[0-9]++(?:[().\x20-]{1,2}+[0-9]++)*+(?![0-9A-Za-z])"

#: A pattern is confident from this score on, with so many different instances, after so many rounds.
CONFIDENT, INSTANCES, ROUNDS = 0.8, 5, 3
#: A longer pattern is known by so many of its last characters.
REACH = 80
#: Characters before a span in which its pattern is looked for first; what is cut there is looked for
#: in the next stretch, at last in all of the text before.
STRETCHES = (2 * REACH, 50 * REACH)
#: Characters of a part of a word in which its beginnings are listed.
PART = 1_000
#: Places in a word where a span may start: no span starts between two letters or two digits,
#: or at a letter after a digit.
PLACE = r"(?s)^(?:[^A-Za-z0-9].|[A-Za-z][^A-Za-z]|[0-9][^A-Za-z0-9])"


def found(text: Column, pattern: str, needs: str | None = None, likely: Column | None = None) -> Column:
    """``array<struct<start, end, hit>>`` of all matches, in code points, end exclusive."""
    regexp = F.lit(pattern)
    hits, gaps = F.regexp_extract_all(text, regexp, F.lit(0)), F.split(text, pattern, -1)
    spans = F.transform(
        F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("len"), x["hit"].alias("hit")),
    )
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    along = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["len"]).alias("at"),
            F.array_append(acc["out"], F.struct(
                (acc["at"] + x["gap"]).alias("start"),
                (acc["at"] + x["gap"] + x["len"]).alias("end"),
                x["hit"].alias("hit"),
            )).alias("out"),
        ),
    )["out"]
    if likely is None:
        likely = text.contains(needs) if needs else text.rlike("[0-9]")
    return F.when(likely, along).otherwise(empty)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _is_card(hit: Column) -> Column:
    digits = _digits(hit)
    return (F.length(digits) >= 14) & (F.length(digits) <= 19) & F.call_function("luhn_check", digits)


def _is_ip(hit: Column) -> Column:
    parts = F.split(hit, r"\.")
    short = F.transform(parts, lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))


def _is_phone(hit: Column) -> Column:
    return F.length(_digits(hit)).between(10, 15)


CHECKS = {"email": lambda hit: F.lit(True), "ip": _is_ip, "card": _is_card, "phone": _is_phone}


def base_spans(text: Column) -> Column:
    """``array<struct<start, rank, end, hit>>`` of all base matches, by start, then kind."""
    def of_kind(rank: int, kind: str) -> Column:
        matches = found(text, BASE[kind], NEEDS[kind])
        return F.transform(
            F.filter(matches, lambda m: CHECKS[kind](m["hit"])),
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), m["hit"].alias("hit")
            ),
        )

    parts = [of_kind(rank, kind) for rank, kind in enumerate(KINDS)]
    return F.sort_array(F.concat(*parts))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    ), ",")


def _before(text: Column, start: Column) -> Column:
    """The word before a position and a space, or the part of a word that touches it: its last ``REACH`` characters."""
    def looked_for(head: Column) -> Column:
        word = F.regexp_extract(head, rf"([^\x20\x09-\x0D]{{1,{REACH}}})[\x20\x09-\x0D]*\z", 1)
        return F.when((word != "") & head.rlike(r"[\x20\x09-\x0D]\z"), F.concat(word, F.lit(" "))).otherwise(word)

    found = looked_for(F.substring(text, F.lit(1), start))
    for stretch in reversed(STRETCHES):
        head = F.substring(text, F.greatest(start - stretch, F.lit(0)) + 1, F.least(start, F.lit(stretch)))
        # Known whole if the text or a space begins it, or REACH characters of it are seen.
        whole = (start <= stretch) | head.rlike(
            rf"(?:[\x20\x09-\x0D][^\x20\x09-\x0D]+|[^\x20\x09-\x0D]{{{REACH}}})[\x20\x09-\x0D]*\z"
        )
        found = F.when(whole, looked_for(head)).otherwise(found)
    return found


def _occurrences(docs: DataFrame) -> DataFrame:
    """``pattern, total`` of every pattern as :func:`_before` makes them, wherever a span could follow.

    A word is an occurrence of itself standing apart, and of each of its beginnings that a
    span could touch. Long words are listed part by part, each with the characters before and
    the one after it that its beginnings need.
    """
    words = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), GAP)).alias("word"))
    words = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("word != ''")
    word = F.col("word")
    cut_up = F.when(F.length(word) <= PART, F.array(word)).otherwise(
        F.regexp_extract_all(word, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    )
    parts = words.select(
        "n", F.concat(F.right(word, F.lit(REACH)), F.lit(" ")).alias("apart"), word.rlike("[^A-Za-z]").alias("mixed"),
        cut_up.alias("parts"),
    ).select("n", "apart", "mixed", "parts", F.posexplode("parts").alias("at", "part")).select(
        "n", "at", "apart", "mixed",
        F.when(F.col("at") > 0, F.right(F.get("parts", F.col("at") - 1), F.lit(REACH))).otherwise("").alias("before"),
        "part",
        F.coalesce(F.substring(F.get("parts", F.col("at") + 1), 1, 1), F.lit("")).alias("after"),
    ).select(
        "n", "at", "apart", "mixed", F.length("before").alias("skip"), F.concat("before", "part", "after").alias("part")
    )
    part, none = F.col("part"), F.array().cast("array<string>")
    ends = F.sequence(F.col("skip") + 1, F.length(part) - 1)
    touching = F.transform(
        F.filter(ends, lambda i: F.substring(part, i, F.lit(2)).rlike(PLACE)),
        lambda i: F.substring(part, F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH))),
    )
    inner = F.when(F.col("mixed") & (F.length(part) > F.col("skip") + 1), touching).otherwise(none)
    apart = F.when(F.col("at") == 0, F.array("apart")).otherwise(none)
    return (
        parts.select("n", F.explode(F.concat(apart, inner)).alias("pattern"))
        .groupBy("pattern").agg(F.sum("n").alias("total"))
    )


def _unknown(text: Column, base: Column) -> Column:
    """Identifier-like strings that touch no base span, with the kinds their form allows."""
    digits = F.filter(found(text, UNKNOWN_DIGITS), lambda m: F.length(_digits(m["hit"])).between(7, 19))
    at = found(text, UNKNOWN_AT, likely=text.rlike(r"@|[\[(]at[\])]"))
    return F.filter(
        F.concat(digits, at),
        lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])),
    )


def _context_rows(texts: DataFrame) -> DataFrame:
    """One row for each seed and unknown string: its place, its pattern and whether it is a seed."""
    seeds = F.transform("_base", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["hit"].alias("hit")
    ))
    others = F.transform(_unknown(F.col("text"), F.col("_base")), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), F.lit(None).cast("int").alias("rank"), m["hit"].alias("hit")
    ))
    return (
        texts.select("text_key", "text", F.explode(F.concat(seeds, others)).alias("m"))
        .select(
            "text_key", "m.start", "m.end", "m.rank", "m.hit",
            _before(F.col("text"), F.col("m.start")).alias("pattern"),
        )
        .filter(F.col("pattern") != "")
    )


def _allowed(rank: Column, hit: Column) -> Column:
    """May a string of this form be of the kind?"""
    digits = F.length(_digits(hit))
    at = hit.rlike("@|[\\[(]at[\\])]")
    return (
        F.when(rank == 0, at)
        .when(rank == 1, ~at & hit.rlike(r"^[0-9]+(\.[0-9]+){3,7}$"))
        .when(rank == 2, ~at & digits.between(13, 19))
        .otherwise(~at & digits.between(7, 15))
    )


def confident_patterns(contexts: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``pattern, rank, score`` of the patterns that can be trusted, after all rounds.

    ``contexts`` as of :func:`_context_rows`; ``occurrences`` has ``pattern, total``.
    """
    edges = cut(
        contexts.groupBy("pattern", "hit", "rank").agg(F.count(F.lit(1)).alias("n"))
        .join(occurrences, "pattern")
    )
    known = edges.filter("rank is not null").select("hit", "rank").distinct().withColumn("score", F.lit(1.0))
    kinds = F.explode(F.array(*[F.lit(r) for r in range(len(KINDS))]))
    open_edges = edges.filter("rank is null").drop("rank").withColumn("rank", kinds).filter(
        _allowed(F.col("rank"), F.col("hit"))
    )
    every = cut(edges.filter("rank is not null").unionByName(open_edges))
    patterns = None
    for _ in range(ROUNDS):
        patterns = (
            every.join(known, ["hit", "rank"])
            .groupBy("pattern", "rank")
            .agg(
                (F.sum(F.col("n") * F.col("score")) / F.max("total")).alias("score"),
                F.count_distinct("hit").alias("instances"),
            )
            .filter((F.col("score") >= CONFIDENT) & (F.col("instances") >= INSTANCES))
            .select("pattern", "rank", F.least("score", F.lit(1.0)).alias("score"))
        )
        patterns = cut(patterns)
        learnt = (
            open_edges.select("pattern", "hit", "rank").join(patterns, ["pattern", "rank"])
            .groupBy("hit", "rank")
            .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("score"))
        )
        known = edges.filter("rank is not null").select("hit", "rank").distinct().withColumn(
            "score", F.lit(1.0)
        ).unionByName(learnt).groupBy("hit", "rank").agg(F.max("score").alias("score"))
    return patterns


def learnt_spans(docs: DataFrame) -> DataFrame:
    """``text_key, learnt``: the spans that confident patterns find in each text, if any."""
    texts = docs.select("text", sha("text").alias("text_key"))
    rows = cut(_context_rows(
        texts.filter(F.col("text").rlike(r"[0-9@]|[\[(]at[\])]")).withColumn("_base", base_spans(F.col("text")))
    ))
    # Seeds and unknown strings count alike, as a later round may have learnt any of them; a
    # pattern before fewer different strings than it needs instances is never trusted.
    kinds = rows.groupBy("pattern").agg(F.count_distinct("hit").alias("k"))
    wanted = kinds.filter(F.col("k") >= INSTANCES).select("pattern")
    occurrences = _occurrences(docs).join(wanted, "pattern", "left_semi")
    patterns = confident_patterns(rows, occurrences)
    best = F.max(F.struct("score", -F.col("rank")))
    return (
        rows.filter("rank is null").select("text_key", "start", "end", "hit", "pattern").distinct()
        .join(patterns, "pattern").filter(_allowed(F.col("rank"), F.col("hit")))
        .groupBy("text_key", "start", "end").agg(best.alias("b"))
        .select("text_key", F.struct(
            "start", (-F.col("b.col2")).cast("int").alias("rank"), "end"
        ).alias("span"))
        .groupBy("text_key").agg(F.sort_array(F.collect_set("span")).alias("learnt"))
    )


def _plain(base: Column) -> Column:
    return F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Personal data in every text.

    ``docs`` needs ``doc_id, text``; other columns are ignored. Returns ``doc_id, n_email,
    n_ip, n_card, n_phone, base_sha256, spans`` with one row per input row; the counts are of
    base matches, ``spans`` lists base and learnt ones.

    A null or empty text has no spans. Repeated rows and equal texts get equal spans. Spans
    of different kinds may overlap; a learnt one touches no base span. An empty table gives
    an empty result. Null ids stay null.
    """
    base = docs.select(
        "doc_id", sha("text").alias("text_key"),
        _plain(base_spans(F.coalesce("text", F.lit("")))).alias("base"),
    )
    every = F.sort_array(F.concat("base", F.coalesce("learnt", F.array().cast("array<struct<start:int,rank:int,end:int>>"))))
    def count(rank: int, kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}")

    counts = [count(rank, kind) for rank, kind in enumerate(KINDS)]
    # Copies of one text may be a third of all rows: see lookup.
    return lookup(base, learnt_spans(docs.select("text")), ["text_key"], "doc_id", "left").select(
        "doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(every).alias("spans"),
    )


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with each span of ``text`` replaced by ``[KIND]``.

    ``docs`` needs ``doc_id, text``. Overlapping spans are masked as one, named after the first. Null texts stay null.
    Columns other than ``text`` pass unchanged, whatever their names.
    """
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    rows = docs.select(F.struct("*").alias("row"), "text", sha("text").alias("text_key"), "doc_id")
    rows = lookup(rows, learnt_spans(docs.select("text")), ["text_key"], "doc_id", "left").withColumn(
        "spans", F.sort_array(F.concat(
            _plain(base_spans(F.coalesce("text", F.lit("")))), F.coalesce("learnt", none)
        ))
    )
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(
        F.col("spans"), start,
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]),
                     F.get(names, s["rank"])).alias("out"),
        )).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))),
    )
    text = F.when(F.size("spans") > 0, masked).otherwise(F.col("text"))
    return rows.select(F.col("row").withField("text", text).alias("row")).select("row.*")
