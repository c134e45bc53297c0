"""From entry text to grade records, and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grades as G
from ..functions.text import clean_entry, single_line, spanish_key, strip
from ..session import cut
from .joins import lookup
from .ordered import block_of, with_row_number

# A line break inside an entry where no code/grade pair and no detached RA/EM suffix can
# reach across: the text before it ends in ``- <token without _>`` (the look behind comes
# after the break, so it is tried at breaks only). A pair holds one dash
# with nothing but the grade after it, and a code needs its ``_`` next to its first token.
_BOUNDARY = r"(?U)\n(?<=-\s{0,8}[^\s_-]{1,8}\n)(?!(?:RA|EM)(?:\s|\(|$))"


def entry_pieces(fragments: DataFrame, block: int | None = None) -> DataFrame:
    """Entry text per student and column, cut at boundaries that no grade spans.

    Taken together the pieces of a student hold the same grades as the whole text. They
    keep a student with very many rows from becoming one text in one task: rows are joined
    per block, each block is cut, and only the first and last piece of a block are joined
    with those of its neighbours.
    """
    keys = ["file_id", "student", "col_no"]
    blocks = (
        fragments.withColumn("_block", block_of("row_idx", block))
        .groupBy(*keys, "_block")
        .agg(
            F.min("first_row").alias("first_row"),
            F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY row_idx)").alias("_text"),
        )
    )
    # Read twice, for the edges and for what lies between them.
    split = cut(blocks.withColumn("_pieces", F.split("_text", _BOUNDARY)).drop("_text"))
    pieces = split.select(
        *keys, "first_row", "_block",
        F.size("_pieces").alias("_n"),
        F.posexplode("_pieces").alias("_i", "entry"),
    ).withColumn("part", F.struct(F.col("_block").alias("block"), F.col("_i").alias("piece")))
    is_edge = (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1)

    # Edges: the last piece of a block continues in the first piece of the next one.
    along = Window.partitionBy(*keys).orderBy("part")
    edges = pieces.filter(is_edge).withColumn(
        "_chain",
        F.sum(F.when(F.col("_i") > 0, 1).otherwise(0)).over(along),
    )
    joined = edges.groupBy(*keys, "_chain").agg(
        F.min("first_row").alias("first_row"),
        F.min("part").alias("part"),
        F.expr("array_join(transform(array_sort(collect_list(struct(part, entry))), x -> x.entry), '\\n')").alias("entry"),
    )
    columns = [*keys, "first_row", "part", "entry"]
    return pieces.filter(~is_edge).select(*columns).unionByName(joined.select(*columns))


def _pairs(entry: Column, kind: str, number: int) -> Column:
    """Matches of one kind. A match reads ``code (n) - grade`` with one bracket and one dash."""
    found = F.transform(
        F.regexp_extract_all(entry, F.lit(G.PATTERNS[kind]), F.lit(0)),
        lambda match: F.struct(
            F.lit(kind).alias("kind"), F.lit(number).alias("kind_no"),
            G.clean_code(F.substring_index(match, "(", 1)).alias("code"),
            strip(F.substring_index(match, "-", -1)).alias("raw"),
        ),
    )
    if kind == "MP":
        return found
    # RA and EM codes end in these letters, so most text needs one of the two patterns.
    nothing = F.array().cast("array<struct<kind:string,kind_no:int,code:string,raw:string>>")
    return F.when(F.contains(F.upper(entry), F.lit(kind)), found).otherwise(nothing)


def extract_records(entries: DataFrame, ids: list[str], entry: str = "entry") -> DataFrame:
    """All code/grade pairs of each entry: RA, then EM, then MP.

    ``entries`` may carry ``col_no``, ``first_row`` and ``part``, which order the result.
    A code without a grade gives an empty text grade. ``capital_em`` tells whether the
    entry's text holds a capital ``EM``, which :func:`placement_modules` asks for.
    """
    found = F.concat(*[_pairs(F.col("_entry"), k, n) for n, k in enumerate(G.PATTERNS)])
    have = set(entries.columns)

    def place(name: str, kind: str) -> Column:
        return (F.col(name) if name in have else F.lit(0)).cast(kind).alias(name)

    part = F.col("part") if "part" in have else F.struct(
        F.lit(0).cast("long").alias("block"), F.lit(0).alias("piece")
    ).alias("part")

    pairs = entries.withColumn("_entry", clean_entry(F.col(entry))).select(
        *ids,
        place("col_no", "int"), place("first_row", "long"), part,
        F.contains("_entry", F.lit("EM")).alias("capital_em"),
        F.posexplode(found).alias("nth", "_pair"),
    )
    return pairs.select(
        *ids,
        F.col("_pair.code").alias("code"),
        F.col("_pair.kind").alias("kind"),
        G.grade_num(F.col("_pair.raw")).alias("grade_num"),
        G.grade_text(F.col("_pair.raw")).alias("grade_text"),
        "capital_em",
        F.struct(
            F.col("_pair.kind_no").alias("kind_no"), "col_no", "first_row", "part", "nth"
        ).alias("pos"),
    )


def union_records(*kinds: DataFrame) -> DataFrame:
    """Union of record sets that each carry their ``kind``."""
    first, *rest = kinds
    for other in rest:
        first = first.unionByName(other)
    return first


def modules(records: DataFrame) -> DataFrame:
    """Distinct module codes per file, found through RA codes."""
    return (
        records.filter(F.col("kind") == "RA")
        .select("file_id", F.regexp_extract("code", r"^([A-Za-z0-9]+)_", 1).alias("mp"))
        .filter(F.col("mp") != "")
        .distinct()
    )


def modules_with_em(entries: DataFrame, modules: DataFrame) -> DataFrame:
    """Modules that have a company-placement entry, with or without a grade.

    ``entries`` holds ``(file_id, student, entry)`` pieces. Codes are matched in any case,
    but only in the text of a student that holds a capital ``EM`` somewhere.
    """
    keys = ["file_id", "student"] + (["col_no"] if "col_no" in entries.columns else [])
    text = entries.select(*keys, clean_entry(F.col("entry")).alias("text"))
    codes = text.select(
        *keys, F.explode(F.regexp_extract_all("text", F.lit(G.EM_CODE_PATTERN), F.lit(1))).alias("c")
    ).select(*keys, G.clean_code(F.col("c")).alias("code"))
    capital = codes.filter(F.contains("code", F.lit("EM")))
    gate = text.filter(F.contains("text", F.lit("EM"))).select(*keys).distinct()
    other = codes.filter(~F.contains("code", F.lit("EM"))).join(gate, keys, "left_semi")
    found = capital.unionByName(other).select("file_id", G.module_of(F.col("code")).alias("mp"))
    return found.distinct().join(modules, ["file_id", "mp"], "left_semi")


def placement_modules(records: DataFrame) -> DataFrame:
    """Type A modules, from records that are already extracted.

    A student's placement codes count only if the student's text holds a capital ``EM``.
    ``capital_em`` tells so where the records carry it; else the codes themselves do.
    """
    em = records.filter(F.col("kind") == "EM")
    keys = [c for c in ("file_id", "student") if c in records.columns]
    shown = F.contains("code", F.lit("EM"))
    if "capital_em" in records.columns:
        gate = records.filter(F.coalesce("capital_em", shown)).select(*keys).distinct()
    else:
        gate = em.filter(shown).select(*keys).distinct()
    placed = em.join(gate, keys, "left_semi").select("file_id", G.module_of(F.col("code")).alias("mp"))
    return placed.distinct().join(modules(records), ["file_id", "mp"], "left_semi")


def tidy_names(records: DataFrame) -> DataFrame:
    """Wrapped names become one trimmed line; names that differ only in that are merged."""
    return records.withColumn("student", single_line(F.col("student")))


def record_order() -> list[Column]:
    """Sort columns inside a file: Spanish name order, folded code, extraction order."""
    return [spanish_key(F.col("student")), F.lower("code"), F.col("pos")]


def student_order(records: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """``row_no`` of each student in its file: first appearance in the sorted records."""
    first = records.groupBy("file_id", "student", *(ids or [])).agg(
        F.min(F.struct(F.lower("code").alias("code"), "pos")).alias("_first")
    )
    return with_row_number(
        first, ["file_id"], [spanish_key(F.col("student")), F.col("_first")]
    ).drop("_first")


def split_duplicates(records: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key occurs once, and the keys that occur more than once with their count."""
    counts = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    repeated = counts.filter(F.col("copies") > 1)
    return records.join(repeated, keys, "left_anti"), repeated


def files_without_duplicates(records: DataFrame) -> DataFrame:
    """Records of the files in which every ``(student, code)`` is unique.

    The records are written once, since every step of a sheet reads them; only their keys
    are grouped, so that no row is sorted.
    """
    key = ["file_id", "student", "code"]
    written = cut(records.select(*key, *[c for c in records.columns if c not in key]))
    bad = split_duplicates(written.select(*key), key)[1].select("file_id").distinct()
    return lookup(written, bad, ["file_id"], "student", "left_anti")


def wide_grades(records: DataFrame, codes: list[str], ids: list[str]) -> DataFrame:
    """Student by code table of displayed grades; run :func:`split_duplicates` first.

    Every student has a row, also one without any of the ``codes``.
    """
    shown = records.select(
        *ids, "code", G.display(F.col("grade_num"), F.col("grade_text")).alias("_shown")
    )
    return shown.groupBy(*ids).pivot("code", codes).agg(F.first("_shown")).na.fill("", codes)
