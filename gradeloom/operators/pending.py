"""Outcomes each student still owes, as one text per student."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grades as G
from ..sources.catalog import with_module_label


def pending_outcomes(records: DataFrame) -> DataFrame:
    """Pending outcome codes, one row each: ``(file_id, student, code, mp, outcome)``.

    ``NA`` still counts as pending here; the sheet blanks it later. Records of one code
    are merged first, so a student has no more rows than there are codes.
    """
    owed = records.filter(
        F.endswith("code", F.lit("RA")) & G.is_pending(F.col("grade_num"), F.col("grade_text"))
    )
    return owed.select("file_id", "student", "code").distinct().select(
        "*", G.module_of(F.col("code")).alias("mp"), G.outcome_of(F.col("code")).alias("outcome")
    )


def pending_summary(records: DataFrame, order: DataFrame, names: DataFrame) -> DataFrame:
    """``(file_id, row_no, student, pending, notes)``; students without any stay, empty."""
    order_key = G.outcome_order(F.col("outcome"))
    blocks = pending_outcomes(records).groupBy("file_id", "student", "mp").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct(order_key.alias("k")))),
                lambda x: F.concat(F.lit("- "), G.outcome_label(x["k"]["label"])),
            ),
            "\n",
        ).alias("lines")
    )
    blocks = with_module_label(blocks, names)
    texts = blocks.groupBy("file_id", "student").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct(
                    "mp", F.concat("mp_label", F.lit(":\n"), "lines").alias("text")
                ))),
                lambda x: x["text"],
            ),
            "\n\n",
        ).alias("pending")
    )
    return order.join(texts, ["file_id", "student"], "left").select(
        "file_id", "row_no", "student",
        F.coalesce("pending", F.lit("")).alias("pending"),
        F.lit("").alias("notes"),
    )
