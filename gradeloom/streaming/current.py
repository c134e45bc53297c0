"""Tables of the newest rows of each key, kept up to date batch by batch.

A batch leaves two folders: its rows, and the keys whose earlier rows they replace. A key may
come without rows; then it has none any more. Folders are never changed, only written whole,
so a batch that runs again after a failure replaces itself. Every ``COMPACT`` batches what
holds so far is written as a new base and what it stands for is deleted a generation later,
so a reader opens one base and a bounded number of batches, however many there were.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Batches between two bases.
COMPACT = 16


class _Folders:
    """The complete folders of a table: ``rows-N``, ``keys-N``, ``base-rows-N``, ``base-keys-N``."""

    def __init__(self, spark: SparkSession, target: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        top = self._path(target)
        self._fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        self._target = target
        self._found = [
            (m[1], int(m[2]), name) for name in names if (m := re.fullmatch(r"(\D+)-(\d+)", name))
        ]

    def numbers(self, kind: str) -> list[int]:
        """Numbers of the complete folders of a kind; keys are written after rows."""
        done = [n for k, n, name in self._found if k == kind
                and self._fs.exists(self._path(f"{self._target}/{name}/_SUCCESS"))]
        return sorted(done)

    def drop_before(self, number: int) -> None:
        """Batches up to ``number`` and the bases before it."""
        for kind, n, name in self._found:
            if n < number or (n == number and not kind.startswith("base")):
                self._fs.delete(self._path(f"{self._target}/{name}"), True)


def _name(target: str, kind: str, number: int) -> str:
    return f"{target}/{kind}-{number}"


def _parts(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame] | None:
    """Rows and keys that count, each with the batch it came in; null before the first batch."""
    folders = _Folders(spark, target)
    bases, batches = folders.numbers("base-keys"), folders.numbers("keys")
    base = bases[-1] if bases else -1

    def paths(kind: str) -> list[str]:
        first = [_name(target, f"base-{kind}", base)] if bases else []
        return first + [_name(target, kind, n) for n in batches if n > base]

    if not paths("keys"):
        return None
    return spark.read.parquet(*paths("rows")), spark.read.parquet(*paths("keys"))


def _newest(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = [c for c in keys.columns if c != "_batch"]
    newest = keys.groupBy(*names).agg(F.max("_batch").alias("_batch"))
    return rows.join(newest, [*names, "_batch"], "left_semi").select(*rows.columns), newest


def write_changes(
    rows: DataFrame, key: list[str], target: str, batch_id: int, keys: DataFrame | None = None,
    every: int = COMPACT,
) -> None:
    """The rows of one batch; they replace all earlier rows of ``keys`` (else of their own keys).

    Batches are numbered from 0 without gaps, as a stream numbers them.
    """
    spark = rows.sparkSession
    number = F.lit(batch_id).cast("long")
    path = _name(target, "rows", batch_id)
    rows.withColumn("_batch", number).write.mode("overwrite").parquet(path)
    own = spark.read.parquet(path) if keys is None else keys
    own.select(*key).distinct().withColumn("_batch", number).write.mode("overwrite").parquet(
        _name(target, "keys", batch_id)
    )
    if (batch_id + 1) % every == 0:
        compact(spark, target, batch_id)


def compact(spark: SparkSession, target: str, batch_id: int) -> None:
    """Write what holds after ``batch_id`` as a base; delete what the base before it replaced."""
    earlier = [n for n in _Folders(spark, target).numbers("base-keys") if n < batch_id]
    parts = _parts(spark, target)
    if parts is None or batch_id in _Folders(spark, target).numbers("base-keys"):
        return
    rows, keys = _newest(*parts)
    rows.write.mode("overwrite").parquet(_name(target, "base-rows", batch_id))
    keys.write.mode("overwrite").parquet(_name(target, "base-keys", batch_id))
    if earlier:
        _Folders(spark, target).drop_before(earlier[-1])


def read_current(spark: SparkSession, target: str) -> DataFrame:
    """The rows that hold now. A table without any batch is an error, as for any missing path."""
    parts = _parts(spark, target)
    if parts is None:
        raise FileNotFoundError(f"no complete batch in {target}")
    return _newest(*parts)[0].drop("_batch")
