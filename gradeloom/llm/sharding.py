"""Shards of near equal bytes by Karmarkar-Karp differencing.

Documents with equal texts form a group that stays together. Each group starts as a partial
partition with all its bytes in one of the slots. The two partial partitions with the
largest spread are put together, the largest slot of one on the smallest of the other, until
one is left. Differencing needs no order of the input beyond this, so it runs in two levels:
groups are dealt to buckets by hash, every bucket is differenced in its own task down to one
partial partition, and those (one short row for each bucket) are differenced once more.

A group of more bytes than a shard's fair part cannot be split: its shard then holds little
more than the group, and the other shards share the rest evenly.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..session import cut
from .common import row_key, sha

SHARDS = 8
#: Groups one task differences at a time, and the least number of buckets.
BUCKET_GROUPS = 50_000
LEAST_BUCKETS = 256


def differenced(parts: np.ndarray) -> np.ndarray:
    """The shard of every slot of every partial partition (``n`` rows of ``k`` sums).

    Ties go by position, so equal input gives equal output.
    """
    n, k = parts.shape
    shard = np.zeros((n, k), dtype=np.int32)
    if not n:
        return shard
    follows = np.full(n * k, -1, dtype=np.int64).tolist()
    heap = []
    for i, sums in enumerate(parts.tolist()):
        # A slot: its sum and the chain of original slots it holds, by first and last.
        slots = sorted(((s, i * k + j, i * k + j) for j, s in enumerate(sums)), key=lambda x: -x[0])
        heap.append((slots[-1][0] - slots[0][0], i, slots))
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        slots = []
        for x, y in zip(a, reversed(b)):
            follows[x[2]] = y[1]
            slots.append((x[0] + y[0], x[1], y[2]))
        slots.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (slots[-1][0] - slots[0][0], turn, slots))
        turn += 1
    flat = shard.reshape(-1)
    for number, (_, at, _) in enumerate(heap[0][2]):
        while at >= 0:
            flat[at] = number
            at = follows[at]
    return shard


def _bucket_slots(k: int):
    def run(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["bytes", "text_key"], ascending=[False, True], kind="stable")
        parts = np.zeros((len(groups), k), dtype=np.int64)
        parts[:, 0] = groups["bytes"]
        return groups.assign(part=differenced(parts)[:, 0])

    return run


def _bucket_shards(k: int):
    def run(sums: pd.DataFrame) -> pd.DataFrame:
        wide = sums.pivot(index="bucket", columns="part", values="bytes")
        wide = wide.reindex(columns=range(k)).fillna(0).astype("int64").sort_index()
        shard = differenced(wide.to_numpy())
        return pd.DataFrame({
            "bucket": np.repeat(wide.index.to_numpy(), k),
            "part": np.tile(np.arange(k, dtype=np.int32), len(wide)),
            "shard": shard.reshape(-1),
        })

    return run


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every document's shard and its place in it.

    ``docs`` needs ``doc_id, text``; other columns are ignored. Returns ``doc_id, size,
    text_crc32, law, shard, slot, grown_shard`` with one row per input row: ``size`` is the
    UTF-8 bytes of the text plus 1, ``law`` is ``bytes``, ``slot`` counts from 0 without gaps
    in each shard, ``grown_shard`` is null.

    A null text weighs 1 byte and belongs to the group of the empty texts. Repeated rows and
    equal texts go to one shard; ties go by hash, so reruns agree. Null ids are placed like
    others. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        sha("text").alias("text_key"),
    ))
    n = rows.count()
    buckets = max(LEAST_BUCKETS, n // BUCKET_GROUPS)
    groups = (
        rows.groupBy("text_key").agg(F.sum("size").alias("bytes"))
        .withColumn("bucket", F.pmod(F.xxhash64("text_key"), F.lit(buckets)).cast("int"))
    )
    slots = cut(groups.groupBy("bucket").applyInPandas(
        _bucket_slots(shards), "text_key string, bytes long, bucket int, part int"
    ))
    # One row for each bucket and part: bounded by the number of buckets, not by documents.
    sums = slots.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"))
    places = sums.groupBy().applyInPandas(
        _bucket_shards(shards), "bucket int, part int, shard int"
    )
    placed = lookup(slots, places, ["bucket", "part"], "text_key").select("text_key", "shard")
    cells = max(LEAST_BUCKETS, n // 100_000)
    rows = cut(
        rows.join(placed, "text_key")
        .withColumn("cell", F.pmod(row_key("doc_id", "text_key"), F.lit(cells)).cast("int"))
    )
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_key")
    return lookup(rows, starts, ["shard", "cell"], "text_key").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.row_number().over(inside) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
