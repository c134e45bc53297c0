"""What goes to Python workers at a time."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import bpe, langid, ngram_join, packed, token_files
from gradeloom.session import BATCH_BYTES

SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"


def tokens(docs, folder):
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def files(docs, folder):
    token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), f"{folder}/x")
    return token_files.read_token_files(docs.sparkSession, f"{folder}/x")


OPERATORS = {
    "language": lambda docs, folder: langid.keep_identified(docs),
    "near_copies": lambda docs, folder: ngram_join.keep_one(docs),
    "tokens": tokens,
    "files": files,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_long_texts_go_to_python_in_small_batches(spark, tmp_path, name):
    docs = spark.range(60, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.repeat(F.concat(F.lit("word"), "id", F.lit(" ")), F.lit(25_000))).alias("text"),
        F.lit("en").alias("lang"),
    )

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["n"])

    spark.conf.unset(SIZE)
    try:
        assert OPERATORS[name](docs, tmp_path).count() == 60
        found = [r.n for r in docs.select("doc_id", "text").mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.unset(SIZE)
    assert sum(found) > 8_000_000
    assert max(found) < 2 * BATCH_BYTES


def test_workers_give_memory_back_at_the_end_of_a_task():
    def held():
        with open("/proc/self/smaps_rollup") as lines:
            return sum(int(line.split()[1]) for line in lines if line.startswith("Anonymous")) / 1024

    def run(batches):
        some = [bytearray(b"x" * 60_000) for _ in range(4_000)]
        keep = bytes(100)  # stands after the rest, so the heap cannot shrink by itself
        yield keep
        del some

    before = held()
    for _ in packed.releasing(run)([]):
        during = held()
    assert during - before > 150
    assert held() - before < 60


def test_codes_in_several_slabs_come_back(monkeypatch):
    monkeypatch.setattr(packed, "SLAB", 7)
    for codes in (np.zeros(0, dtype=np.int64), np.random.default_rng(1).integers(0, 1 << 24, 100), np.arange(50, dtype="u2")):
        assert packed.codes_of(*packed.code_streams(codes)).tolist() == codes.tolist()
