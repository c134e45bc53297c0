"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a space, and runs of one to three
characters are hashed into ``2^15`` features. Document frequencies are counted over all
labelled training documents. The weights are learnt on a bounded sample of them with
follow-the-regularised-leader and elastic-net penalties: the L1 part leaves most weights at
zero. A part of the sample that the weights never saw sets the temperature that turns
scores into calibrated probabilities. Features are made in parallel, the sample's vectors
meet in one task, the model (bounded by features x languages) goes to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..session import small_batches
from .common import fresh
from .packed import expand, releasing, squeeze

FEATURES = 1 << 15
#: Different labelled texts per language in the sample, in all languages together, and per language at least.
SAMPLE, TOGETHER, LEAST_SAMPLE = 1_500, 60_000, 100
#: One sampled document in so many sets the temperature instead of the weights.
CALIBRATE = 5
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 0.05, 0.01, 0.001
#: Characters handled at a time.
SLICE = 4_000_000
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(text: str, letter: np.ndarray) -> np.ndarray | None:
    """How often each feature occurs; ``None`` for a text without letters."""
    total, tail, seen = np.zeros(FEATURES, dtype=np.int64), np.array([32], dtype=np.uint32), False
    for at in range(0, len(text), SLICE):
        raw = text[at : at + SLICE].lower().encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(raw, dtype="<u4")
        is_letter = letter[points]
        seen = seen or bool(is_letter.any())
        points = np.where(is_letter, points, 32).astype(np.uint32)
        if at + SLICE >= len(text):
            points = np.append(points, np.uint32(32))
        c = np.concatenate([tail, points])
        own = len(tail)
        mixed = c * np.uint32(0x9E3779B1)
        for order in (1, 2, 3):
            if len(c) < order:
                continue
            h = mixed[: len(c) - order + 1].copy()
            for j in range(1, order):
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * order) + mixed[j : len(c) - order + 1 + j]
            h ^= h >> np.uint32(16)
            h = (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 15)
            # Runs that lie in the kept tail were counted with the slice before.
            total += np.bincount(h[max(0, own - order + 1) :], minlength=FEATURES)
        tail = c[-2:]
    return total if seen else None


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    values = (1.0 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(values @ values)
    return at, values / norm if norm else values


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def learn_weights(examples: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal over sparse vectors with their labels."""
    # The last row is the bias: a feature that is always 1 and carries no penalty.
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))

    def weights(rows) -> np.ndarray:
        zr, nr = z[rows], n[rows]
        l1 = np.where(np.asarray(rows) == FEATURES, 0.0, L1)[:, None]
        shrunk = np.sign(zr) * np.maximum(np.abs(zr) - l1, 0.0)
        return -shrunk / ((BETA + np.sqrt(nr)) / ALPHA + L2)

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(examples)):
            at, values, label = examples[i]
            rows, x = np.append(at, FEATURES), np.append(values, 1.0)
            w = weights(rows)
            error = _softmax(x @ w)
            error[label] -= 1.0
            g = x[:, None] * error
            squared = n[rows] + g * g
            z[rows] += g - (np.sqrt(squared) - np.sqrt(n[rows])) / ALPHA * w
            n[rows] = squared
    w = weights(np.arange(FEATURES + 1))
    return w[:-1], w[-1]


def calibrated(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss on held-back examples, by a search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(scores / t)[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    grid = np.exp(np.linspace(np.log(0.05), np.log(5.0), 93))
    return float(min(grid, key=loss))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letter, total, docs = letters(), np.zeros(FEATURES, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            counts = gram_counts(text.as_py() or "", letter)
            if counts is not None:
                total += counts > 0
                docs += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, FEATURES), pa.int32()), pa.array(np.append(total[at], docs), pa.int64())],
        ["feature", "n"],
    )


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letter = letters()
    for batch in batches:
        out = []
        for text in batch.column(0):
            counts = gram_counts(text.as_py() or "", letter)
            at = np.flatnonzero(counts) if counts is not None else np.zeros(0, dtype=np.int64)
            out.append(squeeze(at.astype("<u2"), counts[at].astype("<u4")) if len(at) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["lang", "drawn", "counts"]
        )


def train(labelled: DataFrame, sample: int = SAMPLE, together: int = TOGETHER) -> Model | None:
    """Learn from ``text, lang`` of ``labelled``; rows with null in either take no part.

    ``sample`` bounds the different texts per language that the weights are learnt from (drawn
    by a hash, so copies of one text count once), ``together`` those of all languages as long
    as each keeps ``LEAST_SAMPLE``. Every label is a language; the model has a column for each.
    Document frequencies cover all rows. ``None`` if there is nothing to learn from.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.select(F.col("text").cast("string").alias("text"), "lang").filter("text is not null and lang is not null")
    # One row for each language, as the model has.
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).collect()
    if not sizes:
        return None
    names = sorted(r["lang"] for r in sizes)
    sample = min(sample, max(LEAST_SAMPLE, together // len(names)))
    found = (
        rows.select("text").mapInArrow(releasing(_document_frequencies), "feature int, n long")
        .groupBy("feature").agg(F.sum("n").alias("n")).collect()  # at most FEATURES + 1 rows
    )
    df = np.zeros(FEATURES + 1)
    for r in found:
        df[r["feature"]] = r["n"]
    idf = np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1.0

    space = 1 << 30
    share = {r["lang"]: min(space, int(space * sample / r["n"])) for r in sizes}
    limit = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    drawn = rows.withColumn("drawn", F.pmod(F.xxhash64("text"), F.lit(space))).filter(
        F.col("drawn") < F.coalesce(F.try_element_at(limit, F.col("lang")), F.lit(0))
    ).dropDuplicates(["lang", "drawn"])
    shared = spark.sparkContext.broadcast(idf)

    def fit(table: pa.Table) -> pa.Table:
        table = table.filter(pa.compute.is_valid(table.column("counts"))).sort_by([("drawn", "ascending"), ("lang", "ascending")])
        number = {name: i for i, name in enumerate(names)}
        taken = dict.fromkeys(names, 0)
        learnt, kept = [], []
        for lang, drawn, data in zip(*(table.column(c).to_pylist() for c in ("lang", "drawn", "counts"))):
            if taken[lang] >= 2 * sample:
                continue
            taken[lang] += 1
            at, counts = expand(data, "<u2", "<u4")
            full = np.zeros(FEATURES, dtype=np.int64)
            full[at] = counts
            (kept if drawn % CALIBRATE == 0 else learnt).append((*_vector(full, shared.value), number[lang]))
        weights, bias = learn_weights(learnt or kept, len(names))
        scores = np.array([x @ weights[at] + bias for at, x, _ in kept]).reshape(len(kept), len(names))
        heat = calibrated(scores, np.array([y for *_, y in kept], dtype=int))
        used = np.flatnonzero(weights.any(axis=1))
        data = squeeze(used.astype("<u4"), weights[used].astype("<f8"), bias.astype("<f8"), np.array([heat], dtype="<f8"))
        return pa.table({"model": pa.array([data], pa.binary())})

    model = (
        drawn.select("text", "lang", "drawn")
        .mapInArrow(releasing(_sample_counts), "lang string, drawn long, counts binary")
        .groupBy().applyInArrow(fit, "model binary").first()
    )
    if model is None:
        return None
    used, weights, bias, heat = expand(bytes(model["model"]), "<u4", "<f8", "<f8", "<f8")
    full = np.zeros((FEATURES, len(names)))
    full[used] = weights.reshape(len(used), len(names))
    return Model(names, idf, full, bias.copy(), float(heat[0]))


def with_language(docs: DataFrame, model: Model | None, lang: str, score: str) -> DataFrame:
    """All rows and columns of ``docs`` and the predicted language of ``text`` with its probability.

    A text that is null or has no letter gives ``und`` and 0, as does every text without a
    model. Only ``text`` is read; the two new names must be free.
    """
    # Plain values: a broadcast class would need this package on every executor.
    plain = model and (model.languages, model.idf, model.weights, model.bias, model.temperature)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(plain)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letters()
        names, idf, weights, bias, temperature = shared.value or ([], None, None, None, 1.0)
        for batch in batches:
            found, scores = [], []
            for text in batch.column(place):
                counts = gram_counts(text.as_py() or "", letter) if names else None
                if counts is None:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at, x = _vector(counts, idf)
                p = _softmax((x @ weights[at] + bias) / temperature)
                best = int(np.argmax(p))
                found.append(names[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, lang, score],
            )

    fields = [*docs.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())]
    return docs.mapInArrow(releasing(run), StructType(fields))


def held_out() -> Column:
    """Documents that are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document, learnt from the others' labels.

    ``docs`` needs ``doc_id, text, lang``; other columns are ignored, and a prediction reads
    nothing but the text. Null ids count as not held out. Repeated rows give repeated rows;
    equal texts equal predictions. An empty table gives an empty result, one without labels
    ``und`` throughout.
    """
    model = train(docs.filter(~held_out()), sample)
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return with_language(rows, model, "lang_pred", "score").drop("text")


def keep_identified(docs: DataFrame, least: float = 0.0, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose text has a language with at least that probability.

    Texts without letters go. All columns stay as they are. Without any label nothing is
    known of languages, and all texts with letters stay.
    """
    lang, score = fresh(docs, "_lang_pred", "_lang_score")
    model = train(docs.filter(~held_out()), sample)
    if model is None:
        return docs.filter(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    found = with_language(docs, model, lang, score)
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)
