"""Language identification: held-out accuracy, sparsity, calibration, edge cases."""

import zlib

import numpy as np

from gradeloom.llm import langid

SCHEMA = "doc_id long, text string, lang string, score int, _lang_pred int"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify_languages(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_weights_are_sparse_and_a_temperature_calibrates(monkeypatch):
    rng = np.random.default_rng(9)
    examples = []
    for i in range(200):
        at = np.unique(np.r_[rng.integers(0, 3_000, 30), 5_000 + i % 2])
        examples.append((at, np.full(len(at), 1 / np.sqrt(len(at))), i % 2))
    weights, bias = langid.learn_weights(examples, 2)
    assert weights[5_000, 0] > 0 > weights[5_000, 1]
    noise = (weights[:3_000] != 0).mean()
    monkeypatch.setattr(langid, "L1", 0.5)
    weights, bias = langid.learn_weights(examples, 2)
    assert weights[5_000, 0] > 0 > weights[5_000, 1] and (weights[:3_000] != 0).mean() < 0.3 * noise
    scores = np.array([[3.0, 0.0], [3.0, 0.0], [0.0, 3.0], [3.0, 0.0]])
    assert langid.calibrated(scores, np.array([0, 1, 1, 0])) > 1.5
    assert langid.calibrated(np.zeros((0, 2)), np.zeros(0, dtype=int)) == 1.0


def test_slices_of_a_long_text_count_alike(monkeypatch):
    letter = langid.letters()
    text = "Ein Satz, zwei Sätze; drei!" * 40
    whole = langid.gram_counts(text, letter)
    monkeypatch.setattr(langid, "SLICE", 37)
    assert (langid.gram_counts(text, letter) == whole).all()
    assert langid.gram_counts("12 !?", letter) is None and langid.gram_counts("", letter) is None


def test_rows_without_letters_labels_or_anything(spark):
    rows = [(i, "the house and the garden" if i % 2 else "das haus und der garten", "en" if i % 2 else "de", 1, 1)
            for i in range(40)]
    rows += [(100, None, "en", 1, 1), (101, "12 34", "de", 1, 1), (None, "the garden", None, 1, 1), (1, rows[1][1], "en", 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = langid.identify_languages(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[100].lang_pred == by_id[101].lang_pred == "und" and by_id[100].score == 0.0
    assert by_id[1].lang_pred == "en" and by_id[0].lang_pred == "de" and by_id[None].lang_pred == "en"
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2
    unlabelled = spark.createDataFrame([(1, "some text", None, 1, 1)], SCHEMA)
    assert langid.identify_languages(unlabelled).first().lang_pred == "und"
    assert langid.keep_identified(unlabelled).count() == 1
    assert langid.identify_languages(docs.limit(0)).count() == 0


def test_more_languages_than_a_small_sample_and_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(langid, "LEAST_SAMPLE", 4)
    letters = [chr(0x4E00 + 50 * k) for k in range(300)]
    rows = [(0, f"{c * 3} {c}{c} {chr(ord(c) + 1 + i)}", f"l{k:03}") for k, c in enumerate(letters) for i in range(5)]
    # A third of all rows are copies of one text; the other texts of its language still count.
    rows += [(0, "one hot text", "l000")] * 700
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), together=1_200)
    assert model.languages == [f"l{k:03}" for k in range(300)]
    asked = spark.createDataFrame([(c * 4, f"l{k:03}") for k, c in enumerate(letters)], "text string, lang string")
    got = langid.with_language(asked, model, "found", "p").collect()
    assert sum(r.lang == r.found for r in got) > 285
