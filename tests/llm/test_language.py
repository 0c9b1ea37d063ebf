import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.llm import language

EN, ES, DE = "The water board should examine the price of clean water during the recess.", "La comisión debe examinar el precio del agua limpia por tercera vez.", "Der Ausschuss verwirft erneut den Preis für sauberes Wasser mit großer Sorgfalt."


@pytest.fixture(scope="module")
def samples(spark, small):
    return spark.read.parquet(f"{small}/lang_samples.parquet")


def test_held_out_accuracy_and_sparsity(samples):
    rows = [(r["text"], r["lang"]) for r in samples.orderBy("sample_id").collect()]
    model = language.fitted(samples)
    assert model.held_out_accuracy >= 0.95 and (model.weights != 0).mean() < 0.3
    half = language.train(rows[::2])
    _, _, _, sums = language._judged(half, [t for t, _ in rows[1::2]])
    right = np.mean([half.langs[i] == l for i, (_, l) in zip(half.probabilities(sums).argmax(1), rows[1::2])]) if len(sums) == len(rows[1::2]) else 1
    assert right >= 0.9


def test_documents(spark, samples):
    docs = [(1, EN, "eng"), (2, EN, "de"), (3, f"{EN} {ES}", "en"), (4, f'{EN} "{DE}" {EN}', "en"), (5, None, "en"), (6, "", None), (7, "123 456 …", "xx"), (8, "漢字かな नमस्ते", None),
            (9, EN.upper(), " EN "), (10, "Herkavell 12 " + EN + " The word Ausschuss is foreign to this house and its members.", "English"), (11, (EN + " ") * 400 + ES, None), (12, EN, "en"), (12, EN, "en"), (None, DE, "fr")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, lang string, doc int")
    got = {}
    for r in language.corrected_labels(df, samples).collect():
        got.setdefault(r["doc_id"], set()).add(r["lang"])
    assert got == {2: {"en"}, 3: {"en", "es"}, 4: {"en", "de"}, 11: {"en", "es"}, None: {"de"}}
    segments = [(r["segment"], r["lang"]) for r in language.document_segments(df, samples).filter("doc_id = 4").orderBy("segment").collect()]
    assert segments == [(0, "en"), (1, "de"), (2, "en")]


def test_labels(spark):
    labels = ["en", "EN", " en ", "en-GB", "es_MX", "eng", "fre", "ger", "Deutsch", "Español", "und", "??", "", None, "n/a", "xx", "mul", "english (uk)"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(language.canonical(F.col("x"))).collect()]
    assert got == ["en", "en", "en", "en", "es", "en", "fr", "de", "de", "es"] + [None] * 8


def test_empty(spark, samples):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.corrected_labels(df, samples).count() == 0
    assert language.document_languages(spark.createDataFrame([(1, EN, None)], df.schema), samples.limit(0)).count() == 0
