import pytest
from tokenizers import Tokenizer

from plenum.llm import tokens

TEXTS = ["", None, "Hello  world's 123\n\n  end ", "naïve café ﬁ 漢字かな 🙂👩‍👩‍👧 नमस्ते مرحبا", "<|endoftext|> a b c\u0085d\x1c", "x" * 700, "ab" * 300, " " * 50 + "a", "é", "漢字" * 150, "....---\\n\t'S 'll", "​﻿", "a\r\nb"]


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@pytest.mark.parametrize("broadcast_bytes", [tokens.BROADCAST_BYTES, 0])
def test_ids_equal_the_library(spark, exact, broadcast_bytes):
    rows = [(i, t, "word", 1) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows + [rows[2], (None, "null id", "w", 1), (2, "other text", "w", 1)], "doc_id long, text string, word string, pos int")
    got = [(r["doc_id"], list(r["ids"])) for r in tokens.encode(df, broadcast_bytes=broadcast_bytes).collect()]
    want = [(i, exact(t)) for i, t in enumerate(TEXTS)] + [(None, exact("null id")), (2, exact("other text"))]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_round_trip_and_counts(spark, exact):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df).collect()} == {i: len(exact(t)) for i, t in enumerate(TEXTS)}


def test_empty_table(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents(spark, small, exact):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = tokens.encode(docs).collect()
    assert len(got) == len(text) and all(list(r["ids"]) == exact(text[r["doc_id"]]) for r in got)
