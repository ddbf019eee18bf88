import random

import pytest
import sentencepiece

from stagecast.llm.token_counts import PieceCounter, model_path, token_counts


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def test_matches_the_library_on_random_texts(library):
    counter, rng = PieceCounter.from_model(model_path()), random.Random(5)
    parts = ["a", " ", "  ", "\n", "▁", "é", "中", "<s>", "</s>", "<0x41>", "\x00", "\t", "the ", " of", "\U0001f600",
             "ﬁ", ".", "0", "ing", "e\u0301", "%%%"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        assert counter.count(text) == len(library.encode(text)), repr(text)


def test_whole_sequence_and_stretches_agree():
    counter = PieceCounter.from_model(model_path())
    text = "▁the▁whole▁of▁this▁text,▁with▁odd▁%%%▁words▁élan▁中文"
    assert counter.merged(text) == sum(map(counter.stretches, counter.cut.findall(text)))


def test_vocabulary_with_pieces_across_words():
    counter = PieceCounter({"a": 0.0, "b": -1.0, "▁": -2.0, "a▁": -3.0, "a▁b": -4.0, "▁a": -5.0})
    assert counter.count("a b") == 2          # the mark in front, then one piece


def test_documents_match_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in token_counts(docs).collect()}
    for r in docs.collect():
        n = len(library.encode(r["text"]))
        assert (got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["n_tokens"]) == (len(r["text"].encode()), n)
        assert got[r["doc_id"]]["over_limit"] == (n > 4096)


def test_edge_rows(spark, library):
    long = "abc " * 60000 + "x" * 50000
    rows = [(1, None, 7), (2, "", 7), (2, "", 7), (None, "a b", 7), (3, long, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts(df).collect()), key=lambda r: (r[0] is None, r))
    n = len(library.encode(long))
    assert got == [(1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (3, len(long), n, n > 4096),
                   (None, 3, 2, False)]
    assert token_counts(df.limit(0)).count() == 0
