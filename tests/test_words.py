"""Words cut from whole columns: as the patterns find them, at any bounds of slices and parts."""

import random
import re

import pyarrow as pa
import pytest

from quarry.functions import text as T
from quarry.functions import words
from quarry.operators import synth


@pytest.mark.parametrize("seed", range(4))
def test_words_are_those_of_the_patterns(seed, monkeypatch):
    monkeypatch.setattr(words, "BYTES", 5)
    rng = random.Random(seed)
    for _ in range(300):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("ab1_.. .._-é\nİ") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(6))]
        cut = rng.randrange(len(texts) + 1)
        column, texts = pa.array(texts, pa.string()).slice(cut), texts[cut:]
        assert words.bm25(column).to_pylist() == [re.findall(T.BM25_TOKEN, x or "") for x in texts]
        of, made = words.trigrams(column)
        assert list(zip(of.tolist(), made.to_pylist(), strict=True)) == [(i, " ".join(w[j : j + 3])) for i, x in enumerate(texts) for w in [re.findall(T.TRIGRAM_TOKEN, x or "")] for j in range(len(w) - 2)]
        assert [x for p in words.parts(iter([pa.record_batch([column], names=["text"])]), 0) for x in p.column(0).to_pylist()] == texts


def test_trigrams_of_documents(spark, monkeypatch):
    """The two ways to meet questions agree, texts are counted once a part, no trigram is dealt out that no question has."""
    docs = spark.createDataFrame([(1, "One two three, one TWO three four"), (2, "one two three"), (3, None), (4, "red_1 blue green yellow"), (5, "")], "doc_id long, text string")
    assert {tuple(r) for r in synth.trigram_df(docs).collect()} == {("one two three", 2), ("two three one", 1), ("three one two", 1), ("two three four", 1), ("red_1 blue green", 1), ("blue green yellow", 1)}
    q = spark.createDataFrame([(7, "one two three", 1), (8, "red_1 blue green", 4), (9, "two three four", 2), (9, "two three four", 1), (10, None, 3)], "question_id long, question string, doc_id long")
    found = []
    for most in (synth.ASKED, 1):
        monkeypatch.setattr(synth, "ASKED", most)
        monkeypatch.setattr(synth, "RARE_AT_MOST", 1)
        found.append(sorted(map(tuple, synth.lexical_overlap(q, docs).collect())))
    assert found[0] == found[1] == [(7, 1, False), (8, 4, True), (9, 1, True), (9, 2, False), (10, 3, False)]
    monkeypatch.setattr(synth, "ASKED", 10)
    assert "Generate explode" not in synth.document_trigrams(docs, pa.array(["one two three"]))._jdf.queryExecution().toString()
