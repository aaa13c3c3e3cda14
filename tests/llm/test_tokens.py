"""Token counts and pieces against the library."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from korvane.llm import pieces, token_counts
from korvane.llm.common import table

ODD = [None, "", " ", "  two  blanks ", "▁", "a▁b ▁", "<s> </s> <unk> <0x41>", "naïve Ωμέγα 한국어 日本語", "\U0001f600\U0001f468‍\U0001f469", "tab\tline\nend\r\n", "\x00\x01", "é", "ｆｕｌｌ　ｗｉｄｔｈ", "x" * 5000, "ab " * 4000, " ﻿", "=" * 3000]


@pytest.fixture(scope="module")
def sp():
    return token_counts.processor(token_counts.MODEL)


def test_counts(spark, sf, sp):
    rng = random.Random(3)
    long = "".join(rng.choice(["word", "Wörter", "한국", " ", "  ", "\n", "aaaa", "1234", "▁", "\U0001f600"]) for _ in range(60_000))
    rows = [(i, t, 7, "n") for i, t in enumerate([*ODD, long, long])] + [(None, "null id", 7, "n"), (1, "again", 7, "n"), (1, "again", 7, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, over_limit string")
    got = sorted(map(tuple, token_counts.token_counts(df).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t, *_ in rows]
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(df.limit(0)).collect() == []
    docs = table(spark, sf, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs).collect()} == {i: len(sp.encode(t or "")) for i, t in texts.items()}


def test_the_whole_query_in_small_chunks(spark, sf, sp):
    docs = table(spark, sf, "documents")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, huge=300, chunk=200, overlap=16).collect()}
    assert got == {r["doc_id"]: len(sp.encode(r["text"] or "")) for r in docs.collect()}


def test_digest_has_the_pieces(spark, sf, sp):
    for r in pieces.op5_sentencepiece(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").collect():
        assert r["pieces"] == sp.encode(r["text"] or "") and r["n_tokens"] == len(r["pieces"])


@pytest.mark.parametrize("seed", range(6))
def test_chunks_are_spliced_exactly(sp, seed):
    rng = random.Random(seed)
    pools = [["a", "b", " "], ["the ", "cat", "▁", "é", "\U0001f600", "\n"], ["=", "==", " "], ["hello", " wor", "ld", "  "], ["한", "국", " ", "x"], ["9", "0", ".", ","]]
    text = "".join(rng.choice(pools[seed]) for _ in range(6000))
    assert token_counts.count(sp, text, huge=500, chunk=400, overlap=8) == len(sp.encode(text))


def test_pieces_are_the_librarys(spark, sf, sp):
    rows = [(i, t, ["clash"]) for i, t in enumerate(ODD)] + [(None, "null id", None), (1, "again", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pieces array<string>")
    coded = pieces.encode(df)
    for r in coded.collect():
        assert r["pieces"] == sp.encode(r["text"] or "")
    for r in pieces.decode(coded).collect():
        assert r["decoded"] == sp.decode(r["pieces"])
    assert pieces.encode(df.limit(0)).collect() == []
    for r in pieces.encode(table(spark, sf, "documents")).collect():
        assert r["pieces"] == sp.encode(r["text"] or "")
    assert pieces.digest(table(spark, sf, "documents")).where(~F.col("round_trip")).count() == 0


def test_unigram_viterbi():
    """On a small unigram vocabulary the shared-prefix pass equals a plain search over all segmentations."""
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "ab", "bc", "abc", "▁", "▁a", "▁ab", "ca", "cab"]
    m = object.__new__(pieces.Pieces)
    m.ids = {p: i for i, p in enumerate(vocabulary)}
    m.score = [-1.0 - rng.random() * len(p) for p in vocabulary]
    m.merging, m.pairs = False, {}
    m.lengths = {}
    for p in vocabulary:
        m.lengths.setdefault(p[-1], [])
        m.lengths[p[-1]] = sorted({*m.lengths[p[-1]], len(p)}, reverse=True)
    words = sorted({"▁" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(200)})

    def best(w):
        if not w:
            return 0.0
        return max((m.score[m.ids[p]] + best(w[len(p) :]) for p in vocabulary if w.startswith(p)), default=float("-inf"))

    import numpy as np

    for w, ids in m.encode_words(words):
        found = np.frombuffer(ids, np.int32)
        assert "".join(vocabulary[i] for i in found) == w
        assert sum(m.score[i] for i in found) == pytest.approx(best(w))
