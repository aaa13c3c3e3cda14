"""Toxicity and quality: accuracy on rows held out, and defined cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from korvane.llm import quality, toxicity
from korvane.llm.common import table

ODD = [None, "", "12 34", "한국어 문장", "x" * 100_000, "word " * 20_000]
EDGE = "doc_id long, text string, score string, difference int"


def auc(scored):
    ordered = sorted(scored)
    ranks, n1 = 0.0, sum(y for _, y in scored)
    for i, (_, y) in enumerate(ordered):
        ranks += y * (i + 1)
    return (ranks - n1 * (n1 + 1) / 2) / (n1 * (len(scored) - n1))


@pytest.mark.parametrize(("query", "label", "least"), [(toxicity.op2_toxicity, "toxic", 0.94), (quality.op8_quality, "quality", 0.8)])
def test_held_out_rows(spark, query, label, least):
    sf = "/root/testdata/sf0.1"
    y = {r["doc_id"]: r[label] for r in table(spark, sf, "labels").collect()}
    rows = query(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    at = 0.3 if label == "toxic" else 0.7
    assert all(r["predicted"] == int(r["score"] >= at) for r in rows)
    held = [(r["score"], y[r["doc_id"]]) for r in rows if r["held_out"] and y.get(r["doc_id"]) is not None]
    assert len({k for _, k in held}) == 2 and auc(held) >= least


@pytest.mark.parametrize("module", [toxicity, quality])
def test_defined_cases(spark, module):
    label = "toxic" if module is toxicity else "quality"
    rows = [(i, t, "s", 1) for i, t in enumerate(ODD)] + [(None, "no id", "s", 1), (3, "again", "s", 1), (3, "again", "s", 1)]
    df = spark.createDataFrame(rows, EDGE)
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    one = spark.createDataFrame([(0, 1), (1, None), (None, 0)], f"doc_id long, {label} int")
    both = table(spark, "/root/testdata/sf0.01", "labels")
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    for labels in (none, one):
        model = module.train(df, labels)
        assert isinstance(model, float)
        assert module.score(df, model).count() == len(rows)
    model = module.train(docs, both)
    got = module.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not r["text"]}) == 1
    assert module.score(df.limit(0), model).collect() == []


def test_labels_of_held_out_rows_are_not_learned(spark):
    from pyspark.sql import functions as F

    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_fits_of_other_seeds_agree(spark):
    """Five orders of the texts and starts of the vectors: one accuracy, nearly the same documents, moderate weights."""
    sf = "/root/testdata/sf0.1"
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", "toxic").collect()
    bags = [(toxicity.bag(r["text"]), int(r["toxic"]), zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows]
    fitted = [(b, y) for b, y, held in bags if not held]
    fitted = [x for x in fitted if x[1]] + [x for x in fitted if not x[1]][:1500]
    areas, found = [], []
    for seed in range(5):
        odds, bias = toxicity.fit([b for b, _ in fitted], [y for _, y in fitted], 0.11, seed)
        scored = [(1 / (1 + np.exp(-bias - float(odds[b[0]] @ b[1]))), y) for b, y, held in bags if held]
        areas.append(auc(scored))
        found.append(sum(y for s, y in scored if s >= 0.3))
        assert np.abs(odds).max() < 1500
    assert min(areas) > 0.94 and max(areas) - min(areas) < 0.01 and max(found) - min(found) <= 0.1 * max(found)


def test_a_labelled_document_that_repeats_is_learned_once(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    one, many = toxicity.train(docs, labels), toxicity.train(docs.unionByName(docs.where("doc_id % 3 = 0")), labels)
    assert (one[0] == many[0]).all() and one[1] == many[1]


def test_unseen_misspellings_share_vectors():
    a, b, c = (set(toxicity.subwords(w)) for w in ("horrible", "horrrible", "teapot"))
    assert len(a & b) >= 6 and len(a & b) > len(a & c)


def test_vectors_of_all_seen_buckets_and_misspellings(spark):
    """Every observed bucket has a vector, and a misspelled toxic word that was never seen scores on its word's side."""
    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents").select("doc_id", "text")
    odds, _ = toxicity.train(docs, table(spark, sf, "labels"))
    assert (odds != 0).mean() > 0.9
    value = lambda w: float(odds[toxicity.subwords(w)].mean())
    for word, wrong in (("moron", "morron"), ("pathetic", "pathettic"), ("stupid", "stuppid")):
        assert value(word) > 0 and value(wrong) > 0.1 * value(word)
    assert abs(value("the")) < 0.1 * value("moron")


def test_scores_equal_a_plain_sum(spark):
    """A text's score is the softmax of its bag's mean vector."""
    rng = np.random.default_rng(3)
    odds = rng.normal(0, 5, toxicity.BUCKETS).astype(np.float32)
    texts = ["a plain text", "Another, with WORDS words", "", None, "1 2 3", "é한 mixed x" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(df, (odds, -0.5)).collect():
        ids, share = toxicity.bag(r["text"])
        assert abs(r["score"] - 1 / (1 + np.exp(0.5 - float((odds[ids].astype(float) * share).sum())))) < 1e-5
    got = {r["doc_id"] for r in toxicity.below(df, (odds, -0.5), 0.4).collect()}
    assert got == {r["doc_id"] for r in toxicity.score(df, (odds, -0.5)).collect() if r["score"] < 0.4}


def test_quality_scores_equal_plain_compression(spark):
    """The score is the curve at the difference of two plain compressed sizes."""
    import zstandard

    rng = np.random.default_rng(1)
    parts = lambda letters: [" ".join("".join(rng.choice(list(letters), 5)) for _ in range(40)).encode() for _ in range(60)]
    good, bad = (zstandard.train_dictionary(1024, parts(x)).as_bytes() for x in ("abcd", "wxyz"))
    texts = ["abcda bcdab dcbaa " * 9, "wxyzw xyzwx " * 9, "", None, "é", " ".join(x.decode() for x in parts("abyz"))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.score(df, (good, bad, 3.0, -0.2)).collect()}
    assert got[0] > got[2] == got[3] > got[1]

    def plain(text: bytes, dictionary: bytes) -> int:
        c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(text[i : i + quality.BLOCK])) for i in range(0, len(text), quality.BLOCK))

    for i, text in enumerate(texts):
        x = (text or "").encode()
        with_good, with_bad = plain(x, good), plain(x, bad)
        apart = (with_bad - with_good) / (with_bad + with_good) if x else 0.0
        assert abs(got[i] - 1 / (1 + np.exp(-(3.0 * apart - 0.2)))) < 1e-9


def test_labels_that_repeat_a_document(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    labels = table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "toxic", "quality")
    from pyspark.sql import functions as F

    other = labels.where("doc_id % 5 = 0").withColumn("toxic", 1 - F.col("toxic")).withColumn("quality", 1 - F.col("quality"))
    for module in (toxicity, quality):
        assert module.score(docs, module.train(docs, labels.unionByName(other))).where("score BETWEEN 0 AND 1").count() == docs.count()
