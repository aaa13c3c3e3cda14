"""Batches of an encoder."""

from __future__ import annotations

import random

from hypothesis import given
from hypothesis import strategies as st

from korvane.functions.text import embed_text
from korvane.operators.filters import FilterSpec
from korvane.operators.models import HashingEncoder, encode, packed, padding
from korvane.operators.search import search
from korvane.plans.queries import gone, small_catalog
from korvane.sources import catalog as C


@given(st.lists(st.integers(0, 300), max_size=80), st.integers(1, 9), st.integers(1, 900))
def test_batches_hold_every_text_once_within_the_budget(lengths, most, budget):
    batches = packed(lengths, most, budget)
    assert sorted(i for b in batches for i in b) == list(range(len(lengths)))
    for b in batches:
        assert 0 < len(b) <= most and (len(b) == 1 or len(b) * max(lengths[i] for i in b) <= budget)


def test_vectors_come_back_in_order(spark):
    r, encoder = random.Random(3), HashingEncoder(32)
    texts = [None if i % 17 == 0 else "가나다 abc " * r.choice([0, 1, 2, 40, 400]) + str(i) for i in range(300)] + ["x" * 20_000]
    rows = encode(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), encoder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = texts[r["id"]]
        assert (r["vector"] is None) if want is None else r["vector"] == encoder.vectors([want])[0].astype("float32").tolist()


def test_short_texts_are_not_padded_to_long_ones(spark):
    lengths = [len(r["t"]) for r in C.generate(spark, 2000).select(embed_text().alias("t")).collect()]
    lengths = [n * 20 if i % 9 == 0 else n for i, n in enumerate(lengths)]  # some have long descriptions
    before = padding(lengths, [list(range(i, min(i + 32, 2000))) for i in range(0, 2000, 32)])
    after = padding(lengths, packed(lengths, 32))
    assert after < 0.05 * before


def test_vectors_of_an_encoder_are_not_sent_to_all_tasks(spark, sf):
    """Spark takes them for few bytes, however long they are; the driver would have to hold them."""
    p, e = small_catalog(spark, sf)
    size = e._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) < e.count() * 64 * 4 / 2  # what Spark believes
    for found in (search(p, e, [0.5] * 64, FilterSpec(), 10, gone()), p.withColumnRenamed("id", "product_id").join(e.drop("x"), "product_id")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan, plan
