"""Queries with prices of their own: they share a set, and find what the plain plan finds."""

from __future__ import annotations

from pyspark.sql import functions as F

from korvane.operators import index as I
from korvane.operators import search as S
from korvane.operators.models import HashingEncoder
from korvane.plans.queries import gone, small_catalog


def test_prices_make_no_sets():
    """A block is met once for each set, so sets must not be as many as the queries."""
    at = list(I.FILTER_TYPES)
    queries = [I.Query(i, [1.0, 0.0], tuple({"category": "a", "price_max": i}.get(c) for c in at)) for i in range(100)]
    sets = I.Scan(queries, 3).sets
    assert [len(s) for s in sets.values()] == [1]


def test_the_encoder_runs_in_more_than_one_task(spark, sf):
    """A small file is one task of a scan."""
    _, e = small_catalog(spark, sf)
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan


def test_prices_pair_by_pair(spark, sf):
    p, e = small_catalog(spark, sf)
    p = p.withColumns({"price": F.when(F.col("id") % 9 != 0, F.col("price")), "sale_price": F.when(F.col("id") % 4 == 0, F.col("sale_price"))}).cache()
    v = HashingEncoder(64).vectors(["봄 상의", "여름 신발", "x"]).tolist()
    rows = [(i, [*v, [0.0] * 64, None][i % 5], [None, "상의", "신발"][i % 3], 9_000.0 * i if i % 2 else None, 20_000.0 + 1_000 * i if i % 7 else None) for i in range(60)]
    q = spark.createDataFrame(rows, "qid long, q array<float>, category string, price_max double, price_min double")
    sort = lambda df: sorted(map(str, df.select("qid", "rank", "id", F.round("distance", 9)).collect()))
    want = sort(S.search_pairs(p, e.cache(), q, 4, gone()))
    assert want and sort(S.search_batch(p, e, q, 4, gone())) == want
