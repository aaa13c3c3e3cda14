"""The stored index against the plain search, row for row."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from korvane.operators import search as S
from korvane.operators.index import VectorIndex, quantised
from korvane.sources import catalog as C
from korvane.sources.schemas import STYLES

DIM = 24


@pytest.fixture(scope="module")
def catalog(spark):
    return C.generate(spark, 6000).withColumn("gender", F.when(F.col("id") % 40 != 7, F.col("gender"))).cache()


@pytest.fixture(scope="module")
def vectors(spark):
    """Few distinct vectors, so that ties abound, and every odd case."""
    r = np.random.default_rng(5)
    some = r.normal(size=(900, DIM)).astype("float32")
    rows = [(i, some[i % 900].tolist()) for i in range(1, 5600)]
    rows += [(5600, None), (5601, [0.0] * DIM), (5602, [1.0] * (DIM + 1)), (5603, [float("nan")] * DIM), (5604, [float("inf")] + [1.0] * (DIM - 1)), (5605, None), (9999, some[0].tolist())]
    return spark.createDataFrame(rows, "product_id long, embedding array<float>").cache()


def asked(spark, n):
    r = np.random.default_rng(6)
    pick = lambda values, i: values[i % len(values)] if i % 3 else None
    rows = [(i, r.normal(size=DIM).tolist(), pick(list(C.CATEGORIES), i), pick(["여성", "남성", "공용", "없음"], i // 2), pick(["봄", "사계절"], i // 3), pick(STYLES, i // 4) if i % 7 == 0 else None, pick(C.COLORS, i // 5) if i % 11 == 0 else None, 30000.5 if i % 4 == 0 else None, 90000.0 if i % 5 == 0 else None, [None, True, False][i % 3]) for i in range(n)]
    rows += [(n, None, *[None] * 8), (n + 1, [0.0] * DIM, *[None] * 8), (n + 2, [1.0] * (DIM + 1), *[None] * 8), (n + 3, [1.0] * DIM, "없음", *[None] * 7), (n + 4, [2.0] * DIM, "가방", "여성", "봄", "모던", "민트", *[None] * 2, False)]
    return spark.createDataFrame(rows, "qid long, q array<float>, category string, gender string, season string, style string, color string, price_min double, price_max double, in_stock_only boolean").cache()


def hits(df):
    return sorted((r["qid"], r["rank"], r["id"], str(r["distance"])) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark, catalog, vectors, tmp_path_factory):
    return VectorIndex.write(catalog, vectors, str(tmp_path_factory.mktemp("index") / "at"), lanes=6)


@pytest.mark.parametrize("k", [1, 7, 40])
def test_equals_the_plain_search(spark, catalog, vectors, index, k):
    q = asked(spark, 60)
    want = hits(S.search_pairs(catalog, vectors, q, k))
    assert hits(index.search(q, k)) == want and len({h[0] for h in want}) > 50


def test_packs_and_a_passing_index(spark, catalog, vectors, index):
    q = asked(spark, 60)
    assert hits(index.search(q, 5, pack_bytes=4000)) == hits(index.search(q, 5)) == hits(S.search_batch(catalog, vectors, q, 5))


def test_many_queries_need_no_nested_loop(spark, catalog, vectors, index):
    """A hundred times the queries: no pairs of rows are joined without a key, and few exact vectors are compared."""
    q = asked(spark, 6000)
    found = index.search(q, 5)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.select("qid").distinct().count() > 5000
    kept, of = index.candidates(q.where("qid < 6000"), 5).count(), index.vectors.count() * 6000
    assert kept < 0.02 * of
    one = q.where("qid % 500 = 3")
    assert hits(index.search(one, 5)) == hits(found.join(one.select("qid"), "qid")) == hits(S.search_pairs(catalog, vectors, one, 5))


def test_only_lanes_with_candidates_are_read(spark, index):
    q = asked(spark, 1).where("qid = 0").withColumn("category", F.lit("신발"))
    lanes = {r["lane"] for r in index.candidates(q, 5).select("lane").collect()}
    assert 0 < len(lanes) < index.vectors.select("lane").distinct().count()


def test_the_bound_holds():
    r = np.random.default_rng(7)
    x = r.normal(size=(500, 64)) * r.choice([1e-30, 1, 1e6], size=(500, 1)) * (r.random((500, 64)) < 0.3)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    q = r.normal(size=(50, 64))
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    codes, scale, slack = quantised(x)
    near = (codes.astype(np.float32) * scale[:, None]) @ q.astype(np.float32).T
    assert (np.abs(near - x @ q.T) <= slack[:, None]).all()


def test_no_rows(spark, catalog, vectors, tmp_path):
    none = VectorIndex.write(catalog.limit(0), vectors, str(tmp_path / "a"))
    assert none.search(asked(spark, 3), 5).count() == 0
    some = VectorIndex.write(catalog, vectors, str(tmp_path / "b"))
    assert some.search(asked(spark, 3).limit(0), 5).count() == 0 and some.search(asked(spark, 3), 0).count() == 0


def test_an_index_of_encoded_vectors_sends_none_of_them_out(spark, sf, tmp_path, monkeypatch):
    """A batch of requests searches what an encoder has just made; packs of queries leave the driver once they were scanned."""
    from pyspark.core.broadcast import Broadcast

    from korvane.operators import index as I
    from korvane.plans.queries import gone, small_catalog

    plans, ended = [], []
    monkeypatch.setattr(I, "materialize", lambda df, name, made=I.materialize: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), made(df, name))[1])
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a, end=Broadcast.destroy: (ended.append(self), end(self, *a))[1])
    p, e = small_catalog(spark, sf)
    index = VectorIndex.write(p, e, str(tmp_path / "index"), gone())
    rows = next(plan for name, plan in plans if name == "rows")
    assert "SortMergeJoin" in rows and "BroadcastExchange" not in rows, rows
    found = index.search(e.where("product_id % 50 = 0").select(F.col("product_id").alias("qid"), F.col("embedding").alias("q")), 3, pack_bytes=2048)
    assert found.count() == 12 and len(ended) > 1
