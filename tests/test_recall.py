"""The approximate search against the exact one."""

from __future__ import annotations

from pyspark.sql import functions as F

from korvane.operators import search as S
from korvane.plans.queries import QUERIES, gone
from korvane.sources.catalog import product_embeddings, products


def test_recall(spark):
    sf = "/root/testdata/sf0.01"
    p, e = products(spark, sf).cache(), product_embeddings(spark, sf).where("embedding IS NOT NULL").cache()
    q = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")).cache()
    near, exact = S.search_approximate(p, e, q, 10, deleted=gone()), S.search_batch(p, e, q, 10, gone())
    assert exact.count() == 10 * q.count() > 0
    assert S.recall(near, exact).first()["recall"] >= 0.9


def test_every_hundredth_row_is_a_query(spark):
    sf = "/root/testdata/sf0.01"
    want = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 100 = 0").select("vec_id").collect()}
    assert {r["qid"] for r in QUERIES["ann_search"](spark, sf).select("qid").collect()} == want
