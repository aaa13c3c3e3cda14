"""Progress of running jobs."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from korvane.operators import backfill as B
from korvane.operators.models import HashingEncoder, encode
from korvane.operators.watch import Watch
from korvane.sources import catalog as C
from korvane.sources.buckets import BucketTable
from korvane.sources.schemas import EMBEDDINGS


class Slow(HashingEncoder):
    def vectors(self, texts):
        time.sleep(0.1)
        return super().vectors(texts)


def test_counts_rise_while_the_job_runs(spark):
    told = []
    texts = spark.range(960).repartition(24).select(F.col("id").cast("string").alias("text"))
    with Watch(spark, 960, lambda *a: told.append(a), every=0.02) as watch:
        encode(texts, Slow(8), count=watch.done).write.format("noop").mode("overwrite").save()
    counts = [t[0] for t in told]
    assert counts == sorted(counts) and counts[-1] == 960 and any(0 < n < 960 for n in counts)
    for done, total, rate, left in told:
        assert total == 960 and rate > 0 and abs(left * rate - (960 - done)) < 1e-6


def test_a_job_that_fails_reports_no_end(spark):
    told = []
    with pytest.raises(ZeroDivisionError), Watch(spark, 5, lambda *a: told.append(a), every=9):
        1 / 0
    assert told == []


def test_a_fill_ends_with_all_its_rows(spark, tmp_path):
    told = []
    table = BucketTable.create(spark.createDataFrame([], EMBEDDINGS), str(tmp_path / "v"), "product_id", 4)
    made = C.generate(spark, 60)
    assert B.fill(made, table, HashingEncoder(8), report=lambda *a: told.append(a)) == 60
    assert told[-1][:2] == (60, 60) and told[-1][3] == 0.0 and table.read().count() == 60


def test_rebuild_empties_both_tables_and_counts_from_one(spark, tmp_path):
    made = C.generate(spark, 40).withColumn("id", F.col("id") + 1000)
    first = B.rebuild(made, str(tmp_path))
    assert sorted(r["id"] for r in first.collect()) == list(range(1, 41))
    spark.createDataFrame([(1, [1.0], "t", "m", None)], "product_id long, embedding array<float>, embedded_text string, model string, updated_at timestamp").write.mode("append").parquet(f"{tmp_path}/product_embeddings")
    again = B.rebuild(made.where("id <= 1010"), str(tmp_path))
    rows = again.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, 11)) and [r["sku"] for r in rows] == sorted(r["sku"] for r in rows)
    assert C.read(spark, str(tmp_path), "product_embeddings").count() == 0
