"""The ordered copies: the same rows as the plain filters, and fewer of them read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from korvane.operators.filters import FilterSpec, all_of, predicates
from korvane.sources import catalog as C
from korvane.sources import layout as L

SPECS = [
    FilterSpec(), FilterSpec(in_stock_only=False), FilterSpec(category="신발"), FilterSpec(category="없음"), FilterSpec(gender="여성", season="봄"), FilterSpec(price_min=30000.5, price_max=90000.9), FilterSpec(style="모던", color="민트", in_stock_only=False),
    FilterSpec(category="원피스", gender="여성", season="봄", price_min=50000, price_max=80000), FilterSpec(tenant_id="demo", category="가방"),
]


@pytest.fixture(scope="module")
def made(spark):
    odd = F.when(F.col("id") % 50 == 3, F.lit("외계")).when(F.col("id") % 50 != 4, F.col("gender"))
    return C.generate(spark, 40_000).withColumn("gender", odd).withColumn("deleted_at", F.when(F.col("id") % 25 == 3, F.col("created_at"))).cache()


@pytest.fixture(scope="module")
def copy(spark, made, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("copy") / "catalog")
    L.write_catalog(made, at, page_rows=200, group_bytes=512 << 10, files=4)
    return L.read_catalog(spark, at)


@pytest.mark.parametrize("spec", SPECS)
def test_same_rows(made, copy, spec):
    want = made.where(all_of(predicates(spec))).select("id", "sku", "price")
    got = copy.where(L.pruned(spec)).select("id", "sku", "price")
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_less_is_read(made, copy):
    share = lambda spec: L.rows_read(copy.where(L.pruned(spec)).select("id", "name")) / made.count()
    assert share(SPECS[7]) < 0.2 and share(FilterSpec(category="신발")) < 0.4 and share(FilterSpec(price_max=20000)) < 0.6
    assert share(FilterSpec()) == pytest.approx(made.where("deleted_at IS NULL AND stock > 0").count() / made.count())  # the other shelves are not listed
    one = copy.where(F.col("sku") == made.where("id = 77").first()["sku"])
    assert one.count() == 1 and L.rows_read(one) < 0.5 * made.count()  # Bloom filters, row group by row group


def test_all_parts_of_a_filter_are_pushed(spark, copy):
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = copy.where(L.pruned(SPECS[7]))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert all(c in pushed for c in ("EqualTo(category", "In(gender", "In(season", "GreaterThanOrEqual(effective_price", "LessThanOrEqual(effective_price")) and "PartitionFilters: [isnotnull(shelf" in plan


def test_runs_of_the_curve(spark):
    got = [r[0] for r in spark.createDataFrame([(0, 0), (0, 128), (128, 0), (128, 128), (255, 255)], "a int, b int").select(L.interleaved([F.col("a"), F.col("b")])).collect()]
    assert got == [0, 1 << 14, 2 << 14, 3 << 14, (1 << 16) - 1]


def test_outbox_and_no_rows(spark, made, tmp_path):
    events = spark.range(1000).select("id", F.col("id").cast("timestamp").alias("created_at"), F.when(F.col("id") % 10 != 0, F.lit("2024-01-01").cast("timestamp")).alias("processed_at"))
    L.write_outbox(events, str(tmp_path / "o"))
    open_ = spark.read.parquet(str(tmp_path / "o")).where("state = 'open'")
    assert open_.count() == 100 and L.rows_read(spark.read.parquet(str(tmp_path / "o")).where("state = 'open'")) == 100
    L.write_catalog(made.limit(0), str(tmp_path / "c"))
    assert not list((tmp_path / "c").glob("shelf=*"))
