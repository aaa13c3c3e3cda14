"""Stored copies whose order lets Spark's own pushdown skip files, row groups and pages: what indexes are for elsewhere.

The catalog is split into shelves (live and in stock, live and sold out, deleted), and within a shelf its rows follow a
Z-order curve over category, gender, season and effective price: rows that are alike in all four are near each other, so
the least and greatest values in Parquet's statistics say something for each of them. The effective price is a column of
its own, because a test of coalesce(sale_price, price) cannot be pushed down. Parquet's Bloom filters serve id and sku.
The outbox is split into open and settled events, the open ones by time.

Defined cases: null filter values are in the order as value 0 and match no filter; values outside the vocabularies get a
place between their neighbours; rows with equal values stay by id; an empty table gives an empty copy."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.functions.text import effective_price
from korvane.operators.filters import FilterSpec
from korvane.sources.catalog import CATEGORIES
from korvane.sources.schemas import ANY_GENDER, ANY_SEASON, GENDERS, SEASONS

#: Bits of each column in the curve.
BITS = 8
VOCABULARIES = {"category": list(CATEGORIES), "gender": GENDERS, "season": SEASONS}
STOCKED, SOLD_OUT, DELETED = "stocked", "sold_out", "deleted"


def _rank(c: str, members: list[str]) -> Column:
    """A place among 2^BITS that follows the order of the texts, as the statistics do: a vocabulary's members are spread evenly, null is 0."""
    upto = F.size(F.filter(F.array(*map(F.lit, sorted(members))), lambda m: m <= F.col(c)))
    return F.coalesce(upto * (2**BITS // (len(members) + 1)), F.lit(0))


def interleaved(ranks: list[Column]) -> Column:
    """The Z-order of some ranks: their bits in turn, the highest ones first."""
    out, n = F.lit(0).cast("long"), len(ranks)
    for b in range(BITS):
        for j, r in enumerate(ranks):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(r, b).bitwiseAND(1).cast("long"), b * n + n - 1 - j))
    return out


def write_ordered(df: DataFrame, location: str, apart: str, order: list[str], looked_up: tuple[str, ...] = (), page_rows: int = 20_000, group_bytes: int = 32 << 20, files: int | None = None) -> None:
    """df, split by the column `apart` and sorted, with pages and row groups small enough to be skipped and Bloom filters of some columns."""
    sorted_ = df.repartitionByRange(*([files] if files else []), apart, *order).sortWithinPartitions(apart, *order)
    out = sorted_.write.partitionBy(apart).option("parquet.page.row.count.limit", str(page_rows)).option("parquet.block.size", str(group_bytes))
    for c in looked_up:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(location)


def write_catalog(products: DataFrame, location: str, deleted: Column | None = None, **sizes: int) -> None:
    """products with effective_price and shelf, in the order above."""
    gone = deleted if deleted is not None else F.col("deleted_at").isNotNull()
    rows = products.withColumn("effective_price", effective_price()).withColumn("shelf", F.when(gone, DELETED).when(F.col("stock") > 0, STOCKED).otherwise(SOLD_OUT))
    cuts = rows.agg(F.percentile_approx("effective_price", [i / 2**BITS for i in range(1, 2**BITS)], 10_000).alias("cuts")).first()["cuts"] or []
    price = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("effective_price"))) if cuts else F.lit(0)
    curve = interleaved([*(_rank(c, members) for c, members in VOCABULARIES.items()), F.coalesce(price, F.lit(0))])
    write_ordered(rows.withColumn("curve", curve), location, "shelf", ["curve", "id"], ("id", "sku"), **sizes)


def read_catalog(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.parquet(location)


def pruned(spec: FilterSpec) -> Column:
    """A FilterSpec over a catalog of write_catalog(): each part of it is pushed to the scan."""
    out = F.col("shelf") == STOCKED if spec.in_stock_only else F.col("shelf").isin(STOCKED, SOLD_OUT)
    for c in ("category", "style", "color", "tenant_id"):
        if (v := getattr(spec, c)) is not None:
            out = out & (F.col(c) == v)
    for c, always in (("gender", ANY_GENDER), ("season", ANY_SEASON)):
        if (v := getattr(spec, c)) is not None:
            out = out & F.col(c).isin(v, always)
    if spec.price_min is not None:
        out = out & (F.col("effective_price") >= ceil(spec.price_min))  # prices are whole numbers
    if spec.price_max is not None:
        out = out & (F.col("effective_price") <= floor(spec.price_max))
    return out


def write_outbox(outbox: DataFrame, location: str, **sizes: int) -> None:
    """Events by state and time. Open ones are those that are not processed."""
    write_ordered(outbox.withColumn("state", F.when(F.col("processed_at").isNull(), "open").otherwise("settled")), location, "state", ["created_at", "id"], **sizes)


def rows_read(df: DataFrame) -> int:
    """Run df's plan and count the rows that its scans gave, after all skipping."""
    plan = df._jdf.queryExecution()
    leaves = plan.executedPlan().collectLeaves()
    given = lambda: sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))
    before = given()  # of earlier runs of the same frame
    plan.toRdd().count()
    return given() - before
