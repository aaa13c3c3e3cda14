"""Embedding backfill: what is missing, its vectors, and the upsert."""

from __future__ import annotations

import uuid

from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from korvane.functions.text import embed_text
from korvane.functions.vector import check_dim
from korvane.operators.models import Encoder, encode
from korvane.operators.watch import Report, Watch, progress  # noqa: F401  progress is part of this module's interface
from korvane.sources.buckets import BucketTable
from korvane.sources.schemas import EMBEDDINGS
from korvane.sources.stored import materialize

INPUT = ["id", "name", "brand", "category", "subcategory", "gender", "season", "style", "color", "material", "description", "tags"]


def pending(products: DataFrame, embeddings: DataFrame, deleted: Column | None = None) -> DataFrame:
    """Live products without a row of vectors. A row with a null vector, or of another model, counts as there."""
    live = products.where(~deleted if deleted is not None else F.col("deleted_at").isNull())
    return live.join(embeddings.select(F.col("product_id").alias("id")), "id", "left_anti")


def upsert(target: DataFrame, source: DataFrame, key: str = "product_id") -> DataFrame:
    """target with source's rows in place of those with the same key. source must hold each key once, which is checked."""
    once = source.groupBy(key).agg(F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in source.columns if c != key])
    once = once.withColumn(key, F.when(F.assert_true(F.col("n") == 1, F.lit("a key repeats in the source of an upsert")).isNull(), F.col(key))).select(*target.columns)
    return target.join(source.select(key), key, "left_anti").select(*target.columns).unionByName(once)


def cascade_delete(embeddings: DataFrame, products: DataFrame) -> DataFrame:
    """The rows of vectors whose product still exists."""
    return embeddings.join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")


def embed(todo: DataFrame, encoder: Encoder, now: Column | None = None, batch: int = 32, count: Accumulator | None = None) -> DataFrame:
    """Rows of vectors for products, encoded `batch` texts at a time."""
    texts = todo.select(F.col("id").alias("product_id"), embed_text().alias("embedded_text")).repartition("product_id")  # the encoder's work is dealt out however few files there are
    rows = encode(texts, encoder, "embedded_text", "embedding", batch, count=count)
    return rows.select("product_id", check_dim(F.col("embedding"), encoder.dim).alias("embedding"), "embedded_text", F.lit(encoder.name).alias("model"), (now if now is not None else F.current_timestamp()).alias("updated_at"))


def write_version(df: DataFrame, location: str) -> str:
    """Write a table beside the one that may be being read; the caller switches to the returned folder."""
    path = f"{location}/version-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def backfill(spark: SparkSession, products: DataFrame, embeddings: DataFrame, encoder: Encoder, location: str, deleted: Column | None = None, batch: int = 32) -> tuple[str | None, int]:
    """Embed what is pending and write a new version of the vectors. Returns its folder (None if nothing was pending) and the count.

    Running it again after a failure takes up what is still missing."""
    todo = pending(products, embeddings, deleted)
    n = todo.count()
    if not n:
        return None, 0
    rows = embed(todo.select(*INPUT), encoder, batch=batch)
    return write_version(upsert(embeddings.select(*EMBEDDINGS.fieldNames()), rows), location), n


def fill(products: DataFrame, table: BucketTable, encoder: Encoder, deleted: Column | None = None, batch: int = 32, report: Report | None = None) -> int:
    """Embed what `table` does not hold and add it: only filters, and the buckets of new rows, are read or written. Returns the count.

    A failure leaves the state as it was; running it again takes up what is missing. `report` is told how far it is."""
    live = products.where(~deleted if deleted is not None else F.col("deleted_at").isNull())
    todo = materialize(table.absent(live.select(*INPUT), "id"), "todo")
    n = todo.count()
    if n and report is None:
        table.upsert(embed(todo, encoder, batch=batch))
    elif n:
        seen = Observation()
        with Watch(products.sparkSession, n, report) as watch:
            table.upsert(embed(todo, encoder, batch=batch, count=watch.done).observe(seen, F.count(F.lit(1)).alias("rows")))
            watch.finished(seen.get["rows"])
    return n


# What columns of a new product hold that it does not name.
DEFAULTS = {"tenant_id": "demo", "stock": 0}


def append(table: DataFrame, rows: DataFrame, order: str = "sku", now: Column | None = None) -> DataFrame:
    """table and rows, which take the next ids in the order of a unique column and defaults for what they do not name.

    A range shuffle deals rows out in order and each partition counts its own, so ids have no gaps and no task holds them all."""
    last = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))  # one row
    dealt = rows.repartitionByRange(order).sortWithinPartitions(order)
    dealt = materialize(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_inside")), "appended")
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("_part").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")  # a row for each partition
    new = dealt.join(F.broadcast(before), "_part").crossJoin(F.broadcast(last)).withColumn("id", F.col("last") + F.col("_before") + F.col("_inside") + 1)
    time = now if now is not None else F.current_timestamp()
    there = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    value = {"id": F.col("id"), **{c: F.coalesce(there(c), F.lit(v)) for c, v in DEFAULTS.items()}, **{c: F.coalesce(there(c), time) for c in ("created_at", "updated_at")}}
    as_type = lambda f: there(f.name) if f.name in rows.columns and isinstance(f.dataType, ArrayType) else value.get(f.name, there(f.name)).cast(f.dataType)
    return table.unionByName(new.select(*(as_type(f).alias(f.name) for f in table.schema.fields)))


def rebuild(df: DataFrame, location: str) -> DataFrame:
    """Replace a catalog: both tables are emptied and ids begin at 1, in the order of sku."""
    df = append(df.limit(0), df.drop("id"))
    df.write.mode("overwrite").parquet(f"{location}/products")
    df.sparkSession.createDataFrame([], EMBEDDINGS).write.mode("overwrite").parquet(f"{location}/product_embeddings")
    return df.sparkSession.read.schema(df.schema).parquet(f"{location}/products")
