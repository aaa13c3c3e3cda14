"""Outbox events and the streaming backfill.

What happens to a failed event beyond being counted is not fixed by the table; the limit of retries is this module's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korvane.operators.backfill import embed, fill
from korvane.operators.models import Encoder
from korvane.operators.watch import Report
from korvane.sources.buckets import BucketTable
from korvane.sources.stored import materialize


def pending(outbox: DataFrame, most_retries: int | None = None) -> DataFrame:
    """Unprocessed events, oldest first."""
    out = outbox.where("processed_at IS NULL")
    if most_retries is not None:
        out = out.where(F.coalesce("retry_count", F.lit(0)) < most_retries)
    return out.orderBy("created_at", "id")


def numbered(events: DataFrame) -> DataFrame:
    """events with `place`, from 1, in the order in which they are polled. Events are counted by range of time first, so no task holds them all."""
    spread = events.repartitionByRange("created_at", "id").sortWithinPartitions("created_at", "id")
    part = spread.withColumn("part", F.spark_partition_id()).withColumn("inside", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    part = materialize(part, "polled")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = part.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")  # a row for each partition
    return part.join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("inside") + 1).drop("part", "inside", "before")


def settled(outbox: DataFrame, results: DataFrame, now) -> DataFrame:
    """outbox after results (id, error): no error marks an event processed, an error is kept and counted."""
    out = outbox.join(results.select("id", "error", F.lit(True).alias("tried")), "id", "left")
    ok, failed = F.col("tried") & F.col("error").isNull(), F.col("tried") & F.col("error").isNotNull()
    return out.withColumns({
        "processed_at": F.when(ok, now).otherwise(F.col("processed_at")),
        "retry_count": F.when(failed, F.coalesce("retry_count", F.lit(0)) + 1).otherwise(F.col("retry_count")),
        "last_error": F.when(failed, F.col("error")).otherwise(F.col("last_error")),
    }).drop("error", "tried")


def stream_backfill(products: DataFrame, stored: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], encoder: Encoder, checkpoint: str):
    """Embed products as they arrive on the stream `products`, skipping those that stored() has. Returns the writer's query.

    A micro-batch that is repeated after a failure finds its rows stored and adds none."""

    def step(batch: DataFrame, epoch: int) -> None:
        todo = batch.dropDuplicates(["id"]).where("deleted_at IS NULL").join(stored().select(F.col("product_id").alias("id")), "id", "left_anti")
        write(embed(todo, encoder), epoch)

    return products.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_fill(products: DataFrame, table: BucketTable, encoder: Encoder, checkpoint: str, report: Report | None = None):
    """stream_backfill() into a keyed table: a micro-batch reads the filters of its own keys, and not what is stored. `report` is told how far each micro-batch is."""

    def step(batch: DataFrame, epoch: int) -> None:
        fill(batch.dropDuplicates(["id"]), table, encoder, report=report)

    return products.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
