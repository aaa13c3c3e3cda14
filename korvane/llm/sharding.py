"""Balanced label propagation: documents with equal texts drift into one shard, and shards stay equal.

Only DataFrame functions. Documents are the nodes, equal texts the links; law `rows`: shard sizes differ by a row at
most. A group of more than half a shard cannot be placed freely, so it is cut into neighbourhoods of about half a
shard by a hash of doc_id; any other group is one neighbourhood.

  start   Each document is where a hash of its doc_id puts it.
  round   Each neighbourhood counts its documents by shard and aims at the shard that has most of them among those with
          room for the others. Room is a shard's quota less the linked documents in it. Neighbourhoods are let in by
          hashed order as long as the running sum of their movers stays within the room; the others wait for the next
          round. Running sums are over buckets of the order, in a table of SHARDS * LANES rows.
  close   Within a shard, linked documents come before single ones. What exceeds the quota, mostly single documents,
          fills the shards that lack some, in order. Ranks are a bucket's offset plus the place in the bucket, with
          buckets of about ROWS rows, so no task orders a whole shard.

Defined cases: null and empty texts have size 8 and crc 0; null texts are linked with nothing, empty ones with each
other; very long texts count by their hash alone; rows with a null doc_id are placed like others; rows that repeat doc_id
and text are interchangeable, ties in order go by hash; an empty table gives no rows; other columns are not read, so their
names cannot clash. grown_shard is null: it belongs to law `key`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korvane.llm.common import discard, materialize, table

SHARDS = 24
ROUNDS = 4
LANES = 64
ROWS = 2000


def ranked(df: DataFrame, by: list[str], order: list[str], buckets: int) -> DataFrame:
    """df with `place`: gapless from 0 within `by`, where rows with smaller `order` columns come first and hashes decide the rest."""
    key = ["doc_id", "sha"]
    spread = df.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    part = [*by, *order, "bucket"]
    sums = Window.partitionBy(*by).orderBy(*order, "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy(*part).agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(sums), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy(*part).orderBy(*key))
    return spread.withColumn("inside", inside).join(offsets, part).withColumn("place", F.col("offset") + F.col("inside") - 1).drop("offset", "inside", "bucket")


def propagate(rows: DataFrame, quota: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """One round: rows (sha, part, linked, shard, ...) with new shards; and the written counts that they are made from."""
    spark = rows.sparkSession
    linked = rows.where("linked")
    counts = linked.groupBy("sha", "part", "shard").agg(F.count("*").alias("n"))
    counts = materialize(counts, "counts")
    room = quota.join(counts.groupBy("shard").agg(F.sum("n").alias("held")), "shard", "left").select("shard", (F.col("quota") - F.coalesce("held", F.lit(0))).alias("room"))
    whole = counts.groupBy("sha", "part").agg(F.sum("n").alias("size"), F.count("*").alias("shards")).where("shards > 1").drop("shards")
    aims = counts.join(whole, ["sha", "part"]).join(F.broadcast(room), "shard").where("size - n <= room")  # room: SHARDS rows
    aims = aims.groupBy("sha", "part").agg(F.max(F.struct("n", F.xxhash64("sha", "shard").alias("tie"), "shard", "size")).alias("m")).select("sha", "part", F.col("m.shard").alias("aim"), (F.col("m.size") - F.col("m.n")).alias("movers"))
    aims = aims.withColumn("lane", F.pmod(F.xxhash64("sha", "part", F.lit(step)), F.lit(LANES)))
    sums = Window.partitionBy("aim").orderBy("lane")
    lanes = aims.groupBy("aim", "lane").agg(F.sum("movers").alias("movers")).withColumn("upto", F.sum("movers").over(sums))
    open_ = lanes.join(room.withColumnRenamed("shard", "aim"), "aim").where("upto <= room").select("aim", "lane")  # at most SHARDS * LANES rows
    moves = aims.join(F.broadcast(open_), ["aim", "lane"]).select("sha", "part", "aim")
    return rows.join(moves, ["sha", "part"], "left").withColumn("shard", F.coalesce(F.col("aim"), F.col("shard"))).drop("aim"), counts


def shard(documents: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = documents.sparkSession
    body = F.col("text").cast("binary")
    docs = documents.select(
        F.col("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(body), F.lit(0)).alias("text_crc32"),
        F.coalesce(F.sha2(body, 256), F.concat(F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("sha"), F.col("text").isNotNull().alias("there"),
    )
    docs = materialize(docs, "documents")
    n = docs.count()
    quota = spark.range(shards).select(F.col("id").cast("int").alias("shard"), (F.lit(n // shards) + (F.col("id") < n % shards).cast("long")).alias("quota"))
    groups = docs.where("there").groupBy("sha").agg(F.count("*").alias("times")).where("times > 1")
    half = max(1, n // shards // 2)
    rows = docs.join(groups, "sha", "left").withColumn("linked", F.col("times").isNotNull())
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.greatest(F.ceil(F.coalesce("times", F.lit(1)) / half), F.lit(1)).cast("long")))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(shards)).cast("int")).drop("times", "there")
    rows = materialize(rows, "labels")
    discard(docs)
    for step in range(rounds):
        moved, counts = propagate(rows, quota, step)
        rows, before = materialize(moved, "labels"), rows
        discard(before, counts)
    buckets = max(1, n // shards // ROWS)
    placed = materialize(ranked(rows.withColumn("single", (~F.col("linked")).cast("int")), ["shard"], ["single"], buckets).join(F.broadcast(quota), "shard"), "placed")
    discard(rows)
    stay = placed.where("place < quota")
    # what exceeds a quota, in one order, meets the gaps of the other shards, in one order
    gaps = quota.join(stay.groupBy("shard").agg(F.count("*").alias("held")), "shard", "left").select("shard", (F.col("quota") - F.coalesce("held", F.lit(0))).alias("gap"))
    sums = Window.orderBy("shard")  # SHARDS rows
    gaps = gaps.withColumn("upto", F.sum("gap").over(sums)).select(F.col("shard").alias("to"), (F.col("upto") - F.col("gap")).alias("from_place"), "upto").where("upto > from_place")
    over = ranked(placed.where("place >= quota").drop("place").withColumn("all", F.lit(0)), ["all"], ["single"], max(1, n // ROWS))
    over = over.join(F.broadcast(gaps), (F.col("place") >= F.col("from_place")) & (F.col("place") < F.col("upto")))
    columns = ["doc_id", "size", "text_crc32", "sha"]
    final = stay.select(*columns, "shard").unionByName(over.select(*columns, F.col("to").alias("shard")))
    out = ranked(final, ["shard"], [], buckets)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
