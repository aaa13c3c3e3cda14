"""The outbox consumer against a batch replay, through a kill and a restart."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from korvane.plans.queries import outbox_of
from korvane.streaming import consumer as E
from korvane.streaming import outbox as O


def flaky(kind, payload, i, n):
    if n <= i // 4 % 12 - 8:
        if i % 8:
            raise RuntimeError(f"down {n}")
        return f"try {n}"
    return None


def test_equals_a_replay_after_a_restart(spark, sf, tmp_path):
    """The first run is stopped while events wait; the second one gets the rest of the events too."""
    events = O.pending(outbox_of(spark, sf)).select("aggregate_id", "id", "event_type", "payload", "created_at").cache()
    half = events.agg(F.percentile_approx("created_at", 0.5)).first()[0]
    source, target, progress = (str(tmp_path / x) for x in ("in", "out", "at"))
    start = lambda: E.consume(spark.readStream.schema(events.schema).parquet(source), flaky, target, progress, tries=3, pause=0.3)
    events.where(F.col("created_at") <= half).write.parquet(source)
    first = start()
    end = time.monotonic() + 120
    while not (first.lastProgress and E._there(spark, target) and E.settled_events(spark, target).count()) and time.monotonic() < end:
        time.sleep(0.05)
    first.stop()
    early = E.settled_events(spark, target).count()
    assert 0 < early < events.count()
    events.where(F.col("created_at") > half).write.mode("append").parquet(source)
    E.drain(start(), spark, target, events.count(), 240)
    got, want = E.settled_events(spark, target), E.replay(events, flaky, 3)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r["tries"] for r in got.select("tries").distinct().collect()} == {1, 2, 3} and got.where("dead AND error LIKE '%down%'").count() > 0
    # the dead letters are a stream of their own
    dead = E.dead_letters(spark, target).writeStream.format("memory").queryName("dead_letters").trigger(availableNow=True).start()
    dead.awaitTermination()
    assert spark.table("dead_letters").count() == got.where("dead").count() > 0


def test_order_and_waiting():
    """A failing event holds back its aggregate's later ones, and no others."""
    one, asked = E.Consumer(lambda kind, payload, i, n: asked.append(i) or ("bad" if i == 2 else None), 3, 0.0), []
    events = [(i, "t", "{}", None) for i in (1, 2, 3)]
    out, head, tries, settled = one._run((9,), iter(events), 0, 0)
    assert [r[2] for r in out] == [1] and head[0] == 2 and tries == 1 and settled == 1 and asked == [1, 2]
    out, head, tries, settled = one._run((9,), iter(events[1:]), 2, settled)
    assert [(r[2], r[4], r[6]) for r in out] == [(2, 3, True), (3, 1, False)] and head is None and settled == 3


def test_no_events(spark):
    assert E.consumed(spark.createDataFrame([], "aggregate_id long, id long, event_type string, payload string, created_at timestamp"), flaky).count() == 0


def test_a_failing_stream_raises(spark, tmp_path):
    bad = spark.readStream.schema("aggregate_id long, id long, event_type string, payload string, created_at timestamp").parquet(str(tmp_path))
    spark.createDataFrame([(1, 1, "t", "{}", None)], "aggregate_id long, id long, event_type string, payload string, created_at timestamp").write.mode("append").parquet(str(tmp_path / "x"))
    with pytest.raises(TimeoutError):
        E.drain(E.consume(bad, flaky, str(tmp_path / "o"), str(tmp_path / "c")), spark, str(tmp_path / "o"), 5, 3)


MANY = "aggregate_id long, id long, event_type string, payload string, created_at timestamp"


def many(spark, path):
    """Long queues of few aggregates, two of which a double cannot tell apart, one without an id; some events without a time."""
    of = F.expr("CASE id % 4 WHEN 0 THEN 9007199254740992 WHEN 1 THEN 9007199254740993 WHEN 2 THEN 5 END")
    events = spark.range(120).select(of.alias("aggregate_id"), "id", F.lit("t").alias("event_type"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("payload"), F.when(F.col("id") % 16 < 12, F.timestamp_seconds(10000 - F.col("id"))).alias("created_at"))
    events.write.parquet(path)
    return spark.read.schema(MANY).parquet(path)


def often(kind, payload, i, n):
    return f"try {n}" if n <= i // 4 % 4 else None


def test_short_retries_need_no_micro_batches(spark, tmp_path):
    """36 retries one after the other in each queue are waited for within the first micro-batch; they were a micro-batch each."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    events = many(spark, source)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    query = E.consume(spark.readStream.schema(MANY).parquet(source), often, target, str(tmp_path / "at"), tries=3, pause=0.001)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    E.drain(query, spark, target, 120, 120)
    assert query.lastProgress["batchId"] <= 2
    got, want = E.settled_events(spark, target), E.replay(events, often, 3)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("dead").count() == 28


def test_long_pauses_are_state(spark, tmp_path):
    """Without patience every retry is a timer; events that come meanwhile queue behind those that wait."""
    source, target, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    events = many(spark, str(tmp_path / "all")).where("id < 24")
    start = lambda buckets: E.consume(spark.readStream.schema(MANY).parquet(source), often, target, at, tries=3, pause=0.01, patience=0.0, buckets=buckets)
    early = "created_at IS NOT NULL AND id >= 12"  # earliest of all
    events.where(early).write.parquet(source)
    first = start(2)
    end = time.monotonic() + 120
    while not first.lastProgress and time.monotonic() < end:
        time.sleep(0.05)
    first.stop()
    events.where(f"NOT ({early})").write.mode("append").parquet(source)
    E.drain(start(2), spark, target, 24, 240)
    got, want = E.settled_events(spark, target), E.replay(events, often, 3)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and {r["tries"] for r in got.collect()} == {1, 2, 3}
    # a checkpoint holds for its number of buckets
    events.write.mode("append").parquet(source)
    with pytest.raises(Exception, match="dealt into 2 buckets"):
        E.drain(start(1), spark, target, 48, 60)
