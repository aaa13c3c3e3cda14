"""A consumer of outbox events: in order for each aggregate, failed ones again after a pause, hopeless ones set apart.

The tables fix no such rules; these are this module's. Events of an aggregate are handled one after the other, by created_at
and id among those that have arrived. If the handler fails, the event is tried again after `pause` seconds, then after twice
as long, and so on, while the aggregate's later events wait; after `tries` tries it is a dead letter, and the next one is on.

Aggregates are dealt into buckets by a hash. A micro-batch takes a bucket's aggregates side by side: while one waits, the others
go on, and pauses that end within `patience` seconds are waited for there and then, so a retry needs no micro-batch of its own.
What still waits after that is state, and a timer of the bucket wakes it.

State of a bucket: of each aggregate the number of events settled, and of those that wait also the time of the next try, the
queue's ends and the waiting events by number (a map, so that a long queue is never rewritten). Spark keeps it in RocksDB with
the checkpoint; a killed run goes on from there, and the file sink makes every settled event appear once. A handler may run again
for an event whose batch was lost, so its effect should be the same when repeated. A checkpoint holds for one number of buckets.

Defined cases: events without an aggregate_id are an aggregate of their own; an event that comes after later ones of its
aggregate were settled is handled when it comes; repeated events are handled again; no events give no rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import chain, groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from korvane.sources.stored import folder

#: (event_type, payload, id, try from 1) -> an error, or None. An exception counts as an error.
Handler = Callable[[str, str, int, int], str | None]

EVENT = "id long, event_type string, payload string, created_at timestamp"
SETTLED = "aggregate_id long, place long, id long, event_type string, tries int, error string, dead boolean"
PROCESSED, FAILED = "processed", "dead"
AGGREGATE = "nobody boolean, aggregate_id long"  # without nulls: events without an aggregate_id are nobody's
WAITING = "id long, event_type string, payload string"

BUCKETS = 64
#: State stores of a consumer, unless the session has fewer partitions or more cores: each one costs every micro-batch a commit.
STORES = 32
EVENTS = 100_000  # of a bucket, about, where the number of events is known
ROWS = 10_000  # of a frame that leaves a task


@dataclass
class Queue:
    """An aggregate within one call: its events to come, the one that has to be tried again, and where it is stored if it waits."""

    key: tuple[bool, int]
    events: Iterator[tuple]
    settled: int
    tries: int = 0
    head: tuple | None = None
    due: float = 0.0
    first: int = 0
    last: int = 0


class Consumer(StatefulProcessor):
    def __init__(self, handler: Handler, tries: int, pause: float, patience: float = 1.0, buckets: int = BUCKETS):
        self.handler, self.tries, self.pause, self.patience, self.buckets = handler, tries, pause, patience, buckets

    def init(self, handle) -> None:
        self.handle = handle
        self.dealt = handle.getValueState("dealt", "buckets int")
        self.counts = handle.getMapState("counts", AGGREGATE, "settled long")
        self.queues = handle.getMapState("queues", AGGREGATE, "first long, last long, tries int, due double")
        self.waiting = handle.getMapState("waiting", f"{AGGREGATE}, number long", WAITING)

    def _try(self, event: tuple, number: int) -> str | None:
        try:
            return self.handler(event[1], event[2], int(event[0]), number)
        except Exception as e:  # noqa: BLE001  whatever a handler raises is its event's error
            return f"{type(e).__name__}: {e}"

    def _run(self, key: tuple, events: Iterator[tuple], tries: int, settled: int) -> tuple[list[tuple], tuple | None, int, int]:
        """Settle events in turn until one has to wait. Returns what was settled, the one that waits, its tries, and the count."""
        out = []
        for e in events:
            error = self._try(e, tries + 1)
            tries += 1
            if error is not None and tries < self.tries:
                return out, e, tries, settled
            settled += 1
            out.append((key[0], settled, int(e[0]), e[1], tries, error, error is not None))
            tries = 0
        return out, None, 0, settled

    def _settle(self, queues: list[Queue]) -> Iterator[pd.DataFrame]:
        """Go through queues side by side until all are settled, or patience is at an end. What waits keeps its head."""
        order, out, left = [(q.due, n) for n, q in enumerate(queues)], [], self.patience
        heapify(order)
        while order:
            due, n = order[0]
            wait = due - time.time()
            if wait > 0:
                if wait > left:
                    break
                left -= wait
                time.sleep(wait)
            heappop(order)
            q = queues[n]
            events = q.events if q.head is None else chain([q.head], q.events)
            rows, q.head, q.tries, q.settled = self._run((None if q.key[0] else q.key[1],), events, q.tries, q.settled)
            out += rows
            if q.head is not None:
                q.due = time.time() + self.pause * 2 ** (q.tries - 1)
                heappush(order, (q.due, n))
            if len(out) >= ROWS:
                yield self._frame(out)
                out = []
        if out:
            yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SETTLED.split(", ")])
        frame["aggregate_id"] = pd.array([r[0] for r in rows], dtype="Int64")  # a float would not do beside a null
        return frame

    def _wake(self, due: float) -> None:
        """One timer for the bucket, at the earliest time."""
        at, timers = int(1000 * due) + 1, list(self.handle.listTimers())
        if not timers or at < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(rows).sort_values(["nobody", "aggregate_id", "created_at", "id"], kind="stable")
        known = self.dealt.get() if self.dealt.exists() else None
        if known and known[0] != self.buckets:
            raise ValueError(f"the checkpoint's events are dealt into {known[0]} buckets, not {self.buckets}")
        if not known:
            self.dealt.update((self.buckets,))
        queues = []
        for of, its in groupby(new[["nobody", "aggregate_id", "id", "event_type", "payload"]].itertuples(index=False, name=None), itemgetter(0, 1)):
            events = iter([e[2:] for e in its])
            waits = self.queues.getValue(of) if known else None
            if waits:  # behind those that wait
                first, last, tries, due = waits
                self.queues.updateValue(of, (first, self._store(of, last, events), tries, due))
            else:
                there = self.counts.getValue(of) if known else None
                queues.append(Queue(of, events, there[0] if there else 0))
        yield from self._settle(queues)
        for q in queues:
            self.counts.updateValue(q.key, (q.settled,))
            if q.head is not None:
                self.queues.updateValue(q.key, (0, self._store(q.key, 0, chain([q.head], q.events)), q.tries, q.due))
        late = [q.due for q in queues if q.head is not None]
        if late:
            self._wake(min(late))

    def _store(self, of: tuple, last: int, events: Iterator[tuple]) -> int:
        for last, e in enumerate(events, last + 1):  # noqa: B020
            self.waiting.updateValue((*of, last - 1), e)
        return last

    def _stored(self, q: Queue) -> Iterator[tuple]:
        while q.first < q.last:
            yield tuple(self.waiting.getValue((*q.key, q.first)))
            self.waiting.removeKey((*q.key, q.first))  # reached once the event is settled
            q.first += 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        queues = []
        for of, (first, last, tries, due) in list(self.queues.iterator()):
            q = Queue((bool(of[0]), int(of[1])), iter(()), 0, tries, None, due, first, last)
            q.events = self._stored(q)
            q.settled = self.counts.getValue(q.key)[0]
            queues.append(q)
        before = {q.key: (q.first, q.tries) for q in queues}
        yield from self._settle(queues)
        late = []
        for q in queues:
            done = q.first == q.last
            if not done:
                late.append(q.due)
            if before[q.key] != (q.first, q.tries):
                self.counts.updateValue(q.key, (q.settled,))
                if done:
                    self.queues.removeKey(q.key)
                else:
                    self.queues.updateValue(q.key, (q.first, q.last, q.tries, q.due))
        if late:  # later than the timer that has expired, which goes after this
            self.handle.registerTimer(max(int(1000 * min(late)) + 1, expiredTimerInfo.getExpiryTimeInMs() + 1))

    def close(self) -> None:
        pass


def consume(events: DataFrame, handler: Handler, target: str, checkpoint: str, tries: int = 4, pause: float = 0.2, every: str = "0 seconds", patience: float = 1.0, buckets: int = BUCKETS) -> StreamingQuery:
    """Start the consumer over the stream events (aggregate_id and the columns of EVENT); settled events are appended to target.

    A micro-batch holds each bucket's events in a task, and waits up to `patience` seconds in it for retries."""
    spark = events.sparkSession
    of = [F.col("aggregate_id").isNull().alias("nobody"), F.coalesce("aggregate_id", F.lit(0)).cast("long").alias("aggregate_id")]
    rows = events.select(F.pmod(F.hash("aggregate_id"), F.lit(buckets)).alias("bucket"), *of, *(c.split(" ")[0] for c in EVENT.split(", ")))
    settled = rows.groupBy("bucket").transformWithStateInPandas(Consumer(handler, tries, pause, patience, buckets), SETTLED, "Append", "ProcessingTime")
    stores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(STORES, spark.sparkContext.defaultParallelism))
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": str(stores)}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:  # a query takes the session's settings as it starts
        for k, v in settings.items():
            spark.conf.set(k, v)
        return settled.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def settled_events(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(SETTLED).parquet(target)


def dead_letters(spark: SparkSession, target: str) -> DataFrame:
    """The stream of events that were given up, from the consumer's output."""
    return spark.readStream.schema(StructType.fromDDL(SETTLED)).parquet(target).where("dead")


def drain(query: StreamingQuery, spark: SparkSession, target: str, n: int, seconds: float = 600) -> None:
    """Wait until n events are settled, then stop. A query that fails raises here, and one that settles nothing for that many seconds."""
    end, batch, there = time.monotonic() + seconds, -1, 0
    try:
        while query.isActive and time.monotonic() < end:
            p = query.lastProgress
            if p and p["batchId"] > batch and _there(spark, target):  # counted once a micro-batch
                batch, now = p["batchId"], settled_events(spark, target).count()
                if now >= n:
                    return
                if now > there:
                    end, there = time.monotonic() + seconds, now
            time.sleep(0.2)
        if query.exception():
            raise query.exception()
        raise TimeoutError(f"{there} of {n} events are settled, and no more within {seconds} s")
    finally:
        query.stop()


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_spark_metadata")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def replay(events: DataFrame, handler: Handler, tries: int = 4) -> DataFrame:
    """What consume() settles, as a batch: the measure of the stream. An aggregate's events go to one task in order."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one, out, settled = Consumer(handler, tries, 0), [], 0
        for e in rows.sort_values(["created_at", "id"], kind="stable")[["id", "event_type", "payload", "created_at"]].itertuples(index=False, name=None):
            error, number = "", 0
            while error is not None and number < tries:
                number += 1
                error = one._try(e, number)
            settled += 1
            out.append((key[0], settled, int(e[0]), e[1], number, error, error is not None))
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in SETTLED.split(", ")])

    return events.groupBy("aggregate_id").applyInPandas(run, SETTLED)


def consumed(events: DataFrame, handler: Handler, tries: int = 4, pause: float = 0.2) -> DataFrame:
    """Run the consumer over a whole table of events until all are settled."""
    spark = events.sparkSession
    source, target, checkpoint = folder(spark, "events"), folder(spark, "settled"), folder(spark, "progress")
    events.write.parquet(source)
    n = spark.read.schema(events.schema).parquet(source).count()
    if not n:
        return spark.createDataFrame([], SETTLED)
    stream = spark.readStream.schema(events.schema).parquet(source)
    query = consume(stream, handler, target, checkpoint, tries, pause, patience=10.0, buckets=max(BUCKETS, n // EVENTS))
    drain(query, spark, target, n, 600 + n / 1000)  # one micro-batch may have to settle them all
    return settled_events(spark, target)
