"""Small pieces that the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korvane.sources.stored import arrow_batches, bucketed, discard, freeing, hold, let_go, materialize, shared_dir, sweep  # noqa: F401  used from here throughout the package

M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)
#: So many ids (or pairs of short columns) may be sent to all tasks: some 20 MB.
SMALL = 500_000
#: Bytes of keys that may be sent with them.
SENT_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sent(ids: DataFrame) -> DataFrame:
    """ids, marked for broadcast if they are counted to be SMALL rows or fewer. For narrow tables that are written already."""
    return F.broadcast(ids) if ids.count() <= SMALL else ids


def release() -> None:
    """Give unused memory back to the machine: Python workers are kept for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def total_bytes(df: DataFrame, column: str = "text") -> int:
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes end to end, and the n + 1 offsets of the rows. A null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, most: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `most` text bytes, so that per-byte work arrays stay small. A longer text stands alone."""
    n = np.diff(text_bytes(batch.column(batch.schema.get_field_index(column)))[1])
    if not len(n):
        return
    ends = np.cumsum(n)
    start = 0
    while start < len(n):
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def curve(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton's method with a slight ridge; classes count by their share of all labels."""
    w = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    scale = float(np.sqrt(np.mean(x**2))) or 1.0
    a = np.stack([x / scale, np.ones(len(x))], 1)
    t = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ t, -30, 30)))
        g = a.T @ (w * (p - y)) + np.array([1e-2, 0]) * t
        h = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(h, g)
        t -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(t[0] / scale), float(t[1])


def held_out(doc_id: str = "doc_id"):
    """True for the rows whose labels must not be learned. A null id is nobody's label: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def in_order(df: DataFrame, order: list[str], name: str, then=None) -> DataFrame:
    """df as a written table with `_part` and `_inside`: parts are ranges of `order`, `_inside` counts from 0 within a part.

    A range shuffle deals a hot first column out by the later ones, so no task holds it alone. then: a function of the sorted
    frame, applied before the table is written."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = then(dealt) if then else dealt
    return materialize(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_inside")), name)


def numbered(dealt: DataFrame, by: str) -> DataFrame:
    """in_order()'s rows with `pos`, gapless from 0 for each value of `by`, and `total`, the rows of that value.

    The offsets have a row for each value and part, and are sent out only up to a counted number and size."""
    upto = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = dealt.groupBy(by, "_part").agg(F.count("*").alias("n"), F.min("_inside").alias("first"))
    starts = starts.withColumn("_base", F.coalesce(F.sum("n").over(upto), F.lit(0)) - F.col("first")).withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    starts = materialize(starts.select(by, "_part", "_base", "total"), "starts")
    size = starts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(by).cast("string"))), F.lit(0)).alias("b")).first()
    if size["n"] <= SMALL and size["b"] <= SENT_BYTES:
        starts = F.broadcast(starts)
    return dealt.join(starts, [by, "_part"]).withColumn("pos", F.col("_inside") + F.col("_base")).drop("_part", "_inside", "_base")
