"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Where that is unset, a folder of our own serves a local session; on a cluster there is no such folder, so it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "/tmp/korvane-checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def arrow_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes too: texts may be very long. A session that has its own bound keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.isModifiable(key) or spark.sparkContext.getConf().contains(key):
        return
    spark.conf.set(key, BATCH_BYTES)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. For tasks, which have no JVM to ask."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


_written: dict[str, None] = {}  # in order


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted with the tables."""
    path = f"{shared_dir(spark)}/korvane-{name}-{uuid.uuid4().hex}"
    _written[path] = None
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    arrow_batches(spark)
    path = folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._korvane_path = path
    return out


@contextlib.contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Executors delete the shuffle files of what is written in here as soon as it is written, not when the driver happens to collect its garbage. Not for what hold() keeps."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if not spark.conf.isModifiable(key):
        yield
        return
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def bucketed(df: DataFrame, by: str, n: int, name: str) -> DataFrame:
    """materialize() in n files by a hash of a column: what needs rows together by it reads them without a shuffle. The name that the catalog has for it meanwhile is dropped at once."""
    spark = df.sparkSession
    path, title = folder(spark, name), f"korvane_{name}_{uuid.uuid4().hex}"
    with freeing(spark):
        df.repartition(n, by).write.option("path", path).option("compression", "zstd").bucketBy(n, by).saveAsTable(title)
    out = spark.table(title)
    out.schema  # analysed, so that it stays a table of buckets
    spark.sql(f"DROP TABLE {title}")
    out._korvane_path = path
    return out


_held: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    """persist() until sweep(): executors keep df, and what a lost one kept is computed again."""
    arrow_batches(df.sparkSession)
    _held.append(df.persist())
    return df


def let_go(*frames: DataFrame) -> None:
    """Give up what hold() keeps, once nothing reads it any more."""
    for df in frames:
        df.unpersist()
        _held[:] = [h for h in _held if h is not df]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_korvane_path", None)
        if path:
            _delete(df.sparkSession, path)


def sweep(spark: SparkSession, *keep: DataFrame) -> None:
    """Delete all tables of this driver but those in keep, and let go of what hold() keeps. For callers who have written a lazy result: it may read either until then."""
    while _held:
        _held.pop().unpersist()
    kept = {getattr(df, "_korvane_path", None) for df in keep}
    for path in [p for p in _written if p not in kept]:
        _delete(spark, path)


@atexit.register
def _at_exit() -> None:
    """What lazy results still read goes with the driver."""
    spark = SparkSession.getActiveSession() if _written else None
    if spark is not None:
        with contextlib.suppress(Exception):  # the JVM may have ended before
            sweep(spark)
