"""A keyed table that is changed without being rewritten: hash buckets of the key, and states that say where each one is.

Under the location, `data/version=.../bucket=...` holds rows, `keys/version=.../bucket=...` a Bloom filter of a bucket's keys,
and `states` one small file for each state: the version of every bucket. A write makes new files for the buckets that it
touches, and then a new state. Readers take the newest state when they begin and stay with it, so they see a write whole
or not at all, and no file that they read is replaced. A state's number is claimed by creating a file that must not exist,
so of two writers from one state the second is told (Conflict) and nothing is lost.

Defined cases: a null key or a key that repeats in a source fails the write; a source without rows makes no state; a bucket
that loses its last row is no longer listed; vacuum() removes what no kept state names."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from korvane.functions import bloom
from korvane.sources.stored import materialize

#: Blocks (of 512 bits) of a bucket's filter for each thousand rows that it is meant for: 16 bits a key.
BLOCKS_PER_THOUSAND = 32


class Conflict(RuntimeError):
    """Another writer has made, or begun, the state that was to be made."""


@dataclass(frozen=True)
class State:
    number: int
    versions: dict[int, str]


class BucketTable:
    """A table under a location. create() makes one, BucketTable(spark, location) opens it."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")
        about = json.loads(self._text(f"{self.location}/table.json"))
        self.key, self.buckets, self.blocks, self.schema = about["key"], about["buckets"], about["blocks"], StructType.fromJson(about["schema"])

    @classmethod
    def create(cls, df: DataFrame, location: str, key: str, buckets: int = 64, rows_a_bucket: int = 100_000) -> BucketTable:
        """A new table with df's rows. buckets: so many that one is a file of a good size; it stays."""
        spark, table = df.sparkSession, cls.__new__(cls)
        table.spark, table.location, table.key, table.buckets, table.schema = spark, location.rstrip("/"), key, buckets, df.schema
        table.blocks = max(1, rows_a_bucket * BLOCKS_PER_THOUSAND // 1000)
        about = {"key": key, "buckets": buckets, "blocks": table.blocks, "schema": df.schema.jsonValue()}
        table._write_text(f"{table.location}/table.json", json.dumps(about))
        table._publish(State(0, {}))
        table.upsert(df)
        return table

    # files

    def _path(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _text(self, path: str) -> str:
        fs, where = self._path(path)
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write_text(self, path: str, text: str) -> None:
        """All at once: a file of another name, renamed."""
        fs, where = self._path(path)
        _, draft = self._path(f"{path}.{uuid.uuid4().hex}.draft")
        stream = fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not fs.rename(draft, where):
            raise Conflict(f"{path} is there")

    def _names(self, path: str) -> list[str]:
        fs, where = self._path(path)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    # states

    def _numbers(self) -> list[int]:
        return sorted(int(n[6:-5]) for n in self._names(f"{self.location}/states") if n.startswith("state-") and n.endswith(".json"))

    def state(self, number: int | None = None) -> State:
        """The newest state, or one of those kept."""
        number = self._numbers()[-1] if number is None else number
        got = json.loads(self._text(f"{self.location}/states/state-{number:012}.json"))
        return State(number, {int(b): v for b, v in got.items()})

    def _claim(self, number: int) -> None:
        fs, where = self._path(f"{self.location}/states/claim-{number:012}")
        try:
            fs.create(where, False).close()
        except Exception as e:
            raise Conflict(f"state {number} is made or begun; if its writer has died, abandon({number}) frees it") from e

    def _publish(self, state: State) -> None:
        self._write_text(f"{self.location}/states/state-{state.number:012}.json", json.dumps(state.versions))

    def abandon(self, number: int) -> None:
        """Free the number of a state whose writer died before the state was there."""
        if number not in self._numbers():
            fs, where = self._path(f"{self.location}/states/claim-{number:012}")
            fs.delete(where, False)

    # rows

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _scan(self, kind: str, schema: StructType, state: State, buckets: list[int] | None) -> DataFrame:
        full = StructType([*schema.fields]).add("bucket", IntegerType())
        paths = [f"{self.location}/{kind}/version={v}/bucket={b}" for b, v in sorted(state.versions.items()) if buckets is None or b in set(buckets)]
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(StructType([*full.fields]).add("version", StringType())).option("basePath", f"{self.location}/{kind}").parquet(*paths).drop("version")

    def read(self, state: State | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a state (the newest one of now), of all buckets or some."""
        return self._scan("data", self.schema, state or self.state(), buckets).drop("bucket")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of a frame's keys: a number for each bucket at most."""
        return sorted(r["b"] for r in keys.select(self._bucket(F.col(self.key)).alias("b")).distinct().collect())

    def _write(self, rows: DataFrame, touched: list[int], base: State) -> State:
        """A new state in which rows are what the touched buckets hold."""
        self._claim(base.number + 1)
        version = uuid.uuid4().hex
        try:
            placed = rows.select(*self.schema.names).withColumn("bucket", self._bucket(F.col(self.key)))
            placed.repartition("bucket").sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(f"{self.location}/data/version={version}")
            there = {int(n.removeprefix("bucket=")) for n in self._names(f"{self.location}/data/version={version}") if n.startswith("bucket=")}
            new = State(base.number + 1, {b: v for b, v in base.versions.items() if b not in set(touched)} | {b: version for b in there})
            if there:
                keys = self._scan("data", self.schema, State(0, {b: version for b in there}), None)
                bloom.filters(keys, "bucket", self.key, self.blocks).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.location}/keys/version={version}")
            self._publish(new)
        except BaseException:
            self.abandon(base.number + 1)
            raise
        return new

    def upsert(self, source: DataFrame) -> State:
        """source's rows in place of those with the same key. Only the buckets of its keys are read and written."""
        source = materialize(source.select(*self.schema.names), "source")
        base, touched = self.state(), self.touched(source)
        if not touched:
            return base
        once = source.groupBy(self.key).agg(F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in self.schema.names if c != self.key])
        valid = F.assert_true(F.col(self.key).isNotNull() & (F.col("n") == 1), F.lit("a key is null or repeats in the source of an upsert"))
        once = once.withColumn(self.key, F.when(valid.isNull(), F.col(self.key)))
        old = self.read(base, touched).join(source.select(self.key), self.key, "left_anti")
        return self._write(old.select(*self.schema.names).unionByName(once.select(*self.schema.names)), touched, base)

    def delete(self, keys: DataFrame) -> State:
        """The table without the rows of some keys."""
        keys = materialize(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct(), "gone")
        base, touched = self.state(), self.touched(keys)
        touched = [b for b in touched if b in base.versions]
        if not touched:
            return base
        return self._write(self.read(base, touched).join(keys, self.key, "left_anti"), touched, base)

    def split(self, rows: DataFrame, key: str, state: State | None = None) -> tuple[DataFrame, DataFrame]:
        """rows whose key the filters exclude, and those whose key may be stored. Only filters are read."""
        state = state or self.state()
        placed = rows.withColumn("_bucket", self._bucket(F.col(key))).withColumn("_block", bloom.place(F.col(key).cast(self.schema[self.key].dataType), self.blocks))
        words = StructType()
        for c in ("block", *bloom.NAMES):
            words.add(c, LongType())
        held = self._scan("keys", words, state, self._buckets_of(placed))
        met = placed.join(held.withColumnsRenamed({"bucket": "_bucket", "block": "_block"}), ["_bucket", "_block"], "left")
        met = met.withColumn("_maybe", bloom.maybe(F.col(key).cast(self.schema[self.key].dataType)) & F.col(key).isNotNull())
        met = materialize(met.select(*rows.columns, "_bucket", "_maybe"), "met")
        return met.where("NOT _maybe").select(*rows.columns), met.where("_maybe").select(*rows.columns, "_bucket")

    def _buckets_of(self, placed: DataFrame) -> list[int]:
        return [r["_bucket"] for r in placed.select("_bucket").distinct().collect()]  # a number for each bucket at most

    def absent(self, rows: DataFrame, key: str, state: State | None = None) -> DataFrame:
        """rows whose key is not stored. Rows of a bucket are read only if a filter lets one of its keys pass, and of them only keys."""
        state = state or self.state()
        surely, perhaps = self.split(rows, key, state)
        stored = self.read(state, self._buckets_of(perhaps)).select(F.col(self.key).alias(key))
        return surely.unionByName(perhaps.drop("_bucket").join(stored, key, "left_anti").select(*rows.columns))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the states but the newest `keep`, and versions that none of them names. Readers of older states must have ended."""
        numbers = self._numbers()
        stay = [self.state(n) for n in numbers[-max(1, keep) :]]
        used, gone = {v for s in stay for v in s.versions.values()}, []
        for n in numbers[: -max(1, keep)]:
            for name in (f"state-{n:012}.json", f"claim-{n:012}"):
                fs, where = self._path(f"{self.location}/states/{name}")
                fs.delete(where, False)
        for kind in ("data", "keys"):
            for name in self._names(f"{self.location}/{kind}"):
                if name.startswith("version=") and name.removeprefix("version=") not in used:
                    fs, where = self._path(f"{self.location}/{kind}/{name}")
                    fs.delete(where, True)
                    gone.append(f"{kind}/{name}")
        return gone
