"""A ledger of model calls: replies are kept by a hash of model, prompt and request, and no call is made twice.

A reply is a file of its own in the ledger's journal as soon as it is there, so a task that dies after its calls, and
whoever asks the same later, finds them. `compact` moves the journal into Parquet files."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from queue import Empty, SimpleQueue

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.operators.models import LanguageModel
from korvane.sources.stored import materialize, opened

SCHEMA = "key string, reply string"


def key_of(model: str, system: str, user: str, max_tokens: int) -> str:
    """Lengths are hashed too, so that no two requests run into one another."""
    parts = [model, system, user, str(max_tokens)]
    return hashlib.sha256("".join(f"{len(p.encode('utf-8', 'surrogatepass'))}:{p}" for p in parts).encode("utf-8", "surrogatepass")).hexdigest()


def key_column(model: str, system: Column, user: Column, max_tokens: int) -> Column:
    """key_of() as a column."""
    sized = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(*map(sized, (F.lit(model), system, user, F.lit(str(max_tokens))))), 256)


class TimeOut(Exception):
    pass


def call_all(asked: list, call: Callable, at_once: int, seconds: float) -> Iterator[tuple[int, str | None, Exception | None]]:
    """Place, reply and error of each call, as they come, at most `at_once` under way.

    A call that takes longer than `seconds` is an error; its thread is left behind, as a call cannot be broken off."""
    done: SimpleQueue = SimpleQueue()
    running: dict[int, float] = {}

    def one(i: int) -> None:
        try:
            done.put((i, call(asked[i]), None))
        except Exception as e:  # noqa: BLE001  a model may fail in any way
            done.put((i, None, e))

    following = 0
    while running or following < len(asked):
        while following < len(asked) and len(running) < at_once:
            running[following] = time.monotonic() + seconds
            threading.Thread(target=one, args=(following,), daemon=True).start()
            following += 1
        try:
            i, reply, error = done.get(timeout=max(0.0, min(running.values()) - time.monotonic()))
            if running.pop(i, None) is not None:  # else it came after its time
                yield i, reply, error
        except Empty:
            for i in [i for i, end in running.items() if end <= time.monotonic()]:
                del running[i]
                yield i, None, TimeOut(f"no reply within {seconds} s")


class Remembered:
    """A language model that looks in the ledger before it calls. It serves wherever a model does.

    `name` has to change when the model's answers may."""

    def __init__(self, model: LanguageModel, name: str, location: str, seconds: float = 60.0):
        self.model, self.name, self.location, self.seconds = model, name, location.rstrip("/"), seconds

    def _file(self, key: str) -> str:
        return f"journal/{key[:2]}/{key}.json"

    def look(self, key: str) -> str | None:
        """The reply in the journal."""
        files, root = opened(self.location)
        try:
            with files.open_input_stream(f"{root}/{self._file(key)}") as f:
                return json.loads(f.read())["reply"]
        except FileNotFoundError:
            return None

    def keep(self, key: str, reply: str) -> None:
        """Whole or not at all: written beside its place, then moved there."""
        files, root = opened(self.location)
        place = f"{root}/{self._file(key)}"
        files.create_dir(place.rpartition("/")[0], recursive=True)
        aside = f"{root}/aside-{uuid.uuid4().hex}"
        with files.open_output_stream(aside) as f:
            f.write(json.dumps({"key": key, "reply": reply}).encode())
        files.move(aside, place)

    def answer(self, system: str, user: str, max_tokens: int) -> str:
        key = key_of(self.name, system, user, max_tokens)
        found = self.look(key)
        if found is None:
            found = self.model.chat(system, user, max_tokens)
            self.keep(key, found)
        return found

    def chat(self, system: str, user: str, max_tokens: int) -> str:
        ((_, reply, error),) = call_all([user], lambda u: self.answer(system, u, max_tokens), 1, self.seconds)
        if error is not None:
            raise error
        return reply

    def table(self, spark: SparkSession) -> DataFrame:
        """key and reply of what has been compacted."""
        files, root = opened(self.location)
        there = [f for f in files.get_file_info(fs.FileSelector(f"{root}/replies", allow_not_found=True)) if f.type == fs.FileType.Directory]
        if not there:
            return spark.createDataFrame([], SCHEMA)
        return spark.read.schema(SCHEMA).parquet(*(f"{self.location}/replies/{f.base_name}" for f in there))

    def compact(self, spark: SparkSession) -> int:
        """Move the journal into the table, and return how many replies moved. A reply may be in both for a while; readers take either.

        Not for two at once, nor while calls are made."""
        files, root = opened(self.location)
        folders = [f for f in files.get_file_info(fs.FileSelector(f"{root}/journal", allow_not_found=True)) if f.type == fs.FileType.Directory]  # 256 at most
        if not folders:
            return 0
        new = spark.read.schema(SCHEMA).json([f"{self.location}/journal/{f.base_name}" for f in folders])
        path = f"{self.location}/replies/{uuid.uuid4().hex}"
        new.sort("key").write.parquet(path)
        for f in folders:
            files.delete_dir(f"{root}/journal/{f.base_name}")
        return spark.read.schema(SCHEMA).parquet(path).count()


def ask(requests: DataFrame, model: Remembered, max_tokens: int, tasks: int = 8, at_once: int = 4) -> DataFrame:
    """requests (system, user, ...) with reply and error. Equal requests are one call, and what the ledger has is none.

    At most `tasks` times `at_once` calls are under way on the whole cluster. A null request is an error without a call. Errors are not kept: asking again tries again."""
    spark = requests.sparkSession
    keyed = requests.withColumn("key", key_column(model.name, F.col("system"), F.col("user"), max_tokens))
    once = keyed.where("key IS NOT NULL").groupBy("key").agg(F.any_value("system").alias("system"), F.any_value("user").alias("user"))
    stored = model.table(spark)
    todo = materialize(once.join(stored, "key", "left_anti"), "requests")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asked = list(zip(b["system"], b["user"], strict=True))
            rows = [(b["key"].iloc[i], reply, None if error is None else f"{type(error).__name__}: {error}") for i, reply, error in call_all(asked, lambda a: model.answer(*a, max_tokens), at_once, model.seconds)]
            yield pd.DataFrame(rows, columns=["key", "reply", "error"])

    got = materialize(todo.repartition(tasks, "key").mapInPandas(run, f"{SCHEMA}, error string"), "replies")
    known = stored.join(once.select("key"), "key", "left_semi").dropDuplicates(["key"])
    all_ = got.unionByName(known.withColumn("error", F.lit(None).cast("string")))
    out = keyed.join(all_, "key", "left").drop("key")
    return out.withColumn("error", F.when(F.col("system").isNull() | F.col("user").isNull(), "null request").otherwise(F.col("error")))
