"""The ledger of model calls."""

from __future__ import annotations

import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from korvane.operators.ledger import Remembered, TimeOut, ask, call_all, key_column, key_of
from korvane.operators.models import HashingEncoder, RuleBased
from korvane.plans.recommend import recommend_batch
from korvane.sources.catalog import product_embeddings, products


class Counting:
    """Writes a file for each call. `dies`: the worker ends after so many calls, once."""

    def __init__(self, folder, dies=0):
        self.folder, self.dies = str(folder), dies

    def calls(self) -> int:
        return sum(1 for f in Path(self.folder).iterdir() if f.name.startswith("call"))

    def chat(self, system, user, max_tokens):
        if user == "fails":
            raise ValueError("no")
        if user == "hangs":
            time.sleep(30)
        Path(self.folder, f"call-{time.time_ns()}-{os.getpid()}").touch()
        if self.dies and self.calls() > self.dies:
            try:
                Path(self.folder, "died").touch(exist_ok=False)
            except FileExistsError:
                pass
            else:
                time.sleep(0.5)  # replies of the other calls under way are kept
                Path(self.folder, "lost").touch()
                os._exit(1)
        return RuleBased().chat(system, user, max_tokens) if system else f"{user}!"


def requests(spark, users):
    return spark.createDataFrame([(i, "", u) for i, u in enumerate(users)], "id long, system string, user string")


def test_equal_requests_are_one_call_and_none_later(spark, tmp_path):
    model = Counting(tmp_path)
    kept = Remembered(model, "m", str(tmp_path / "ledger"))
    users = [f"u{i % 40}" for i in range(300)] + [None]
    for _ in range(2):
        got = ask(requests(spark, users), kept, 9).collect()
        assert len(got) == 301 and all(r["reply"] == f"{r['user']}!" and r["error"] is None for r in got if r["user"]) and model.calls() == 40
        assert [r["error"] for r in got if r["user"] is None] == ["null request"]
    assert kept.compact(spark) == 40 and kept.compact(spark) == 0
    assert ask(requests(spark, [*users, "new"]), kept, 9).where("reply IS NULL").count() == 1 and model.calls() == 41
    assert ask(requests(spark, ["u1"]), Remembered(model, "other", kept.location), 9).count() == 1 and model.calls() == 42


def test_failures_and_time_outs_are_rows_and_are_asked_again(spark, tmp_path):
    model = Counting(tmp_path)
    kept = Remembered(model, "m", str(tmp_path / "ledger"), seconds=1.0)
    begun = time.monotonic()
    for _ in range(2):
        got = {r["user"]: r for r in ask(requests(spark, ["a", "fails", "hangs", "b"]), kept, 9, tasks=1).collect()}
        assert got["a"]["reply"] == "a!" and got["fails"]["error"] == "ValueError: no" and got["hangs"]["error"].startswith("TimeOut") and got["b"]["reply"] == "b!"
    assert model.calls() == 2 and time.monotonic() - begun < 25
    with pytest.raises(TimeOut):
        kept.chat("", "hangs", 9)


def test_calls_under_way_are_bounded():
    now, most = [], []

    def call(i):
        now.append(i)
        most.append(len(now))
        time.sleep(0.01)
        now.remove(i)
        return i

    assert sorted(i for i, _, _ in call_all(list(range(30)), call, 3, 5)) == list(range(30)) and max(most) <= 3


def test_a_worker_that_dies_loses_only_the_call_under_way(spark, tmp_path):
    """The attempt begins anew: what was answered before is read from the journal."""
    model = Counting(tmp_path, dies=12)
    kept = Remembered(model, "m", str(tmp_path / "ledger"))
    users = [f"u{i}" for i in range(40)]
    with pytest.raises(Exception, match="(?i)worker|crash|exit"):  # local sessions do not try a task again
        ask(requests(spark, users), kept, 9, tasks=1, at_once=1).collect()
    assert Path(tmp_path, "died").exists()
    got = ask(requests(spark, users), kept, 9, tasks=1, at_once=1).collect()
    assert len(got) == 40 and all(r["reply"] == f"{r['user']}!" for r in got)
    assert model.calls() == 41  # the one that was lost, twice


def test_keys_are_the_same_in_both_forms(spark):
    df = spark.createDataFrame([("s", "가"), ("", ""), ("s1:", "x")], "s string, u string")
    for r in df.select("*", key_column("m", F.col("s"), F.col("u"), 5).alias("k")).collect():
        assert r["k"] == key_of("m", r["s"], r["u"], 5)


def test_a_batch_over_the_ledger_calls_once(spark, sf, tmp_path):
    model = Counting(tmp_path)
    kept = Remembered(model, "rules", str(tmp_path / "ledger"))
    p, e = products(spark, sf), product_embeddings(spark, sf)
    asked = spark.createDataFrame([(1, "봄 신발"), (2, "여성 가방 10만원 이하")], "qid long, query string")
    encoder = HashingEncoder(len(e.where("embedding IS NOT NULL").first()["embedding"]))
    run = lambda: sorted(map(str, recommend_batch(p, e, asked, encoder, kept, k=5, deleted=F.col("is_deleted")).collect()))
    first = run()
    n = model.calls()
    assert len(first) == 2 and 0 < n <= 4 and run() == first and model.calls() == n
