"""The keyed table: what a write touches, what readers see, and what the filters save."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from korvane.operators import backfill as B
from korvane.operators.models import HashingEncoder
from korvane.sources import catalog as C
from korvane.sources.buckets import BucketTable, Conflict
from korvane.sources.schemas import EMBEDDINGS, PRODUCTS
from korvane.streaming import outbox as O

N = 2000


def rows(spark, ids, value="a"):
    return spark.createDataFrame([(i, f"{value}{i}") for i in ids], "k long, v string")


def content(df):
    return {r["k"]: r["v"] for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    return BucketTable.create(rows(spark, range(N)), str(tmp_path / "t"), "k", 8, 500)


def test_one_key_writes_one_bucket(spark, table):
    before = table.state()
    after = table.upsert(rows(spark, [5], "b"))
    assert len(before.versions) == 8 and sum(after.versions[b] != v for b, v in before.versions.items()) == 1
    assert table._names(f"{table.location}/data/version={after.versions[table.touched(rows(spark, [5]))[0]]}").count("_SUCCESS") == 1
    assert content(table.read()) == {i: f"b{i}" if i == 5 else f"a{i}" for i in range(N)}
    table.upsert(rows(spark, [5, N + 7], "c"))
    assert content(table.read())[N + 7] == f"c{N + 7}" and table.read().count() == N + 1
    assert BucketTable(spark, table.location).state() == table.state()


def test_a_reader_sees_one_state(spark, table):
    reader = table.read()
    table.upsert(rows(spark, range(0, N, 2), "b"))
    table.delete(rows(spark, range(1, N, 2)))
    assert content(reader) == {i: f"a{i}" for i in range(N)}
    assert content(table.read()) == {i: f"b{i}" for i in range(0, N, 2)}
    assert content(table.read(table.state(1))) == content(reader)


def test_a_failed_write_changes_nothing(spark, table):
    state = table.state()
    for bad in (rows(spark, [1, 1]), spark.createDataFrame([(None, "x")], "k long, v string")):
        with pytest.raises(Exception, match="repeats"):
            table.upsert(bad)
    assert table.state() == state and content(table.read())[1] == "a1"
    assert table.upsert(rows(spark, [1], "z")).number == state.number + 1  # the number is free again


def test_of_two_writers_one_is_told(spark, table):
    base = table.state()
    table._claim(base.number + 1)  # another writer has begun
    with pytest.raises(Conflict):
        table.upsert(rows(spark, [1], "b"))
    assert table.state() == base
    table.abandon(base.number + 1)
    table.upsert(rows(spark, [1], "b"))
    with pytest.raises(Conflict):
        table._write(rows(spark, [2], "c"), [0], base)  # from a state that is no longer the newest
    assert content(table.read())[1] == "b1"


def test_delete_vacuum_and_no_rows(spark, table, tmp_path):
    assert table.upsert(rows(spark, [])) == table.state() == table.delete(rows(spark, [N + 1, N + 2]).where("k < 0"))
    table.delete(rows(spark, range(N)))
    assert table.read().count() == 0 and table.state().versions == {}
    table.upsert(rows(spark, [3]))
    gone = table.vacuum()
    assert gone and content(table.read()) == {3: "a3"} and table._numbers() == [table.state().number]
    empty = BucketTable.create(rows(spark, []), str(tmp_path / "e"), "k", 4)
    assert empty.read().count() == 0 and empty.absent(rows(spark, [1]), "k").count() == 1


def test_absent(spark, table):
    asked = rows(spark, [*range(-50, 50), N + 1]).unionByName(spark.createDataFrame([(None, "n")], "k long, v string"))
    assert sorted(str(r["k"]) for r in table.absent(asked, "k").collect()) == sorted(map(str, [*range(-50, 0), N + 1, None]))


def test_new_keys_read_no_rows(spark, table):
    """Bloom filters answer for keys that are not stored; of those that pass only their buckets' files are read."""
    surely, perhaps = table.split(rows(spark, range(10 * N, 11 * N)), "k")
    assert surely.count() > 0.98 * N and perhaps.count() < 0.02 * N
    files = table.absent(rows(spark, [10 * N]), "k").inputFiles()
    assert not any("/data/" in f for f in files)
    files = [f for f in table.absent(rows(spark, [7]), "k").inputFiles() if "/data/" in f]
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1


@pytest.fixture(scope="module")
def made(spark):
    return C.generate(spark, 400).cache()


def test_fill_takes_up_what_is_missing(spark, made, tmp_path):
    table, encoder = BucketTable.create(spark.createDataFrame([], EMBEDDINGS), str(tmp_path / "v"), "product_id", 4), HashingEncoder(8)
    assert B.fill(made.where("id <= 25"), table, encoder) == 25
    first = table.read()
    assert B.fill(made.where("id <= 40"), table, encoder) == 15 and B.fill(made.where("id <= 40"), table, encoder) == 0
    assert sorted(r["product_id"] for r in table.read().collect()) == list(range(1, 41)) and first.exceptAll(table.read()).count() == 0


def test_a_stream_repeats_without_repeating_rows(spark, made, tmp_path):
    table, source = BucketTable.create(spark.createDataFrame([], EMBEDDINGS), str(tmp_path / "v"), "product_id", 4), str(tmp_path / "in")
    for ids, checkpoint in (("id <= 20", "a"), ("id BETWEEN 15 AND 30", "a"), ("id <= 0", "b")):  # b: everything once more
        made.where(ids).write.mode("append").parquet(source)
        O.stream_fill(spark.readStream.schema(PRODUCTS).parquet(source), table, HashingEncoder(8), str(tmp_path / checkpoint)).awaitTermination()
    assert sorted(r["product_id"] for r in table.read().collect()) == list(range(1, 31))
