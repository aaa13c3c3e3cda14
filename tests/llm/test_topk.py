"""Top-k against a full scan."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from korvane.llm.topk import OP1_SQL, top_k

SCHEMA = "vec_id long, embedding array<float>, query_id string, score double"  # the last two clash with columns of the result


def scan(rows, asks, k=5):
    vectors = [(i, [math.floor(float(np.float32(x)) * 256) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in vectors if asks(i)}:
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for j, own in vectors if j == q for i, v in vectors if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def got(df, every=7):
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % every == 0).collect())


def test_equals_a_full_scan(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(0, 0.4, (1500, 8)).astype("float32")
    points[300:900] = points[300]  # a vector that a third of all rows share
    rows = [(i, [float(x) for x in p], "x", 1.0) for i, p in enumerate(points)]
    rows += [(2000, None, "x", 1.0), (2001, [1.0, None], "x", 1.0), (2002, [float("nan")] * 8, "x", 1.0), (2003, [float("inf")] * 8, "x", 1.0), (None, [1.0] * 8, "x", 1.0)]
    rows += [(2100, [], "x", 1.0), (2107, [0.5, 0.5], None, None), (2114, [0.0] * 8, "x", 1.0)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == scan(rows, lambda i: i % 7 == 0)


def test_repeated_ids_few_rows_and_no_rows(spark):
    rows = [(0, [0.5, 0.1], "x", 1.0), (0, [0.5, 0.1], "x", 1.0), (0, [0.2, 0.9], "x", 1.0), (3, [1.0, 1.0], "x", 1.0), (14, [-1.0, 0.0], "x", 1.0)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == scan(rows, lambda i: i % 7 == 0)
    assert got(spark.createDataFrame(rows[:1], SCHEMA)) == []
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_large_components_are_not_cut(spark):
    rows = [(0, [1.0, 0.0], "x", 1.0), (1, [5000.0, 0.0], "x", 1.0), (2, [6000.0, 0.0], "x", 1.0), (3, [5999.0, 1.0], "x", 1.0)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == scan(rows, lambda i: i % 7 == 0)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 2e6, 3)], "x", 1.0) for i in range(60)]  # products beyond 2^53
    assert got(spark.createDataFrame(rows, SCHEMA)) == scan(rows, lambda i: i % 7 == 0)
    rows = [(0, [1e30, 1.0], "x", 1.0), (1, [-1e30, 2.0], "x", 1.0), (2, [3e38, 0.0], "x", 1.0)]  # scores that no long holds
    assert [r[2:] for r in got(spark.createDataFrame(rows, SCHEMA))] == [(2, 2**63 - 1), (1, -(2**63))]


def test_equals_the_sql_on_repeated_ids(spark):
    import duckdb

    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 200)), [float(np.float32(x)) for x in rng.normal(0, 30, 6)]) for _ in range(600)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 50) == sorted(con.execute(OP1_SQL).fetchall())
