"""Distances: values, and properties over random vectors."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from korvane.functions.vector import cosine_distance


def distances(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<float>, b array<float>")
    return [r["d"] for r in df.withColumn("d", cosine_distance(F.col("a"), F.col("b"))).orderBy("i").collect()]


def test_values(spark):
    got = distances(spark, [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [3.0, 6.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])])
    assert got[:4] == pytest.approx([0, 2, 1, 0], abs=1e-12) and got[4:] == [None, None]


def test_properties(spark):
    rng = random.Random(6)
    v = lambda: [rng.gauss(0, 1) for _ in range(16)]
    pairs = [(v(), v()) for _ in range(100)]
    d = distances(spark, pairs)
    assert all(-1e-12 <= x <= 2 + 1e-12 for x in d)
    assert distances(spark, [(b, a) for a, b in pairs]) == pytest.approx(d, abs=1e-12)
    assert distances(spark, [([3 * x for x in a], b) for a, b in pairs]) == pytest.approx(d, abs=1e-6)
    assert distances(spark, [(a, a) for a, _ in pairs]) == pytest.approx([0] * 100, abs=1e-12)
