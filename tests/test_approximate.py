"""The approximate search against a plain join over its cells."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from korvane.functions.vector import cosine_distance
from korvane.operators import search as S
from korvane.operators.filters import FilterSpec
from korvane.plans.queries import gone
from korvane.sources.catalog import product_embeddings, products


def cell(v, planes, seed):
    out = F.lit(0).cast("long")
    for p in range(planes):
        normal = F.transform(F.sequence(F.lit(1), F.size(v)), lambda i: (F.pmod(F.xxhash64(i, F.lit(p), F.lit(seed)), F.lit(2001)) - 1000).cast("double"))  # noqa: B023
        s = F.aggregate(F.zip_with(v, normal, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, b: a + b)
        out = out + F.when(s > 0, F.lit(1 << p)).otherwise(0).cast("long")
    return out


def plain(p, e, queries, k, planes, tables):
    found = S.candidates(p, e, FilterSpec(), gone()).where("embedding IS NOT NULL")
    cells = lambda v: F.array(*[F.struct(F.lit(t).alias("t"), cell(v, planes, t).alias("c")) for t in range(tables)])
    met = found.select("id", F.explode(cells(F.col("embedding"))).alias("cell")).join(queries.select("qid", F.explode(cells(F.col("q"))).alias("cell")), "cell").select("qid", "id").distinct()
    scored = met.join(found.select("id", "embedding"), "id").join(queries, "qid").withColumn("distance", cosine_distance(F.col("embedding"), F.col("q")))
    order = Window.partitionBy("qid").orderBy(F.col("distance").asc_nulls_last(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "distance")


def test_equals_the_plain_join(spark, sf):
    p = products(spark, sf).cache()
    rng, ids = random.Random(5), [r[0] for r in p.select("id").collect()]
    odd = [[0.0] * 8, [], [1.0, None] + [1.0] * 6, [float("nan")] + [1.0] * 7, [float("inf"), float("-inf")] + [1.0] * 6, [1.0, 2.0], [1.0] * 11, None, [1e-30] * 8]
    some = lambda n: odd[n] if n < len(odd) else [rng.choice([-1.0, 0.0, 0.5, rng.gauss(0, 1)]) for _ in range(8)]
    e = spark.createDataFrame([(i, some(n if n % 2 else n // 2)) for n, i in enumerate(ids)], "product_id long, embedding array<float>").cache()
    q = spark.createDataFrame([(n, some(n)) for n in range(40)], "qid long, q array<float>").cache()
    sort = lambda df: sorted(map(str, df.collect()))
    for k, planes, tables in ((1, 5, 2), (3, 3, 4), (500, 9, 1)):
        want = sort(plain(p, e, q, k, planes, tables))
        assert want
        assert sort(S.search_approximate(p, e, q, k, planes, tables, gone())) == want
        assert sort(S.search_approximate(p, e, q, k, planes, tables, gone(), pack_bytes=1000)) == want
    assert S.search_approximate(p, e, q.limit(0), deleted=gone()).count() == S.search_approximate(p, e.limit(0), q, deleted=gone()).count() == S.search_approximate(p, e, q, 0, deleted=gone()).count() == 0


def test_pairs_stay_in_the_tasks(spark):
    """What leaves a task is bounded by its queries' nearest, not by the pairs that share a cell."""
    sf = "/root/testdata/sf0.01"
    e = product_embeddings(spark, sf).where("embedding IS NOT NULL")
    q = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    out = S.search_approximate(products(spark, sf), e, q, 2, deleted=gone())
    assert out.count() == 2 * q.count()
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
