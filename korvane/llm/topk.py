"""Exact top-k by inner product: a pivot-distance index.

Components become floor(256 x). So that the largest inner product is the smallest distance, each vector x gets one
more coordinate, sqrt(M^2 - |x|^2), and a query gets 0 there: |q - x|^2 = |q|^2 + M^2 - 2 q.x, M being the largest
length of all.

  index   Each vector is keyed by its nearest pivot and its distance to it. Pivots are a bounded sample (PIVOTS
          vectors, those with the smallest hashes); all vectors are indexed. The table is sorted by pivot, distance
          and id over all partitions, and runs of one pivot are packed into annuli of at most ANNULUS vectors with
          their least and greatest distance. A vector that many rows share just fills more annuli.
  seed    A query is a row of the index: the k-th best score within its own annulus bounds its search radius.
  search  Queries, in packs of like keys, meet the annuli of each pivot that a radius can reach: with D = d(q, pivot)
          no vector of an annulus [a, b] is nearer than max(D - b, a - D). A task takes a pack's annuli by that
          bound, nearest first, and passes over those whose bound exceeds the k-th distance found so far. Vectors
          are sent only for pairs of pack and annulus that the seeds' radii leave.

Distances are compared with a margin for rounding, scores are exact integers (in floating point while they stay below
2^53, in 64-bit integers beyond), so the result is that of a full scan.

Packs hold up to PACK queries, so each vector is sent once for thousands of queries that can reach its annulus, not once
for each query.

Defined cases: rows whose vec_id or vector is null, or whose vector holds a null, NaN or infinite component, take no
part; a shorter vector counts as padded with zeros; an empty vector is a zero vector; rows that repeat a vec_id all
count, as candidates of other ids and, if asked, as queries whose best rows are ranked together; rows of one id are never
each other's candidates; ties go to the smaller vec_id; a score that a long cannot hold is cut to the nearest that it
can, and where products reach 2^62 scores have the precision of a double; empty tables give no rows; other columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvane.llm.common import discard, materialize, table

PIVOTS = 64
ANNULUS = 512
PACK = 2048
K = 5


def vectors(df: DataFrame) -> DataFrame:
    """vec_id and its integer vector v, for every row that takes part."""
    x = F.col("embedding")
    whole = df.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    most = float(1 << 62)  # a long holds it
    scaled = F.transform(x, lambda c: F.floor(F.least(F.greatest(c.cast("double") * 256, F.lit(-most)), F.lit(most))))
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def matrix(rows, dim: int) -> np.ndarray:
    """Rows of integers, padded with zeros."""
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def lifted(m: np.ndarray, top2: float | None) -> np.ndarray:
    m = m.astype(float)
    last = np.zeros(len(m)) if top2 is None else np.sqrt(np.maximum(0, top2 - (m**2).sum(1)))
    return np.concatenate([m, last[:, None]], 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    if len(scores) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def top_k(df: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for each vector that is_query (of vec_id) holds for."""
    spark = df.sparkSession
    every = materialize(vectors(df).withColumn("asks", F.coalesce(is_query, F.lit(False))), "vectors")
    facts = every.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)).alias("top2"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    if not facts["n"] or k < 1:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, dim, top2, top = facts["n"], max(1, facts["dim"]), float(facts["top2"]), facts["top"] or 0
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    most = top2 * (1 + 1e-9)  # no inner product, nor a part of one, exceeds the greatest squared length
    number, none = (np.int64, np.iinfo(np.int64).min) if 1 << 53 <= most < 1 << 62 else (np.float64, -np.inf)
    sample = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    pivots = np.unique(lifted(matrix([r["v"] for r in sample], dim), top2), axis=0)  # at most PIVOTS rows: part of each task's closure
    margin = 1e-6 * (np.sqrt(top2) + 1)

    def load(ids: bytes, vs: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(ids, "<i8"), np.frombuffer(vs, kind).reshape(-1, dim).astype(number)

    def radius(m: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance that an inner product stands for; without limit where there is no product yet."""
        far = np.sqrt(np.maximum(0, (m.astype(float) ** 2).sum(1) + top2 - 2 * np.where(score > none, score, 0).astype(float))) + margin
        return np.where(score > none, far, np.inf)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = matrix(b["v"], dim)
                d = distances(lifted(m, top2), pivots)
                at = d.argmin(1)
                yield pd.DataFrame({"pivot": at.astype("int32"), "far": d[np.arange(len(m)), at], "vec_id": b["vec_id"], "asks": b["asks"], "v": [r.tobytes() for r in m.astype(kind)]})

    def annulus(rows: pd.DataFrame, number_: int) -> dict:
        ids, m = load(rows["vec_id"].to_numpy("<i8").tobytes(), b"".join(rows["v"]))
        asks = np.flatnonzero(rows["asks"].to_numpy())
        kth = np.full(len(asks), none, number)
        if len(asks) and len(ids) > k:
            s = m[asks] @ m.T
            s[ids[asks][:, None] == ids] = none
            kth = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
        return {"pivot": int(rows["pivot"].iloc[0]), "low": float(rows["far"].iloc[0]), "high": float(rows["far"].iloc[-1]), "annulus": (TaskContext.get().partitionId() << 32) + number_, "ids": ids.tobytes(), "vs": m.astype(kind).tobytes(), "asks": ids[asks].tobytes(), "asked": m[asks].astype(kind).tobytes(), "kth": kth.tobytes()}

    def annuli_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, count = None, itertools.count()
        for b in batches:  # sorted by pivot and distance: a run goes on in the next batch
            rest = b if rest is None else pd.concat([rest, b])
            ready = [g.iloc[i : i + ANNULUS] for _, g in rest.groupby("pivot", sort=True) for i in range(0, len(g), ANNULUS)]
            if len(ready) > 1:
                yield pd.DataFrame([annulus(g, next(count)) for g in ready[:-1]])
            rest = ready[-1] if ready else None
        if rest is not None and len(rest):
            yield pd.DataFrame([annulus(rest, next(count))])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (64 * ANNULUS) + 1)
    keys = every.mapInPandas(keyed, "pivot int, far double, vec_id long, asks boolean, v binary")
    ranged = keys.repartitionByRange(parts, "pivot", "far", "vec_id").sortWithinPartitions("pivot", "far", "vec_id")
    index = materialize(ranged.mapInPandas(annuli_of, "pivot int, low double, high double, annulus long, ids binary, vs binary, asks binary, asked binary, kth binary"), "annuli")
    discard(every)

    def packs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, m, kth, count = np.zeros(0, "<i8"), np.zeros((0, dim), number), np.zeros(0, number), itertools.count()
        for b in [*batches, None]:  # sorted by pivot and distance: neighbours make a pack
            if b is not None:
                ids = np.concatenate([ids, *(np.frombuffer(x, "<i8") for x in b["asks"])])
                m = np.concatenate([m, *(np.frombuffer(x, kind).reshape(-1, dim).astype(number) for x in b["asked"])])
                kth = np.concatenate([kth, *(np.frombuffer(x, number) for x in b["kth"])])
            while len(ids) >= PACK or (b is None and len(ids)):
                q, s = m[:PACK], kth[:PACK]
                d, r = distances(lifted(q, None), pivots), radius(q, s)[:, None]
                yield pd.DataFrame({"pack": [(TaskContext.get().partitionId() << 32) + next(count)], "qids": [ids[:PACK].tobytes()], "qs": [q.astype(kind).tobytes()], "kth": [s.tobytes()], "reach": [[{"pivot": j, "near": float(a), "out": float(z)} for j, (a, z) in enumerate(zip((d - r).min(0), (d + r).max(0), strict=True))]]})
                ids, m, kth = ids[PACK:], m[PACK:], kth[PACK:]

    asking = index.where(F.length("asks") > 0).select("pivot", "low", "annulus", "asks", "asked", "kth")
    queries = asking.agg(F.coalesce(F.sum(F.length("asks")), F.lit(0)).alias("n")).first()["n"] // 8
    asking = asking.repartitionByRange(queries // (4 * PACK) + 1, "pivot", "low", "annulus").sortWithinPartitions("pivot", "low", "annulus")
    packs = materialize(asking.select("asks", "asked", "kth").mapInPandas(packs_of, "pack long, qids binary, qs binary, kth binary, reach array<struct<pivot: int, near: double, out: double>>"), "packs")
    rings = index.select("pivot", "low", "high", "annulus", F.pmod(F.xxhash64("annulus"), F.lit(8)).alias("part"))
    reach = packs.select("pack", F.explode("reach").alias("r")).select("pack", "r.*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("part"))
    met = reach.join(rings, ["pivot", "part"]).where((F.col("high") >= F.col("near")) & (F.col("low") <= F.col("out"))).select("pack", "pivot", "low", "high", "annulus")
    spread = max(4, n // (ANNULUS * 64) + 1)
    met = materialize(met.withColumn("lane", F.pmod(F.xxhash64("annulus"), F.lit(spread))), "met")  # numbers only
    # a lane gets its pack once, before the annuli
    rings = met.join(index.select("annulus", "ids", "vs"), "annulus").select("pack", "lane", F.lit(1).alias("after"), "pivot", "low", "high", "ids", "vs")
    heads = met.select("pack", "lane").distinct().join(packs.select("pack", "qids", "qs", "kth"), "pack").withColumn("after", F.lit(0))
    pairs = rings.unionByName(heads, allowMissingColumns=True).repartition("pack", "lane").sortWithinPartitions("pack", "lane", "after", "pivot", "low")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, state = None, None
        for b in batches:
            for (pack, lane_), g in b.groupby(["pack", "lane"], sort=False):
                if lane != (pack, lane_):
                    if state:
                        yield found(state)
                    lane = (pack, lane_)  # its first row is the pack
                    qids, q = load(g["qids"].iloc[0], g["qs"].iloc[0])
                    state = [qids, q, np.frombuffer(g["kth"].iloc[0], number).copy(), [np.zeros(0, "<i8")] * len(q), [np.zeros(0, number)] * len(q), distances(lifted(q, None), pivots)]
                qids, q, kth, ids, scores, d = state
                g = g[g["after"] == 1]
                bound = [np.maximum(d[:, p] - high, low - d[:, p]) for p, low, high in zip(g["pivot"].astype(int), g["low"], g["high"], strict=True)]
                for i in np.argsort([x.min() for x in bound], kind="stable"):
                    open_ = np.flatnonzero(bound[i] <= radius(q, kth))
                    if not len(open_):
                        continue
                    vid, v = load(g["ids"].iloc[i], g["vs"].iloc[i])
                    got = q[open_] @ v.T
                    for row, j in zip(got, open_, strict=True):
                        ok = np.flatnonzero((row >= kth[j]) & (vid != qids[j]))
                        if len(ok):
                            a, s = np.concatenate([ids[j], vid[ok]]), np.concatenate([scores[j], row[ok]])
                            top = best(s, a, k)
                            ids[j], scores[j] = a[top], s[top]
                            if len(top) == k:
                                kth[j] = max(kth[j], scores[j][-1])
        if state:
            yield found(state)

    def found(state: list) -> pd.DataFrame:
        qids, _, _, ids, scores, _ = state
        n = [len(x) for x in ids]
        return pd.DataFrame({"query_id": np.repeat(qids, n), "vec_id": np.concatenate(ids), "score": whole(np.concatenate(scores))})

    def whole(scores: np.ndarray) -> np.ndarray:
        if number is np.int64:
            return scores
        edge = float(1 << 63)
        return np.where(scores >= edge, np.iinfo(np.int64).max, np.where(scores < -edge, np.iinfo(np.int64).min, np.clip(scores, -edge, np.nextafter(edge, 0))).astype(np.int64)) if len(scores) and np.abs(scores).max() >= edge else scores.astype(np.int64)

    hits = pairs.select("pack", "lane", "after", "pivot", "low", "high", "ids", "vs", "qids", "qs", "kth").mapInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
