"""A stored index of product vectors: quantised blocks that are scanned first, and the exact vectors of what can still win.

  build    Live products with their vectors are range sorted by category, gender, season and price, and written twice: as
           `vectors`, one row a product, by lane (the range), and as `blocks`, one row for up to ROWS products of a lane. A
           block has each vector of length 1 as int8 codes with a scale and a bound on what the codes leave out; a bitmap
           of its products for each value of each filter; prices and stock.
  scan     A table of queries goes to the scan in packs of a bounded size. For each set of filters but
           prices, a block's bitmaps are intersected and the codes of what is left meet all queries of the set in matrix
           products; prices are compared pair by pair. The bound gives each
           distance a least and a greatest value. A task keeps what may be among its own k nearest.
  exact    Per query, the k-th least greatest value is a limit: what is at least farther cannot win. The rest meets the
           exact vectors in an equi-join by lane and id (lanes without candidates are not read) and is ranked by the exact
           distance. The result is that of the plain search, row for row.

Defined cases: null vectors, zero vectors and those of another length than the query have a null distance and come last, by
id; a vector with NaN or infinite components, or of another length than most, is always compared exactly; a query filters by what it sets, and asks for stock
unless in_stock_only is false; a null filter value of a product matches no filter; qid and product ids are unique; no
queries or no products give no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korvane.functions.text import effective_price
from korvane.functions.vector import cosine_distance
from korvane.operators.filters import TEXTS
from korvane.sources.schemas import ANY_GENDER, ANY_SEASON, CANDIDATE, FILTERS
from korvane.sources.stored import arrow_batches, materialize

#: Products of a block.
ROWS = 2048
#: Bytes of a pack of queries: what is sent to all tasks at a time.
PACK_BYTES = 16 << 20
#: Pairs that a task keeps before it drops those that its own k nearest have overtaken.
HELD = 1 << 20
#: Pairs of a query and a product that are compared in one step.
STEP = 1 << 20

FILTER_TYPES = {f.name: f.dataType for f in FILTERS.fields}
ALSO = {"gender": ANY_GENDER, "season": ANY_SEASON}
NO_FILTERS = (None,) * len(FILTER_TYPES)
MAPS = ", ".join(f"{c} map<string,binary>" for c in TEXTS)
BLOCKS = f"lane int, n int, dim int, ids binary, codes binary, scale binary, slack binary, kind binary, price binary, priced binary, stocked binary, {MAPS}"
KNOWN, VOID, WILD = 0, 1, 2
#: Distances are 2 at most; what has none counts as farther.
BEYOND = 3.0


def vector_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and what each is: null and zero vectors are VOID, those of another length than most or with components that are no numbers WILD. Unusable rows are zeros."""
    sizes = np.array([len(v) if v.is_valid else -1 for v in column])
    dim = int(np.bincount(sizes[sizes > 0]).argmax()) if (sizes > 0).any() else 0
    out, kind = np.zeros((len(column), dim)), np.where(sizes == dim, KNOWN, np.where(sizes > 0, WILD, VOID)).astype(np.uint8)
    for i in np.flatnonzero(kind == KNOWN):
        v = column[int(i)].values
        if v.null_count:
            kind[i] = VOID
        else:
            out[i] = v.to_numpy(zero_copy_only=False)
    wild = ~np.isfinite(out).all(axis=1)
    out[wild], kind[wild] = 0, WILD
    size = np.linalg.norm(out, axis=1)
    kind[(kind == KNOWN) & (size == 0)] = VOID
    return out / np.where(size > 0, size, 1)[:, None], kind


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale, and a bound on the error of any product with a vector of length 1, rounding included."""
    scale = (np.abs(unit).max(axis=1, initial=0) / 127).astype(np.float32)
    codes = np.rint(unit / np.where(scale > 0, scale, 1)[:, None]).clip(-127, 127).astype(np.int8)
    left = np.linalg.norm(unit - codes * scale.astype(np.float64)[:, None], axis=1)
    return codes, scale, (left * 1.0001 + unit.shape[1] * 2.5e-7 + 1e-6).astype(np.float32)


def _block(rows: pa.RecordBatch) -> dict:
    column = lambda c: rows.column(rows.schema.get_field_index(c))
    unit, kind = vector_rows(column("embedding"))
    codes, scale, slack = quantised(unit)
    bits = lambda x: np.packbits(x).tobytes()
    price = column("price")
    out = {"lane": column("lane")[0].as_py(), "n": len(rows), "dim": unit.shape[1], "ids": column("id").to_numpy().astype("<i8").tobytes(), "codes": codes.tobytes(), "scale": scale.tobytes(), "slack": slack.tobytes(), "kind": kind.tobytes()}
    out |= {"price": price.fill_null(0).to_numpy().astype("<i8").tobytes(), "priced": bits(price.is_valid().to_numpy(zero_copy_only=False)), "stocked": bits(column("stock").fill_null(0).to_numpy() > 0)}
    for c in TEXTS:
        values = np.array(column(c).to_pylist(), dtype=object)
        out[c] = [(v, bits(values == v)) for v in sorted({v for v in values if v is not None})]
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as they come, ROWS of a lane at a time."""
    kinds = {"int": pa.int32(), "binary": pa.binary(), "map<string,binary>": pa.map_(pa.string(), pa.binary())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in BLOCKS.split(", "))])
    held = None

    def cut(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
        lanes = table.column("lane").to_numpy()
        start = 0
        for end in [*(np.flatnonzero(lanes[1:] != lanes[:-1]) + 1), len(lanes)]:
            while start < end and (end - start >= ROWS or end < len(lanes) or last):
                stop = min(end, start + ROWS)
                yield pa.RecordBatch.from_pylist([_block(table.slice(start, stop - start).combine_chunks().to_batches()[0])], schema)
                start = stop
        yield table.slice(start)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None and len(held) else table
        *full, held = cut(table, False) if len(table) else [table]
        yield from full
    if held is not None and len(held):
        yield from list(cut(held, True))[:-1]


@dataclass(frozen=True)
class Query:
    """What a scan has to know of one query."""

    qid: object
    vector: list[float] | None
    filters: tuple  # in the order of FILTER_TYPES


class Scan:
    """One task's nearest: pairs of query and product whose least distance may still be among the k nearest seen.

    Queries with the same filters but prices are a set; prices are compared pair by pair, as they are as many as the queries."""

    def __init__(self, queries: list[Query], k: int):
        self.k, self.queries = k, queries
        sets: dict[tuple, list[int]] = {}
        bound = np.full((2, len(queries)), np.nan)
        for i, q in enumerate(queries):
            f = dict(zip(FILTER_TYPES, q.filters, strict=True))
            sets.setdefault((*(f[c] for c in TEXTS), f["in_stock_only"] is not False), []).append(i)
            bound[:, i] = [np.nan if f[c] is None else f[c] for c in ("price_min", "price_max")]
        self.bound = np.where(np.isnan(bound), [[-np.inf], [np.inf]], bound)
        self.bounded = ~np.isnan(bound).all(axis=0)
        self.sets: dict[object, list[tuple[dict, bool, np.ndarray]]] = {}  # by category
        for (*texts, stocked), members in sets.items():
            self.sets.setdefault(texts[0], []).append((dict(zip(TEXTS, texts, strict=True)), stocked, np.array(members)))
        unit, kind = vector_rows(pa.array([q.vector for q in queries], pa.list_(pa.float64())))
        kind[[q.vector is not None and len(q.vector) != unit.shape[1] for q in queries]] = VOID  # meets no vector but the odd ones
        self.unit, self.kind = unit.astype(np.float32), kind
        self.best = np.full((len(queries), k), np.inf, np.float32)  # the least greatest distances
        self.pairs: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def _on(self, b: dict, values: dict[str, dict], texts: dict, stocked: bool) -> np.ndarray:
        """Places of a block's products that a set's filters leave, but for prices."""
        bits = np.full(-(-b["n"] // 8), 255, np.uint8)
        for c, wanted in texts.items():
            if wanted is not None:
                maps = [m for v in {wanted, ALSO.get(c, wanted)} if (m := values[c].get(v)) is not None]
                if not maps:
                    return np.zeros(0, np.int64)
                bits = bits & np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in maps])
        if stocked:
            bits = bits & np.frombuffer(b["stocked"], np.uint8)
        return np.flatnonzero(np.unpackbits(bits)[: b["n"]]) if bits.any() else np.zeros(0, np.int64)

    def _keep(self, of: np.ndarray, lane: int, ids: np.ndarray, low: np.ndarray, high: np.ndarray, fit: np.ndarray | None = None) -> None:
        """low and high have a row for each query of `of` and a column for each of ids; fit: which pairs there are."""
        met = low <= self.best[of].max(axis=1)[:, None]
        q, x = np.nonzero(met if fit is None else met & fit)
        self._keep_pairs(of, q, x, lane, ids, low, high)

    def _keep_pairs(self, of: np.ndarray, q: np.ndarray, x: np.ndarray, lane: int, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """The pairs at rows q (ascending) and columns x of low and high alone."""
        if not len(q):
            return
        hit = np.unique(q)
        near = np.full((len(hit), high.shape[1]), np.inf, np.float32)
        near[np.searchsorted(hit, q), x] = high[q, x]
        self.best[of[hit]] = np.partition(np.concatenate([self.best[of[hit]], near], axis=1), self.k - 1, axis=1)[:, : self.k]
        stay = low[q, x] <= self.best[of].max(axis=1)[q]
        q, x = q[stay], x[stay]
        self.pairs.append((of[q], np.full(len(q), lane, np.int32), ids[x], low[q, x], high[q, x]))
        self.held += len(q)
        if self.held > HELD:
            self._drop()

    def _drop(self) -> None:
        of, lane, ids, low, high = map(np.concatenate, zip(*self.pairs, strict=True))
        stay = low <= self.best[of].max(axis=1)
        rows = np.flatnonzero(stay & (low >= BEYOND))  # without a distance the least ids come first
        rows = rows[np.lexsort((ids[rows], of[rows]))]
        place = np.arange(len(rows)) - np.searchsorted(of[rows], of[rows])
        stay[rows[place >= self.k]] = False
        self.pairs = [(of[stay], lane[stay], ids[stay], low[stay], high[stay])]
        self.held = int(stay.sum())

    def block(self, b: dict) -> None:
        n, dim = b["n"], b["dim"]
        ids, price, kind = np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["price"], "<i8"), np.frombuffer(b["kind"], np.uint8)
        priced = np.unpackbits(np.frombuffer(b["priced"], np.uint8))[:n].astype(bool)
        codes = np.frombuffer(b["codes"], np.int8).reshape(n, dim)
        scale, slack = np.frombuffer(b["scale"], np.float32), np.frombuffer(b["slack"], np.float32)
        values = {c: dict(b[c]) for c in TEXTS}
        for category in [None, *values["category"]]:
            for texts, stocked, members in self.sets.get(category, ()):
                on = self._on(b, values, texts, stocked)
                if not len(on):
                    continue
                cost, there = price[on], priced[on]
                low, high = (cost[there].min(), cost[there].max()) if there.any() else (np.inf, -np.inf)
                fits = ~self.bounded[members] | ((self.bound[0, members] <= high) & (self.bound[1, members] >= low))
                vectors = codes[on].astype(np.float32) * scale[on][:, None]
                step = max(1, STEP // len(on))
                for start in range(0, int(fits.sum()), step):
                    self._meet(members[fits][start : start + step], dim, b["lane"], ids[on], kind[on], vectors, slack[on], cost, there)

    def _meet(self, of: np.ndarray, dim: int, lane: int, ids: np.ndarray, what: np.ndarray, vectors: np.ndarray, slack: np.ndarray, cost: np.ndarray, priced: np.ndarray) -> None:
        """Queries of one set and the products of a block that the set leaves."""

        def fit(of: np.ndarray, rows: np.ndarray) -> np.ndarray | None:
            if not self.bounded[of].any():
                return None
            c = cost[rows][None, :]
            return ~self.bounded[of][:, None] | (priced[rows] & (c >= self.bound[0, of][:, None]) & (c <= self.bound[1, of][:, None]))

        known = of[self.kind[of] == KNOWN] if dim == self.unit.shape[1] else of[:0]
        blind = of[self.kind[of] == VOID] if dim == self.unit.shape[1] else of[self.kind[of] != WILD]
        wild = of[self.kind[of] == WILD]
        if len(known):
            rows = np.flatnonzero(what == KNOWN)
            if len(rows):
                far = 1 - self.unit[known] @ vectors[rows].T
                self._keep(known, lane, ids[rows], far - slack[rows], far + slack[rows], fit(known, rows))
            rows, short = np.flatnonzero(what == VOID), known[self.best[known].max(axis=1) >= BEYOND]
            self._all(short, lane, ids, rows, BEYOND, fit)
        rows = np.flatnonzero(what != WILD)
        self._all(blind, lane, ids, rows, BEYOND, fit)
        self._all(np.concatenate([known, blind]), lane, ids, np.flatnonzero(what == WILD), -1, fit)
        self._all(wild, lane, ids, np.arange(len(ids)), -1, fit)

    def _all(self, of: np.ndarray, lane: int, ids: np.ndarray, rows: np.ndarray, low: float, fit) -> None:
        """Pairs without a distance (low is BEYOND), or with one that only the exact vectors tell (-1)."""
        if len(of) and len(rows):
            shape = (len(of), len(rows))
            self._keep(of, lane, ids[rows], np.full(shape, low, np.float32), np.full(shape, BEYOND, np.float32), fit(of, rows))

    def found(self) -> Iterator[tuple[np.ndarray, ...]]:
        if self.pairs:
            self._drop()
            yield from self.pairs


@dataclass(frozen=True)
class VectorIndex:
    """blocks and vectors as they are stored under a location."""

    blocks: DataFrame
    vectors: DataFrame

    @classmethod
    def write(cls, products: DataFrame, embeddings: DataFrame, location: str, deleted: Column | None = None, ordered: bool = True, lanes: int | None = None) -> VectorIndex:
        """Index the live products that have a row of vectors. ordered=False leaves them as they come, for an index that serves once; lanes: so many ranges, else as many as Spark finds fit."""
        spark = products.sparkSession
        arrow_batches(spark)
        live = products.where(~deleted if deleted is not None else F.col("deleted_at").isNull())
        rows = live.select("id", *TEXTS, effective_price().cast("long").alias("price"), F.col("stock").cast("long").alias("stock")).join(embeddings.select(F.col("product_id").alias("id"), "embedding"), "id")
        if ordered:
            rows = materialize(rows, "rows")  # the ranges are found by a pass of their own
            order = ["category", "gender", "season", "price", "id"]
            rows = rows.repartitionByRange(*([lanes] if lanes else []), *order).sortWithinPartitions(*order)
        rows.withColumn("lane", F.spark_partition_id()).write.partitionBy("lane").parquet(f"{location}/vectors")
        cls._vectors(spark, location).mapInArrow(_pack, BLOCKS).write.parquet(f"{location}/blocks")
        return cls.read(spark, location)

    @classmethod
    def read(cls, spark: SparkSession, location: str) -> VectorIndex:
        arrow_batches(spark)
        return cls(spark.read.schema(BLOCKS).parquet(f"{location}/blocks"), cls._vectors(spark, location))

    @staticmethod
    def _vectors(spark: SparkSession, location: str) -> DataFrame:
        return spark.read.schema(f"id long, {', '.join(f'{c} string' for c in TEXTS)}, price long, stock long, embedding array<float>, lane int").parquet(f"{location}/vectors")

    def candidates(self, queries: DataFrame, k: int, pack_bytes: int = PACK_BYTES) -> DataFrame:
        """qid, lane, id, low, high: the pairs that may be among a query's k nearest. A written table."""
        spark = queries.sparkSession
        kind = queries.schema["qid"].dataType.simpleString()
        asked = materialize(queries.select("qid", "q", *(F.col(c).cast(t) if c in queries.columns else F.lit(None).cast(t).alias(c) for c, t in FILTER_TYPES.items())), "asked")
        size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("dim")).first()
        packs = max(1, -(-size["n"] * (12 * max(1, size["dim"]) + 256) // pack_bytes))
        schema, out = f"qid {kind}, lane int, id long, low float, high float", None
        for p in range(packs):
            pack = asked.where(F.pmod(F.xxhash64("qid"), F.lit(packs)) == p) if packs > 1 else asked
            sent = spark.sparkContext.broadcast([Query(r["qid"], r["q"], tuple(r[c] for c in FILTER_TYPES)) for r in pack.collect()])  # pack_bytes, some more by chance

            def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                if not sent.value:
                    return
                state = Scan(sent.value, k)
                for batch in batches:
                    for i in range(batch.num_rows):
                        state.block(batch.slice(i, 1).to_pylist()[0])
                for of, lane, ids, low, high in state.found():
                    yield pa.RecordBatch.from_arrays([pa.array([sent.value[i].qid for i in of], {"int": pa.int32(), "bigint": pa.int64()}.get(kind, pa.string())), pa.array(lane), pa.array(ids), pa.array(low), pa.array(high)], ["qid", "lane", "id", "low", "high"])

            found = materialize(self.blocks.mapInArrow(scan, schema), "candidates")
            sent.destroy()  # unpersist() would leave each pack in the driver
            out = found if out is None else out.unionByName(found)
        # the k-th least greatest distance of all tasks
        at = F.row_number().over(Window.partitionBy("qid").orderBy("high", "id"))
        limit = out.select("qid", "id", "high").withColumn("at", at).where(F.col("at") <= k).where(F.col("at") == k).select("qid", F.col("high").alias("limit"))
        kept = out.join(limit, "qid", "left").where(F.col("limit").isNull() | (F.col("low") <= F.col("limit"))).drop("limit")
        return materialize(kept, "kept")

    def search(self, queries: DataFrame, k: int, pack_bytes: int = PACK_BYTES) -> DataFrame:
        """qid, rank, id, distance of the k nearest products of each query (qid, q and any of the eight filters)."""
        if k <= 0:
            return queries.select("qid", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("distance")).limit(0)
        kept = self.candidates(queries, k, pack_bytes)
        lanes = [r["lane"] for r in kept.select("lane").distinct().collect()]  # one for each range at most
        vectors = self.vectors.where(F.col("lane").isin(lanes)).select("lane", "id", "embedding")
        scored = kept.select("qid", "lane", "id").join(vectors, ["lane", "id"]).join(queries.select("qid", "q"), "qid").withColumn("distance", cosine_distance(F.col("embedding"), F.col("q")))
        order = Window.partitionBy("qid").orderBy(F.col("distance").asc_nulls_last(), "id")
        return scored.select("qid", "id", "distance").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "distance")


def with_products(hits: DataFrame, products: DataFrame) -> DataFrame:
    """qid, rank, the candidate columns and distance."""
    return hits.join(products.select(*CANDIDATE), "id").select("qid", "rank", *CANDIDATE, "distance")
