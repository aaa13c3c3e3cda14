"""MinHash near-duplicates with tensored banding.

A text is lower-cased (A-Z) and cut into words at ASCII white space; its set holds its distinct shingles of WORDS
words, or its whole sequence if it has fewer. Two texts are linked if 100 * |intersection| >= 75 * |union|.

  sketch    Two collections of HALVES keys each, of DEEP minhashes a key, take 2 * HALVES * DEEP minhashes; a table's
            key pairs one of either, which gives HALVES * HALVES tables of 2 * DEEP minhashes. Two sets of similarity s
            meet in none with probability below 2 * (1 - s ** DEEP) ** HALVES: 1.1e-4 at 0.75, 5e-6 at 0.8.
            With it comes an odd sketch of the set: the parities of its shingles in some 4 to 8 bits a shingle. The bits
            in which two sketches differ tell the size of the sets' difference.
  classes   Equal sets (128-bit fingerprint) count as one node, that of the smallest doc_id.
  groups    Nodes that share a left half key are dealt together; the tables of that half are formed in the task. Of
            groups with the same nodes one is kept, that of the least half. A group of more than GROUP nodes is dealt
            in chunks.
  trees     Within a chunk each node names, of the nodes that share a table with it and lie in another component, the
            most alike one that passes the test below; of what its groups name, the best is verified on full sets. Links
            join components; chunks are dealt anew each round. One pair a node and round joins big groups.
  rest      Groups that still hold several components are searched whole, all chunks against all: every pair of nodes
            that share a table, lie in different components and pass the test is verified on full sets. Only such pairs
            leave a task, each from one group only, and no group is expanded into all its pairs.

The test passes every linked pair but one in some 3 million: sizes within 3:4, and odd sketches that differ in no more
bits than those of sets at similarity 0.75 do, give or take five standard deviations (Mitzenmacher et al., 2014).

Defined cases: texts that are null, empty or without words have an empty set, are linked with nothing and are their
own component; very long texts are taken whole, in Arrow batches bounded by bytes; rows with a null doc_id are linked
with nothing, with component_id null and kept true; rows that repeat a doc_id are one node, linked by any of their
texts; an empty table gives no rows; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvane.llm.common import byte_table, discard, materialize, mix, release, sent, slices, table, text_bytes
from korvane.llm.graph import components

WORDS = 5
HALVES = 18
DEEP = 3
HASHES = 2 * HALVES * DEEP
#: Rounds of trees; they stop earlier when a round links nothing. What they leave is the rest's.
ROUNDS = 4
#: Nodes of a group that are compared in one piece.
GROUP = 2048
#: Pairs that are compared at one time.
PAIRS = 1 << 16

BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
TABLE = byte_table(21)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(5)
TIMES = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
FOLD = _rng.integers(0, 2**63, (2 * HALVES, DEEP), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, UNBASE)):
            p = np.full(max(n, 1 << 16), base)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of every word, in order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = LOWER[data]
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.r_[True, ~word[:-1]]))
    ends = np.flatnonzero(word & (edge[1:] | np.r_[~word[1:], True])) + 1
    up, down = powers(n)
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(TABLE[low] * up, dtype=np.uint64)]
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return np.searchsorted(offsets, starts, "right") - 1, h


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, by row and hash."""
    row, h = word_hashes(data, offsets)
    if not len(h):
        return row, h
    n = np.bincount(row, minlength=len(offsets) - 1)
    s = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        s = s * BASE + h[j : j + len(s)]
    whole = np.flatnonzero(row[: len(s)] == row[WORDS - 1 :]) if len(s) else np.zeros(0, np.int64)
    out_row, out = [row[whole]], [mix(s[whole])]
    first = np.cumsum(n) - n
    for k in range(1, WORDS):  # shorter texts: the whole sequence
        r = np.flatnonzero(n == k)
        if len(r):
            s = np.full(len(r), k, np.uint64)
            for j in range(k):
                s = s * BASE + h[first[r] + j]
            out_row.append(r)
            out.append(mix(s))
    row, h = np.concatenate(out_row), np.concatenate(out)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]
    return row[new], h[new]


def odd_sketch(h: np.ndarray) -> bytes:
    """Parities of a set's hashes, dealt to a power of 2 bits: 4 to 8 a member, 256 at the least."""
    m = max(256, 1 << (4 * len(h) - 1).bit_length())
    return np.packbits((np.bincount((h >> np.uint64(20)).astype(np.int64) & (m - 1), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(na: np.ndarray, nb: np.ndarray, differ: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The test: are odd sketches of m bits that differ in so many those of sets of na and nb members that may be linked?"""
    d = np.floor((na + nb) / 7)  # the greatest difference of linked sets
    mean = m / 2 * -np.expm1(d * np.log1p(-2 / m))
    spread = np.maximum(m / 4 * -np.expm1(-4 * d / m) - d * np.exp(-4 * d / m), 0)
    return (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)) & (differ <= mean + 5 * np.sqrt(spread) + 1)


def sketch(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fingerprint (two longs), left (HALVES keys), codes (32 bits of each of the 2 * HALVES keys) and odd; the last three null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1 << 20):
                row, h = shingles(*text_bytes(b.column(1)))
                n = np.bincount(row, minlength=b.num_rows)
                full = np.flatnonzero(n)
                at = (np.cumsum(n) - n)[full]
                f1, f2 = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
                keys = np.zeros((len(full), 2 * HALVES), np.uint64)
                if len(full):
                    f1[full], f2[full] = np.add.reduceat(mix(h), at), np.add.reduceat(mix(h ^ BASE), at)
                    for t in range(HASHES):
                        k, j = divmod(t, DEEP)
                        keys[:, k] += np.minimum.reduceat(h * TIMES[t] + PLUS[t], at) * FOLD[k, j]
                    keys = mix(keys + np.arange(2 * HALVES, dtype=np.uint64) * BASE)
                left, codes, odd = [None] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
                short = (keys >> np.uint64(32)).astype("<u4")
                for i, r in enumerate(full.tolist()):
                    left[r], codes[r], odd[r] = keys[i, :HALVES].view(np.int64), short[i].tobytes(), odd_sketch(h[at[i] : at[i] + n[r]])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(left, pa.list_(pa.int64())), pa.array(codes, pa.binary()), pa.array(odd, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "left", "codes", "odd"])
        release()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, left array<long>, codes binary, odd binary")


def compared(a: np.ndarray, b: np.ndarray, m: np.ndarray, bits: dict[int, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits in which the odd sketches of rows a and b differ, and of how many: a longer sketch is folded to the shorter's length."""
    differ, least = np.zeros(len(a), np.int64), np.minimum(m[a], m[b])
    for width in np.unique(least).tolist():
        k = np.flatnonzero(least == width)
        x, y = (folded(bits, m, at, r[k], width) for r in (a, b))
        differ[k] = np.bitwise_count(x ^ y).sum(1)
    return differ, least


def folded(bits: dict[int, np.ndarray], m: np.ndarray, at: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width // 64), np.uint64)
    for size in np.unique(m[rows]).tolist():
        k = np.flatnonzero(m[rows] == size)
        out[k] = np.bitwise_xor.reduce(bits[size][at[rows[k]]].reshape(len(k), size // width, width // 64), axis=1)
    return out


def pairs_of(t: pa.Table, best: bool) -> pa.RecordBatch:
    """The pairs of a table of whole pieces, sorted by piece: a, b and how alike they may be. best: each row's best pair only."""
    piece, part, node, half = (t.column(c).to_numpy() for c in ("piece", "part", "component", "half"))
    ids, n = t.column("doc_id").to_numpy(), t.column("n_shingles").to_numpy()
    codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), "<u4").reshape(-1, 2 * HALVES)
    odd = t.column("odd").to_pylist()
    m = np.array([len(o) * 8 for o in odd], np.int64)
    bits, at = {}, np.zeros(len(odd), np.int64)
    for size in np.unique(m).tolist():
        k = np.flatnonzero(m == size)
        bits[size], at[k] = np.frombuffer(b"".join(odd[i] for i in k), np.uint64).reshape(len(k), -1), np.arange(len(k))
    edges = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
    end = np.repeat(np.r_[edges[1:], len(piece)], np.diff(np.r_[edges, len(piece)]))
    mixed = np.minimum.reduceat(node, edges) < np.maximum.reduceat(node, edges)
    open_ = np.flatnonzero(np.repeat(mixed, np.diff(np.r_[edges, len(piece)])))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    top, who = np.full(len(ids), -1.0), np.zeros(len(ids), np.int64)
    waits: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        if not waits:
            return
        a, b = (np.concatenate(x) for x in zip(*waits, strict=True))
        waits.clear()
        for i in range(0, len(a), PAIRS):
            x, y = a[i : i + PAIRS], b[i : i + PAIRS]
            meet = (codes[x, HALVES:] == codes[y, HALVES:]).any(1)
            x, y = x[meet], y[meet]
            if not best and len(x):  # a pair is of its first left half
                first = (codes[x, :HALVES] == codes[y, :HALVES]).argmax(1) == half[x]
                x, y = x[first], y[first]
            differ, width = compared(x, y, m, bits, at)
            ok = may_link(n[x], n[y], differ, width)
            x, y, alike = x[ok], y[ok], 1 - differ[ok] / (n[x[ok]] + n[y[ok]])
            if not best:
                found.append((ids[x], ids[y], alike))
                continue
            for p, q in ((x, y), (y, x)):
                order = np.lexsort((-ids[q], alike, p))  # of equals the least id is last
                p, q, s = p[order], q[order], alike[order]
                last = np.r_[p[1:] != p[:-1], np.ones(min(1, len(p)), bool)]
                p, q, s = p[last], q[last], s[last]
                better = s > top[p]
                top[p[better]], who[p[better]] = s[better], q[better]

    step, waiting = 1, 0
    while True:
        open_ = open_[open_ + step < end[open_]]
        if not len(open_):
            break
        other = open_ + step
        k = (node[open_] != node[other]) & (4 * np.minimum(n[open_], n[other]) >= 3 * np.maximum(n[open_], n[other])) & (best | (part[open_] < 0) | (part[open_] != part[other]))
        if k.any():
            waits.append((open_[k], other[k]))
            waiting += int(k.sum())
            if waiting >= PAIRS:
                settle()
                waiting = 0
        step += 1
    settle()
    if best:
        k = np.flatnonzero(top >= 0)
        found = [(ids[k], ids[who[k]], top[k])]
    a, b, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "alike"])


def searched(rows: DataFrame, payload: DataFrame, found: DataFrame, best: bool, salt: int = 0) -> DataFrame:
    """a, b, alike: what pairs_of() finds in the pieces of the groups in rows (key, half, size, doc_id, f1) that hold several components."""
    placed = _placed(rows, found)
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    placed = placed.join(mixed, "key")
    chunks = F.ceil(F.col("size") / GROUP).cast("int")
    chunk = F.pmod(F.xxhash64("doc_id", F.lit(salt)), chunks).cast("int")
    if best:
        placed = placed.withColumn("piece", F.when(chunks == 1, F.col("key")).otherwise(F.xxhash64("key", chunk))).withColumn("part", F.lit(-1))
    else:  # chunk x meets chunk y in the piece of both; a chunk's own pairs are found in its piece with itself
        placed = placed.withColumn("own", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        placed = placed.withColumn("piece", F.when(chunks == 1, F.col("key")).otherwise(F.xxhash64("key", low, high))).withColumn("part", F.when(low == high, F.lit(-1)).otherwise(F.col("own")))
    wide = placed.select("piece", "part", "half", "doc_id", "f1", "component").join(payload, ["doc_id", "f1"]).drop("f1")
    wide = wide.repartition("piece").sortWithinPartitions("piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            piece = b.column(b.schema.get_field_index("piece")).to_numpy()
            cut = int(np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])[-1])  # the last piece may go on
            if cut or (rest and rest[-1].column(b.schema.get_field_index("piece"))[-1].as_py() != piece[0]):
                if cut:
                    rest.append(b.slice(0, cut))
                yield pairs_of(pa.Table.from_batches(rest), best)
                rest = [b.slice(cut)]
            else:
                rest.append(b)
        if rest:
            yield pairs_of(pa.Table.from_batches(rest), best)
        release()

    return wide.mapInArrow(run, "a long, b long, alike double")


def verified(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs a, b that are linked, on their full sets. pairs is written already; the texts of its documents go to them."""
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sent(ids), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1 << 20, "x"):
                sides = [shingles(*text_bytes(b.column(b.schema.get_field_index(c)))) for c in ("x", "y")]
                cuts = [np.searchsorted(row, np.arange(b.num_rows + 1)) for row, _ in sides]
                ok = []
                for i in range(b.num_rows):
                    x, y = (h[cut[i] : cut[i + 1]] for (_, h), cut in zip(sides, cuts, strict=True))
                    all_ = np.sort(np.concatenate([x, y]))
                    both = int((all_[1:] == all_[:-1]).sum())
                    ok.append(100 * both >= 75 * (len(all_) - both) > 0)
                k = pa.array(np.flatnonzero(ok), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)).take(k) for c in ("a", "b")], ["a", "b"])
        release()

    side = lambda c, t: texts.select(F.col("doc_id").alias(c), F.col("text").alias(t))
    linked = sent(pairs.select("a", "b")).join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(run, "a long, b long").distinct()
    out = materialize(linked, "links")
    discard(ids)
    return out


def _placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the component of their doc_id so far."""
    return rows.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components of found and links: the links join components, which are then renamed. Both are deleted."""
    own = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    between = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    above = components(between)
    known = found.join(above.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    out = materialize(known.unionByName(above.join(found.select("node"), "node", "left_anti").select("node", "component")), "components")
    discard(found, links, above)
    return out


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    sketched = materialize(sketch(documents), "sketches")
    known = sketched.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = known.groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.count("*").alias("times")).where("times > 1").select("f1", "f2", "node")
    copies = materialize(known.select("doc_id", "f1", "f2").join(classes, ["f1", "f2"]).where("doc_id <> node").select("doc_id", "f1", "node").distinct(), "copies")
    found = components(copies.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    nodes = known.join(sent(copies.select("doc_id", "f1")), ["doc_id", "f1"], "left_anti")

    left = nodes.select("doc_id", "f1", F.posexplode("left").alias("half", "key"))
    one, two = F.xxhash64("doc_id", "f1"), F.xxhash64("f1", "doc_id", F.lit(1))
    groups = left.groupBy("key").agg(F.count("*").alias("size"), F.min("half").alias("half"), F.bit_xor(one).alias("x"), F.sum(two.cast("decimal(38,0)")).alias("s")).where("size > 1")
    groups = groups.groupBy("size", "x", "s").agg(F.min(F.struct("half", "key")).alias("k")).select("k.key", "size")
    groups = materialize(groups, "groups")
    rows = materialize(left.join(sent(groups), "key"), "rows")
    members = materialize(rows.select("doc_id", "f1").distinct(), "members")
    payload = nodes.select("doc_id", "f1", "n_shingles", "codes", "odd").join(sent(members), ["doc_id", "f1"], "left_semi").dropDuplicates(["doc_id", "f1"])
    payload = materialize(payload, "payload")

    for step in range(ROUNDS):
        named = searched(rows, payload, found, best=True, salt=step)
        named = named.groupBy("a").agg(F.max_by("b", F.struct("alike", -F.col("b"))).alias("b"))
        named = materialize(named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "trees")
        links = verified(named, documents)
        discard(named)
        if not links.take(1):
            discard(links)
            break
        found = _joined(found, links)

    rest = materialize(searched(rows, payload, found, best=False).select("a", "b").distinct(), "rest")
    links = verified(rest, documents)
    found = _joined(found, links)
    out = sketched.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    out = materialize(out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept")), "near_duplicates")
    discard(sketched, copies, groups, rows, members, payload, rest, found)
    return out


def op4_near_dups(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
