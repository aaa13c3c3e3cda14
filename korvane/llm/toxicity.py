"""Toxicity: character n-gram bags averaged into a linear softmax.

A word is a run of letters, lower-cased; its subwords are the word itself and its n-grams of MIN_N to MAX_N
characters with end marks, hashed to BUCKETS vectors. A text is the mean of its words, a word the mean of its
subwords, so that a misspelling never seen still shares most n-gram vectors with the word it stands for. Vectors and
softmax are trained jointly, in numpy, on a bounded sample of labelled rows.

A softmax over a mean of vectors is the mean of a softmax's scores, so a trained model is one number a bucket and
a bias: scoring needs no shuffle and sends out BUCKETS floats.

Defined cases: a null or empty text, or one without letters, scores what the bias alone gives; very long texts are
scored whole; a null doc_id is not held out and is kept; repeated rows are scored each by itself; equal texts score
alike, and of rows that repeat a labelled doc_id the one whose text has the least hash is learned from; labels that are null, or not 0 or 1, are not learned, and of labels that repeat a doc_id each class counts;
without both classes among the labels every text scores the share of label 1 (0 without labels); empty tables give no
rows; a column named score is replaced by score() and left alone by below().
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from korvane.llm.common import arrow_batches, curve, discard, held_out, materialize, release, table

BUCKETS = 1 << 16
MIN_N, MAX_N = 3, 5
DIM = 4
#: Bound of the sample that the model is fitted on: so many labelled rows of each class, those with the smallest hashes.
SAMPLE_PER_CLASS = 1500
#: And so many numbers of their bags, for each class: texts may be very long.
SAMPLE_NUMBERS = 4_000_000
#: Chosen by the accuracy on folds of the rows that may be learned from (see README); results hardly depend on them.
EPOCHS, BATCH, RATE, RIDGE, LEAST, START = 4, 16, 4.0, 1e-3, 1e-2, 0.001
CALIBRATE = 4
CACHED_WORDS = 300_000
#: A document is toxic from this score on.
TOXIC = 0.3
WORDS = re.compile(r"[^\W\d_]+")


def subwords(word: str) -> list[int]:
    """Buckets of a word's n-grams. Very long words are as good as any: their n-grams are all taken."""
    marked = f"<{word}>"
    grams = [marked, *(marked[i : i + n] for n in range(MIN_N, MAX_N + 1) for i in range(len(marked) - n + 1))]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams]


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares; shares sum to 1."""
    words = Counter(WORDS.findall((text or "").lower()))
    n = sum(words.values())
    ids, share = [], []
    for w, c in words.items():
        g = subwords(w)
        ids += g
        share += [c / n / len(g)] * len(g)
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    unique, at = np.unique(np.array(ids, np.int32), return_inverse=True)
    return unique, np.bincount(at, share).astype(np.float32)


class Bags:
    """Bags end to end, so that a batch of texts is a few numpy calls."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]]):
        self.n = np.array([len(ids) for ids, _ in bags], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.ids, self.share = (np.concatenate([b[k] for b in bags]) if bags else np.zeros(0) for k in (0, 1))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, shares, and the place among rows of the text that each belongs to."""
        n = self.n[rows]
        at = np.repeat(self.start[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.ids[at], self.share[at].astype(float), np.repeat(np.arange(len(rows)), n)


def odds_of(bags: Bags, y: np.ndarray, rows: list[np.ndarray], prior: float, rng: np.random.Generator) -> np.ndarray:
    """Train bucket vectors V and softmax U jointly on the rows of either class; a log-odds number for each bucket.

    Every bucket that these rows have gets a vector. Buckets come in scaled by how far the classes' mean shares lie apart,
    in root mean squares of the bucket, as naive Bayes weights do; texts then have a length of about 1. Steps are taken on
    the mean gradient of BATCH texts, both classes in turn, with a rate that falls to zero and a ridge, which leaves little
    to the order of the texts."""
    square, mean = np.zeros(BUCKETS), np.zeros((2, BUCKETS))
    for k, part in enumerate((1 - prior, prior)):
        for some in np.array_split(rows[k], len(rows[k]) // 64 + 1):
            ids, share, _ = bags.take(some)
            square += np.bincount(ids, share**2, BUCKETS) * part / max(1, len(rows[k]))
            mean[k] += np.bincount(ids, share, BUCKETS) / max(1, len(rows[k]))
    apart = np.where(square > 0, np.abs(mean[1] - mean[0]) / np.sqrt(np.maximum(square, 1e-300)), 0)
    scale = np.where(square > 0, np.maximum(apart, LEAST * apart.max(initial=0)), 0)
    scale = scale / np.sqrt(max(1e-300, float((square * scale**2).sum())))
    v = rng.normal(0, START, (DIM, BUCKETS))
    u = rng.normal(0, 1, (DIM, 2))
    u = (u - u.mean(1, keepdims=True)) / np.linalg.norm(u[:, 1] - u[:, 0])
    bias = np.zeros(2)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        turns = [rng.permutation(np.resize(rng.permutation(r), max(map(len, rows)))) for r in rows]
        turns = np.stack(turns, 1).ravel()
        for start in range(0, len(turns), BATCH):
            texts = turns[start : start + BATCH]
            ids, share, own = bags.take(texts)
            x = share * scale[ids]
            h = np.stack([np.bincount(own, x * at[ids], len(texts)) for at in v], 1)
            z = h @ u + bias
            e = np.exp(z - z.max(1, keepdims=True))
            d = e / e.sum(1, keepdims=True)
            d[np.arange(len(texts)), y[texts]] -= 1
            d /= len(texts)
            back = d @ u.T
            v *= 1 - rate * RIDGE
            for k in range(DIM):
                v[k] -= rate * np.bincount(ids, x * back[own, k], BUCKETS)
            u -= 0.01 * rate * (h.T @ d)
            bias -= 0.1 * rate * d.sum(0)
    return scale * ((u[:, 1] - u[:, 0]) @ v)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], prior: float, seed: int = 7) -> tuple[np.ndarray, float]:
    """A log-odds number for each bucket, and the bias.

    A first fit leaves out one text in CALIBRATE; a logistic curve over these texts turns odds into scores, at a share of
    label 1 halfway, in log-odds, between even and the prior. The second fit has all texts; its odds are brought to the
    first one's spread."""
    y, n = np.array(labels), len(bags)
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    half = 1 / (1 + np.sqrt((1 - prior) / prior))
    rank = np.empty(n, np.int64)
    for k in (0, 1):
        rank[y == k] = np.arange((y == k).sum())
    held = rank % CALIBRATE == CALIBRATE - 1

    every = Bags(bags)

    def raw(odds: np.ndarray, rows: np.ndarray) -> np.ndarray:
        def some(of: np.ndarray) -> np.ndarray:
            ids, share, own = every.take(of)
            return np.bincount(own, odds[ids] * share, len(of))

        return np.concatenate([some(of) for of in np.array_split(np.flatnonzero(rows), rows.sum() // 64 + 1)])

    odds = odds_of(every, y, [np.flatnonzero(y == k) for k in (0, 1)], prior, np.random.default_rng(seed))
    if len(set(y[held].tolist())) < 2:
        return odds.astype(np.float32), float(np.log(half / (1 - half)))
    first = odds_of(every, y, [np.flatnonzero((y == k) & ~held) for k in (0, 1)], prior, np.random.default_rng(seed))
    slope, intercept = curve(raw(first, held), y[held], half)
    spread = raw(first, ~held).std() / max(1e-12, raw(odds, np.ones(n, bool)).std())
    return (odds * max(slope, 0.0) * spread).astype(np.float32), intercept


class Scorer:
    """A fitted model with a bounded cache of word scores."""

    def __init__(self, odds: np.ndarray, bias: float):
        self.odds, self.bias, self.words = odds.astype(float).tolist(), bias, {}

    def word(self, w: str) -> float:
        if len(self.words) >= CACHED_WORDS:
            self.words.clear()
        g, odds = subwords(w), self.odds
        s = self.words[w] = sum([odds[b] for b in g]) / len(g)
        return s

    def text(self, t: str | None) -> float:
        words = WORDS.findall((t or "").lower())
        get, known = self.word, self.words.get
        total = 0.0
        for w in words:
            s = known(w)
            total += get(w) if s is None else s
        z = self.bias + (total / len(words) if words else 0.0)
        return 1 / (1 + np.exp(-min(max(z, -60.0), 60.0)))


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[np.ndarray, float] | float:
    """Fit on the sample. Labels of held-out rows are never read. Without both classes: the share of label 1."""
    spark = documents.sparkSession
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(~held_out() & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return 1.0 if counts.get(1) else 0.0
    order = F.xxhash64("doc_id"), F.col("doc_id")
    picked = [known.where(F.col("y") == k).dropDuplicates(["doc_id"]).orderBy(*order).limit(SAMPLE_PER_CLASS) for k in (0, 1)]
    picked = spark.createDataFrame([tuple(r) for p in picked for r in p.collect()], "doc_id long, y int")  # at most 2 * SAMPLE_PER_CLASS pairs

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [bag(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary())], ["doc_id", "y", "ids", "share"])

    # one row of a doc_id, however often it repeats
    once = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    made = materialize(once.select("doc_id", "y", "least.text").mapInArrow(bags, "doc_id long, y int, ids binary, share binary"), "bags")
    sizes = sorted(map(tuple, made.select("y", F.xxhash64("doc_id"), "doc_id", F.octet_length("ids")).collect()))  # at most 2 * SAMPLE_PER_CLASS rows of numbers
    used, within = {0: 0, 1: 0}, []
    for y, _, doc_id, n in sizes:
        used[y] += n // 4
        if used[y] <= SAMPLE_NUMBERS or used[y] == n // 4:
            within.append((doc_id, y))
    rows = made.join(F.broadcast(spark.createDataFrame(within, "doc_id long, y int")), ["doc_id", "y"]).collect() if within else []
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["y"]))
    discard(made)
    if len({r["y"] for r in rows}) < 2:
        return counts[1] / (counts[0] + counts[1])
    return fit([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["share"], np.float32)) for r in rows], [r["y"] for r in rows], counts[1] / (counts[0] + counts[1]))


def _scored(documents: DataFrame, model: tuple[np.ndarray, float], kind: StructType, row) -> DataFrame:
    """row(batch, scores) of each batch. The scorer, with its cache, ends with its task: Python workers are kept for later stages."""
    arrow_batches(documents.sparkSession)
    odds, bias = documents.sparkSession.sparkContext.broadcast(model[0]), model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(odds.value, bias)
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            yield row(b, np.array([s.text(t.as_py()) for t in text]))
        del s
        release()

    return documents.mapInArrow(run, kind)


def score(documents: DataFrame, model: tuple[np.ndarray, float] | float) -> DataFrame:
    """All columns of documents and `score` double; a column of that name gives way. One pass, no shuffle."""
    documents = documents.drop("score")
    if isinstance(model, float):
        return documents.withColumn("score", F.lit(model))
    add = lambda b, z: pa.RecordBatch.from_arrays([*b.columns, pa.array(z, pa.float64())], [*b.schema.names, "score"])
    return _scored(documents, model, StructType([*documents.schema.fields]).add("score", DoubleType()), add)


def below(documents: DataFrame, model: tuple[np.ndarray, float] | float, most: float) -> DataFrame:
    """The rows of documents that score less than `most`, with their own columns only."""
    if isinstance(model, float):
        return documents if model < most else documents.limit(0)
    keep = lambda b, z: b.take(pa.array(np.flatnonzero(z < most), pa.int64()))
    return _scored(documents, model, documents.schema, keep)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
