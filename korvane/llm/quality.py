"""Quality: a compression classifier.

Two zstandard dictionaries are built, from texts labelled good and from texts labelled bad. A text is compressed with
either, in blocks of BLOCK bytes that know nothing of each other, so that a long text cannot teach the compressor its
own style; all of it counts. What decides is the difference of the two compressed sizes over their sum. A logistic
curve, fitted on labelled texts that the dictionaries have not seen, turns that into the probability of label 1.

Fitting uses a bounded sample: of each class at most SAMPLE_PER_CLASS labelled rows, those with the smallest hashes;
half of them, in at most DICTIONARY_BLOCKS blocks a class (again by hash), build the dictionaries, the others the curve.

Defined cases: a null or empty text scores what the curve gives for no difference; very long texts are compressed whole,
block by block; a null doc_id is kept and is not held out; repeated rows and equal texts are scored each, alike; labels
that are null, or not 0 or 1, are not learned, and of labels that repeat a doc_id each class counts; without both classes,
or with too little text for a dictionary, every text scores the share of label 1 (1 without labels); empty tables give
no rows; other columns are carried, but those named difference or score give way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from korvane.llm.common import arrow_batches, curve, held_out, slices, table

BLOCK = 2048
LEVEL = 3
DICTIONARY = 48 << 10
SAMPLE_PER_CLASS = 1500
DICTIONARY_BLOCKS = 1500


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        self.both = []
        for d in (good, bad):
            d = zstandard.ZstdCompressionDict(d)
            d.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def difference(self, text: bytes) -> float:
        """Above 0 where the good dictionary helps more."""
        good, bad = self.both
        view = memoryview(text)
        parts = [view[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        g, b = sum([len(good(p)) for p in parts]), sum([len(bad(p)) for p in parts])
        return (b - g) / (b + g) if parts else 0.0


_compressors: dict[int, Compressors] = {}


def difference(documents: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """All columns of documents and `difference` double. One pass, no shuffle; the two dictionaries are sent out."""
    arrow_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast((good, bad))
    key = zlib.crc32(good + bad)
    at = [c for c in documents.columns if c != "difference"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _compressors:
            _compressors.clear()
            _compressors[key] = Compressors(*sent.value)
        c = _compressors[key]
        for batch in batches:
            for b in slices(batch):
                texts = b.column(b.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.difference(t or b"") for t in texts], pa.float64())], [*at, "difference"])

    documents = documents.select(*at)
    return documents.mapInArrow(run, StructType([*documents.schema.fields]).add("difference", DoubleType()))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[bytes, bytes, float, float] | float:
    """Dictionaries and curve. Labels of held-out rows are never read. Without both classes: the share of label 1."""
    spark = documents.sparkSession
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(~held_out() & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 1.0
    if len(counts) < 2:
        return float(share)
    picked = [known.where(F.col("y") == k).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS).collect() for k in (0, 1)]
    picked = spark.createDataFrame([(r["doc_id"], r["y"], i % 2 == 0) for p in picked for i, r in enumerate(p)], "doc_id long, y int, builds boolean")
    sample = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column("y").to_pylist()
            for i, t in enumerate(b.column("text").cast(pa.large_binary()).to_pylist()):
                parts = [t[j : j + BLOCK] for j in range(0, len(t or b""), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array([y[i]] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["y", "block"])

    built = []
    parts = sample.where("builds").select("y", "text").mapInArrow(blocks, "y int, block binary")
    for k in (1, 0):
        got = [bytes(r["block"]) for r in parts.where(F.col("y") == k).orderBy(F.xxhash64("block"), "block").limit(DICTIONARY_BLOCKS).collect()]
        try:
            built.append(zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, got)) // 4)), got, level=LEVEL).as_bytes())
        except (zstandard.ZstdError, ValueError):
            return float(share)
    rows = difference(sample.where("not builds").select("doc_id", "y", "text"), *built).select("y", "difference").collect()
    x, y = np.array([r["difference"] for r in rows]), np.array([r["y"] for r in rows])
    return (*built, *curve(x, y, share)) if len(set(y.tolist())) == 2 else float(share)


def score(documents: DataFrame, model: tuple[bytes, bytes, float, float] | float) -> DataFrame:
    """All columns of documents but `difference`, and `score` double."""
    documents = documents.drop("score")
    if isinstance(model, float):
        return documents.withColumn("score", F.lit(model))
    good, bad, slope, intercept = model
    return difference(documents, good, bad).withColumn("score", 1 / (1 + F.exp(-(F.col("difference") * slope + intercept)))).drop("difference")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
