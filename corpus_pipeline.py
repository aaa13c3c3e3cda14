"""From raw documents to token ids: five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back as the docs of
the next. All but the last return the columns of documents, whatever further columns there are and however they are
named. Defined cases: each stage's operator states its own; rows with a null doc_id are never taken for copies or leaks,
and so pass to the end; null texts stay null; rows that repeat a doc_id go together; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.llm import leaks, near_dups, pieces, repeats, toxicity
from korvane.llm.common import materialize, sent, sweep, table


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but those with a doc_id in ids. Texts are shuffled only if the ids are too many to be sent out."""
    ids = materialize(ids.select("doc_id").where("doc_id IS NOT NULL").distinct(), "dropped")
    return docs.join(sent(ids), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels and drop the documents that the operator predicts as toxic."""
    return toxicity.below(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), toxicity.TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near duplicates."""
    return without(docs, near_dups.near_duplicates(docs).where(~F.col("kept")))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the byte runs that documents with smaller ids have too. A character that a cut goes through is dropped."""
    others = {c: f"_carried_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # names that no operator has
    own = docs.select("doc_id", "text", F.col("text").isNotNull().alias("_text_there"), *(F.col(c).alias(to) for c, to in others.items()))
    left = repeats.repeats(own, carry=("_text_there", *others.values()))
    text = F.when(F.col("_text_there"), F.col("kept"))
    cut = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": text} | {c: F.col(to) for c, to in others.items()}
    if "n_chars" in others:
        cut["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return left.select(*(cut[c].alias(c) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    return without(docs, leaks.leaks(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    rows = pieces.encode(docs.select("doc_id", "lang", "source", "text"), most=2 << 20)
    return rows.select("doc_id", "lang", "source", F.size("pieces").cast("long").alias("n_tokens"), "pieces")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", drop_leaks),
    ("pieces", encode),
]

#: No stage but the exact joins can be said in SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        sweep(spark, docs)  # what the stage has left, and the stage before
    return docs
