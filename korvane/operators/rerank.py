"""From candidates to recommendations: payload, preview, resolution and the result envelope."""

from __future__ import annotations

from collections.abc import Iterator
from json import dumps, loads

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvane.functions.text import effective_price, truthy_price
from korvane.operators.models import RERANK, LanguageModel
from korvane.operators.parse import parse_recommendations
from korvane.sources.schemas import CANDIDATE
from korvane.sources.stored import materialize

PREVIEW = 5


# What a reranker is sent of a candidate and of a request, by name and in order.
PAYLOAD = ["product_id", "name", "category", "subcategory", "gender", "season", "style", "color", "price"]
PAYLOAD_LENIENT = [*PAYLOAD, "stock"]
REQUEST = ["user_query", "candidates"]


def payload(dialect: str = "strict") -> Column:
    """What a reranker sees of a candidate, as JSON with nulls written out. lenient: with stock, and a sale price of 0 does not count."""
    strict = dialect == "strict"
    made = {"product_id": F.col("id"), "price": effective_price() if strict else truthy_price()}
    return F.to_json(F.struct(*(made.get(c, F.col(c)).alias(c) for c in (PAYLOAD if strict else PAYLOAD_LENIENT))), {"ignoreNullFields": "false"})


def in_order(hits: DataFrame, columns: list[str]) -> Column:
    """Collected rows of a limited result, nearest first. Only for at most k rows a group."""
    near = F.struct(F.col("distance").isNull().alias("none"), "distance", "id")
    return F.transform(F.array_sort(F.collect_list(F.struct(near.alias("near"), F.struct(*columns).alias("row")))), lambda x: x.row)


def preview(hits: DataFrame, n: int = PREVIEW) -> DataFrame:
    return hits.orderBy(F.col("distance").asc_nulls_last(), "id").limit(n)


def rerank(hits: DataFrame, queries: DataFrame, model: LanguageModel, dialect: str = "strict", strict: bool = False, max_tokens: int = 1024) -> DataFrame:
    """qid, position, product_id, given_id, reason, error for hits (qid, ...) and queries (qid, query).

    A query without candidates gets no row and no model call; one whose reply cannot be read, or whose call fails, gets one
    row with its error. The replies are stored, so the model is called once a query however often the result is read.
    given_id is the id as the model wrote it, product_id the number that it stands for, null if it is none. strict: ids
    outside the candidates and repeats go, five stay."""

    packed = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(F.col("distance").isNull(), "distance", "id").alias("near"), payload(dialect).alias("p")))), lambda x: x.p).alias("candidates"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for qid, query, listed in zip(b["qid"], b["query"], b["candidates"], strict=True):
                try:
                    asked = dumps(dict(zip(REQUEST, (query, [loads(c) for c in listed]), strict=True)), ensure_ascii=False)
                    recs = parse_recommendations(model.chat(RERANK, asked, max_tokens), dialect)
                    rows += [(qid, i, *chosen(r), None) for i, r in enumerate(recs, 1)]
                except Exception as e:  # noqa: BLE001  a model may fail in any way; the other queries go on
                    rows.append((qid, 0, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["qid", "position", "product_id", "given_id", "reason", "error"]).astype({"product_id": "Int64"})

    kind = hits.schema["qid"].dataType.simpleString()
    asked = packed.select("qid", "candidates").join(queries.select("qid", "query"), "qid")
    out = materialize(asked.mapInPandas(run, f"qid {kind}, position int, product_id long, given_id string, reason string, error string"), "recommendations")
    if not strict:
        return out
    known = out.join(hits.select("qid", F.col("id").alias("product_id")), ["qid", "product_id"], "left_semi").select(*out.columns)
    first = known.withColumn("again", F.row_number().over(Window.partitionBy("qid", "product_id").orderBy("position"))).where("again = 1").drop("again")
    five = first.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("position"))).where(F.col("position") <= 5)
    return five.select(*out.columns).unionByName(out.where("error IS NOT NULL"))


def chosen(r: dict) -> tuple[int | None, str | None, str | None]:
    """product_id, given_id and reason of one element of a reply."""
    given = r.get("product_id")
    try:
        number = int(given)
    except (TypeError, ValueError, OverflowError):
        number = None
    reason = r.get("reason")
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None, None if given is None else str(given), None if reason is None else str(reason)


def resolved(recs: DataFrame, shown: DataFrame) -> DataFrame:
    """Recommendations whose product is among the shown ones."""
    return recs.join(shown.withColumnRenamed("id", "product_id"), "product_id", "inner")


def display(recs: DataFrame, shown: DataFrame) -> DataFrame:
    """Every recommendation, with the product's name or a stand-in for it."""
    names = shown.select(F.col("id").alias("product_id"), "name", effective_price().alias("price"))
    out = recs.join(names, "product_id", "left")
    return out.withColumn("name", F.coalesce("name", F.concat(F.lit("상품 "), F.col("product_id").cast("string"))))


def chosen_count(recs: Column) -> Column:
    """How many products were chosen."""
    return F.coalesce(F.size(recs), F.lit(0))


def envelope(queries: DataFrame, hits: DataFrame, recs: DataFrame) -> DataFrame:
    """One row for each query: candidate_count, recommendations and candidates_preview, empty arrays where there are none.

    Where queries have an error column, the reranker's error joins it."""
    counted = hits.groupBy("qid").agg(F.count("*").alias("candidate_count"), F.slice(in_order(hits, [*CANDIDATE, "distance"]), 1, PREVIEW).alias("candidates_preview"))
    listed = F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("position", "product_id", "given_id", "reason"))))
    chosen_ = recs.groupBy("qid").agg(F.transform(listed, lambda r: F.struct(r.product_id.alias("product_id"), r.given_id.alias("given_id"), r.reason.alias("reason"))).alias("recommendations"), F.max("error").alias("rerank_error"))
    out = queries.join(counted, "qid", "left").join(chosen_, "qid", "left")
    out = out.withColumns({"candidate_count": F.coalesce("candidate_count", F.lit(0)), "recommendations": F.coalesce("recommendations", F.array().cast(chosen_.schema["recommendations"].dataType)), "candidates_preview": F.coalesce("candidates_preview", F.array().cast(counted.schema["candidates_preview"].dataType))})
    if "error" in queries.columns:
        out = out.withColumn("error", F.coalesce("error", "rerank_error"))
    return out.drop("rerank_error")
