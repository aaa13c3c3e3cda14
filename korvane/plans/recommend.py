"""The service's three operations as functions over frames: recommend, search and embed."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korvane.operators import rerank as R
from korvane.operators.filters import normalize
from korvane.operators.models import PARSE, Encoder, LanguageModel
from korvane.operators.parse import ParseError, parse_filters, parse_queries
from korvane.operators.search import search as nearest
from korvane.sources.schemas import FILTERS
from korvane.sources.stored import materialize


def checked(query: str, k: int) -> None:
    if not query or not query.strip():
        raise ValueError("the query is blank")
    if k < 0:
        raise ValueError("k must not be negative")


def embed(texts: list[str], encoder: Encoder) -> dict[str, Any]:
    return {"model": encoder.name, "dim": encoder.dim, "vectors": encoder.vectors(texts).tolist()}


def search(products: DataFrame, embeddings: DataFrame, query: str, encoder: Encoder, filters: dict[str, Any] | None = None, k: int = 10, dialect: str = "strict", deleted: Column | None = None) -> DataFrame:
    """The k products nearest to the words of the query. No filters still ask for stock."""
    checked(query, k)
    return nearest(products, embeddings, encoder.vectors([query])[0].tolist(), normalize(filters, dialect), k, deleted)


def recommend(products: DataFrame, embeddings: DataFrame, query: str, encoder: Encoder, model: LanguageModel, k: int = 30, dialect: str = "strict", strict: bool = False, deleted: Column | None = None) -> DataFrame:
    """One row: filters, semantic_query, candidate_count, recommendations, candidates_preview. A reply that cannot be read raises.

    The parsed meaning is embedded, the request itself goes to the reranker. Either model is called once, and the search
    runs once: candidates and replies are stored."""
    checked(query, k)
    spark = products.sparkSession
    filters, meaning = parse_filters(model.chat(PARSE, query, 512), dialect)
    hits = nearest(products, embeddings, encoder.vectors([meaning])[0].tolist(), normalize(filters, dialect), k, deleted).withColumn("qid", F.lit(0).cast("long"))
    hits = materialize(hits, "hits")
    asked = spark.range(1).select(F.col("id").alias("qid"), F.lit(query).alias("query"), F.lit(json.dumps(filters, ensure_ascii=False)).alias("filters"), F.lit(meaning).alias("semantic_query"))
    recs = R.rerank(hits, asked, model, dialect, strict)
    failed = recs.where("error IS NOT NULL").select("error").first()
    if failed:
        raise ParseError(failed["error"])
    return R.envelope(asked, hits, recs).drop("qid", "query")


def recommend_batch(products: DataFrame, embeddings: DataFrame, queries: DataFrame, encoder: Encoder, model: LanguageModel, k: int = 30, dialect: str = "strict", strict: bool = True, deleted: Column | None = None) -> DataFrame:
    """recommend() for a table of queries (qid, query), with an error column instead of exceptions.

    Parsed requests, candidates and replies are stored, so each model is called once a query."""
    from korvane.operators.models import encode
    from korvane.operators.search import search_batch

    parsed = materialize(parse_queries(queries, model, dialect), "parsed")
    named = parsed.where("error IS NULL").select("qid", "query", "semantic_query", "spec")
    parsed = parsed.drop("spec")
    asked = encode(named.select("qid", "query", "semantic_query", "spec.*"), encoder, "semantic_query", "q")
    asked = materialize(asked.select("qid", "q", *FILTERS.names), "asked")
    hits = materialize(search_batch(products, embeddings, asked, k, deleted), "hits")
    recs = R.rerank(hits, named.select("qid", "query"), model, dialect, strict)
    return R.envelope(parsed, hits, recs)
