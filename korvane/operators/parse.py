"""Model replies: fences, filters and recommendations. Each has a strict and a lenient reading."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korvane.operators.filters import BOUNDS, normalize
from korvane.operators.models import PARSE, LanguageModel
from korvane.sources.schemas import FILTERS, RECOMMENDATIONS


class ParseError(ValueError):
    pass


def strip_fence(reply: str, dialect: str = "strict") -> str:
    """strict: the fence's whole first line goes, and a fence at the end. lenient: what is between the first two fences, without a json tag and back-ticks left at its end."""
    t = reply.strip()
    if not t.startswith("```"):
        return t
    if dialect == "strict":
        return re.sub(r"(?s)```\s*\Z", "", re.sub(r"\A```[^\n]*\n", "", t)).strip()
    # the steps and their order are fixed: what they leave is what is parsed
    inner = t.split("```", 2)[1].removeprefix("json").strip()
    return inner.rstrip("`").strip()


def load(reply: str, dialect: str) -> dict[str, Any]:
    text = strip_fence(reply, dialect)
    try:
        got = json.JSONDecoder().raw_decode(text)[0] if dialect == "strict" else json.loads(text)
    except ValueError as e:
        raise ParseError(f"not JSON: {text[:200]}") from e
    if not isinstance(got, dict):
        raise ParseError("not an object")
    return got


def parse_filters(reply: str, dialect: str = "strict") -> tuple[dict[str, Any], str]:
    """Filters and semantic query. strict keeps booleans, numbers and texts only."""
    got = load(reply, dialect)
    if not isinstance(got.get("filters"), dict):
        raise ParseError("no filters")
    if not isinstance(got.get("semantic_query"), str):
        raise ParseError("no semantic_query")
    filters = got["filters"]
    return {k: v for k, v in filters.items() if isinstance(v, bool | int | float | str)} if dialect == "strict" else filters, got["semantic_query"]


def parse_recommendations(reply: str, dialect: str = "strict") -> list[dict[str, Any]]:
    """(product_id, reason) in order. strict: ids as whole numbers, others dropped; lenient: as they are. Elements that are no objects go in strict and are an error in lenient."""
    got = load(reply, dialect).get("recommendations")
    if not isinstance(got, list):
        raise ParseError("no recommendations")
    if dialect == "lenient":
        if not all(isinstance(r, dict) for r in got):
            raise ParseError("a recommendation is no object")
        return got
    out = []
    for r in got:
        try:
            out.append({"product_id": int(r["product_id"]), "reason": str(r.get("reason") or "")})
        except (KeyError, TypeError, ValueError, OverflowError, AttributeError):
            continue
    return out


def filters_of(reply: Column) -> Column:
    """A well-formed reply as struct(filters, semantic_query)."""
    return F.from_json(reply, f"filters {FILTERS.simpleString()}, semantic_query string")


def recommendations_of(reply: Column) -> Column:
    """A well-formed reply as array(struct(product_id long, reason)); ids that are no numbers go."""
    recs = F.from_json(reply, f"recommendations {RECOMMENDATIONS}")["recommendations"]
    cast = F.transform(recs, lambda r: F.struct(r.product_id.try_cast("long").alias("product_id"), r.reason.alias("reason")))
    return F.filter(cast, lambda r: r.product_id.isNotNull())


def _spec(filters: dict[str, Any], dialect: str) -> dict[str, Any]:
    """A filter map as normalize() reads it, in the columns of FILTERS."""
    spec = normalize(filters, dialect)
    return {c: v if (v := getattr(spec, c)) is None or c not in BOUNDS else float(v) for c in FILTERS.names}


def parse_queries(queries: DataFrame, model: LanguageModel, dialect: str = "strict", max_tokens: int = 512) -> DataFrame:
    """queries (qid, query) with filters (JSON), semantic_query, error, and spec (the filters as normalize() reads them): one bad reply does not fail the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for qid, query in zip(b["qid"], b["query"], strict=True):
                try:
                    if not query or not query.strip():
                        raise ParseError("blank query")
                    filters, meaning = parse_filters(model.chat(PARSE, query, max_tokens), dialect)
                    spec = _spec(filters, dialect)  # a map that cannot be read is this query's error
                    rows.append((qid, query, json.dumps(filters, ensure_ascii=False), meaning, None, spec))
                except Exception as e:  # noqa: BLE001  a model may fail in any way; the other queries go on
                    rows.append((qid, query, None, None, f"{type(e).__name__}: {e}", None))
            yield pd.DataFrame(rows, columns=["qid", "query", "filters", "semantic_query", "error", "spec"])

    return queries.select("qid", "query").mapInPandas(run, f"qid {queries.schema['qid'].dataType.simpleString()}, query string, filters string, semantic_query string, error string, spec {FILTERS.simpleString()}")
