"""Request filters: an untyped map becomes a FilterSpec, a FilterSpec a list of predicates."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields
from math import isfinite, trunc
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korvane.functions.text import effective_price
from korvane.sources.schemas import ANY_GENDER, ANY_SEASON

TEXTS = ("category", "gender", "season", "style", "color")
BOUNDS = ("price_min", "price_max")


@dataclass(frozen=True)
class FilterSpec:
    """Values that apply; None applies nothing."""

    category: str | None = None
    gender: str | None = None
    season: str | None = None
    style: str | None = None
    color: str | None = None
    price_min: float | None = None
    price_max: float | None = None
    in_stock_only: bool = True
    tenant_id: str | None = None


def normalize(raw: dict[str, Any] | None, dialect: str = "strict") -> FilterSpec:
    """Read a filter map in one of two dialects.

    strict: only texts filter texts, the empty one too; only numbers bound prices, without their fraction; stock is
    asked for unless in_stock_only is false itself. lenient: empty and zero-like values filter nothing, bounds stay as
    they are, texts are read as numbers, and stock is asked for if in_stock_only is absent or truthy. Lists and objects
    filter nothing in either. A bound that is NaN or infinite, or in lenient a text that is no number, is a ValueError."""
    if dialect not in ("strict", "lenient"):
        raise ValueError(f"no such dialect: {dialect}")
    raw, strict, got = dict(raw or {}), dialect == "strict", {}
    for k in TEXTS:
        v = raw.get(k)
        if isinstance(v, str) and (strict or v):
            got[k] = v
        elif not strict and isinstance(v, int | float) and v:
            got[k] = str(v)
    for k in BOUNDS:
        v = raw.get(k)
        if isinstance(v, bool):
            continue
        if isinstance(v, str) and not strict:
            v = float(v)
        if isinstance(v, int | float):
            if not isfinite(v):
                raise ValueError(f"{k} is not finite: {v}")
            got[k] = trunc(v) if strict else v
    stock = raw.get("in_stock_only", True)
    got["in_stock_only"] = stock is not False if strict else bool(stock)
    return FilterSpec(**got)


def predicates(spec: FilterSpec, deleted: Column | None = None) -> list[Column]:
    """The conjuncts for a spec. `deleted`: true for a deleted product; default: deleted_at is set."""
    out = [~deleted if deleted is not None else F.col("deleted_at").isNull()]
    if spec.in_stock_only:
        out.append(F.col("stock") > 0)
    for k in ("category", "style", "color", "tenant_id"):
        if (v := getattr(spec, k)) is not None:
            out.append(F.col(k) == v)
    if spec.gender is not None:
        out.append(F.col("gender").isin(spec.gender, ANY_GENDER))
    if spec.season is not None:
        out.append(F.col("season").isin(spec.season, ANY_SEASON))
    if spec.price_min is not None:
        out.append(effective_price() >= F.lit(spec.price_min))
    if spec.price_max is not None:
        out.append(effective_price() <= F.lit(spec.price_max))
    return out


def all_of(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def chip_rows(filters: DataFrame, key: str = "qid") -> DataFrame:
    """chips() for a table of filter structs: a row of key, name and value for each value that applies."""
    names = [c for c in filters.columns if c != key]
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in names])
    return filters.select(key, F.explode(pairs).alias("chip")).select(key, "chip.name", "chip.value").where("value IS NOT NULL")


def chips(spec: FilterSpec) -> list[tuple[str, str]]:
    """Key and value of what applies, for display."""
    return [(f.name, str(v)) for f in fields(spec) if (v := asdict(spec)[f.name]) is not None]
