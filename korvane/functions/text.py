"""Scalar expressions of the catalog: prices, embedding texts, fences, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def effective_price() -> Column:
    return F.coalesce("sale_price", "price")


def truthy_price() -> Column:
    """The price that a sale price of 0 does not replace."""
    return F.coalesce(F.nullif(F.col("sale_price"), F.lit(0)), F.col("price"))


def strike_price() -> Column:
    """The full price where a sale price other than 0 is shown instead of it."""
    return F.when(F.coalesce(F.col("sale_price"), F.lit(0)) != 0, F.col("price"))


def round_price(p: Column) -> Column:
    return F.floor(p / 1000) * 1000 + 900


def whole_won(x: Column) -> Column:
    """A price bound without its fraction, towards zero."""
    return x.cast("int")


def embed_text() -> Column:
    """What a product's vector stands for. A missing field reads None, missing tags read nothing."""
    f = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    labels = [("성별", "gender"), ("시즌", "season"), ("스타일", "style"), ("색상", "color"), ("소재", "material")]
    parts = [f("name"), F.lit(". 카테고리: "), f("category"), F.lit(" "), f("subcategory"), F.lit(". 브랜드: "), f("brand")]
    for label, c in labels:
        parts += [F.lit(f". {label}: "), f(c)]
    tags = F.coalesce(F.array_join("tags", ", ", "None"), F.lit(""))
    return F.concat(*parts, F.lit(". 설명: "), f("description"), F.lit(" 태그: "), tags)


def trimmed(x: Column) -> Column:
    """x without white space at its ends, line ends included."""
    return F.regexp_replace(x, r"\A\s+|\s+\z", "")


def strip_fence_strict(reply: Column) -> Column:
    """The whole first line goes if it opens a fence, and a fence at the very end."""
    t = trimmed(reply)
    body = F.regexp_replace(F.regexp_replace(t, r"(?s)\A```[^\n]*\n", ""), r"(?s)```\s*\z", "")
    return F.when(t.startswith("```"), trimmed(body)).otherwise(t)


def strip_fence_lenient(reply: Column) -> Column:
    """What stands between the first two fences, without a lower-case json tag and back-ticks left at its end."""
    t = trimmed(reply)
    inner = F.regexp_replace(F.get(F.split(t, "```", 3), 1), r"\Ajson", "")
    return F.when(t.startswith("```"), trimmed(F.regexp_replace(trimmed(inner), r"`+\z", ""))).otherwise(t)


def three_digits(x: Column) -> Column:
    return F.format_string("%.3f", x)


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)
