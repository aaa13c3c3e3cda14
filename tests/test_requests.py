"""Filter maps and model replies in both dialects: one case for each divergence."""

from __future__ import annotations

import pytest

from korvane.operators.filters import FilterSpec, normalize
from korvane.operators.parse import ParseError, parse_filters, parse_recommendations, strip_fence


@pytest.mark.parametrize(
    ("raw", "strict", "lenient"),
    [
        ({"style": ""}, FilterSpec(style=""), FilterSpec()),
        ({"in_stock_only": None}, FilterSpec(), FilterSpec(in_stock_only=False)),
        ({"in_stock_only": 0}, FilterSpec(), FilterSpec(in_stock_only=False)),
        ({"in_stock_only": False}, FilterSpec(in_stock_only=False), FilterSpec(in_stock_only=False)),
        ({"price_max": 49999.9}, FilterSpec(price_max=49999), FilterSpec(price_max=49999.9)),
        ({"price_min": -1.9}, FilterSpec(price_min=-1), FilterSpec(price_min=-1.9)),
        ({"price_min": "100"}, FilterSpec(), FilterSpec(price_min=100.0)),
        ({"price_max": 0}, FilterSpec(price_max=0), FilterSpec(price_max=0)),
        ({"color": ["블랙"], "category": {"a": 1}}, FilterSpec(), FilterSpec()),
        ({"unknown": "kept by nobody"}, FilterSpec(), FilterSpec()),
        (None, FilterSpec(), FilterSpec()),
    ],
)
def test_filter_maps(raw, strict, lenient):
    assert normalize(raw) == strict
    assert normalize(raw, "lenient") == lenient


def test_no_such_dialect():
    with pytest.raises(ValueError):
        normalize({}, "loose")


@pytest.mark.parametrize(
    ("reply", "strict", "lenient"),
    [
        ('{"a": 1}', '{"a": 1}', '{"a": 1}'),
        ('```json\n{"a": 1}\n```', '{"a": 1}', '{"a": 1}'),
        ('```\n{"a": 1}\n```', '{"a": 1}', '{"a": 1}'),
        ('```JSON\n{"a": 1}\n```', '{"a": 1}', 'JSON\n{"a": 1}'),
        ('```json\n{"a": 1}\n``` and prose', '{"a": 1}\n``` and prose', '{"a": 1}'),
        ('```json{"a": 1}```', '```json{"a": 1}', '{"a": 1}'),
        ('```json\n{"a": 1}\n``', '{"a": 1}\n``', '{"a": 1}'),
    ],
)
def test_fences(reply, strict, lenient):
    assert strip_fence(reply) == strict
    assert strip_fence(reply, "lenient") == lenient


def test_filters():
    reply = '{"filters": {"gender": "여성", "season": null, "tags": [1]}, "semantic_query": "코트"}'
    assert parse_filters(reply) == ({"gender": "여성"}, "코트")
    assert parse_filters(reply, "lenient") == ({"gender": "여성", "season": None, "tags": [1]}, "코트")
    assert parse_filters(reply + " trailing") == ({"gender": "여성"}, "코트")
    with pytest.raises(ParseError):
        parse_filters(reply + " trailing", "lenient")


@pytest.mark.parametrize("reply", ["here it is:\n```json\n{}\n```", "{}", '{"filters": {}, "semantic_query": null}', '{"semantic_query": "x"}', "[1]", ""])
@pytest.mark.parametrize("dialect", ["strict", "lenient"])
def test_bad_replies(reply, dialect):
    with pytest.raises(ParseError):
        parse_filters(reply, dialect)


def test_recommendations():
    reply = '{"recommendations": [{"product_id": "12", "reason": "a"}, {"product_id": "junk"}, {"product_id": 3}]}'
    assert parse_recommendations(reply) == [{"product_id": 12, "reason": "a"}, {"product_id": 3, "reason": ""}]
    assert parse_recommendations(reply, "lenient")[0]["product_id"] == "12"
    with pytest.raises(ParseError):
        parse_recommendations("{}")


@pytest.mark.parametrize("raw", [{"price_min": float("nan")}, {"price_max": float("inf")}])
@pytest.mark.parametrize("dialect", ["strict", "lenient"])
def test_bounds_that_are_no_numbers(raw, dialect):
    with pytest.raises(ValueError):
        normalize(raw, dialect)
    assert normalize({"price_max": "cheap"}) == FilterSpec()
    with pytest.raises(ValueError):
        normalize({"price_max": "cheap"}, "lenient")


def test_elements_that_are_no_objects():
    reply = '{"recommendations": [5, {"product_id": 3, "reason": "r"}, null]}'
    assert parse_recommendations(reply) == [{"product_id": 3, "reason": "r"}]
    with pytest.raises(ParseError):
        parse_recommendations(reply, "lenient")
