"""recommend_batch against recommend, one request after the other."""

from __future__ import annotations

import json

import pytest

from korvane.operators.models import PARSE, HashingEncoder
from korvane.operators.parse import ParseError
from korvane.plans.queries import gone, small_catalog
from korvane.plans.recommend import embed, recommend, recommend_batch, search

FILTERS = [{"style": None}, {"color": None}, {"price_min": 200000}, {"price_min": 100000.7, "price_max": 300000.9}, {"in_stock_only": False}, {"in_stock_only": 0}, {"price_max": "250000"}, {}]


class Canned:
    """The request is the reply; the reranker takes the first two."""

    def chat(self, system: str, user: str, max_tokens: int) -> str:
        if system == PARSE:
            return user
        return json.dumps({"recommendations": [{"product_id": c["product_id"], "reason": "r"} for c in json.loads(user)["candidates"][:2]]})


class Counting(Canned):
    """Writes a line for each call, whichever process it is in; replies to rerank with `reply` if there is one."""

    def __init__(self, path, reply=None):
        self.path, self.reply = str(path), reply

    def chat(self, system, user, max_tokens):
        with open(self.path, "a") as f:
            f.write("parse\n" if system == PARSE else "rerank\n")
        if system != PARSE and self.reply == "time-out":
            raise TimeoutError("no answer")
        return self.reply if system != PARSE and self.reply is not None else super().chat(system, user, max_tokens)


@pytest.mark.parametrize("dialect", ["strict", "lenient"])
def test_batch_equals_one_by_one(spark, sf, dialect):
    p, e = small_catalog(spark, sf)
    p, e = p.cache(), e.cache()
    some = p.where("NOT is_deleted AND stock > 0").first()
    filters = [{k: some[k] if v is None else v for k, v in f.items()} for f in FILTERS]
    asked = [(i, json.dumps({"filters": f, "semantic_query": "봄 원피스"}, ensure_ascii=False)) for i, f in enumerate(filters)]
    bad = (99, '{"filters": {"price_max": "cheap"}, "semantic_query": "x"}')
    batch = recommend_batch(p, e, spark.createDataFrame([*asked, bad], "qid long, query string"), HashingEncoder(64), Canned(), 10_000, dialect, True, gone())
    got = {r["qid"]: r for r in batch.collect()}
    counts = set()
    for i, query in asked:
        one = recommend(p, e, query, HashingEncoder(64), Canned(), 10_000, dialect, True, gone()).first()
        assert got[i]["error"] is None and one["candidate_count"] > 0
        for c in ("candidate_count", "recommendations"):
            assert got[i][c] == one[c], (filters[i], c)
        assert [x["id"] for x in got[i]["candidates_preview"]] == [x["id"] for x in one["candidates_preview"]]
        counts.add(one["candidate_count"])
    assert len(counts) > 4
    assert (got[99]["error"] is None) == (dialect == "strict")


ASKED = json.dumps({"filters": {}, "semantic_query": "봄 원피스"}, ensure_ascii=False)
NONE = json.dumps({"filters": {"category": "nothing is called so"}, "semantic_query": "x"})


def test_each_model_is_called_once_a_query(spark, sf, tmp_path):
    p, e = small_catalog(spark, sf)
    model = Counting(tmp_path / "calls")
    asked = spark.createDataFrame([(1, ASKED), (2, NONE), (3, " ")], "qid long, query string")
    rows = {r["qid"]: r for r in recommend_batch(p, e, asked, HashingEncoder(64), model, 10, deleted=gone()).collect()}
    assert sorted((tmp_path / "calls").read_text().split()) == ["parse", "parse", "rerank"]  # no candidates: no second call
    assert len(rows[1]["recommendations"]) == 2 and rows[2]["recommendations"] == [] and rows[2]["candidate_count"] == 0 and "blank" in rows[3]["error"]
    one = Counting(tmp_path / "one")
    assert recommend(p, e, ASKED, HashingEncoder(64), one, 10, deleted=gone()).collect()[0]["candidate_count"] == 10
    assert (tmp_path / "one").read_text().split() == ["parse", "rerank"]


@pytest.mark.parametrize("reply", ["no JSON", "{}", '{"recommendations": 5}', "time-out"])
def test_rerank_errors_are_carried(spark, sf, tmp_path, reply):
    p, e = small_catalog(spark, sf)
    model = Counting(tmp_path / "calls", reply)
    asked = spark.createDataFrame([(1, ASKED)], "qid long, query string")
    for dialect in ("strict", "lenient"):
        for strict in (True, False):
            row = recommend_batch(p, e, asked, HashingEncoder(64), model, 10, dialect, strict, gone()).first()
            assert row["error"] and row["recommendations"] == [] and row["candidate_count"] == 10
    with pytest.raises(ParseError):
        recommend(p, e, ASKED, HashingEncoder(64), model, 10, deleted=gone())


def test_ids_of_recommendations(spark, sf, tmp_path):
    p, e = small_catalog(spark, sf)
    reply = '{"recommendations": [{"product_id": "12", "reason": "a"}, {"product_id": "x", "reason": "b"}, {"product_id": null}, {"product_id": 3}]}'
    asked = spark.createDataFrame([(1, ASKED)], "qid long, query string")
    got = lambda dialect: [tuple(r) for r in recommend_batch(p, e, asked, HashingEncoder(64), Counting(tmp_path / "c", reply), 10, dialect, False, gone()).first()["recommendations"]]
    assert got("strict") == [(12, "12", "a"), (3, "3", "")]
    assert got("lenient") == [(12, "12", "a"), (None, "x", "b"), (None, None, None), (3, "3", None)]


def test_payload_is_what_rerankers_are_sent(spark, sf):
    from pyspark.sql import functions as F

    from korvane.operators.rerank import payload

    p, _ = small_catalog(spark, sf)
    row = p.where("brand IS NOT NULL").withColumns({"gender": F.lit(None).cast("string"), "sale_price": F.lit(0)}).select(payload().alias("s"), payload("lenient").alias("l"), "price").first()
    s, other = json.loads(row["s"]), json.loads(row["l"])
    assert list(s) == ["product_id", "name", "category", "subcategory", "gender", "season", "style", "color", "price"]
    assert list(other) == [*s, "stock"] and s["gender"] is None and s["price"] == 0 and other["price"] == row["price"]


def test_search_and_embed(spark, sf):
    p, e = small_catalog(spark, sf)
    encoder = HashingEncoder(64)
    rows = search(p, e, "봄 원피스", encoder, {"gender": "여성"}, 7, deleted=gone()).collect()
    assert len(rows) == 7 and all(r["gender"] in ("여성", "공용") and r["stock"] > 0 for r in rows)
    assert [r["distance"] for r in rows] == sorted(r["distance"] for r in rows)
    got = embed(["a", "b"], encoder)
    assert got["model"] == "hashing" and got["dim"] == 64 and [round(sum(x * x for x in v), 9) for v in got["vectors"]] == [1, 1]
    assert search(p, e, "x", encoder, k=0, deleted=gone()).collect() == []
    for query, k in ((" ", 5), ("x", -1)):
        with pytest.raises(ValueError):
            search(p, e, query, encoder, k=k, deleted=gone())
