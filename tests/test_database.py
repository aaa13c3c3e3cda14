"""The tables in a database: Derby, which comes with Spark, stands for any."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from korvane.operators import backfill as B
from korvane.operators.models import HashingEncoder, RuleBased, model_of
from korvane.operators.search import search
from korvane.plans import jobs
from korvane.sources.database import TABLES, Database
from korvane.sources.schemas import PRODUCTS, Settings


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    out = Database(f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/shop;create=true")
    out.create(spark)
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sources():
    url = "jdbc:postgresql://db.example:5433/shop?stringtype=unspecified"
    assert Database("postgres://a%40b:p%3Aw@db.example:5433/shop?stringtype=unspecified").source() == {"url": url, "user": "a@b", "password": "p:w"}
    assert Database("mariadb://h/x", {"fetchsize": "7"}).source() == {"url": "jdbc:mariadb://h/x", "fetchsize": "7"}
    for bad in ("", "shop", "postgresql:///shop"):
        with pytest.raises(ValueError):
            Database(bad).source()


def test_empty_tables(spark, db):
    db.create(spark)  # again: they stay
    for name, schema in TABLES.items():
        rows = db.read(spark, name)
        assert db.bounds(spark, name) is None and rows.collect() == []
        assert [(f.name, f.dataType.simpleString()) for f in rows.schema] == [(f.name, f.dataType.simpleString()) for f in schema]
    assert jobs.embed_missing(spark, db, HashingEncoder(16)) == 0


def test_catalog_and_vectors(spark, db):
    jobs.seed(spark, db, 600)
    rows = db.read(spark, "products", 5)
    assert db.bounds(spark, "products") == (1, 600) and rows.rdd.getNumPartitions() == 5
    told = jobs.generate(spark, 600).drop("created_at", "updated_at")
    assert {tuple(map(str, r)) for r in rows.select(told.columns).collect()} == {tuple(map(str, r)) for r in told.collect()}

    dear = rows.where("category = '신발' AND price >= 100000").select("id", "price")
    text = plan(dear)
    assert "EqualTo(category,신발)" in text and "GreaterThanOrEqual(price,100000)" in text and "description" not in text
    assert dear.count() == told.where("category = '신발' AND price >= 100000").count() > 0

    encoder, heard = HashingEncoder(16), []
    some = rows.where("id % 3 = 0")
    db.write("product_embeddings", B.embed(some, encoder))
    before = {r["product_id"]: r for r in db.read(spark, "product_embeddings").collect()}
    assert jobs.embed_missing(spark, db, encoder, 8, lambda *got: heard.append(got)) == 600 - len(before)
    assert heard[-1][:2] == (400, 400)
    vectors = db.read(spark, "product_embeddings")
    after = {r["product_id"]: r for r in vectors.collect()}
    assert len(after) == vectors.count() == 600 and all(after[k] == r for k, r in before.items())
    want = {r["product_id"]: r["embedding"] for r in B.embed(rows, encoder).collect()}
    assert all(after[k]["embedding"] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    assert jobs.embed_missing(spark, db, encoder) == 0
    query = encoder.vectors(["블랙 코트"])[0].tolist()
    stored = told.withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}).select(PRODUCTS.names)
    assert [r["id"] for r in search(rows, vectors, query, k=7).collect()] == [r["id"] for r in search(stored, B.embed(stored, encoder), query, k=7).collect()]


def test_seeding_again_empties(spark, db):
    jobs.seed(spark, db, 20, 7)
    assert db.bounds(spark, "products") == (1, 20) and db.read(spark, "product_embeddings").count() == 0


def test_a_run_that_was_broken_off(spark, db):
    class Failing(HashingEncoder):
        def vectors(self, texts):
            raise RuntimeError("gone")

    jobs.seed(spark, db, 50)
    with pytest.raises(Exception, match="gone"):
        jobs.embed_missing(spark, db, Failing(16))
    assert db.read(spark, "product_embeddings").count() == 0
    assert jobs.embed_missing(spark, db, HashingEncoder(16)) == 50


def test_settings(monkeypatch):
    assert isinstance(model_of(Settings()), RuleBased)
    monkeypatch.setenv("LLM_MODEL", "far away")
    with pytest.raises(ValueError):
        model_of(Settings())
    monkeypatch.delenv("DB_DSN", raising=False)
    for args in ([], ["seed"], ["other"]):
        with pytest.raises(SystemExit):
            jobs.main(args)
