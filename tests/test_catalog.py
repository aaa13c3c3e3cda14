"""The generator's laws, appends, backfills, the outbox and the command line."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from korvane.functions.vector import l2_normalize
from korvane.operators import backfill as B
from korvane.operators.filters import FilterSpec, chip_rows, chips
from korvane.operators.models import HashingEncoder, encoder_of
from korvane.plans import smoke
from korvane.sources import catalog as C
from korvane.sources.schemas import EMBEDDINGS, GENDERS, OUTBOX, PRODUCTS, SEASONS, STYLES, Settings, create_tables, violations
from korvane.streaming import outbox as O


@pytest.fixture(scope="module")
def made(spark):
    return C.generate(spark, 4000).cache()


def test_generated_rows_keep_the_laws(spark, made):
    rows = made.collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["id"])] == list(range(1, 4001))
    assert violations(made, PRODUCTS, ["id", "sku"]).collect() == []
    for r in rows:
        low, high = C.PRICES[r["category"]]
        assert r["price"] % 1000 == 900 and low // 1000 * 1000 <= r["price"] <= high + 900
        assert r["subcategory"] in C.CATEGORIES[r["category"]] and r["material"] in C.MATERIALS[r["category"]]
        assert r["style"] in STYLES and r["color"] in C.COLORS and r["brand"] in C.BRANDS
        assert r["sale_price"] is None or (r["sale_price"] % 1000 == 900 and r["sale_price"] <= r["price"])
        pool, least, most = (C.SHOE_SIZES, 3, 7) if r["category"] == C.SHOES else (C.SIZES, 2, 5)
        assert least <= len(r["sizes"]) == len(set(r["sizes"])) <= most and set(r["sizes"]) <= set(pool)
        assert r["tags"] == [r[c] for c in ("category", "subcategory", "brand", "gender", "season", "style", "color")]
        assert len(r["sku"]) == 14 and r["sku"].startswith("SKU-") and r["deleted_at"] is None
        assert r["brand"] in r["name"] and r["color"] in r["name"]
    share = lambda test: sum(map(test, rows)) / len(rows)
    assert share(lambda r: r["stock"] == 0) == pytest.approx(0.1, abs=0.02) and share(lambda r: r["sale_price"] is not None) == pytest.approx(0.35, abs=0.03)
    for c, weights in (("gender", dict(zip(GENDERS, (5, 4, 3), strict=True))), ("season", dict(zip(SEASONS, (3, 3, 3, 3, 2), strict=True)))):
        n = Counter(r[c] for r in rows)
        assert all(n[v] / len(rows) == pytest.approx(w / sum(weights.values()), abs=0.03) for v, w in weights.items())
    again = C.generate(spark, 4000).drop("created_at", "updated_at")
    assert again.exceptAll(made.drop("created_at", "updated_at")).count() == 0


def test_append_fills_ids_and_defaults(spark, made, tmp_path):
    table, new = made.where("id <= 10"), made.where("id > 10").drop("id", "tenant_id", "stock", "created_at", "updated_at", "deleted_at")
    out = B.append(table, new, now=F.lit("2024-05-01").cast("timestamp")).where("id > 10").collect()
    assert [f.dataType.simpleString() for f in B.append(table, new).schema.fields] == [f.dataType.simpleString() for f in PRODUCTS.fields]
    assert sorted(r["id"] for r in out) == list(range(11, 4001))
    assert [r["sku"] for r in sorted(out, key=lambda r: r["id"])] == sorted(r["sku"] for r in new.select("sku").collect())
    assert {(r["tenant_id"], r["stock"], str(r["created_at"]), r["deleted_at"]) for r in out} == {("demo", 0, "2024-05-01 00:00:00", None)}
    rebuilt = B.rebuild(made.where("id > 3990"), str(tmp_path))
    assert sorted(r["id"] for r in rebuilt.select("id").collect()) == list(range(1, 11))
    assert spark.read.parquet(f"{tmp_path}/product_embeddings").count() == 0
    assert sorted(r["id"] for r in B.append(made.limit(0), new.limit(0)).collect()) == []


def test_backfill_takes_up_what_is_missing(spark, made, tmp_path):
    p, encoder = made.where("id <= 40"), HashingEncoder(16)
    empty = spark.createDataFrame([], EMBEDDINGS)
    path, n = B.backfill(spark, p.where("id <= 25"), empty, encoder, str(tmp_path), batch=7)
    assert n == 25
    first = spark.read.schema(EMBEDDINGS).parquet(path)
    path, n = B.backfill(spark, p, first, encoder, str(tmp_path))
    second = spark.read.schema(EMBEDDINGS).parquet(path)
    assert n == 15 and second.count() == 40 and violations(second, EMBEDDINGS, ["product_id"]).collect() == []
    assert B.backfill(spark, p, second, encoder, str(tmp_path)) == (None, 0)
    assert first.exceptAll(second).count() == 0  # what was there stays as it was
    assert B.progress(10, 40, 5.0) == (2.0, 15.0) and B.progress(0, 40, 0.0) == (0.0, 0.0)


def test_a_stream_repeats_without_repeating_rows(spark, made, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "vectors")
    spark.createDataFrame([], EMBEDDINGS).write.parquet(target)
    stored = lambda: spark.read.schema(EMBEDDINGS).parquet(target)
    write = lambda df, epoch: df.write.mode("append").parquet(target)
    for ids, checkpoint in (("id <= 20", "a"), ("id BETWEEN 15 AND 30", "a"), ("id <= 0", "b")):  # b: everything once more
        made.where(ids).write.mode("append").parquet(source)
        O.stream_backfill(spark.readStream.schema(PRODUCTS).parquet(source), stored, write, HashingEncoder(8), str(tmp_path / checkpoint)).awaitTermination()
    assert sorted(r["product_id"] for r in stored().select("product_id").collect()) == list(range(1, 31))


def test_settled(spark):
    rows = [(1, 7, "t", "{}", None, None, None, "2024-01-02"), (2, 7, "t", "{}", None, 2, "old", "2024-01-01"), (3, 7, "t", "{}", "2024-01-03", 0, None, "2024-01-01")]
    frame = spark.createDataFrame(rows, "id long, aggregate_id long, event_type string, payload string, processed_at string, retry_count int, last_error string, created_at string")
    frame = frame.select(*(F.col(f.name).cast(f.dataType) for f in OUTBOX.fields))
    assert [r["id"] for r in O.pending(frame).collect()] == [2, 1] and [r["id"] for r in O.pending(frame, 2).collect()] == [1]
    out = {r["id"]: r for r in O.settled(frame, spark.createDataFrame([(1, "bad"), (2, None)], "id long, error string"), F.lit("2025-01-01").cast("timestamp")).collect()}
    assert out[1]["processed_at"] is None and (out[1]["retry_count"], out[1]["last_error"]) == (1, "bad")
    assert str(out[2]["processed_at"]) == "2025-01-01 00:00:00" and (out[2]["retry_count"], out[2]["last_error"]) == (2, "old")
    assert str(out[3]["processed_at"]) == "2024-01-03 00:00:00"


def test_tables_and_violations(spark, tmp_path):
    create_tables(spark, str(tmp_path))
    create_tables(spark, str(tmp_path))
    for name, schema in (("products", PRODUCTS), ("product_embeddings", EMBEDDINGS), ("outbox_events", OUTBOX)):
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == 0 and spark.read.parquet(f"{tmp_path}/{name}").columns == schema.fieldNames()
    bad = spark.createDataFrame([(1, None), (1, "m"), (None, "m")], "product_id long, model string")
    got = {(r["rule"], r["n"]) for r in violations(bad.withColumns({"embedding": F.lit(None), "embedded_text": F.lit("t"), "updated_at": F.lit("x")}), EMBEDDINGS, ["product_id"]).collect()}
    assert got == {("product_id is null", 1), ("model is null", 1), ("product_id repeats", 1)}


def test_declared_types(spark):
    rows = spark.createDataFrame([(1, "[0.5,1]", "t", "m", "2024-01-01 00:00:00")], "product_id int, embedding string, embedded_text string, model string, updated_at string")
    out = C.declared(rows, EMBEDDINGS)
    assert [f.dataType.simpleString() for f in out.schema.fields] == [f.dataType.simpleString() for f in EMBEDDINGS.fields]
    assert out.first()["embedding"] == [0.5, 1.0]


def test_chips_and_settings(spark, monkeypatch):
    spec = FilterSpec(gender="여성", price_max=5)
    assert chips(spec) == [("gender", "여성"), ("price_max", "5"), ("in_stock_only", "True")]
    rows = chip_rows(spark.createDataFrame([(1, "여성", 5), (2, None, None)], "qid long, gender string, price_max int")).collect()
    assert {tuple(r) for r in rows} == {(1, "gender", "여성"), (1, "price_max", "5")}
    monkeypatch.setenv("EXPECTED_DIM", "32")
    assert encoder_of(Settings()).dim == 32
    monkeypatch.setenv("EMBED_MODEL", "far away")
    with pytest.raises(ValueError):
        encoder_of(Settings())


def test_l2_normalize(spark):
    got = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>").select(l2_normalize(F.col("v")).alias("v")).collect()
    assert got[0]["v"] == pytest.approx([0.6, 0.8]) and got[1]["v"] == [0, 0] and got[2]["v"] is None


def test_command_line(spark, made, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("EXPECTED_DIM", "64")
    p = made.where("id <= 300")
    p.write.parquet(f"{tmp_path}/products")
    B.embed(p, HashingEncoder(64)).write.parquet(f"{tmp_path}/product_embeddings")
    smoke.main(["봄 원피스", "--gender", "여성", "-k", "3", "--catalog", str(tmp_path)], spark)
    lines = capsys.readouterr().out.strip().split("\n")
    assert len(lines) == 1 + 6 and lines[1].startswith(" 1. [0.") and lines[2].startswith("     ") and lines[4].endswith("원")
    assert smoke.spec_of(smoke.arguments(["q", "--price-max", "0"])) == FilterSpec()  # a price of 0 filters nothing here
    assert smoke.spec_of(smoke.arguments(["q", "--price-max", "9", "--season", "봄"])) == FilterSpec(price_max=9, season="봄")
