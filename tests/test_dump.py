"""COPY text as a data source."""

from __future__ import annotations

import random
from datetime import UTC, datetime

import pytest

from korvane.sources import dump as D
from korvane.sources.schemas import EMBEDDINGS, PRODUCTS

NASTY = ["", "a\tb", "a\nb", "\\N", "\\.", "back\\slash", "가나다", "COPY public.products (id) FROM stdin;", "\r\x08\x0c\x0b", "NULL", 'say "so", {now}', None]


def tables(spark, n=400):
    r, now = random.Random(4), datetime(2024, 5, 6, 7, 8, 9, 123456, UTC)
    some = lambda: r.choice(NASTY)
    rows = [(i, "demo", f"S{i}", some() or "n", some(), "신발", some(), some(), some(), some(), some(), r.choice([None, [], ["S", 'a"b', "c,d", None, "NULL", "\\", "\t"]]), some(), i, r.choice([None, 5]), 3, some(), ["x"], now, now, r.choice([None, now])) for i in range(n)]
    vectors = [(i, r.choice([None, [0.1, -2.5e-8, 3.0], []]), some() or "", "hashing", now) for i in range(n)]
    return spark.createDataFrame(rows, PRODUCTS), spark.createDataFrame(vectors, EMBEDDINGS)


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_round_trip_in_many_ranges(spark, tmp_path):
    for name, df in zip(("p", "e"), tables(spark), strict=True):
        path = str(tmp_path / name)
        D.write_copy(df.coalesce(1), path)
        for split in (97, 4096, D.SPLIT):
            got = D.read_copy(spark, path, df.schema, split=split)
            assert split != 4096 or got.rdd.getNumPartitions() > 5
            same(got, df)


@pytest.mark.parametrize("split", [61, 5000, D.SPLIT])
def test_tables_of_one_plain_dump(spark, tmp_path, split):
    products, vectors = tables(spark, 60)
    body = ["-- a dump", "SET x = 1;", ""]
    for name, df in (("products", products), ("product_embeddings", vectors), ("outbox_events", products.limit(0).select("id"))):
        lines = [r[0] for r in df.select(D.copy_line(df)).collect()]
        body += [f"COPY public.{name} ({', '.join(df.columns)}) FROM stdin;", *lines, "\\.", "", "-- more"]
    path = tmp_path / "dump.sql"
    path.write_text("\n".join(body), "utf-8", newline="\n")
    same(D.read_dump(spark, str(path), "products", PRODUCTS, split=split), products)
    same(D.read_dump(spark, str(path), "product_embeddings", EMBEDDINGS, split=split), vectors)
    assert D.read_dump(spark, str(path), "outbox_events", products.select("id").schema, split=split).count() == 0


def test_escapes_as_the_form_has_them():
    assert D.unescaped("\\N") is None and D.unescaped("") == ""
    assert D.unescaped("a\\tb\\\\n\\q") == "a\tb\\nq"
    assert D.unescaped("\\101\\x42\\352\\260\\200가") == "AB가가"
    assert D.elements('{a,"b, c",NULL,"NULL","q\\\\"}') == ["a", "b, c", None, "NULL", "q\\"] and D.elements("{}") == []


def test_lines_of_another_width_raise(spark, tmp_path):
    (tmp_path / "t").write_text("1\t2\n3\n")
    with pytest.raises(Exception, match="1 columns, not 2"):
        D.read_copy(spark, str(tmp_path / "t"), PRODUCTS.__class__().add("a", "long").add("b", "long")).collect()
    (tmp_path / "none").write_text("")
    assert D.read_copy(spark, str(tmp_path / "none"), EMBEDDINGS).count() == 0
