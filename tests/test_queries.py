"""Every registered retrieval query against its SQL in DuckDB, as multisets of rows."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from korvane.plans.queries import QUERIES, SQL

TABLES = ["part", "embeddings", "events"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: [plain(x) for x in v] if isinstance(v, list | tuple) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v.asDict(True) if hasattr(v, "asDict") else v
    return Counter(str([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_give_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def test_flagship_plan(spark, sf):
    """Top-k without a full sort, and only the needed columns of either table."""
    plan = QUERIES["vector_search"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


def test_entry_works_without_the_corpus_package(tmp_path):
    """In a copy of the repository that has neither the package nor the pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "korvane", tmp_path / "korvane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries() if k[2:3].isdigit()), len(e.oracle_sql()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(QUERIES)), "False", str(len(SQL))], said.stderr


def test_outbox_order(spark, sf, duck):
    got = [r["id"] for r in QUERIES["outbox_pending"](spark, sf).orderBy("place").collect()]
    assert got == [r[0] for r in duck.execute("SELECT event_id FROM events WHERE event_id % 4 = 0 ORDER BY ts, event_id").fetchall()]
