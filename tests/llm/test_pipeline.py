"""The pipeline: each stage against its operator or a brute-force version, and the whole."""

from __future__ import annotations

import corpus_pipeline as P
import pytest
from korvane.llm import common, token_counts
from korvane.llm.common import table
from korvane.sources import stored

from .test_near_dups import all_pairs
from .test_repeats import every_string


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def test_stages_keep_the_columns(spark, sf, docs):
    for name, f in P.STAGES[:-1]:
        out = f(spark, docs, sf)
        assert out.dtypes == docs.dtypes, name


def test_one_document_of_each_group_stays(spark, sf, docs):
    want = {i for i, _, _, kept in all_pairs([(r["doc_id"], r["text"]) for r in docs.collect()]) if kept}
    assert {r["doc_id"] for r in P.drop_near_duplicates(spark, docs, sf).collect()} == want


def test_repeats_are_cut(spark, sf, docs):
    want = {i: n - gone for i, n, gone, *_ in every_string([(r["doc_id"], r["text"]) for r in docs.collect()])}
    got = {r["doc_id"]: r for r in P.cut_repeats(spark, docs, sf).collect()}
    assert got.keys() == want.keys()
    assert all(0 <= want[i] - len((r["text"] or "").encode()) <= 6 * len(want) and (r["text"] is None or r["n_chars"] == len(r["text"])) for i, r in got.items())


CLASH = ["score", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "blk", "bucket", "kind", "text_there", "component_id", "similarity", "item_id", "pieces", "a", "_carried_0"]


def test_columns_that_clash_are_carried(spark, sf, docs):
    from pyspark.sql import functions as F

    more = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASH))
    for name, f in P.STAGES[:-1]:
        out = f(spark, more, sf)
        assert out.columns == more.columns, name
        rows = out.select("doc_id", *CLASH).collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASH), name


def test_odd_rows_pass(spark, sf, docs):
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (10**9, None, "en", None, None)], docs.schema)
    for _, f in P.STAGES[:-1]:
        assert f(spark, odd, sf).count() == 3
        assert f(spark, odd.limit(0), sf).count() == 0


def test_run(spark, sf, docs):
    out = P.run(spark, sf).collect()
    sp = token_counts.processor(token_counts.MODEL)
    assert 0 < len(out) < docs.count()
    left = spark._jvm.org.apache.hadoop.fs.Path(common.shared_dir(spark))
    assert [p for p in stored._written] and len(stored._written) == 1  # the result; all else is deleted
    assert {f.getPath().getName() for f in left.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(left) if f.getPath().getName().startswith("korvane-")} == {p.rsplit("/", 1)[1] for p in stored._written}
    stage = docs
    for _, f in P.STAGES[:-1]:
        stage = f(spark, stage, sf)
    texts = {r["doc_id"]: r["text"] for r in stage.collect()}
    assert {r["doc_id"]: r["pieces"] for r in out} == {i: sp.encode(t or "") for i, t in texts.items()}
