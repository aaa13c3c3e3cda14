"""Repeated byte strings against a table of all of them."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from korvane.llm import repeats as R
from korvane.llm.common import table


def every_string(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha) by looking up each 50-byte string of the input."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49) if i is not None else ():
            first[b[s : s + 50]] = min(i, first.get(b[s : s + 50], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49) if i is not None else ():
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in R.repeats(df, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def made(seed):
    rng = random.Random(seed)
    passage = ["".join(rng.choice("abcdefgh é한") for _ in range(rng.randint(40, 300))) for _ in range(12)]
    rows = []
    for i in range(120):
        t = "".join(rng.choice([rng.choice(passage), rng.choice(passage)[5:70], "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 80)))]) for _ in range(rng.randint(1, 6)))
        rows.append((rng.randrange(10_000) if seed else i, t))
    rows += [(20_000, None), (20_001, ""), (20_002, "short"), (20_003, "z" * 49), (20_004, "z" * 50), (20_005, "z" * 51), (20_006, "z" * 4000), (20_007, "ab" * 3000), (20_008, "ba" * 40)]
    rows += [(20_100 + i, rows[3][1]) for i in range(60)]  # copies
    return rows


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_equals_every_string(spark, seed):
    rows = list(dict(made(seed)).items())
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, blk int, kept string")
    assert got(df) == every_string(rows)


def test_equals_every_string_on_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    assert got(docs) == every_string([tuple(r) for r in docs.collect()])


def test_hot_passage(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(500)]
    passage = " ".join(words[:30])
    rows = [(i, f"{rng.choice(words)} {i * 7919} {passage[rng.randint(0, 20) :]} {rng.choice(words)} {i}") for i in range(R.HOT + 300)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == every_string(rows)


@pytest.mark.parametrize("hot", [2, 5, 1 << 14])
def test_what_counts_as_hot_changes_no_byte(spark, monkeypatch, hot):
    rng = random.Random(9)
    passage = ["".join(rng.choice("abcdefgh é") for _ in range(160)) for _ in range(3)]
    rows = [(i, "".join(rng.choice([rng.choice(passage)[rng.randint(0, 60) :], "".join(rng.choice("xyz ") for _ in range(30))]) for _ in range(5))) for i in range(60)]
    monkeypatch.setattr(R, "HOT", hot)
    rng.shuffle(rows)
    assert local(rows, 4) == every_string(rows)


def block(rows):
    import pyarrow as pa

    return pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string()), "blk": pa.array([rows[0][0]] * len(rows), pa.int64())})


def local(rows, n):
    """The four passes over n blocks, without Spark."""
    import pyarrow as pa

    blocks = [block(rows[i::n]) for i in range(n)]
    by = lambda ts, c: {k: pa.concat_tables(ts).filter(pa.compute.equal(pa.concat_tables(ts)[c], k)) for k in set(pa.concat_tables(ts)[c].to_pylist())}
    none = R.notes([])
    shared = by([R.find_shared(t) for t in by([R.tell_anchors(n)(b, none) for b in blocks], "bucket").values()], "blk")
    of = lambda got, b: got.get(b["blk"][0].as_py(), none)
    judged = by([R.judge(t) for t in by([R.tell_strings(n)(b, of(shared, b)) for b in blocks], "bucket").values()], "blk")
    out = [R.cut(False, [], n)(b, pa.concat_tables([of(shared, b), of(judged, b)])) for b in blocks]
    return sorted((tuple(r.values())[:5] for t in out for r in t.to_pylist()), key=str)


def test_null_and_repeated_ids(spark):
    a, b = "shared passage of more than fifty bytes, which all of these rows hold somewhere", "and other text that only two rows have, also more than fifty bytes in length"
    rows = [(None, a), (None, a + b), (4, a), (4, a), (4, b), (9, a + " " + b), (2, "x")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == every_string(rows)
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


def test_a_copy_under_a_repeated_id_leaves_the_other_row_alone(spark):
    a, b = "first text, of more than fifty bytes in length, that is copied under another id", "second text under the same id, more than fifty bytes in length, found nowhere else"
    rows = [(1, a), (5, a), (5, b)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == every_string(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.text("ab", min_size=0, max_size=45)), min_size=1, max_size=40))
def test_deep_shallow_sorts(rows):
    wide = np.zeros((len(rows), 45), np.uint8)
    for i, (_, t) in enumerate(rows):
        wide[i, : len(t)] = list(t.encode())
    first = np.array([g for g, _ in rows], np.int64)
    order, common = R.deep_shallow(wide, first)
    keys = [(int(first[i]), wide[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    for (g, x), (h, y), n in zip(keys, keys[1:], common[1:]):
        assert n == (-1 if g != h else next((k for k in range(45) if x[k] != y[k]), 45))


def test_nothing_stays_persisted(spark, sf):
    from korvane.sources.stored import sweep

    sweep(spark)
    assert R.op6_suffix_dedup(spark, sf).count() > 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


@pytest.mark.parametrize("part", [0.02, 0.2])
def test_rounds_change_no_byte(spark, monkeypatch, part):
    rounds = []
    monkeypatch.setattr(R, "ROUND", part)
    monkeypatch.setattr(R, "HOT", 5)
    monkeypatch.setattr(R, "materialize", lambda df, name, made=R.materialize: (rounds.append(name), made(df, name))[1])
    rows = list(dict(made(1)).items())
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == every_string(rows)
    assert rounds.count("judged") > 2


def test_texts_are_stored_once_and_what_was_shuffled_goes(spark, sf):
    """Else disk holds the texts as shuffle files and as cached rows beside all that was ever sent out."""
    import gc
    import time
    from pathlib import Path

    from korvane.sources.stored import sweep

    def shuffled():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data")}

    sweep(spark)
    gc.collect()
    before = shuffled()
    out = R.repeats(table(spark, sf, "documents"))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1, plan  # the notes move, the texts do not
    left = lambda: sum(f.stat().st_size for f in shuffled() - before if f.exists())
    for _ in range(50):
        if left() < 2000:
            break
        time.sleep(0.2)
    assert left() < 2000  # counts and sums of what is written
    assert out.count() == table(spark, sf, "documents").count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("korvane_")]
    sweep(spark)
