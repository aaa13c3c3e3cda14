"""op13 against a plain trie."""

from __future__ import annotations

import math
import random
import zlib
from hashlib import sha256

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from korvane.llm.prefixes import OP13_SQL, intervals, op13_prefix_trie, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    nodes = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], ([], []))[0].append(c)
        nodes[path][1].append(c)
    out = []
    for p, (members, end) in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        children = {q for q in under if len(q) == len(p) + 1}
        leaves = [q for q in under if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in under)]
        saved = sum((len(nodes[q][0]) - 1) * len(q[-1][1]) for q in under if q)
        out.append((min(members), len(p), min(nodes[p[:-1]][0]) if p else None, len(members), len(children), len(leaves), saved, sha256(",".join(map(str, sorted(end))).encode()).hexdigest()))
    return sorted(map(str, out))


def made(n, seed, words):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "bot"]), r.choice(words)) for c in r.sample(range(3 * n), n) for t in range(r.choice([0, 1, 2, 3, 5, 9]))]


def spread(values, width, fan):
    """The intervals by blocks, as tree() makes them."""
    items = [(i, v if i else -1, 1, (i * 7 % 11, 1, 1, 1)) for i, v in enumerate(values)]
    found, size, blocks = [], width, max(1, -(-len(items) // width))
    parts = [items[i : i + width] for i in range(0, len(items), width)]
    while True:
        done = [intervals(p, len(values) if blocks == 1 else None) for p in parts]
        found += [x for f, _ in done for x in f]
        if blocks == 1:
            return sorted(found)
        kept = [k for _, k in done]
        parts = [[x for k in kept[i : i + fan] for x in k] for i in range(0, len(kept), fan)]
        blocks = len(parts)


@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.integers(1, 6), st.integers(2, 4))
def test_blocks_do_not_change_the_intervals(values, width, fan):
    assert spread(values, width, fan) == spread(values, len(values), fan)


@pytest.mark.parametrize(("n", "words", "width", "fan"), [(60, ["a", "b"], 4, 2), (120, ["x", "yy", ""], 7, 3), (80, ["only"], 3, 2), (50, [f"w{i}" for i in range(40)], 1024, 64)])
def test_equals_a_plain_trie(spark, n, words, width, fan):
    rows = made(n, n, words)
    got = trie(spark.createDataFrame(rows, SCHEMA).repartition(5), width, fan).collect()
    assert sorted(str(tuple(r)) for r in got) == plain(rows)


def test_hot_conversation(spark):
    """A third of all conversations are alike, and most begin alike."""
    rows = [(c, t, "user", "same" if c % 3 == 0 or t < 2 else f"{c} {t}") for c in range(1, 900) if c % 100 for t in range(4 + c % 2)]
    got = trie(spark.createDataFrame(rows, SCHEMA), 16, 4).collect()
    assert sorted(str(tuple(r)) for r in got) == plain(rows)


def test_nulls_ties_and_other_columns(spark):
    rows = [
        (None, 0, "user", "x"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, "", ""), (1, 2, "user", "é日本"), (2, 0, "user", "first"), (2, 1, "", ""), (-5, 0, "a", "z"), (-105, 1, "a", "z"), (0, 0, "r", "s"), (0, 1, "r", "t"),
        (100, 0, "user", "q"), (101, 0, "user", "q"), (7, 0, "user", "w" * 200_000), (8, 0, "user", "w" * 200_000),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'k' AS key", "2 AS low", "3 AS _part")
    assert sorted(str(tuple(r)) for r in trie(df).collect()) == plain(rows)


def test_turnless_single_and_empty(spark):
    assert trie(spark.createDataFrame([], SCHEMA)).count() == 0
    short = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 6 >= 1][:3]  # their one turn is replaced by none
    for ids in (short[:1], short, [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 0][:1]):
        rows = [(c, 0, "user", "x") for c in ids]
        assert sorted(str(tuple(r)) for r in trie(spark.createDataFrame(rows, SCHEMA)).collect()) == plain(rows)


def test_long_conversation(spark):
    rows = [(c, t, "user", "x" if t < 1500 + c else "y") for c in (100, 101, 102) for t in range(3000)]
    got = {(r["depth"], r["conv_id"]): r for r in trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 1601 + 3 * 1400 - 1 and got[0, 100]["n_convs"] == 3 and got[0, 100]["n_leaves"] == 3 and got[1600, 100]["n_convs"] == 3


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert sorted(str(tuple(r)) for r in op13_prefix_trie(spark, sf).collect()) == sorted(map(str, con.execute(OP13_SQL).fetchall()))
