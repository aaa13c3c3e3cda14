"""Near-duplicates against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from korvane.llm import near_dups
from korvane.llm.common import table
from korvane.llm.graph import components
from korvane.llm.near_dups import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def all_pairs(rows):
    """(doc_id, n_shingles, component_id, kept) of rows with ids."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and min(len(a), len(b)) * 4 >= 3 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    low, high = sorted((root(i), root(j)))
                    up[high] = low
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def made():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((n, " ".join(w).upper() if n % 3 else "\t".join(w)))
            n += 1
    rows += [(n + i, "the same text again and again") for i in range(150)]  # a group of copies with a third of all rows
    chain = [f"c{i}" for i in range(200)]
    rows += [(n + 200 + i, " ".join(chain[6 * i : 6 * i + 70])) for i in range(20)]  # links pass along a chain
    rows += [(n + 400, None), (n + 401, ""), (n + 402, " \t\n"), (n + 403, "one"), (n + 404, "ONE"), (n + 405, "x" * 50_000), (n + 406, "é È é")]
    rng.shuffle(rows)
    return rows


def test_equals_all_pairs(spark):
    rows = made()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, component_id int, node int")
    assert sorted(map(tuple, near_duplicates(df).collect())) == all_pairs(rows)


@pytest.mark.parametrize("rounds", [0, 1])
def test_groups_in_chunks(spark, monkeypatch, rounds):
    """Groups of more than GROUP nodes meet chunk by chunk, and what the trees leave is found by the rest."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    rows = []
    for i in range(70):  # one group of near copies, of which many are not linked to each other
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_dups, "GROUP", 8)
    monkeypatch.setattr(near_dups, "ROUNDS", rounds)
    want = all_pairs(rows)
    assert 1 < sum(kept for *_, kept in want) < 70
    assert sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == want


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 3000), st.floats(0.75, 1), st.integers(0, 2**32))
def test_odd_sketches_pass_linked_sets(n, s, seed):
    rng = np.random.default_rng(seed)
    both = max(1, int(np.ceil(s * n)))
    rest = n - both
    own = int(rng.integers(0, rest + 1))
    h = rng.integers(0, 2**63, n, dtype=np.uint64)
    x, y = h[: both + own], np.r_[h[:both], h[both + own :]]
    a, b = (np.frombuffer(near_dups.odd_sketch(v), np.uint64) for v in (x, y))
    m = min(len(a), len(b)) * 64
    fold = lambda v: np.bitwise_xor.reduce(v.reshape(-1, m // 64), axis=0)
    differ = int(np.bitwise_count(fold(a) ^ fold(b)).sum())
    assert near_dups.may_link(*(np.array([v]) for v in (len(x), len(y), differ, m)))[0]


def test_equals_all_pairs_on_documents(spark, sf):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    assert sorted(map(tuple, near_duplicates(docs).collect())) == all_pairs([tuple(r) for r in docs.collect()])


def test_null_ids_repeats_and_no_rows(spark):
    text = "a text that all of these rows have"
    df = spark.createDataFrame([(None, text), (None, text), (5, text), (5, text), (9, text)], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4, None, True)] * 2 + [(5, 4, 5, True)] * 2 + [(9, 4, 5, False)], key=str)
    assert near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 50])
def test_components(spark, n):
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 90), (7000, 90)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 90: 90, 100: 90, 7000: 90}
