"""Decontamination: alignment against a plain table, and planted passages."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from korvane.llm import leaks as L
from korvane.llm.common import table


def plain(a, b):
    best = 0
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = max(0, t[i - 1][j - 1] + (L.MATCH if x == y else L.MISMATCH), t[i - 1][j] + L.GAP, t[i][j - 1] + L.GAP)
            best = max(best, t[i][j])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25))
def test_alignment(a, b):
    score, first, last = L.align(np.array(a, np.int64), np.array(b, np.int64))
    assert score == plain(a, b)
    if score:
        assert plain(a, b[first:last]) == score


def made():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(5)) for _ in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: text(rng.randint(12, 60)) for i in range(20)}
    docs, want = {}, set()
    for d in range(200):
        w = text(rng.randint(50, 400))
        if d % 5 == 0:
            i = rng.randrange(20)
            passage = list(items[i])
            for _ in range(len(passage) // 10 if d % 2 else 0):  # an edited copy
                passage[rng.randrange(len(passage))] = rng.choice(vocabulary)
            if d % 10 == 5:
                passage.insert(len(passage) // 2, "inserted")
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() for x in passage]
            want.add((d, i))
        docs[d] = ", ".join(w)
    return items, docs, want


def test_planted_passages_are_found_and_others_are_not(spark):
    items, docs, want = made()
    d = spark.createDataFrame([(i, t, 0.5, 3) for i, t in docs.items()] + [(None, docs[0], 0.5, 3), (900, None, 0.5, 3), (901, "", 0.5, 3)], "doc_id long, text string, similarity double, item_id int")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(None, docs[1]), (90, None), (91, "")], "item_id long, text string")
    rows = L.leaks(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    brute = {(i, k): plain(w, L.words(docs[i])) / (2 * len(w)) for i, k in want for w in [items[k]]}
    for r in rows:
        assert abs(r["similarity"] - brute[r["doc_id"], r["item_id"]]) < 1e-9
        assert r["last_word"] >= r["first_word"] >= 0


def test_common_passage_short_item_and_repeats(spark):
    common = "a passage with common words that every document has"
    docs = [(i, f"{common} and number {i}") for i in range(300)] + [(500, "it says two words here"), (500, "it says two words here")]
    items = [(1, common), (1, common), (2, "two words"), (3, "nothing has this one at all")]
    rows = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(i, 1) for i in range(300)} | {(500, 2)}
    assert len(rows) == 301


def test_no_rows(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    assert L.leaks(docs.limit(0), items).collect() == []
    assert L.leaks(docs, items.limit(0)).collect() == []


def test_hot_edited_group_beside_one_full_copy(spark):
    """A large group of edited copies is found whole, though one document alone holds the item in full."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(5)) for _ in range(2000)]
    item = [rng.choice(vocabulary) for _ in range(36)]
    edited = list(item)
    for at in (8, 17, 26):
        edited[at] = f"changed{at}"
    docs = [(i, " ".join([rng.choice(vocabulary) for _ in range(40)] + (edited if i % 3 == 0 else item if i == 1 else []) + [rng.choice(vocabulary) for _ in range(40)])) for i in range(600)]
    rows = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in rows} == {1} | set(range(0, 600, 3))
    assert all(r["similarity"] == (1 if r["doc_id"] == 1 else (2 * 33 - 3) / 72) for r in rows)


def edited(rng, passage, rate, vocabulary):
    out = []
    for w in passage:
        x = rng.random()
        out += [rng.choice(vocabulary)] if x < rate / 3 else [] if x < 2 * rate / 3 else [w, rng.choice(vocabulary)] if x < rate else [w]
    return out


def test_equals_all_pairs(spark):
    """Every document against every item, at all rates of words changed, left out and put in: no pair at FOUND or above is lost."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]  # few words: seeds are common
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 40))] for _ in range(25)] + [["w3"], ["w5", "w9"], ["w7", "w7"]]
    docs = []
    for d in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        item = rng.choice(items)
        at = rng.randint(0, len(w))
        w[at:at] = edited(rng, item, (d % 11) / 12, vocabulary)
        docs.append(w)
    for item in items[:8]:  # each third word changed; a word put in after each; each fourth word changed
        docs += [[x if i % 3 != 2 else "changed" for i, x in enumerate(item)], [y for x in item for y in (x, "put")], [x if i % 4 != 3 else "changed" for i, x in enumerate(item)]]
    want = {(d, k): plain(i, w) / (2 * len(i)) for d, w in enumerate(docs) for k, i in enumerate(items)}
    # an item of two words needs both, in order, with at most one between them: one word alone would reach FOUND
    both = lambda w, i: any(w[a] == i[0] and i[1] in w[a + 1 : a + 3] for a in range(len(w)))
    want = {(d, k): s for (d, k), s in want.items() if s >= L.FOUND and (len(items[k]) != 2 or both(docs[d], items[k]))}
    frame = lambda rows, schema: spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], schema)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in L.leaks(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")).collect()}
    assert len(want) > 100 and got.keys() == want.keys()
    assert all(abs(got[key] - want[key]) < 1e-9 for key in want)


def test_repeated_words_and_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "again " * 20_000), (2, "once"), (3, "x " * 30_000 + "a real passage of words that nobody else has " + "y " * 30_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "again " * 100), (2, "a real passage of words that nobody else has"), (3, "once")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["similarity"]) for r in L.leaks(docs, items).collect()} == {(1, 1, 1.0), (3, 2, 1.0), (2, 3, 1.0)}


def test_windows_of_a_long_passage_and_memory():
    """A text of one word over and over meets an item of that word at every diagonal: no list of pairs is made, and windows find what the whole would."""
    import tracemalloc

    it = L.Items([(1, "again " * 100)], L.FOUND)
    n = 5_000_000
    numbers, seed, place = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    numbers[:1000], seed, place = -1, seed[1000:-2], place[1000:-2]
    tracemalloc.start()
    got = L.passages(it, 0, numbers, seed, place)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert got == (200, 1000, 1100, 99)
