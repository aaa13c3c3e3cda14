"""Sharding: its law, its links and its defined cases."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from korvane.llm import sharding
from korvane.llm.common import table
from korvane.llm.sharding import LANES, ROUNDS, SHARDS, op9_sharding, shard


def lawful(rows, texts, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    by = defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        by[r["shard"]].append(r["slot"])
    counts = [len(by[s]) for s in range(shards)]
    assert set(by) <= set(range(shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def parted(rows, texts):
    """The share of linked rows that are not in their group's main shard."""
    text = {}
    for i, t in texts:
        text[i] = t
    groups = defaultdict(Counter)
    for r in rows:
        if text[r["doc_id"]] is not None:
            groups[text[r["doc_id"]]][r["shard"]] += 1
    linked = [c for c in groups.values() if c.total() > 1]
    return sum(c.total() - max(c.values()) for c in linked) / max(1, sum(c.total() for c in linked))


def hashed(*values):
    """Spark's xxhash64: each value is hashed with the hash before it as seed. int is a long here, np.int32 an int."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else int(v).to_bytes(4 if isinstance(v, np.int32) else 8, "little", signed=True)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def plain_propagation(texts, shards, rows):
    """doc_id: (shard, slot), by one loop over all documents a round."""
    n, small = len(texts), np.int32
    sha = {i: f"null {i}" if t is None else hashlib.sha256(t.encode()).hexdigest() for i, t in texts}
    times = Counter(sha[i] for i, t in texts if t is not None)
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    half = max(1, n // shards // 2)
    linked = {i: times[sha[i]] > 1 for i, _ in texts}
    part = {i: hashed(i) % max(1, math.ceil((times[sha[i]] if linked[i] else 1) / half)) for i, _ in texts}
    at = {i: hashed(small(1), i) % shards for i, _ in texts}
    for step in range(ROUNDS):
        counts = defaultdict(Counter)
        for i, _ in texts:
            if linked[i]:
                counts[sha[i], part[i]][at[i]] += 1
        held = Counter(at[i] for i, _ in texts if linked[i])
        room = [q - held[s] for s, q in enumerate(quota)]
        aims, waiting = {}, Counter()
        for key, by in counts.items():
            may = [(k, hashed(key[0], small(s)), s) for s, k in by.items() if by.total() - k <= room[s]]
            if len(by) > 1 and may:
                k, _, s = max(may)
                lane = hashed(*key, small(step)) % LANES
                aims[key] = s, lane
                waiting[s, lane] += by.total() - k
        let_in = {(s, lane) for s, lane in waiting if sum(waiting[s, x] for x in range(lane + 1)) <= room[s]}
        for i, _ in texts:
            aim = aims.get((sha[i], part[i])) if linked[i] else None
            if aim in let_in:
                at[i] = aim[0]
    buckets = max(1, n // shards // rows)
    order = lambda k: lambda i: (not linked[i], hashed(i, sha[i]) % k, i)
    over = []
    for s in range(shards):
        over += sorted((i for i in at if at[i] == s), key=order(buckets))[quota[s] :]
    over.sort(key=order(max(1, n // rows)))
    left = set(over)
    held, k = Counter(s for i, s in at.items() if i not in left), 0
    for s in range(shards):
        for i in over[k : k + quota[s] - held[s]]:
            at[i] = s
        k += quota[s] - held[s]
    out = {}
    for s in range(shards):
        own = sorted((i for i in at if at[i] == s), key=lambda i: (hashed(i, sha[i]) % buckets, i))
        out |= {i: (s, slot) for slot, i in enumerate(own)}
    return out


@pytest.mark.parametrize(("shards", "rows"), [(5, 20), (24, 2000)])
def test_equals_a_plain_propagation(spark, monkeypatch, shards, rows):
    monkeypatch.setattr(sharding, "ROWS", rows)
    texts = [(i, "hot") for i in range(0, 900, 3)] + [(i, f"of {i % 40}") for i in range(1, 900, 3)] + [(i, f"only {i}" if i % 30 > 2 else None) for i in range(2, 900, 3)] + [(9000, ""), (9001, "")]
    got = shard(spark.createDataFrame(texts, "doc_id long, text string"), shards).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == plain_propagation(texts, shards, rows)


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    rows = op9_sharding(spark, sf).collect()
    lawful(rows, texts, SHARDS)
    assert parted(rows, texts) < 0.1


def test_hot_group_and_odd_rows(spark):
    texts = [(i, "hot") for i in range(200)] + [(1000 + i, f"pair {i // 2}") for i in range(200)] + [(2000 + i, f"single {i}") for i in range(190)]
    texts += [(5000, None), (5001, None), (5002, ""), (5003, ""), (7, "hot"), (None, "x"), (None, "x"), (None, None)]
    df = spark.createDataFrame([(i, t, 3, "s") for i, t in texts], "doc_id long, text string, shard int, slot string")
    rows = shard(df, 6).collect()
    lawful(rows, texts, 6)
    assert parted([r for r in rows if r["doc_id"] is not None and 1000 <= r["doc_id"] < 2000], texts) < 0.1


def test_few_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    lawful(shard(df).collect(), [(1, "a"), (2, "a"), (3, "b")], SHARDS)
    assert shard(df.limit(0)).collect() == []


def test_no_python_in_the_plan(spark, sf):
    plan = op9_sharding(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
