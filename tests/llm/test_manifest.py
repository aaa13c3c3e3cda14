"""op11 against a plain tree, and the traversal's memory."""

from __future__ import annotations

import zlib
from hashlib import sha256

import duckdb
import pytest

from korvane.llm.manifest import ARITY, OP11_SQL, Traversal, digest, fold, height, manifest, op11_merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and of each node the siblings to the left and right at every level."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, w in enumerate(where):
            run = w - w % 3
            paths[i].append(("".join(nodes[run:w]), "".join(nodes[w + 1 : run + 3])))
            where[i] = w // 3
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def written(*values) -> str:
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(rows):
    """doc_id, leaf, subroot, root, proof, folded, verified."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    found, tops = [], []
    for s in keys:
        leaves = sorted(((r[0] is not None, r[0] or 0, written(*r)), r) for r in by[s])
        top, paths = climb([x[0][2] for x in leaves])
        tops.append(top)
        found.append([(r, x[2], p) for (x, r), p in zip(leaves, paths, strict=True)])
    root, above = climb(tops)
    out = []
    for top, up, docs in zip(tops, above, found, strict=True):
        for r, leaf, path in docs:
            at = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                at = written(*r[:4], r[4].replace("\n", ""))
            for a, b in path + up:
                at = H(a, at, b)
            out.append((r[0], r[1], leaf, top, root, H(*(a + b for a, b in path + up)), at, at == root))
    return out


def key(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 26, 27, 28, 100, 243, 700])
def test_traversal(n):
    leaves = [H(str(i)).encode() for i in range(n)]
    root, paths = climb([x.decode() for x in leaves])
    t = Traversal(leaves.__getitem__, n, height(n))
    assert [[(a.decode(), b.decode()) for a, b in p] for p in t.step()] == paths
    assert t.late == 0 and t.most <= 5 * ARITY * max(1, height(n))  # ready in time, and logarithmic memory
    assert all(fold(x, [(a.encode(), b.encode()) for a, b in p]).decode() == root for x, p in zip(leaves, paths, strict=True))


def test_traversal_of_a_block_within_a_larger_tree():
    t = Traversal([b"x"].__getitem__, 1, 3)
    assert list(t.step()) == [[(b"", b"")] * 3] and fold(b"x", [(b"", b"")] * 3) == digest(digest(digest(b"x")))


def test_equals_a_plain_tree(spark):
    rows = [(i, "hot", "en", i, f"line {i}\nnext {i % 7}") for i in range(1700)]
    rows += [(10_000 + i, f"s{i:03}", None, None, "a\n" * (i % 3)) for i in range(760)]  # more sources than a block holds
    rows += [(5, None, "en", 1, None), (6, None, None, 0, ""), (None, None, "de", 2, "x\ny"), (None, "hot", None, None, None), (6, None, None, 0, ""), (7, "é", "ü", 1, "日本\n語"), (8, "", "", 9, "long\n" * 100_000)]
    got = manifest(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert key(tuple(r) for r in got) == key(plain(rows))
    assert any(not r["verified"] for r in got) and any(r["verified"] for r in got)


def test_equal_rows_and_other_columns(spark):
    rows = [(1, "a", "en", 2, "x\n")] * 800
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'q' AS leaf", "1 AS tree", "2 AS pos", "3 AS _part")
    assert key(tuple(r) for r in manifest(df).collect()) == key(plain(rows))


def test_empty_and_single(spark):
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    one = manifest(spark.createDataFrame([(1, "a", "en", 2, "x")], SCHEMA)).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["verified"] and one["proof_sha256"] == sha256().hexdigest()


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert key(tuple(r) for r in op11_merkle_manifest(spark, sf).collect()) == key(con.execute(OP11_SQL).fetchall())
