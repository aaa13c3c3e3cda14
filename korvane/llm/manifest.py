"""A Merkle manifest of a corpus: every document's leaf, its proof up to one root, and whether a tampered copy still verifies.

A document's leaf is the SHA-256 of its columns, each with its length. The leaves of a source, by doc_id, form a tree of
runs of three; the sources' roots form one more such tree. Digests are lowercase hex texts wherever they are hashed again.

  order     Leaves get gapless positions in their source by a range shuffle over (source, doc_id), which splits hot sources.
  blocks    SPAN consecutive leaves, aligned, are one row: the only thing a task holds at a time.
  up        A treehash stack folds a block to its top; tops are the leaves of blocks a level higher, until a tree has one
            block left. A level has 1/SPAN of the rows of the one below. The sources' tree is made in the same way.
  down      From the highest blocks to the lowest, each block is traversed leaf by leaf: every level keeps the run that the
            path goes through, and a treehash stack that prepares the next one. Of the unfinished stacks, the one with the
            lowest tail goes on, so the stacks are ready in time and hold a logarithmic number of nodes. A block's own part
            of a proof is followed by the part that all its leaves share, which came with the block's row.

Defined cases: a null doc_id comes first in its source and is written `-`; rows that repeat a doc_id are leaves of their own,
in the order of their digests; a null and an empty text differ (`-` and `0:`); very long texts are hashed once, where they
are read; no text is shuffled; an empty table gives no rows; columns beyond the five are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvane.llm.common import discard, in_order, materialize, numbered, table

ARITY = 3
LEVELS = 6
#: Leaves of a block.
SPAN = ARITY**LEVELS

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*nodes: bytes) -> bytes:
    return sha256(b"".join(nodes)).hexdigest().encode()


def height(n: int) -> int:
    """Levels above n leaves until one node remains."""
    up = 0
    while ARITY**up < n:
        up += 1
    return up


class Treehash:
    """The stack that folds leaves start, start + 1, ... into the node at `level` that begins there."""

    def __init__(self, level: int, start: int, count: int):
        self.level, self.at, self.end = level, start, min(start + ARITY**level, count)
        self.stack: list[list[bytes]] = [[] for _ in range(level + 1)]

    @property
    def done(self) -> bool:
        return self.at == self.end

    def tail(self) -> int:
        """The height of the lowest node held; of one that has not begun, its level."""
        return next((h for h, nodes in enumerate(self.stack) if nodes), self.level)

    def held(self) -> int:
        return sum(map(len, self.stack))

    def push(self, leaf: bytes) -> None:
        self.at += 1
        self.stack[0].append(leaf)
        for h in range(self.level):
            if len(self.stack[h]) == ARITY or self.done and self.stack[h]:  # at the end of the leaves a run may be short
                self.stack[h + 1].append(digest(*self.stack[h]))
                self.stack[h].clear()

    def node(self) -> bytes:
        return self.stack[self.level][0]


class Traversal:
    """The authentication paths of a block's leaves, one after the other. leaf(i) gives a leaf.

    step() yields, for each leaf, the siblings to the left and to the right at every level."""

    def __init__(self, leaf: Callable[[int], bytes], count: int, levels: int):
        self.leaf, self.count, self.levels = leaf, count, levels
        self.most = self.late = 0  # nodes held at once; stacks that were not ready in time
        self.runs: list[list[bytes]] = []
        for h in range(levels):  # of the first run, the path's own node is known once it is left
            self.runs.append([b"", *(self._whole(h, j) for j in range(1, ARITY) if j * ARITY**h < count)])
        self.coming = [self._prepare(h, 1) for h in range(levels)]

    def _whole(self, level: int, index: int) -> bytes:
        t = Treehash(level, index * ARITY**level, self.count)
        while not t.done:
            t.push(self.leaf(t.at))
        return t.node()

    def _prepare(self, level: int, run: int) -> list[Treehash]:
        starts = [(run * ARITY + j) * ARITY**level for j in range(1, ARITY)]
        return [Treehash(level, s, self.count) for s in starts if s < self.count]

    def _advance(self) -> None:
        """One leaf for each level, to the unfinished stack with the lowest tail."""
        for _ in range(self.levels):
            open_ = [t for level in self.coming for t in level if not t.done]
            if not open_:
                return
            t = min(open_, key=lambda t: (t.tail(), t.level))
            t.push(self.leaf(t.at))

    def step(self) -> Iterator[list[tuple[bytes, bytes]]]:
        for i in range(self.count):
            path = []
            for h, run in enumerate(self.runs):
                here = i // ARITY**h % ARITY
                path.append((b"".join(run[:here]), b"".join(run[here + 1 :])))
            yield path
            if i + 1 == self.count:
                return
            self._advance()
            self.most = max(self.most, sum(map(len, self.runs)) + sum(t.held() for level in self.coming for t in level))
            left = self.leaf(i)
            for h in range(self.levels):
                if (i + 1) % ARITY**h:
                    break  # the path's node at this level stays
                index = i // ARITY**h
                if index % ARITY == 0:
                    self.runs[h][0] = left
                if index % ARITY < ARITY - 1:
                    break  # the run stays
                left = digest(*self.runs[h])
                for t in self.coming[h]:
                    self.late += not t.done
                    while not t.done:
                        t.push(self.leaf(t.at))
                self.runs[h] = [b"", *(t.node() for t in self.coming[h])]
                self.coming[h] = self._prepare(h, index // ARITY + 2)


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        node = digest(left, node, right)
    return node


def _block_levels(total: int, count: int) -> int:
    """A tree of one block ends with its last node; blocks of larger trees all have the same height."""
    return height(count) if total <= SPAN else LEVELS


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One block at a time as Python values."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _hex(row: dict) -> list[bytes]:
    return [x["leaf"].hex().encode() for x in row["leaves"]]


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for row in _rows(batch):
            leaves = _hex(row)
            t = Treehash(_block_levels(row["total"], len(leaves)), 0, len(leaves))
            for x in leaves:
                t.push(x)
            found.append(bytes.fromhex(t.node().decode()))
        yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), pa.array(found, pa.binary()), batch.column("total")], ["tree", "pos", "leaf", "below"])


PATHS = "tree string, block long, of string, node binary, left array<string>, right array<string>, subroot string, root string"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node's whole path, of blocks whose leaves are blocks or sources."""
    texts = pa.list_(pa.string())
    for batch in batches:
        for row in _rows(batch):
            leaves, items = _hex(row), row["leaves"]
            paths = [[(a.decode(), b.decode()) for a, b in p] for p in Traversal(leaves.__getitem__, len(leaves), _block_levels(row["total"], len(leaves))).step()]
            same = lambda c, row=row, n=len(items): pa.array([row[c]] * n, pa.string())
            yield pa.RecordBatch.from_arrays(
                [same("tree"), pa.array([x["pos"] for x in items], pa.int64()), pa.array([x.get("of") for x in items], pa.string()), pa.array([x["leaf"] for x in items], pa.binary()),
                 pa.array([[a for a, _ in p] + row["left"] for p in paths], texts), pa.array([[b for _, b in p] + row["right"] for p in paths], texts), same("subroot"), same("root")],
                ["tree", "block", "of", "node", "left", "right", "subroot", "root"],
            )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the lowest blocks: every document's row of the manifest."""
    for batch in batches:
        for row in _rows(batch):
            items, leaves, root = row["leaves"], _hex(row), row["root"]
            upper = [(a.encode(), b.encode()) for a, b in zip(row["left"], row["right"], strict=True)]
            shared = b"".join(a + b for a, b in upper)
            proofs, folded = [], []
            for x, leaf, path in zip(items, leaves, Traversal(leaves.__getitem__, len(leaves), _block_levels(row["total"], len(leaves))).step(), strict=True):
                proofs.append(sha256(b"".join(a + b for a, b in path) + shared).hexdigest())
                folded.append(fold(fold(x["other"].hex().encode() if x["other"] else leaf, path), upper).decode())
            same = lambda v, n=len(items): pa.array([v] * n, pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["doc_id"] for x in items], pa.int64()), same(row["tree"][1:] if row["tree"][0] == "=" else None), pa.array([x.decode() for x in leaves], pa.string()),
                 same(row["subroot"]), same(root), pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_())],
                ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )


def _blocks(nodes: DataFrame, name: str) -> DataFrame:
    """tree, block, total and the block's leaves in order, of nodes (tree, pos, total, leaf and what further columns there are)."""
    more = [c for c in nodes.columns if c not in ("tree", "total")]
    rows = nodes.groupBy("tree", F.floor(F.col("pos") / SPAN).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", *(c for c in more if c != "pos")))).alias("leaves"), F.max("total").alias("total"))
    return materialize(rows, name)


def _up(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The block tables of all levels, and tree and top of every tree."""
    levels, tops = [], None
    while True:
        levels.append(_blocks(nodes, "blocks"))
        made = materialize(levels[-1].mapInArrow(_tops, "tree string, pos long, leaf binary, below long"), "tops")
        done = made.where(F.col("below") <= SPAN).select("tree", "leaf")
        tops = done if tops is None else tops.unionByName(done)
        nodes = made.where(F.col("below") > SPAN).select("tree", "pos", F.ceil(F.col("below") / SPAN).cast("long").alias("total"), "leaf")
        if nodes.isEmpty():
            return levels, tops


def _down(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest blocks with what lies above them. above: tree, left, right, subroot, root, of every tree's top."""
    given = None
    for k in reversed(range(len(levels))):
        rows = levels[k].where(F.col("total") <= SPAN).join(above, "tree")  # one block a tree
        if given is not None:
            rows = rows.unionByName(levels[k].where(F.col("total") > SPAN).join(given, ["tree", "block"]))
        if k:
            given = materialize(rows.mapInArrow(_paths, PATHS), "paths").drop("of", "node")
    return rows


def manifest(documents: DataFrame) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified: a row for each document."""
    written = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    leaf = lambda text: F.unhex(F.sha2(F.concat(*(written(F.col(c).cast("string")) for c in COLUMNS[:-1]), written(text)), 256))
    cut = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    leaves = documents.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("tree"),  # null first, else bytewise
        F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("leaf"), F.when(cut, leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("other"), F.monotonically_increasing_id().alias("salt"),
    )
    leaves = materialize(leaves, "leaves")
    dealt = in_order(leaves, ["tree", "doc_id", "leaf", "salt"], "ordered")  # the salt splits rows that are all alike
    discard(leaves)
    levels, tops = _up(numbered(dealt, "tree").drop("salt"))
    discard(dealt)
    tops = materialize(tops.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "leaf"), "subroots")
    # the tree over the sources: the same, with one tree
    sources = numbered(in_order(tops, ["of"], "sources"), "tree")
    upper, root = _up(sources)
    none, no_text = F.array().cast("array<string>"), F.lit("")
    root = root.select(F.lower(F.hex("leaf")).alias("root"))  # one row, or none
    to = _down(upper, root.select(no_text.alias("tree"), none.alias("left"), none.alias("right"), no_text.alias("subroot"), "root"))
    to = to.mapInArrow(_paths, PATHS).select(F.col("of").alias("tree"), "left", "right", F.lower(F.hex("node")).alias("subroot"), "root")
    rows = _down(levels, materialize(to, "source_paths"))
    return rows.mapInArrow(_documents, "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t
),
d AS (
  SELECT *, row_number() OVER () AS id,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS c32,
    concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END, CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
      CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars) END) AS head,
    replace(text, chr(10), '') AS cut
  FROM documents, crc
),
l AS (
  SELECT id, doc_id, source, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
    CASE WHEN c32 % 2 = 0 THEN sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(cut), ':', cut) END)) END AS other
  FROM d
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS total FROM l),
low(source, lvl, pos, h, total) AS (
  SELECT source, 0, pos, leaf, total FROM numbered
  UNION ALL
  SELECT source, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((total + 2) // 3) FROM low WHERE total > 1 GROUP BY source, lvl, pos // 3
),
subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM low WHERE total = 1),
high(lvl, pos, h, total) AS (
  SELECT 0, pos, subroot, total FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((total + 2) // 3) FROM high WHERE total > 1 GROUP BY lvl, pos // 3
),
low_runs AS (SELECT source, lvl, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM low WHERE total > 1 GROUP BY ALL),
high_runs AS (SELECT lvl, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM high WHERE total > 1 GROUP BY ALL),
steps AS (
  SELECT n.id, 0 AS part, r.lvl, (n.pos // CAST(3 ** r.lvl AS BIGINT)) % 3 AS here, r.hs
  FROM numbered n JOIN low_runs r ON n.source IS NOT DISTINCT FROM r.source AND r.run = n.pos // CAST(3 ** (r.lvl + 1) AS BIGINT)
  UNION ALL
  SELECT n.id, 1, r.lvl, (s.pos // CAST(3 ** r.lvl AS BIGINT)) % 3, r.hs
  FROM numbered n JOIN subroots s ON n.source IS NOT DISTINCT FROM s.source JOIN high_runs r ON r.run = s.pos // CAST(3 ** (r.lvl + 1) AS BIGINT)
),
sides AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY part, lvl) AS step, coalesce(array_to_string(hs[1:here], ''), '') AS lefts, coalesce(array_to_string(hs[here + 2:], ''), '') AS rights FROM steps
),
folds(id, step, h) AS (
  SELECT id, 0, coalesce(other, leaf) FROM l
  UNION ALL
  SELECT f.id, f.step + 1, sha256(concat(s.lefts, f.h, s.rights)) FROM folds f JOIN sides s ON s.id = f.id AND s.step = f.step + 1
),
proofs AS (SELECT id, sha256(string_agg(concat(lefts, rights), '' ORDER BY step)) AS proof FROM sides GROUP BY id),
tops AS (SELECT id, arg_max(h, step) AS folded FROM folds GROUP BY id)
SELECT n.doc_id, n.source, n.leaf, s.subroot, r.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, t.folded AS folded_root, t.folded = r.h AS verified
FROM numbered n JOIN subroots s ON n.source IS NOT DISTINCT FROM s.source JOIN high r ON r.total = 1 JOIN tops t ON t.id = n.id LEFT JOIN proofs p ON p.id = n.id
"""
