"""The prefix trie of conversations: every shared beginning, with its members, its children and what caching it saves.

  rebuild   Turns become a 16-byte digest and a length, in the order of `turn`; from here on no text is moved. A conversation's
            path is the chain of digests of its first 1, 2, ... turns.
  sort      Conversations are range sorted by their paths, which puts those that share a beginning side by side; identical
            ones are dealt out by conv_id. The LCP array holds how many turns each shares with the one before it.
  tree      The nodes of the trie at which conversations part are the intervals between nearest smaller values of the LCP
            array, its Cartesian tree with equal neighbours merged. Blocks of BLOCK conversations are folded by a stack: an
            interval that ends inside the block is a finished node; of the rest only the block's minima stay (the first
            place of each new minimum from the left, the last from the right), each with the sums of what lies up to the
            next. FAN blocks' minima are a block of the next level, until one is left. Every interval gets its sums on the way.
  expand    A node stands for all depths from below its parent's: these get rows of their own.

Sums that need no walk through a subtree: a conversation closes a leaf if it is longer than what it shares with the next;
the tokens of the distinct nodes that it adds are those behind what it shares with the one before.

Defined cases: rows without a conv_id are no conversation; a null turn comes first, rows that repeat a turn go by the digest
of role and text; null and empty role or text are the same; very long texts count by digest and length; identical
conversations share all nodes, and their ids are hashed as a stream of sorted chunks; an empty table gives no rows; other
columns are not read, so their names cannot clash. A conversation's digests and lengths (40 bytes a turn) are one row, so
one conversation may have some 50 million turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvane.llm.common import discard, in_order, materialize, table

#: Conversations of a block of the LCP array, and blocks of a level whose minima make one of the next.
BLOCK = 1024
FAN = 64
#: A conversation may begin with so many turns of another, but one.
BORROWED = 6
#: Ids of a chunk that is put together before ids of identical conversations meet.
CHUNK = 4096

Sums = tuple[int, int, int, int]  # the smallest conv_id; tokens; leaves closed; tokens of new nodes


def add(a: Sums | None, b: Sums) -> Sums:
    return b if a is None else (min(a[0], b[0]), a[1] + b[1], a[2] + b[2], a[3] + b[3])


def intervals(elements: list[tuple[int, int, int, Sums]], end: int | None = None) -> tuple[list[tuple], list[tuple[int, int, int, Sums]]]:
    """The finished intervals and the minima that stay of a part of the LCP array.

    elements: position, value, how many children begin with it, and the sums from there up to the next. end: the array's
    length if elements are its last ones, so that nothing comes after. An interval is (first, last, value, the larger of the
    values beside it, children, sums)."""
    found, kept, stack = [], [], []  # stack: value, first place, last place, children, sums before the last place, sums from there
    for pos, value, children, sums in elements if end is None else [*elements, (end, -1, 0, None)]:
        while stack and stack[-1][0] > value:
            top, first, _, n, before, after = stack.pop()
            whole = add(before, after)
            if stack:
                below = stack[-1]
                found.append((below[2], pos - 1, top, max(below[0], value), n, whole))
                below[5] = whole
            else:
                kept.append((first, top, n, whole))  # what lies to the left is not known
        if sums is None:
            break
        if stack and stack[-1][0] == value:
            e = stack[-1]
            e[2], e[3], e[4], e[5] = pos, e[3] + children, add(e[4], e[5]), sums
        else:
            stack.append([value, pos, pos, children, stack[-1][5] if stack else None, sums])
    for i, (value, first, last, n, before, after) in enumerate(stack):
        upto = stack[i + 1][4] if i + 1 < len(stack) else after
        if i == 0 and first != last:
            kept.append((first, value, n, before))
            n = 0
        kept.append((last, value, n, upto))
    return found, kept


FOLDED = "final boolean, low long, high long, depth long, parent long, children long, conv_id long, tokens long, closed long, fresh long, block long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            items, end = row["items"], row["end"]
            out = []
            if "len" in items[0]:  # the LCP array itself; the last item may be the next block's first
                own = items[:-1] if items[-1]["pos"] // row["width"] != row["block"] else items
                for x, y in zip(own, [*items[1:], {"value": -1}][: len(own)], strict=True):
                    x["children"] = int(x["len"] > x["value"])
                    if x["len"] > max(x["value"], y["value"]):  # alone
                        out.append((True, x["pos"], x["pos"], x["len"], max(x["value"], y["value"]), 0, x["conv_id"], x["tokens"], x["closed"], x["fresh"]))
                items = own
            found, kept = intervals([(x["pos"], x["value"], x["children"], (x["conv_id"], x["tokens"], x["closed"], x["fresh"])) for x in items], end)
            out += [(True, *x[:5], *x[5]) for x in found]
            out += [(False, pos, None, value, None, n, *sums) for pos, value, n, sums in kept] if end is None else []
            columns = list(zip(*out, strict=True)) or [()] * 10
            kinds = [pa.bool_(), *[pa.int64()] * 10]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*columns, [row["block"]] * len(out)], kinds, strict=True)], [c.split()[0] for c in FOLDED.split(", ")])


def tree(lcp: DataFrame, n: int, width: int = BLOCK, fan: int = FAN) -> DataFrame:
    """The intervals (low, high, depth, parent, children, conv_id, tokens, closed, fresh) of the LCP array lcp(pos, value, len,
    conv_id, tokens, closed, fresh) of n rows; a conversation that parts from both neighbours is one of its own."""
    block = F.floor(F.col("pos") / width)
    ahead = (F.col("pos") > 0) & (F.col("pos") % width == 0)  # the block before looks at it too
    rows = lcp.withColumn("block", F.explode(F.when(ahead, F.array(block, block - 1)).otherwise(F.array(block))))
    fields, blocks, out = ["pos", "value", "conv_id", "tokens", "closed", "fresh", "len"], -(-n // width), None
    while True:
        last = F.lit(n if blocks <= 1 else None).cast("long")
        rows = rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("items")).select("block", "items", last.alias("end"), F.lit(width).alias("width"))
        folded = materialize(rows.mapInArrow(_fold, FOLDED), "folded")
        done = folded.where("final").drop("final", "block")
        out = done if out is None else out.unionByName(done)
        if blocks <= 1:
            return out
        rows = folded.where("NOT final").select(F.col("low").alias("pos"), F.col("depth").alias("value"), "children", "conv_id", "tokens", "closed", "fresh", F.floor(F.col("block") / fan).alias("block"))
        fields, blocks = ["pos", "value", "children", "conv_id", "tokens", "closed", "fresh"], -(-blocks // fan)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (array of key, n: digest and code points) of every conversation, as the contract rebuilds it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", key.alias("key"), F.length(text).cast("long").alias("n")).alias("t"))
    own = materialize(turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"].alias("key"), t["n"].alias("n"))).alias("own")), "own")
    root = F.col("conv_id") - F.col("conv_id") % 100
    roots = own.where(root == F.col("conv_id")).select(F.col("conv_id").alias("root"), F.slice("own", 1, BORROWED - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED).cast("int")
    joined = own.withColumn("root", root).join(roots, "root", "left").withColumn("h", h)
    none = F.slice("own", 1, F.lit(0))
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("first", none), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own"))).alias("turns"))


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chain of digests, and the tokens up to each turn."""
    for batch in batches:
        paths, sums = [], []
        for turns in batch.column("turns"):
            path, upto, at = [], [0], b""
            for t in turns.as_py():
                at = sha256(at + t["key"]).digest()[:16]
                path.append(at)
                upto.append(upto[-1] + t["n"])
            paths.append(path)
            sums.append(upto)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(paths, pa.list_(pa.binary())), pa.array(sums, pa.list_(pa.int64()))], ["conv_id", "path", "sums"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With what each row shares with the one before it, and that one's length; null for the first row of a partition."""
    before = None
    for batch in batches:
        lcps, lengths = [], []
        for item in batch.column("path"):
            path = item.as_py()
            if before is None:
                lcps.append(None)
                lengths.append(None)
            else:
                lcps.append(next((i for i, (a, b) in enumerate(zip(path, before, strict=False)) if a != b), min(len(path), len(before))))
                lengths.append(len(before))
            before = path
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lcps, pa.int64()), pa.array(lengths, pa.int64())], [*batch.schema.names, "shares", "before"])


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and SHA-256 of its chunks, which follow each other; they may reach over batches."""
    key = state = None
    for batch in batches:
        keys, hashes = [], []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids"), strict=True):
            if k == key:
                state.update(b",")
            else:
                if state is not None:
                    keys.append(key)
                    hashes.append(state.hexdigest())
                key, state = k, sha256()
            state.update(ids.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])


def ends(paths: DataFrame) -> DataFrame:
    """key and ends_sha256 for each distinct whole conversation of paths(conv_id, key). No list of all ids is ever put together."""
    chunks = paths.groupBy("key", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return chunks.repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids").mapInArrow(_ids, "key binary, ends_sha256 string")


def _at(path: Column, depth: Column) -> Column:
    """The digest of the first `depth` turns; none have an empty one."""
    return F.when(depth == 0, F.lit(b"")).otherwise(F.get(path, depth.cast("int") - 1))


def trie(conversations: DataFrame, width: int = BLOCK, fan: int = FAN) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    traced = materialize(rebuilt(conversations).mapInArrow(_trace, "conv_id long, path array<binary>, sums array<long>"), "traced")
    dealt = in_order(traced, ["path", "conv_id"], "paths", lambda df: df.mapInArrow(_shared, "conv_id long, path array<binary>, sums array<long>, shares long, before long"))
    discard(traced)
    # a part's first row meets the last one of the part before it: a row for each part
    parts = dealt.groupBy("_part").agg(F.count("*").alias("n"), F.min_by("path", "_inside").alias("first"), F.max_by("path", "_inside").alias("last"))
    order = Window.orderBy("_part")
    previous = F.lag("last").over(order)
    parts = parts.select("_part", (F.sum("n").over(order) - F.col("n")).alias("_base"), F.coalesce(F.size(F.array_intersect("first", previous)), F.lit(-1)).cast("long").alias("_shares"), F.size(previous).cast("long").alias("_before"))
    parts = materialize(parts, "parts")
    length, tokens = F.size("path").cast("long"), F.element_at("sums", -1)
    every = dealt.join(F.broadcast(parts), "_part").select("conv_id", "path", "sums", (F.col("_base") + F.col("_inside")).alias("pos"), F.coalesce("shares", "_shares").alias("value"), F.coalesce("before", "_before").alias("before"))
    every = every.withColumns({"len": length, "tokens": tokens, "closed": F.coalesce(F.col("value") < F.col("before"), F.lit(False)).cast("long"), "fresh": tokens - F.get("sums", F.greatest("value", F.lit(0)).cast("int"))})
    n = dealt.count()
    nodes = tree(every.select("pos", "value", "len", "conv_id", "tokens", "closed", "fresh"), n, width, fan)
    # what the first conversation of an interval says of the node and of the depths above it
    first = every.select(F.col("pos").alias("low"), "path", "sums", F.col("len").alias("_len"), F.col("tokens").alias("_tokens"), F.col("closed").alias("_closed"), F.col("fresh").alias("_fresh"))
    upto = lambda x: F.when(x == 0, F.lit(0).cast("long")).otherwise(F.get("sums", x.cast("int") - 1))  # noqa: E731  tokens above depth x
    compact = nodes.join(first, "low").select(
        _at(F.col("path"), F.col("depth")).alias("key"), F.when(F.col("parent") >= 0, _at(F.col("path"), F.col("parent"))).alias("above"), "conv_id", "depth", "parent", (F.col("high") - F.col("low") + 1).alias("n_convs"),
        (F.col("children") + (F.col("_len") > F.col("depth")).cast("long")).alias("n_children"), (F.col("closed") - F.col("_closed") + 1).alias("n_leaves"),
        (F.col("tokens") - (F.col("fresh") - F.col("_fresh")) - F.col("_tokens")).alias("saved"), F.transform(F.sequence(F.col("parent") + 1, F.col("depth")), upto).alias("uptos"),
    )
    compact = materialize(compact, "nodes")
    parents = compact.select(F.col("key").alias("above"), F.col("conv_id").alias("_parent"))
    hashes = ends(every.select("conv_id", _at(F.col("path"), F.col("len")).alias("key")))
    rows = compact.join(parents, "above", "left").join(hashes, "key", "left")
    rows = rows.select("*", F.posexplode("uptos").alias("_i", "_upto")).withColumn("_depth", F.col("parent") + 1 + F.col("_i"))
    own = F.col("_depth") == F.col("depth")
    return rows.select(
        "conv_id", F.col("_depth").alias("depth"), F.when(F.col("_depth") > 0, F.when(F.col("_i") == 0, F.col("_parent")).otherwise(F.col("conv_id"))).alias("parent_conv_id"), "n_convs",
        F.when(own, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("saved") - (F.col("n_convs") - 1) * F.col("_upto")).alias("saved_tokens"),
        F.coalesce(F.when(own, F.col("ends_sha256")), F.lit(sha256().hexdigest())).alias("ends_sha256"),
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


OP13_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t
),
own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
h AS (
  SELECT conv_id, turns,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 6 AS h
  FROM own, crc
),
rebuilt AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100
),
digests AS (
  SELECT conv_id, len(turns) AS n, list_transform(range(len(turns) + 1), lambda d: sha256(CAST(turns[1:d] AS VARCHAR))) AS path, list_transform(turns, lambda t: length(t.x)) AS sizes FROM rebuilt
),
spread AS (SELECT conv_id, n, path, sizes, unnest(range(n + 1)) AS depth FROM digests),
nodes AS (
  SELECT path[depth + 1] AS node, depth, any_value(path[1:depth + 1]) AS line, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END) AS size,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM spread GROUP BY ALL
),
children AS (SELECT line[depth] AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node, depth)),
above AS (SELECT unnest(line) AS node, unnest(range(depth + 1)) AS depth, n_children, (n_convs - 1) * size AS saved FROM counted),
sums AS (SELECT node, depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY ALL)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums s USING (node, depth) LEFT JOIN nodes p ON p.node = c.line[c.depth] AND p.depth = c.depth - 1
"""
