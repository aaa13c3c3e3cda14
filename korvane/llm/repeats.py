"""Suffix-array deduplication of repeated byte strings.

A byte goes if a WINDOW-byte string over it also starts in a document with a smaller doc_id. Strings are judged on
the input, and never cross documents.

  blocks    Documents are dealt by a hash of doc_id into blocks of about BLOCK bytes, which are written once as buckets of
            a table; from then on texts are read there, and only what is found out about them moves. Of equal texts only the first stays in play:
            the others go whole (a narrow join on their SHA-256).
  anchors   In every WINDOW-byte string the 16-byte strings with the least hash are its anchors, so equal strings have
            equal anchors in equal places. Blocks tell, for each bucket of anchor hashes, which anchors they hold and in
            how many documents; buckets tell the blocks which of them several documents share.
  suffixes  Shared anchors go out with what surrounds them, at most WINDOW bytes either way. A bucket puts equal
            surroundings together; where an anchor has several, it sorts what follows the anchor, and what precedes it
            backwards, as suffixes: multikey quicksort, a word of eight bytes at a time, to SHALLOW bytes, then blind
            tries for the groups that are still equal. Common prefix lengths of neighbours then give, for each length,
            the classes of equal suffixes, and so the smallest doc_id for every string through the anchor.
  hot       What surrounds an anchor that HOT or more documents share is dealt out in finer pieces: each distinct string
            over it goes out by itself, with the block's smallest doc_id, to the bucket of its own hash. Buckets sort
            such strings by the same deep-shallow sort; equal bytes, not equal hashes, decide. HOT moves work, no result.
  rounds    Surroundings are several times as large as the texts where much is shared, and the more documents, the more
            is. So they go out in rounds, some buckets in each, of about ROUND times the texts' bytes at most. Every round
            reads the blocks again; its shuffle files go when its verdicts are written.

Defined cases: a null or empty text has no bytes; texts under WINDOW bytes lose nothing; a very long text makes its
block as much longer; rows with a null doc_id lose nothing and take nothing; rows that repeat a doc_id do not remove
each other; of equal texts the smallest doc_id keeps its bytes; an empty table gives no rows; other columns are not
read, so their names cannot clash (those in `carry` may not bear the names of the result).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from korvane.llm.common import bucketed, byte_table, discard, freeing, materialize, mix, release, sent, table

WINDOW = 50
ANCHOR = 16
SPAN = WINDOW - ANCHOR  # 34: bytes that a string may have before its anchor, or after it
BLOCK = 4 << 20
WORK = 1 << 16  # bytes of text that have work arrays at one time: these then stay in a core's cache
SHALLOW = 24
HOT = 2048
ROUND = 1.25  # before compression, which takes a third
OUT_NEAR, OUT_FAR = WINDOW + SPAN + 18, (SPAN + 1) * (WINDOW + 8)  # bytes that go out for an anchor, for a hot one at most
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTES = byte_table(11), byte_table(12)

# --- sorting -----------------------------------------------------------------------------------------------------


def blind_trie(strings: list[bytes]) -> list[int]:
    """Order of equally long strings. Nodes hold only the depth at which they branch and one byte for each branch."""
    if len(strings) == 2:
        return [0, 1] if strings[0] <= strings[1] else [1, 0]
    root: list | int = 0  # a leaf is the number of a string; a node [depth, {byte: child}, any string below it]
    same: dict[int, list[int]] = {}
    for i, s in enumerate(strings[1:], 1):
        node = root
        while not isinstance(node, int):  # blindly: only branch bytes are looked at
            node = node[1].get(s[node[0]], node[2])
        t = strings[node]
        if s == t:
            same.setdefault(node, []).append(i)
            continue
        d = next(k for k, (a, b) in enumerate(zip(s, t, strict=True)) if a != b)
        above, node = None, root
        while not isinstance(node, int) and node[0] < d:
            above, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == d:
            node[1][s[d]] = i
            continue
        new = [d, {s[d]: i, t[d]: node}, i]
        if above is None:
            root = new
        else:
            above[1][s[above[0]]] = new
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, int):
            out += [node, *same.get(node, ())]
        else:
            todo += [c for _, c in sorted(node[1].items(), reverse=True)]
    return out


def deep_shallow(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows (n x length, bytes) within groups of equal `first`, and the common prefix of each with the one before it, -1 at a new group."""
    n, length = rows.shape
    order = np.argsort(first, kind="stable")
    group = np.cumsum(np.r_[0, np.diff(first[order].astype(np.int64)) != 0])
    wide = np.zeros((n, -(-length // 8) * 8), np.uint8)
    wide[:, :length] = rows
    words = np.ascontiguousarray(wide).view(">u8").astype(np.uint64)
    for d in range(min(SHALLOW // 8, words.shape[1])):  # one step of multikey quicksort in all open groups at once
        size = np.bincount(group)
        open_ = np.flatnonzero(size[group] > 1)
        if not len(open_):
            break
        sub = order[open_]
        order[open_] = sub[np.lexsort((words[sub, d], group[open_]))]
        w = words[order, d]
        group = np.cumsum(np.r_[0, (np.diff(group) != 0) | ((w[1:] != w[:-1]) & (size[group][1:] > 1))])
    starts = np.flatnonzero(np.r_[True, np.diff(group) != 0])
    for a, b in zip(starts, np.r_[starts[1:], n], strict=True):
        if b - a > 1:
            part = order[a:b]
            order[a:b] = part[blind_trie([rows[i, SHALLOW:].tobytes() for i in part])] if length > SHALLOW else part
    s = rows[order]
    common = np.r_[-1, np.where((eq := s[1:] == s[:-1]).all(1), length, eq.argmin(1))] if n else np.zeros(0, np.int64)
    common[np.r_[True, first[order][1:] != first[order][:-1]]] = -1
    return order, common


def row_hashes(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    h = np.zeros(len(rows), np.uint64)
    for w in wide.view("<u8").T:
        h = mix((h + w) * BASE)
    return h


def classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each class of equal rows (n x length, bytes), and each row's class. Sorted by hash, decided by bytes."""
    h = row_hashes(rows)
    order = np.argsort(h, kind="stable")
    new = np.r_[np.ones(min(1, len(h)), bool), h[order][1:] != h[order][:-1]]
    first, which = order[new], np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    if (rows != rows[first[which]]).any():  # two rows of one hash
        return np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)[1:]
    return first, which


# --- a block's strings ---------------------------------------------------------------------------------------------


def rolled(data: np.ndarray, length: int, which: int) -> np.ndarray:
    """Polynomial hash of every `length` bytes, by doubling."""
    cur, size, power, out, done, n = BYTES[which][data], 1, BASE, None, 0, len(data) - length + 1
    while True:
        if length & size:
            out = cur[done : done + n].copy() if out is None else out * power + cur[done : done + n]
            done += size
        if size * 2 > length:
            return mix(out)
        cur = cur[:-size] * power + cur[size:]
        with np.errstate(over="ignore"):
            power, size = power * power, size * 2


def extreme(a: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over each `width` neighbours."""
    size = 1
    while size * 2 <= width:
        a = f(a[:-size], a[size:])
        size *= 2
    return f(a[: len(a) - (width - size)], a[width - size :]) if width > size else a


class Block:
    """A block's rows, by doc_id and text so that a row has the same number each time, and their anchors."""

    def __init__(self, t: pa.Table, copies: set[tuple[int, bytes]]):
        ids, texts = t.column("doc_id").to_pylist(), t.column("text").cast(pa.large_binary()).to_pylist()
        self.order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k] or b""))
        rows = [(ids[k], texts[k]) for k in self.order]
        self.ids, self.texts = [r[0] for r in rows], [r[1] or b"" for r in rows]
        known = {i for i, _ in copies}
        self.copy = [i in known and (i, hashlib.sha256(x).digest()) in copies for i, x in zip(self.ids, self.texts, strict=True)]
        self.row, self.pos, self.hash, own, at = [], [], [], [], []
        live = [k for k, (i, x) in enumerate(rows) if i is not None and x and len(x) >= WINDOW and not self.copy[k]]
        self.start = np.full(len(rows), -1, np.int64)
        size = 0
        for k in live:
            self.start[k] = size
            size += len(self.texts[k])
        self.data = np.frombuffer(b"".join([self.texts[k] for k in live]), np.uint8)
        self.doc = np.array([i if i is not None else -1 for i in self.ids], np.int64)
        first = 0
        while first < len(live):  # slices of rows bound the work arrays
            last, n = first, 0
            while last < len(live) and (n == 0 or n + len(self.texts[live[last]]) <= WORK):
                n += len(self.texts[live[last]])
                last += 1
            base = self.start[live[first]]
            self._anchors(self.data[base : base + n], np.array([len(self.texts[k]) for k in live[first:last]]), np.array(live[first:last]), base)
            first = last
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.sizes, self.padded = np.array([len(x) for x in self.texts], np.int64), None
        self.row, self.pos, self.hash = cat(self.row, np.int64), cat(self.pos, np.int64), cat(self.hash, np.uint64)

    def _anchors(self, data: np.ndarray, lengths: np.ndarray, rows: np.ndarray, base: int) -> None:
        h = rolled(data, ANCHOR, 0)
        least = extreme(h, SPAN + 1, np.minimum)  # over the anchors of the string that starts here
        ends = np.cumsum(lengths)
        starts_whole = np.ones(len(least), bool)
        for e in ends[:-1]:
            starts_whole[max(0, e - WINDOW + 1) : e] = False
        most = extreme(np.concatenate([np.zeros(SPAN, np.uint64), np.where(starts_whole, least, 0), np.zeros(SPAN, np.uint64)]), SPAN + 1, np.maximum)
        pos = np.flatnonzero(h == most[: len(h)])
        r = np.searchsorted(ends, pos, "right")
        self.row.append(rows[r])
        self.pos.append(pos + base - self.start[rows[r]])
        self.hash.append(h[pos])

    def around(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What follows the anchors k, what precedes them backwards, and how much of either is text."""
        rv = np.minimum(WINDOW, self.sizes[self.row[k]] - self.pos[k])
        lv = np.minimum(SPAN, self.pos[k])
        at = self.start[self.row[k]] + self.pos[k]
        right, left = self.windows(WINDOW)[at + SPAN], self.windows(SPAN)[at][:, ::-1].copy()
        for side, valid, length in ((right, rv, WINDOW), (left, lv, SPAN)):
            cut = np.flatnonzero(valid < length)
            side[cut] = np.where(np.arange(length) < valid[cut][:, None], side[cut], 0)
        return right, left, rv, lv

    def windows(self, length: int) -> np.ndarray:
        """All runs of `length` bytes of the block's data, with SPAN zeros before it and WINDOW after it."""
        if self.padded is None:
            self.padded = np.concatenate([np.zeros(SPAN, np.uint8), self.data, np.zeros(WINDOW, np.uint8)])
        return np.lib.stride_tricks.sliding_window_view(self.padded, length)

    def strings(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each string over one of the anchors k: row, and its place in the block's data."""
        start = (self.pos[k][:, None] - np.arange(SPAN + 1)).ravel()
        row = np.repeat(self.row[k], SPAN + 1)
        ok = (start >= 0) & (start + WINDOW <= self.sizes[row])
        at = np.unique((self.start[row] + start)[ok])
        rows = np.flatnonzero(self.start >= 0)
        rows = rows[np.argsort(self.start[rows])]
        row = rows[np.searchsorted(self.start[rows], at, "right") - 1] if len(at) else np.zeros(0, np.int64)
        return row, at

    def distinct(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct strings at these places (n x WINDOW, bytes), and which of them each place has."""
        rows = self.windows(WINDOW)[at + SPAN]
        first, which = classes(rows)
        return rows[first], which


# --- what moves ----------------------------------------------------------------------------------------------------

NOTE = "blk long, kind int, bucket long, a binary, b binary, c binary, d binary"
RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
NOTES = pa.schema([("blk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), *((x, pa.binary()) for x in "abcd")])
COPIES, SHARED, NEAR, FAR = range(4)


def notes(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pydict({f.name: [r[i] for r in rows] for i, f in enumerate(NOTES)}, NOTES)


def read_notes(t: pa.Table) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for r in t.to_pylist():
        out.setdefault(r["kind"], []).append(r)
    return out


def buckets(h: np.ndarray, n: int) -> np.ndarray:
    """Anchors have the least hashes about them, so their hashes are mixed again before they are dealt out."""
    return ((mix(h ^ BASE) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def short(h: np.ndarray) -> np.ndarray:
    """What tells anchors of one bucket apart: 40 bits. Two that it takes for one only cost a needless comparison of bytes."""
    return mix(h ^ BASE) & np.uint64((1 << 40) - 1)


def pack(k: np.ndarray) -> bytes:
    return np.ascontiguousarray(k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def parts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of a sorted array."""
    if not len(bucket):
        return
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True):
        yield int(bucket[a]), slice(a, b)


def block_of(t: pa.Table, got: dict) -> Block:
    return Block(t, {(i, r["b"][32 * k : 32 * k + 32]) for r in got.get(COPIES, []) for k, i in enumerate(np.frombuffer(r["a"], np.int64).tolist())})


def tell_anchors(n_buckets: int):
    def run(t: pa.Table, more: pa.Table) -> pa.Table:
        b = block_of(t, read_notes(more))
        order = np.lexsort((b.row, b.hash))
        h, row = b.hash[order], b.doc[b.row[order]]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        docs = np.add.reduceat((new | np.r_[True, row[1:] != row[:-1]]).astype(np.int64), np.flatnonzero(new)) if len(h) else np.zeros(0, np.int64)
        keys, blk = h[new], t.column("blk")[0].as_py() if t.num_rows else -1
        to, keys = buckets(keys, n_buckets), short(keys)
        order = np.argsort(to, kind="stable")
        to, keys, docs = to[order], keys[order], docs[order]
        release()
        return notes([(blk, SHARED, k, pack(keys[s]), np.minimum(docs[s], 65535).astype("<u2").tobytes(), None, None) for k, s in parts(to)])

    return run


def find_shared(t: pa.Table) -> pa.Table:
    rows = t.to_pylist()
    keys = [unpack(r["a"]) for r in rows]
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    docs = np.bincount(at, np.concatenate([np.frombuffer(r["b"], "<u2") for r in rows]).astype(float))
    out, i = [], 0
    for r, k in zip(rows, keys, strict=True):
        n = docs[at[i : i + len(k)]]
        i += len(k)
        if (n >= 2).any():
            out.append((r["blk"], SHARED, r["bucket"], pack(k[n >= 2]), np.packbits(n[n >= 2] >= HOT).tobytes(), None, None))
    return notes(out)


def shared_of(b: Block, got: dict, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the block's anchors that several documents share: the few-document ones and the hot ones."""
    said = [(unpack(r["a"]) | np.uint64(r["bucket"] << 40), r["b"]) for r in got.get(SHARED, [])]
    if not said:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = np.concatenate([k for k, _ in said])
    hot = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for k, x in said])
    order = np.argsort(keys)
    keys, hot = keys[order], hot[order]
    own = short(b.hash) | (buckets(b.hash, n_buckets).astype(np.uint64) << np.uint64(40))
    i = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    known = keys[i] == own
    return np.flatnonzero(known & ~hot[i]), np.flatnonzero(known & hot[i])


def tell_strings(n_buckets: int, rounds: int = 1, now: int = 0):
    """What goes to every rounds-th bucket from `now` on."""

    def run(t: pa.Table, more: pa.Table) -> pa.Table:
        got = read_notes(more)
        b, blk, out = block_of(t, got), t.column("blk")[0].as_py() if t.num_rows else -1, []
        near, hot = shared_of(b, got, n_buckets)
        to = buckets(b.hash[near], n_buckets)
        near, to = near[to % rounds == now], to[to % rounds == now]
        order = np.lexsort((b.hash[near], to))
        near, to = near[order], to[order]
        for k, s in parts(to):
            right, left, rv, lv = b.around(near[s])
            out.append((blk, NEAR, k, np.concatenate([right, left], 1).tobytes(), np.stack([rv, lv], 1).astype(np.uint8).tobytes(), b.doc[b.row[near[s]]].tobytes(), np.stack([b.row[near[s]], b.pos[near[s]]], 1).astype("<u4").tobytes()))
        row, at = b.strings(hot)
        strings, which = b.distinct(at)
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, which, b.doc[row])
        to = buckets(row_hashes(strings), n_buckets)
        order = np.argsort(to, kind="stable")
        order = order[to[order] % rounds == now]
        to, strings, least = to[order], strings[order], least[order]
        out += [(blk, FAR, n_buckets + k, strings[s].tobytes(), None, least[s].tobytes(), None) for k, s in parts(to)]
        release()
        return notes(out)

    return run


def judge_near(right: np.ndarray, left: np.ndarray, rv: np.ndarray, lv: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each occurrence a mask: bit o is set if the string that starts o bytes before the anchor is in a smaller document too."""
    n = len(doc)
    offsets = np.arange(SPAN + 1)
    allowed = ((offsets <= lv[:, None]) & (WINDOW - offsets <= rv[:, None])) @ (np.uint64(1) << offsets.astype(np.uint64))
    whole = np.concatenate([right, left, rv[:, None].astype(np.uint8), lv[:, None].astype(np.uint8)], 1)
    first, same = classes(whole)
    smallest = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(smallest, same, doc)
    mask = np.where(doc > smallest[same], allowed, np.uint64(0))
    anchor = classes(right[first, :ANCHOR])[1]
    few = np.flatnonzero(np.bincount(anchor)[anchor] > 1)  # anchors whose surroundings are all equal are done
    if not len(few):
        return mask
    few = few[np.argsort(smallest[few], kind="stable")]  # so that the first of each class below has its smallest document
    f, anchor, small = first[few], anchor[few], smallest[few]
    by_right, common_right = deep_shallow(right[f], anchor)
    by_left, common_left = deep_shallow(left[f], anchor)
    m = len(f)
    own = np.zeros(m, np.uint64)
    for o in range(SPAN + 1):
        ok = np.flatnonzero((o <= lv[f]) & (WINDOW - o <= rv[f]))
        if len(ok) < 2:
            continue
        a, b = np.empty(m, np.int64), np.empty(m, np.int64)
        a[by_right] = np.cumsum(common_right < WINDOW - o)
        b[by_left] = np.cumsum(common_left < o)
        key = (a * (m + 1) + b)[ok]
        order = np.argsort(key, kind="stable")
        k, s = key[order], small[ok][order]
        new = np.r_[True, k[1:] != k[:-1]]
        least = s[new][np.cumsum(new) - 1]
        own[ok[order[least < s]]] |= np.uint64(1) << np.uint64(o)
    every = np.zeros(len(first), np.uint64)
    every[few] = own
    return mask | np.where(doc == smallest[same], every[same], np.uint64(0))


def judge(t: pa.Table) -> pa.Table:
    rows, out = t.to_pylist(), []
    if rows[0]["kind"] == NEAR:
        cat = lambda k, kind: np.concatenate([np.frombuffer(r[k], kind) for r in rows])
        s, v, doc, at = cat("a", np.uint8).reshape(-1, WINDOW + SPAN), cat("b", np.uint8).reshape(-1, 2).astype(np.int64), cat("c", np.int64), cat("d", "<u4").reshape(-1, 2)
        mask, i = judge_near(s[:, :WINDOW], s[:, WINDOW:], v[:, 0], v[:, 1], doc), 0
        for r in rows:
            n = len(r["c"]) // 8
            k = i + np.flatnonzero(mask[i : i + n])
            i += n
            if len(k):
                out.append((r["blk"], NEAR, r["bucket"], at[k].tobytes(), mask[k].tobytes(), None, None))
        return notes(out)
    strings, doc = (np.concatenate([np.frombuffer(r[k], kind) for r in rows]) for k, kind in (("a", np.uint8), ("c", np.int64)))
    order, common = deep_shallow(strings.reshape(-1, WINDOW), np.zeros(len(doc), np.int64))
    new = np.flatnonzero(common < WINDOW)
    least = np.empty(len(doc), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], new), np.diff(np.r_[new, len(doc)]))
    i = 0
    for r in rows:
        n = len(r["c"]) // 8
        k = i + np.flatnonzero(least[i : i + n] < doc[i : i + n])
        i += n
        if len(k):
            out.append((r["blk"], FAR, r["bucket"], strings.reshape(-1, WINDOW)[k].tobytes(), None, least[k].tobytes(), None))
    release()
    return notes(out)


def cut(keep_text: bool, carry: list[str], n_buckets: int):
    def run(t: pa.Table, more: pa.Table) -> pa.Table:
        got = read_notes(more)
        b = block_of(t, got)
        starts = np.zeros(len(b.data) + 1, bool)  # places in the block's data where a string that goes starts
        for r in got.get(NEAR, []):
            at, mask = np.frombuffer(r["a"], "<u4").reshape(-1, 2).astype(np.int64), np.frombuffer(r["b"], np.uint64)
            at = b.start[at[:, 0]] + at[:, 1]
            for o in range(SPAN + 1):
                starts[at[(mask >> np.uint64(o)) & np.uint64(1) == 1] - o] = True
        _, hot = shared_of(b, got, n_buckets)
        if len(hot):
            row, at = b.strings(hot)
            strings, which = b.distinct(at)
            # the smallest document of this block, or of another one
            smallest = np.full(len(strings), np.iinfo(np.int64).max)
            np.minimum.at(smallest, which, b.doc[row])
            far = got.get(FAR, [])
            if far:
                other = np.concatenate([np.frombuffer(r["a"], np.uint8) for r in far]).reshape(-1, WINDOW)
                least = np.concatenate([np.frombuffer(r["c"], np.int64) for r in far])
                _, both = classes(np.concatenate([strings, other]))
                place = np.empty(both.max() + 1, np.int64)
                place[both[: len(strings)]] = np.arange(len(strings))
                np.minimum.at(smallest, place[both[len(strings) :]], least)
            starts[at[smallest[which] < b.doc[row]]] = True
        edge = starts.astype(np.int8)
        edge[WINDOW:] -= starts[:-WINDOW]
        gone = np.cumsum(edge, dtype=np.int8) > 0  # no byte is in more than WINDOW strings
        n_removed, n_spans, sha, kept = [], [], [], []
        for k, x in enumerate(b.texts):
            own = gone[b.start[k] : b.start[k] + len(x)] if b.start[k] >= 0 else gone[:0]
            if b.copy[k] and len(x) >= WINDOW:
                n_removed.append(len(x)), n_spans.append(1)
                left = b""
            elif own.any():
                n_removed.append(int(own.sum())), n_spans.append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()))
                left = np.frombuffer(x, np.uint8)[~own].tobytes()
            else:
                n_removed.append(0), n_spans.append(0)
                left = x
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode("utf-8", "ignore") if keep_text else None)
        own = [pa.array(b.ids, pa.int64()), pa.array([len(x) for x in b.texts], pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())]
        also = t.take(pa.array(b.order, pa.int64()))
        return pa.Table.from_arrays([*own, *(also.column(c) for c in carry)], [*RESULT, *carry])

    return run


def repeats(documents: DataFrame, keep_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept for every row, and the columns in carry.

    kept is the remaining text, without characters that a cut goes through; null unless keep_text, and then the result is a
    written table and its intermediate ones are deleted."""
    spark = documents.sparkSession
    carry = [c for c in carry if c not in (*RESULT, "text", "blk")]
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    narrow = materialize(docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").cast("long").alias("n")), "texts")
    size = narrow.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // BLOCK + 1, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))))
    blk = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(n_blocks)).alias("blk")  # rows without an id are dealt by their texts
    blocks = bucketed(docs.select("doc_id", "text", *carry, blk), "blk", n_blocks, "blocks")

    long = narrow.where(F.col("n") >= WINDOW)

    def gather(t: pa.Table) -> pa.Table:
        return notes([(t.column("blk")[0].as_py(), COPIES, 0, t.column("doc_id").to_numpy().astype(np.int64).tobytes(), b"".join(t.column("sha").to_pylist()), None, None)])

    both = lambda df, f, kind: blocks.groupBy("blk").cogroup(df.groupBy("blk")).applyInArrow(f, kind)
    dealt = lambda df: df.repartition(n_blocks, "bucket").groupBy("bucket")
    with freeing(spark):
        first = materialize(long.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")).where("times > 1").select("sha", "first"), "first")
        copies = long.join(sent(first), "sha").where(F.col("doc_id") > F.col("first")).select("doc_id", F.unhex("sha").alias("sha"), F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).alias("blk"))
        copied = materialize(copies.groupBy("blk").applyInArrow(gather, NOTE), "copied")
        discard(narrow, first)
        shared = materialize(dealt(both(copied, tell_anchors(n_blocks), NOTE)).applyInArrow(find_shared, NOTE), "shared")
        known = copied.unionByName(shared)
        rounds = rounds_for(shared, size)
        judged = [materialize(dealt(both(known, tell_strings(n_blocks, rounds, now), NOTE)).applyInArrow(judge, NOTE), "judged") for now in range(rounds)]
        for df in judged:
            known = known.unionByName(df)
        kind = _parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
        out = both(known, cut(keep_text, carry, n_blocks), StructType([*kind.fields, *docs.select(*carry).schema.fields]))
        if keep_text:
            return out  # as large as the texts: the caller writes it, and then sweep() deletes what it is made from
        out = materialize(out, "repeats")
    discard(blocks, copied, shared, *judged)
    return out


def count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        yield pa.RecordBatch.from_pydict({"n": [len(x) // 5 for x in a], "hot": [int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for x in b]}, pa.schema([("n", pa.int64()), ("hot", pa.int64())]))


def rounds_for(shared: DataFrame, size: int) -> int:
    """So many that none sends out more than ROUND times the texts' bytes, as far as the shared anchors tell."""
    told = shared.select("a", "b").mapInArrow(count_shared, "n long, hot long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("hot"), F.lit(0)).alias("hot")).first()
    return max(1, -(-(told["n"] * OUT_NEAR + told["hot"] * OUT_FAR) // max(1, int(ROUND * size))))


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")
