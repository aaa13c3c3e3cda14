"""SentencePiece encoding and decoding by a Viterbi pass that shares prefixes.

A text gets a mark in front, blanks become marks, and it falls into marked words: a run of marks and what follows up
to the next mark. No vocabulary piece has a mark after another character (checked when a model is loaded), and no
piece holds a character outside the vocabulary's, so nothing crosses the words' edges.

The distinct words of a batch are sorted, which is a depth-first walk of their trie: a word keeps the forward states
of the prefix that it shares with the one before it and computes only the rest.

  unigram models: the forward state of a prefix is its best sum of piece scores and the last piece on that path.
  merge (BPE) models: a path is allowed if each two adjacent pieces stay unmerged when taken alone; exactly one
  path to every prefix is (token_counts.py says why), so the state is the last piece, and the result is what the
  library's merging gives. Scores are 0 or minus infinity, the maximum is the one path that is left.

Characters without a piece become the pieces of their bytes. Decoding joins pieces and takes the first mark away.

Defined cases: a null or empty text has no pieces, and null pieces decode to null; a null doc_id is kept; repeated rows
and equal texts are encoded each; texts of any length are encoded whole; an empty table gives no rows; other columns are
carried, but one named like the result's (pieces, decoded) gives way; digest() reads doc_id and text alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from korvane.llm.common import arrow_batches, release, slices, table
from korvane.llm.token_counts import MODEL, processor

MARK = "▁"
CACHED_WORDS = 400_000
CACHED_PAIRS = 500_000
LONGEST_CACHED = 48


def model_type(blob: bytes) -> int:
    """Field 3 of the trainer's settings (field 2) in a model file: 1 unigram, 2 BPE."""

    def fields(b: bytes):
        i = 0

        def number() -> int:
            nonlocal i
            n = shift = 0
            while True:
                n |= (b[i] & 127) << shift
                i, shift = i + 1, shift + 7
                if b[i - 1] < 128:
                    return n

        while i < len(b):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            else:
                size = {1: 8, 5: 4}.get(tag & 7) or number()
                yield tag >> 3, b[i : i + size]
                i += size

    for k, v in fields(blob):
        if k == 2:
            return next((x for f, x in fields(v) if f == 3), 1)
    return 1


class Pieces:
    """A vocabulary and the caches of one worker."""

    def __init__(self, sp):
        kinds = [(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size())]
        self.ids = {p: i for i, p in kinds if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))}
        self.score = [sp.get_score(i) for i, _ in kinds]
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.plain = [p.replace(MARK, " ").encode() for _, p in kinds]
        for b, i in enumerate(self.byte):
            self.plain[i] = bytes([b])
        self.merging = model_type(sp.serialized_model_proto()) == 2
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a mark after another character: words are not independent")
        self.lengths: dict[str, list[int]] = {}
        for p in self.ids:
            self.lengths.setdefault(p[-1], []).append(len(p))
        self.lengths = {c: sorted(set(n), reverse=True) for c, n in self.lengths.items()}
        known = "".join(re.escape(c) for c in sorted({c for p in self.ids for c in p} - {MARK}))
        self.words = re.compile(f"{MARK}+[{known}]*|[{known}]+|[^{known}{MARK}]")
        self.cache: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.text = [p for _, p in kinds]
        self.edges: tuple[dict, dict] = ({}, {})

    def merged(self, text: str) -> list[str]:
        """Greedy merging of a short text: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def edge(self, p: int, right: bool) -> list[tuple[str, float]] | None:
        """The symbols that stand, one after another, at an edge of a piece while it is merged, each with the score of the merge that takes it in.

        None where merges do not come in falling order of score: then pairs are merged afresh."""
        text = self.text[p]
        parts, seen, falling = list(text), [], True
        at, before = (-1 if right else 0), np.inf
        while len(parts) > 1:
            best = max(((self.score[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return None
            k = -best[1]
            if k == (len(parts) - 2 if right else 0):
                seen.append((parts[at], best[0]))
            falling &= best[0] <= before
            before = best[0]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [*seen, (text, -np.inf)] if falling and MARK * 2 not in text else None

    def stays(self, text: str, cut: int, a: int, b: int) -> bool:
        """Whether the pieces a and b that text falls into at cut stay as they are.

        They do not if, while both are being merged, symbols meet at the cut whose union is a piece that comes before
        the merges that would take either of them in; of equals the left one comes first."""
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        left, right = self.edges[0].get(a, 0), self.edges[1].get(b, 0)
        if left == 0:
            left = self.edges[0][a] = self.edge(a, True)
        if right == 0:
            right = self.edges[1][b] = self.edge(b, False)
        if left is None or right is None:
            ok = self.merged(text) == [text[:cut], text[cut:]]
        else:
            ok, ids, score = True, self.ids, self.score
            for u, u_taken in left:
                for v, v_taken in right:
                    if (i := ids.get(u + v)) is not None and score[i] > u_taken and score[i] >= v_taken:
                        ok = False
                        break
        self.pairs[a << 32 | b] = ok
        return ok

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Encode sorted distinct words, depth first through their trie. A state is (score, last piece, where it begins)."""
        ids, lengths, score, merging, pairs = self.ids, self.lengths, self.score, self.merging, self.pairs
        states: list[tuple] = [(0.0, -1, 0)]
        last = ""
        for w in words:
            shared, most = 0, min(len(w), len(last))
            while shared < most and w[shared] == last[shared]:
                shared += 1
            del states[shared + 1 :]
            for i in range(shared + 1, len(w) + 1):
                found = None
                for n in lengths.get(w[i - 1], ()):
                    j = i - n
                    if j < 0 or (before := states[j]) is None or (p := ids.get(w[j:i])) is None:
                        continue
                    if not merging:
                        s = before[0] + score[p]
                        if found is None or s > found[0]:
                            found = (s, p, j)
                    elif j == 0:
                        ok = self.alone.get(p)
                        if ok is None:
                            ok = self.alone[p] = len(self.merged(w[:i])) == 1
                        if ok:
                            found = (0.0, p, 0)
                            break
                    else:
                        ok = pairs.get(before[1] << 32 | p)
                        if ok is None:
                            ok = self.stays(w[before[2] : i], j - before[2], before[1], p)
                        if ok:
                            found = (0.0, p, j)
                            break
                states.append(found)
            last = w
            out, i = [], len(w)
            if states[i] is None:  # only a single character without a piece
                yield w, np.array([self.byte[b] for b in w.encode()], np.int32).tobytes()
                continue
            while i:
                _, p, i = states[i]
                out.append(p)
            yield w, np.array(out[::-1], np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, four bytes each."""
        split = [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cache) >= CACHED_WORDS:
            self.cache.clear()
        new = {w for s in split for w in s}.difference(self.cache)
        own = dict(self.encode_words(sorted(new)))
        long = {w: own.pop(w) for w in new if len(w) > LONGEST_CACHED}
        self.cache.update(own)
        get = (self.cache | long).__getitem__ if long else self.cache.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        out = b"".join(map(self.plain.__getitem__, ids))
        return out[1:].decode("utf-8", "replace") if out[:1] == b" " else out.decode("utf-8", "replace")


def _mapped(documents: DataFrame, make, column: str, kind: str, arrow: pa.DataType, model: str, source: str, most: int = 4 << 20) -> DataFrame:
    at = [c for c in documents.columns if c != column]  # a column of the result's name gives way

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Pieces(processor(model))  # with its caches it ends with the task: workers are kept for later stages
        for b in batches:
            for part in slices(b, most, source) if pa.types.is_string(b.schema.field(source).type) or pa.types.is_large_string(b.schema.field(source).type) else [b]:
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in at), pa.array(make(m, part.column(part.schema.get_field_index(source)).to_pylist()), arrow)], [*at, column])

        del m
        release()

    arrow_batches(documents.sparkSession)
    return documents.mapInArrow(run, StructType([*documents.select(*at).schema.fields]).add(column, _parse_datatype_string(kind)))


def encode(documents: DataFrame, model: str = MODEL, most: int = 4 << 20) -> DataFrame:
    """All columns of documents and `pieces` array<int>. About `most` bytes of text are encoded at one time: more share more prefixes, and take more memory."""
    return _mapped(documents, lambda m, texts: [np.frombuffer(x, np.int32) for x in m.encode(texts)], "pieces", "array<int>", pa.list_(pa.int32()), model, "text", most)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """All columns of encoded and `decoded` string; null where pieces is null."""
    return _mapped(encoded, lambda m, ids: [None if x is None else m.decode(x) for x in ids], "decoded", "string", pa.string(), model, "pieces")


def digest(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), round_trip (decoding gives the text back) and the pieces."""

    def make(m: Pieces, texts: list[str | None]) -> list[dict]:
        out = []
        for t, ids in zip(texts, m.encode(texts), strict=True):
            out.append({"n": len(ids) // 4, "crc": zlib.crc32(ids), "ok": m.decode(np.frombuffer(ids, np.int32).tolist()) == (t or "").replace(MARK, " "), "pieces": np.frombuffer(ids, np.int32)})
        return out

    got = _mapped(documents.select("doc_id", "text"), make, "d", "n long, crc long, ok boolean, pieces array<int>", pa.struct([("n", pa.int64()), ("crc", pa.int64()), ("ok", pa.bool_()), ("pieces", pa.list_(pa.int32()))]), model, "text")
    return got.select("doc_id", F.col("d.n").alias("n_tokens"), F.col("d.crc").alias("ids_crc32"), F.col("d.ok").alias("round_trip"), "d.pieces")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
