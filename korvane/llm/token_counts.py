"""Token counts of whole texts, as the sentencepiece library gives them.

Texts up to HUGE characters are encoded as they are. A longer text is encoded in chunks that overlap, each with the
byte offsets of its pieces, so that no more than a chunk's lattice is in memory. Two neighbouring chunks are spliced
at a boundary b that is proven stable: both encodings have the same piece before b and the same piece after b.

Why that proves it: merging only ever joins two neighbours, so a list of pieces is the encoding of its text exactly
if every two adjacent pieces, taken alone, stay unmerged (the first merge across a boundary would need the same two
neighbours in the same states, and the greedy order of those two does not depend on what stands around them). Left of
b all adjacent pairs occur in the left chunk's encoding, right of b in the right one's, and the pair at b in both.

Where an overlap has no such boundary it is widened fourfold; once it would cover the whole left chunk, the text is
encoded in one piece.

Defined cases: a null or empty text has 0 bytes and 0 tokens; very long texts are counted whole, in chunks; a null doc_id
is kept; repeated rows and equal texts are counted each; an empty table gives no rows; other columns are not read, so
their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvane.llm.common import arrow_batches, table

MODEL = "piece_bpe_32k.model"
HUGE = 32_768
CHUNK = 16_384
OVERLAP = 256
LIMIT = 4096

_loaded: dict = {}


def processor(model: str):
    if model not in _loaded:
        import public_tokenizers
        import sentencepiece

        _loaded[model] = sentencepiece.SentencePieceProcessor(model_file=model if "/" in model else public_tokenizers.path(model))
    return _loaded[model]


def offsets(sp, text: str, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Encode text; the byte offsets at which its symbols end (a mark counts one byte, start is where text begins) and the tokens up to each.

    The bytes of a character that the vocabulary lacks are one symbol."""
    ends, tokens, at, n = [], [], start - 1, 0  # the mark that the library puts first
    for piece, is_byte in ((p, sp.is_byte(i)) for p, i in zip(sp.encode(text, out_type=str), sp.encode(text), strict=True)):
        n += 1
        at += 1 if is_byte else len(piece.encode()) - 2 * piece.count("▁")
        if is_byte and 0x80 <= int(piece[3:5], 16) < 0xC0 and ends:
            ends[-1], tokens[-1] = at, n
        else:
            ends.append(at)
            tokens.append(n)
    return np.array(ends, np.int64), np.array(tokens, np.int64)


def splice(left: np.ndarray, right: np.ndarray) -> tuple[int, int] | None:
    """Indices, in either list of ends, of a boundary whose neighbours on both sides are the same. The middle one of all."""
    common, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    same = np.flatnonzero((np.diff(i)[:-1] == 1) & (np.diff(i)[1:] == 1) & (np.diff(j)[:-1] == 1) & (np.diff(j)[1:] == 1)) + 1 if len(common) > 2 else []
    if not len(same):
        return None
    k = same[len(same) // 2]
    return int(i[k]), int(j[k])


def count(sp, text: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    if len(text) <= huge:
        return len(sp.encode(text))
    whole, text = text, text.replace("▁", " ")  # the library writes blanks as this mark
    total, start, end, at = 0, 0, chunk, 0
    ends, tokens = offsets(sp, text[:end], 0)
    before = 0  # tokens of the left chunk that are counted already
    while end < len(text):
        wide = overlap
        while True:
            if wide >= end - start:
                return len(sp.encode(whole))
            s, e = end - wide, min(len(text), end + chunk)
            first = at + len(text[start:s].encode())
            new_ends, new_tokens = offsets(sp, text[s:e], first)
            found = splice(ends, new_ends)
            if found and tokens[found[0]] >= before:
                break
            wide *= 4
        total += int(tokens[found[0]]) - before
        before = int(new_tokens[found[1]])
        ends, tokens, start, end, at = new_ends, new_tokens, s, e, first
    return total + int(tokens[-1]) - before


def token_counts(documents: DataFrame, model: str = MODEL, limit: int = LIMIT, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. One pass, no shuffle."""
    arrow_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for b in batches:
            got = []
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                texts = [t or "" for t in part.column("text").to_pylist()]
                short = [t for t in texts if len(t) <= huge]
                counted = iter([len(x) for x in sp.encode(short, num_threads=1)] if short else [])
                got += [next(counted) if len(t) <= huge else count(sp, t, huge, chunk, overlap) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(got, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = documents.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
