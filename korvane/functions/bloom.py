"""A blocked Bloom filter as a table: a block is a row of eight 64-bit words, of which a key sets one bit each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
NAMES = [f"w{i}" for i in range(WORDS)]


def place(key: Column, blocks: int) -> Column:
    """A key's block, by a hash of its own: rows may be dealt out by xxhash64(key) itself."""
    return F.pmod(F.xxhash64(key, F.lit(2)), F.lit(blocks))


def bit(key: Column, word: int) -> Column:
    """The word's one bit of a key: six bits of a second hash."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 6 * word).bitwiseAND(63).cast("int"))


def filters(keys: DataFrame, by: str, key: str, blocks: int) -> DataFrame:
    """by, block and words: a filter of `blocks` blocks for each value of `by`, formed before the shuffle."""
    words = keys.select(by, place(F.col(key), blocks).alias("block"), *(bit(F.col(key), i).alias(c) for i, c in enumerate(NAMES)))
    return words.groupBy(by, "block").agg(*(F.bit_or(c).alias(c) for c in NAMES))


def maybe(key: Column) -> Column:
    """Whether the words that a row has been joined with may hold its key; false where there are none."""
    out = F.lit(True)
    for i, c in enumerate(NAMES):
        out = out & (F.col(c).bitwiseAND(bit(key, i)) != 0)
    return F.coalesce(out, F.lit(False))
