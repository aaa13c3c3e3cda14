"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

  seeds     Texts are lower-cased runs of letters and digits. A seed is an ordered pair of an item's words with at most
            one word between them (a 2-gram, or one with a gap); documents are searched for such pairs with at most one
            word between them too, so that a word changed, left out or put in does not break the next seed.
  bound     An alignment of M words with E errors has at least (M - 1) - E / 2 neighbouring matched words with at most one
            error between them, and each such pair is a seed. One that reaches `found` of an item of m words has
            2 M - E >= 2 found m, hence at least `found` m - 1 places of the item at which a seed starts. So
            no such alignment is lost: an item is looked at if that many of its places have a seed in the document.
            The exception is an item so short that one word alone reaches `found` (two words, at FOUND): there a lone word
            says nothing, so one seed, both words in order, is asked for.
  rare      If that many places must be met, one of the others' number plus one must be met among any so many places.
            Those with the seeds that are rarest among the items are taken: only they join a document to an item.
  passages  A document's hits on an item, by diagonal (place in the document less place in the item), gather into
            passages: runs of hits that lie within reach of each other, with as much text around them as an alignment
            that is found can reach. A passage that has too few of the item's words, repeats counted, to reach `found`
            whatever their order is not aligned.
  score     Passage and item are aligned by Smith-Waterman over words (MATCH, MISMATCH, GAP); the score over that of
            the whole item matched is `similarity`, from 0 to 1. FOUND and more is a leak.

The items are a benchmark: their seeds are sent to all tasks if there are about SENT of them at most, a checked size;
otherwise items are dealt in batches of that many words and the documents are read once for each batch.

Defined cases: null or empty texts and items, and those without words, match nothing; an item of one word is found
wherever that word is, one of two words where both are in order with at most one between them; very long texts are
searched whole; words that repeat meet each other everywhere, but only distinct diagonals count; rows with a null item_id
or doc_id take no part; rows that repeat an item_id count as items of their own, the best counts; rows that repeat a
doc_id are searched each, the best counts; of passages that align equally well the first counts; empty tables give no
rows; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvane.llm.common import arrow_batches, release, slices, table

GAPS = (1, 2)
MATCH, MISMATCH, GAP = 2, -1, -1
FOUND = 0.5
SENT = 1_000_000
PAIRS = 1 << 14
#: Words of a text that are aligned at a time, besides those that reach over.
WIDE = 1 << 18
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two lists of word numbers: its score, and the part of b it ends with: first and last place + 1.

    Row by row; a gap within a row is a running maximum. Starts travel with the scores."""
    n = len(b)
    steps = np.arange(n + 1)
    score, start = np.zeros(n + 1, np.int64), steps.copy()
    best = (0, 0, 0)
    for x in a:
        diagonal = score[:-1] + np.where(b == x, MATCH, MISMATCH)
        above = score[1:] + GAP
        new, at = np.zeros(n + 1, np.int64), steps.copy()
        new[1:] = np.maximum(np.maximum(diagonal, above), 0)
        at[1:] = np.where(new[1:] == 0, steps[1:], np.where(diagonal >= above, start[:-1], start[1:]))
        lifted = new - GAP * steps
        run = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == run, steps, 0))
        across = run + GAP * steps
        better = across > new
        new, at = np.where(better, across, new), np.where(better, at[source], at)
        k = int(new.argmax())
        if new[k] > best[0]:
            best = (int(new[k]), int(at[k]), k)
        score, start = new, at
    return best


class Items:
    """Seeds of a list of items, and where they are."""

    def __init__(self, items: list[tuple[int, str]], found: float):
        lists = [words(t) for _, t in items]
        self.ids, self.found = [i for i, _ in items], found
        self.vocabulary: dict[str, int] = {}
        self.coded = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws], np.int64) for ws in lists]
        self.bags = [Counter(c.tolist()) for c in self.coded]
        self.single = {int(c[0]): [] for c in self.coded if len(c) == 1}
        n = self.n = len(self.vocabulary)
        codes, at, item = [], [], []
        for k, c in enumerate(self.coded):
            if len(c) == 1:
                self.single[int(c[0])].append(k)
            for g in GAPS:
                codes.append(c[:-g] * n + c[g:])
                at.append(np.arange(max(0, len(c) - g)))
                item.append(np.full(max(0, len(c) - g), k))
        codes, at, item = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, at, item))
        self.codes, seed = np.unique(codes, return_inverse=True)
        held = np.bincount(seed, minlength=len(self.codes))
        order = np.lexsort((at, item))
        self.at, self.seed, item = at[order], seed[order], item[order]
        self.edges = np.searchsorted(item, np.arange(len(self.coded) + 1))
        self.need, join = np.ones(len(self.coded), np.int64), []
        for k, c in enumerate(self.coded):
            m, own = len(c), slice(self.edges[k], self.edges[k + 1])
            need = max(1, ceil(found * m - 1 - 1e-9))
            self.need[k] = need
            common = np.zeros(max(0, m - 1), np.int64)
            np.maximum.at(common, self.at[own], held[self.seed[own]])
            rare = np.argsort(common, kind="stable")[: max(0, m - 1 - need + 1)]
            join.append(np.isin(self.at[own], rare))
        rare = np.flatnonzero(np.concatenate(join)) if join else np.zeros(0, np.int64)
        order = rare[np.argsort(self.seed[rare], kind="stable")]
        self.joined = item[order]
        self.join = np.searchsorted(self.seed[order], np.arange(len(self.codes) + 1))

    def met(self, doc: np.ndarray, item: np.ndarray, has: np.ndarray) -> np.ndarray:
        """Of pairs of a document and an item, which have hits at as many of the item's places as they need. has: sorted numbers of document and seed."""
        ok = np.zeros(len(doc), bool)
        for i in range(0, len(doc), PAIRS):
            d, k = doc[i : i + PAIRS], item[i : i + PAIRS]
            n = self.edges[k + 1] - self.edges[k]
            pair = np.repeat(np.arange(len(d)), n)
            own = np.repeat(self.edges[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            key = d[pair] * len(self.codes) + self.seed[own]
            hit = has[np.minimum(np.searchsorted(has, key), len(has) - 1)] == key if len(has) else np.zeros(len(key), bool)
            pair, at = pair[hit], self.at[own[hit]]  # by pair and place
            new = np.r_[np.ones(min(1, len(at)), bool), (pair[1:] != pair[:-1]) | (at[1:] != at[:-1])]
            ok[i : i + PAIRS] = np.bincount(pair[new], minlength=len(d)) >= self.need[k]
        return ok


def leaks(documents: DataFrame, items: DataFrame, found: float = FOUND) -> DataFrame:
    """doc_id, item_id, similarity, n_hits, first_word, last_word: the best passage of each document and item at `found` or above."""
    spark = documents.sparkSession
    arrow_batches(spark)
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    listed = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = listed.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    batches = total // (SENT * 2) + 1  # a word takes two characters at the least
    out = None
    for k in range(batches):
        got = listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) == k).collect()  # about SENT words
        part = _leaks(spark, docs, sorted((r["item_id"], r["text"]) for r in got), found)
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("similarity", "n_hits", (-F.col("first_word")).alias("f"), "last_word")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.similarity", "b.n_hits", (-F.col("b.f")).alias("first_word"), "b.last_word")


def passages(it: Items, k: int, numbers: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[int, int, int, int] | None:
    """The best alignment of item k with a document's words: its score, its first and last word, and the item's places with a hit."""
    item, bag, m = it.coded[k], it.bags[k], len(it.coded[k])
    if m == 1:
        diagonals, n_hits = np.flatnonzero(numbers == item[0]), 1
    else:
        own, at = it.seed[it.edges[k] : it.edges[k + 1]], it.at[it.edges[k] : it.edges[k + 1]]
        met = np.isin(own, seed)
        n_hits = len(np.unique(at[met]))
        there = np.zeros(len(numbers) + m, bool)  # by diagonal + m: words that repeat meet each other without a list of pairs
        for x in np.unique(own[met]):
            here = place[seed == x] + m
            for j in at[own == x].tolist():
                there[here - j] = True
        diagonals = np.flatnonzero(there) - m
    reach = int(2 * (1 - it.found) * m) + 1  # errors that leave `found` of the score
    edges = np.flatnonzero(np.r_[True, np.diff(diagonals) > max(m, reach)])
    best = (0, 0, 0)
    for a, z in zip(diagonals[edges].tolist(), diagonals[np.r_[edges[1:], len(diagonals)] - 1].tolist(), strict=True):
        low, high = max(0, a - reach), min(len(numbers), z + m + reach)
        has = Counter(numbers[low:high].tolist())
        if sum(min(n, has[w]) for w, n in bag.items()) < it.found * m:
            continue
        for start in range(low, high, WIDE):  # what is found spans m + reach words at most
            s, first, last = align(item, numbers[start : min(high, start + WIDE + m + reach)])
            if s > best[0]:
                best = (s, start + first, start + last)
    return (*best, n_hits) if best[0] >= it.found * MATCH * m else None


def _leaks(spark, docs: DataFrame, items: list[tuple[int, str]], found: float) -> DataFrame:
    sent = spark.sparkContext.broadcast(Items(items, found))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = sent.value
        known = it.vocabulary.get
        for batch in batches:
            for b in slices(batch, 1 << 20):
                lists = [[known(w, -1) for w in words(t)] for t in b.column(1).to_pylist()]
                sizes = np.array([len(x) for x in lists], np.int64)
                numbers = np.array([x for ws in lists for x in ws], np.int64)
                doc, first = np.repeat(np.arange(len(lists)), sizes), np.cumsum(sizes) - sizes
                seeds, places = [], []
                for g in GAPS:
                    x, y = numbers[:-g], numbers[g:]
                    at = np.flatnonzero((x >= 0) & (y >= 0) & (doc[:-g] == doc[g:]))
                    code = x[at] * it.n + y[at]
                    i = np.minimum(np.searchsorted(it.codes, code), max(0, len(it.codes) - 1))
                    hit = it.codes[i] == code if len(it.codes) else np.zeros(len(code), bool)
                    seeds.append(i[hit])
                    places.append(at[hit])
                seed, place = np.concatenate(seeds), np.concatenate(places)
                n = it.join[seed + 1] - it.join[seed]
                to = np.repeat(it.join[seed] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                joined = np.unique(np.repeat(doc[place], n) * len(it.ids) + it.joined[to])
                joined = joined[it.met(joined // max(1, len(it.ids)), joined % max(1, len(it.ids)), np.unique(doc[place] * len(it.codes) + seed))]
                alone = [(doc[p], k) for p in np.flatnonzero(np.isin(numbers, list(it.single))) for k in it.single[int(numbers[p])]] if it.single else []
                pairs = np.unique(np.concatenate([joined, np.array([d * len(it.ids) + k for d, k in alone], np.int64)]))
                order = np.argsort(doc[place], kind="stable")
                seed, place = seed[order], place[order]
                cut = np.searchsorted(doc[place], np.arange(len(lists) + 1))
                out = []
                ids = b.column(0).to_pylist()
                for d, k in zip((pairs // max(1, len(it.ids))).tolist(), (pairs % max(1, len(it.ids))).tolist(), strict=True):
                    own = slice(cut[d], cut[d + 1])
                    got = passages(it, k, numbers[first[d] : first[d] + sizes[d]], seed[own], place[own] - first[d])
                    if got:
                        out.append((ids[d], it.ids[k], got[0] / (MATCH * len(it.coded[k])), got[3], got[1], got[2] - 1))
                cols = list(zip(*out, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "similarity", "n_hits", "first_word", "last_word"])
        release()

    return docs.mapInArrow(judge, "doc_id long, item_id long, similarity double, n_hits long, first_word long, last_word long")


def op7_leaks(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
