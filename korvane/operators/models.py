"""Model interfaces, and stand-ins that need no network: a hashing encoder, a rule-based parser and reranker, a replay."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from korvane.sources.catalog import CATEGORIES, COLORS
from korvane.sources.schemas import GENDERS, SEASONS, STYLES, Settings


#: What a language model is told first. The two tasks are told apart by these texts.
PARSE = f"""You turn a request to a clothing shop into JSON and answer with that JSON alone.

{{"filters": {{"category": text or null, "gender": text or null, "season": text or null, "style": text or null, "color": text or null, "price_min": number or null, "price_max": number or null, "in_stock_only": boolean}}, "semantic_query": text}}

category is one of {", ".join(CATEGORIES)}; gender one of {", ".join(GENDERS)}; season one of {", ".join(SEASONS)}; style one of {", ".join(STYLES)}.
What the request does not say is null. in_stock_only is true unless the request speaks of stock. semantic_query holds what is asked for, in the request's own Korean."""
RERANK = """You choose clothes for a customer. You get the request as user_query and products as candidates.
Choose the five that suit it best, the best first, and give one line of reason for each. Answer with JSON alone:

{"recommendations": [{"product_id": whole number, "reason": text}]}"""


class Encoder(Protocol):
    name: str
    dim: int

    def vectors(self, texts: list[str]) -> np.ndarray:
        """A row of length 1 for each text."""


class LanguageModel(Protocol):
    def chat(self, system: str, user: str, max_tokens: int) -> str:
        """One reply."""


#: Trigrams whose places an encoder remembers.
TRIGRAMS = 1 << 16


class HashingEncoder:
    """Character trigrams hashed to signed dimensions. It knows spelling, not meaning."""

    def __init__(self, dim: int = 1024, name: str = "hashing"):
        self.dim, self.name = dim, name
        self.places: dict[str, int] = {}

    def vectors(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, t in zip(out, texts, strict=True):
            t = f" {t.lower()} "
            if len(self.places) > TRIGRAMS:
                self.places.clear()
            h = np.fromiter((self._place(t[i : i + 3]) for i in range(len(t) - 2)), np.int64)
            row += np.bincount(h >> 1, np.where(h & 1, 1.0, -1.0), self.dim)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def _place(self, trigram: str) -> int:
        """Twice the dimension, and 1 for the sign +."""
        got = self.places.get(trigram)
        if got is None:
            h = zlib.crc32(trigram.encode("utf-8", "surrogatepass"))
            got = self.places[trigram] = (h >> 1) % self.dim * 2 + (h & 1)
        return got


def encoder_of(settings: Settings) -> HashingEncoder:
    """The encoder that the settings name. Only the stand-in is at hand without a network."""
    if not settings.embed_model.startswith("hashing"):
        raise ValueError(f"no encoder {settings.embed_model} here; pass one of your own")
    return HashingEncoder(settings.dim, settings.embed_model)


#: Characters, padding included, of a batch that an encoder gets. A text longer than that stands alone.
BUDGET = 8192


def packed(lengths: list[int], most: int, budget: int = BUDGET) -> list[list[int]]:
    """Places of texts, dealt into batches of like lengths: `most` texts at most, and within the budget when all are padded to the longest."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    out: list[list[int]] = []
    for i in order:  # the longest so far
        if not out or len(out[-1]) >= most or (len(out[-1]) + 1) * lengths[i] > budget:
            out.append([])
        out[-1].append(i)
    return out


def padding(lengths: list[int], batches: list[list[int]]) -> int:
    """Characters that padding to the longest of a batch adds."""
    return sum(len(b) * max(lengths[i] for i in b) - sum(lengths[i] for i in b) for b in batches)


def encode(df: DataFrame, encoder: Encoder, text: str = "text", vector: str = "vector", batch: int = 32, budget: int = BUDGET, count: Accumulator | None = None) -> DataFrame:
    """df with a vector for each text (null for null). The encoder is built once in each Python worker.

    Within an Arrow batch the encoder gets texts of like lengths together, so that short ones are not padded to long ones; vectors come back in the rows' order. `count` is told how many rows are done.
    Spark cannot know the size of what an encoder returns and takes a vector for four bytes, so it would send a large table of them to all tasks, through the driver: joins are told to merge."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            there = s.dropna()
            got: list = [None] * len(there)
            for places in packed([len(t) for t in there], batch, budget):
                for i, v in zip(places, encoder.vectors([there.iloc[i] for i in places]).astype("float32"), strict=True):
                    got[i] = v
            if count is not None:
                count.add(len(s))
            yield pd.Series(got, there.index, dtype=object).reindex(s.index).where(s.notna(), None)

    return df.withColumn(vector, run(text)).hint("merge")


def model_of(settings: Settings) -> RuleBased:
    """The language model that the settings name. Only the stand-in is at hand without a network."""
    if settings.language_model != "rules":
        raise ValueError(f"no language model {settings.language_model} here; pass one of your own")
    return RuleBased()


class Replay:
    """Canned replies, by the user's text."""

    def __init__(self, replies: dict[str, str]):
        self.replies = replies

    def chat(self, system: str, user: str, max_tokens: int) -> str:
        return self.replies[user]


# Words of a request that stand for a vocabulary's members.
SYNONYMS = {"남자": "남성", "남성용": "남성", "여자": "여성", "여성용": "여성", "검정": "블랙", "검은": "블랙", "흰색": "화이트", "하얀": "화이트", "회색": "그레이", "빨간": "레드", "파란": "블루"}
PRICE = re.compile(r"(\d+(?:\.\d+)?)\s*(만|천)?\s*원?\s*(이하|미만|이상|초과|까지|부터)")


class RuleBased:
    """Finds vocabulary words and price phrases in a request, and ranks candidates by the words they share with it.

    A stand-in: its expectations are its own, and it says nothing about a real model's relevance."""

    def chat(self, system: str, user: str, max_tokens: int) -> str:
        return self.rerank(user) if system == RERANK else self.parse(user)

    def parse(self, text: str) -> str:
        plain = text
        for word, means in SYNONYMS.items():
            plain = plain.replace(word, means)
        first = lambda words: next((w for w in sorted(words, key=len, reverse=True) if w in plain), None)
        category = first(CATEGORIES) or next((c for c, subs in CATEGORIES.items() if any(s in plain for s in subs)), None)
        got = {"category": category, "gender": first(GENDERS), "season": first(SEASONS), "style": first(STYLES), "color": first(COLORS), "price_min": None, "price_max": None, "in_stock_only": True}
        for number, unit, side in PRICE.findall(text):
            value = float(number) * {"만": 10_000, "천": 1_000, "": 1}[unit]
            got["price_max" if side in ("이하", "미만", "까지") else "price_min"] = value
        return json.dumps({"filters": got, "semantic_query": text.strip()}, ensure_ascii=False)

    def rerank(self, user: str) -> str:
        request = json.loads(user)
        words = set(request["user_query"].split())
        score = lambda c: -len(words & {str(v) for v in c.values()})
        best = sorted(request["candidates"], key=score)[:5]
        return json.dumps({"recommendations": [{"product_id": c["product_id"], "reason": str(c["name"])} for c in best]}, ensure_ascii=False)
