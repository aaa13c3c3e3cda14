"""Licence scans: sparse TF-IDF cosines to templates, then inheritance from the nearest directory that has a licence file.

A text's units are its lines, and the runs of neighbouring lines that all share much of their weight with the
templates' words, so that a header over several lines is one unit. Terms are lower-cased runs of letters and digits;
a term's weight is its count times log((1 + texts) / (1 + texts that hold it)) + 1, counted over the whole table; a
term that no template has weighs as if one text held it. A unit takes the template with the greatest cosine, at ALIKE
or more (ties: the earlier template), a text its best unit.

Full licence texts are templates too, with the words of all of them as terms. The whole text is compared with them, and
if it is not like one, stretches of it: for each full text that the words left could be like, the stretch of pieces (PIECE
words of a line at most) where the weight of its words most exceeds that of others. What a stretch is like grows
greedily: the template whose sum with those taken has the greatest cosine, as long as that takes a third or more off what
is missing to 1, so a file with two licences has both. FULL_ALIKE or more of the final cosine is a match; equal cosines
go by the share of the template's runs of SHINGLE words that the stretch holds, then to the earlier template. The stretch
of the greatest cosine is taken, then the rest is searched again. A full licence text goes before units, and units inside
it count for nothing of their own. A text is a licence file if its matching units and full licence texts hold half of its
words or more, otherwise what it has is a header. `own_licenses` lists all licences that a text matches, the best first.

A path inherits, if it has no licence of its own, from the nearest directory above it, its own first, that holds a
licence file; of several the most alike decides, then the smaller path. Only distinct directories are paired with
their ancestors, and one row for each licensed directory answers them.

Defined cases: null and empty texts have no licence of their own; very long texts are read whole, in Arrow batches bounded
by bytes; a null path is the root's child with an empty name; paths may repeat, each row is answered; licence files of one
directory that are equally alike go by path, then by licence; an empty table gives no rows; other columns are carried
along, but those named like the result's (own_license, own_licenses, similarity, license_file, license, inherited_from,
directory) give way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from importlib.resources import files as resources
from itertools import accumulate
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from korvane.llm.common import arrow_batches, materialize, sent, table

ALIKE = 0.6
RUN = 0.3
FULL_ALIKE = 0.85
PIECE = 16
SHINGLE = 5
WORD = re.compile(r"[^\W_]+")

# Short public licence statements, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("proprietary", "All rights reserved."),
]


#: Licences with a full text in license_texts, by SPDX identifier.
FULL = ["AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0"]


def full_texts() -> list[tuple[str, str]]:
    """The full texts of FULL."""
    return [(k, (resources("korvane.llm") / "license_texts" / f"{k}.txt").read_text("utf-8")) for k in FULL]


def shingles(ws: list[str]) -> list[str]:
    return [" ".join(x) for x in zip(*(ws[i:] for i in range(SHINGLE)), strict=False)]


def terms(text: str) -> list[str]:
    return WORD.findall(text.lower())


class FullTexts:
    """Full licence texts with weights from the whole table's counts."""

    def __init__(self, full: list[tuple[str, str]], weight: Callable[[str], float], other: float):
        self.ids = [k for k, _ in full]
        self.words = [terms(t) for _, t in full]
        self.counts = [Counter(ws) for ws in self.words]
        self.square = {w: weight(w) ** 2 for c in self.counts for w in c}
        self.other = other**2
        self.norms = [self.dot(c, c) for c in self.counts]
        # a stretch at FULL_ALIKE has this share of the squared weight, so this many distinct words at least
        self.least = []
        for c, all_ in zip(self.counts, self.norms, strict=True):
            heaviest, got, n = sorted((k * k * self.square[w] for w, k in c.items()), reverse=True), 0.0, 0
            while got < FULL_ALIKE**2 * all_ * (1 - 1e-9):
                got, n = got + heaviest[n], n + 1
            self.least.append(n)

    def dot(self, a: Counter, b: Counter) -> float:
        return sum(n * b[w] * self.square.get(w, self.other) for w, n in a.items() if w in b)

    def possible(self, bag: set[str]) -> list[int]:
        """Full texts with enough of their squared weight on words of the bag."""
        some = [i for i, c in enumerate(self.counts) if len(bag) >= self.least[i] and len(bag.intersection(c)) >= self.least[i]]
        return [i for i in some if sum(n * n * self.square[w] for w, n in self.counts[i].items() if w in bag) >= FULL_ALIKE**2 * self.norms[i] * (1 - 1e-9)]

    def like(self, ws: list[str]) -> tuple[float, list[int]]:
        """Cosine and the full texts whose sum ws is like; (0, []) below FULL_ALIKE."""
        bag = Counter(ws)
        square = self.dot(bag, bag)
        known = sum(n * n * self.square[w] for w, n in bag.items() if w in self.square)
        may = self.possible(set(bag)) if known >= FULL_ALIKE**2 * square * (1 - 1e-9) else []
        with_ = {i: self.dot(self.counts[i], bag) for i in may}
        taken: list[int] = []
        cosine, dots, norm, runs = 0.0, 0.0, 0.0, None
        while len(taken) < len(may):
            best = None
            for i in (i for i in may if i not in taken):
                grown = norm + self.norms[i] + 2 * sum(self.dot(self.counts[i], self.counts[j]) for j in taken)
                c = (dots + with_[i]) / sqrt(grown * square)
                if best is None or c > best[0] + 1e-9:
                    best = (c, i, grown)
                elif c > best[0] - 1e-9:
                    runs = runs or set(shingles(ws))
                    share = lambda k: len(runs & (own := set(shingles(self.words[k])))) / len(own)  # noqa: E731, B023
                    if share(i) > share(best[1]):
                        best = (c, i, grown)
            if 1 - best[0] > 2 / 3 * (1 - cosine) - 1e-12:
                break
            cosine, norm, dots = best[0], best[2], dots + with_[best[1]]
            taken.append(best[1])
        return (cosine, taken) if cosine >= FULL_ALIKE - 1e-12 else (0.0, [])

    def stretch(self, pieces: list[list[str]], i: int) -> tuple[int, int]:
        """Pieces [a, z) where the squared weight of the words of full text i most exceeds that of other words."""
        own, best, at, sum_, from_ = self.counts[i], 0.0, (0, 0), 0.0, 0
        for k, ws in enumerate(pieces):
            if sum_ <= 0:
                sum_, from_ = 0.0, k
            for w in ws:
                sum_ += self.square[w] if w in own else -self.square.get(w, self.other)
            if sum_ > best:
                best, at = sum_, (from_, k + 1)
        return at

    def find(self, lines: list[list[str]], mark: bytearray) -> list[tuple[float, str]]:
        """Cosine and id of the full texts found; mark gets the words that they cover."""
        words = [w for ws in lines for w in ws]
        if not self.possible(set(words)):
            return []
        cosine, taken = self.like(words)
        if taken:
            mark[:] = b"\1" * len(mark)
            return [(cosine, self.ids[i]) for i in taken]
        pieces = [ws[i : i + PIECE] for ws in lines for i in range(0, len(ws), PIECE)]
        starts = [0, *accumulate(map(len, pieces))]
        out, rest = [], [(0, len(pieces))]
        while rest:
            a, z = rest.pop()
            part = pieces[a:z]
            found = (0.0, [], 0, 0)
            for i in self.possible({w for ws in part for w in ws}):
                x, y = self.stretch(part, i)
                got = self.like([w for ws in part[x:y] for w in ws])
                if got[0] > found[0] + 1e-9:
                    found = (*got, a + x, a + y)
            cosine, taken, x, y = found
            if taken:
                out += [(cosine, self.ids[i]) for i in taken]
                mark[starts[x] : starts[y]] = b"\1" * (starts[y] - starts[x])
                rest += [(a, x), (y, z)]
        return sorted(out, key=lambda g: -g[0])


class Scanner:
    """Templates with weights from the whole table's counts."""

    def __init__(self, templates: list[tuple[str, str]], held: dict[str, int], texts: int, full: list[tuple[str, str]]):
        self.ids = [k for k, _ in templates]
        counts = [Counter(terms(t)) for _, t in templates]
        weight = lambda n: log((1 + texts) / (1 + n)) + 1
        self.full = FullTexts(full, lambda w: weight(held.get(w, 0)), weight(1))
        self.weight = {w: weight(held.get(w, 0)) for c in counts for w in c}
        self.other = weight(1)
        self.vectors = [{w: n * self.weight[w] for w, n in c.items()} for c in counts]
        self.norms = [sqrt(sum(x * x for x in v.values())) for v in self.vectors]
        self.by_term: dict[str, list[int]] = {}
        for i, v in enumerate(self.vectors):
            for w in v:
                self.by_term.setdefault(w, []).append(i)

    def squares(self, counts: Counter) -> tuple[float, float]:
        """Squared weight of the terms that templates have, and of all."""
        known = sum((n * self.weight[w]) ** 2 for w, n in counts.items() if w in self.weight)
        return known, known + self.other**2 * sum(n * n for w, n in counts.items() if w not in self.weight)

    def unit(self, counts: Counter, most: float) -> tuple[float, int]:
        best = (0.0, -1)
        for i in sorted({i for w in counts for i in self.by_term.get(w, ())}):
            v = self.vectors[i]
            c = sum(n * self.weight[w] * v[w] for w, n in counts.items() if w in v) / (self.norms[i] * sqrt(most))
            if c > best[0] + 1e-12:
                best = (c, i)
        return best

    def text(self, text: str | None) -> tuple[str | None, float, bool, list[str]]:
        lines = [WORD.findall(line) for line in (text or "").lower().split("\n")]
        words = [w for ws in lines for w in ws]
        inside = bytearray(len(words))
        full = self.full.find(lines, inside)
        covered = bytearray(inside)
        best, all_, run = (0.0, -1), [], []
        known_term = self.weight.__contains__

        def close() -> None:
            nonlocal best
            units = [*run, (sum((u for u, _, _ in run), Counter()), run[0][1], run[-1][2])] if len(run) > 1 else run
            found = []
            for u, a, z in units:
                known, most = self.squares(u)
                if known >= ALIKE**2 * most:  # no cosine exceeds this share's root
                    got = self.unit(u, most)
                    if got[0] >= ALIKE - 1e-12:
                        if 2 * sum(inside[a:z]) <= z - a:
                            found.append((got, (a, z) == (run[0][1], run[-1][2])))
                        covered[a:z] = b"\1" * (z - a)
            for got, _ in found:
                if got[0] > best[0] + 1e-12:
                    best = got
            if found:
                top, whole = max(found, key=lambda f: (f[0][0], f[1]))
                all_.extend([top] if whole else [got for got, _ in found])
            run.clear()

        at = 0
        for ws in lines:
            n = sum(map(known_term, ws))
            if n and (known := self.squares(c := Counter(ws)))[0] >= RUN * known[1]:
                run.append((c, at, at + len(ws)))
            elif ws and run:
                close()
            at += len(ws)
        if run:
            close()
        named = [self.ids[i] for _, i in sorted(all_, key=lambda g: -g[0])]
        if full:  # what holds a licence does not reserve all rights
            listed = list(dict.fromkeys([k for _, k in full] + [k for k in named if k != "proprietary"]))
            return full[0][1], full[0][0], 2 * sum(covered) >= len(words), listed
        if best[1] < 0:
            return None, 0.0, False, []
        return self.ids[best[1]], best[0], 2 * sum(covered) >= len(words), list(dict.fromkeys([self.ids[best[1]], *named]))


def own_licenses(files: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """All columns of files but text, and own_license, own_licenses, similarity, license_file. Two passes over the texts, no shuffle of them."""
    spark = files.sparkSession
    arrow_batches(spark)
    full = full_texts()
    vocabulary = {w for _, t in [*templates, *full] for w in terms(t)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        n = 0
        for b in batches:
            for t in b.column("text").to_pylist():
                n += 1
                held.update(vocabulary.intersection(terms(t or "")))
        yield pa.RecordBatch.from_arrays([pa.array([*held, ""]), pa.array([*held.values(), n], pa.int64())], ["term", "n"])

    rows = files.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term of the templates
    held = {r["term"]: r["n"] for r in rows}
    texts = held.pop("", 0)
    at = [c for c in files.columns if c not in ("text", "own_license", "own_licenses", "similarity", "license_file", "license", "inherited_from", "directory")]
    held_and_full = spark.sparkContext.broadcast((held, full))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, full = held_and_full.value
        s = Scanner(templates, held, texts, full)
        for b in batches:
            got = [s.text(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in at), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] if g[0] else None for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_()), pa.array([g[3] for g in got], pa.list_(pa.string()))], [*at, "own_license", "similarity", "license_file", "own_licenses"])

    kind = StructType([*files.select(*at).schema.fields])
    for f in _parse_datatype_string("own_license string, similarity double, license_file boolean, own_licenses array<string>").fields:
        kind.add(f)
    return files.select(*at, "text").mapInArrow(scan, kind)


def licenses(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """files (path, text, ...) without text, with own_license, own_licenses, similarity, license_file, license and inherited_from (a directory)."""
    clean = F.regexp_replace(F.coalesce("path", F.lit("")), "/+", "/")
    own = own_licenses(files, templates).withColumn("directory", F.regexp_replace(F.regexp_replace(clean, "[^/]*$", ""), "/$", ""))
    own = materialize(own, "licenses")
    order = F.struct((-F.col("similarity")).alias("s"), "path", "own_license")
    licensed = own.where("license_file").groupBy("directory").agg(F.min_by("own_license", order).alias("from_license"))
    steps = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    asked = own.where("own_license IS NULL").select("directory").distinct()
    pairs = asked.select(F.col("directory").alias("below"), F.explode(F.array_distinct(above)).alias("directory"))
    nearest = pairs.join(licensed, "directory").groupBy("below").agg(F.max_by(F.struct("directory", "from_license"), F.length("directory")).alias("near"))
    nearest = materialize(nearest.withColumnRenamed("below", "directory"), "nearest")
    out = own.join(sent(nearest), "directory", "left")
    return out.withColumn("license", F.coalesce("own_license", "near.from_license")).withColumn("inherited_from", F.when(F.col("own_license").isNull(), F.col("near.directory"))).drop("near", "directory")


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """Documents lie at source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    files = docs.select("doc_id", F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"), "text")
    return licenses(files).select("doc_id", "path", "own_license", "own_licenses", "similarity", "license_file", "license", "inherited_from")
