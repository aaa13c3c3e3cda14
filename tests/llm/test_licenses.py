"""Licence scans."""

from __future__ import annotations

import random
from collections import Counter
from math import log, sqrt

from korvane.llm.common import table
from korvane.llm.licenses import ALIKE, FULL_ALIKE, TEMPLATES, full_texts, licenses, op10_licenses, terms

APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
MIT = "Released under the MIT License."
CODE = "\n".join(f"value{i} = compute{i}(argument{i}, other{i})" for i in range(60))
SCHEMA = "path string, text string, license int, directory string, similarity string"


def of(spark, rows):
    df = spark.createDataFrame([(p, t, 1, "d", "s") for p, t in rows], SCHEMA)
    return {r["path"]: r for r in licenses(df).collect()}


def test_headers_files_and_inheritance(spark):
    rows = [("LICENSE", MIT), ("a/LICENSE", APACHE), ("a/b/c/x.py", CODE), ("a/y.py", CODE), ("a/b/own.py", f"# {MIT}\n{CODE}"), ("z/deep/er/w.py", CODE), ("top.py", CODE), ("ab/q.py", CODE), (None, CODE), ("a//b/empty.py", ""), ("a/null.py", None)]
    got = of(spark, rows)
    assert got["a/LICENSE"]["license_file"] and got["a/LICENSE"]["own_license"] == "Apache-2.0"
    assert got["a/b/c/x.py"]["license"] == "Apache-2.0" and got["a/b/c/x.py"]["inherited_from"] == "a"
    assert got["a/y.py"]["license"] == got["a//b/empty.py"]["license"] == got["a/null.py"]["license"] == "Apache-2.0"
    assert got["a/b/own.py"]["own_license"] == got["a/b/own.py"]["license"] == "MIT" and not got["a/b/own.py"]["license_file"]
    for p in ("z/deep/er/w.py", "top.py", "ab/q.py", None):
        assert got[p]["license"] == "MIT" and got[p]["inherited_from"] == "" and got[p]["own_license"] is None
    assert len(got) == len(rows)


def test_without_licences_and_without_rows(spark):
    got = of(spark, [("a/x.py", CODE), ("a/y.py", "All the rights of this road are reserved for bicycles, and so on and on it goes")])
    assert all(r["license"] is None for r in got.values())
    assert licenses(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_document_is_answered(spark, sf):
    rows = op10_licenses(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    for r in rows:
        for name, line in (("MIT", "Released under the MIT License."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.")):
            if r["own_license"] is None:
                assert line not in (texts[r["doc_id"]] or ""), name


def test_full_texts_are_licence_files_and_inherited(spark):
    full = dict(full_texts())
    named = {k: f"Copyright (c) 2020 Some One. All rights reserved.\n\n{t}" for k, t in full.items()}
    flowed = {k: "# " + " ".join(t.split()) for k, t in full.items()}
    rows = [(f"{d}/{k}/LICENSE", t) for d, texts in (("named", named), ("flowed", flowed)) for k, t in texts.items()]
    rows += [(f"named/{k}/src/x.py", CODE) for k in full] + [("both/LICENSE", f"{full['MIT']}\n\n{full['Apache-2.0']}"), ("h/x.py", "\n".join([full["MIT"], *[CODE] * 5]))]
    rows += [("edited/LICENSE", full["BSD-3-Clause"].replace("University", "Example Company, Inc.").replace("REGENTS", "COPYRIGHT HOLDERS"))]
    got = of(spark, rows)
    for k in full:
        for d in ("named", "flowed"):
            r = got[f"{d}/{k}/LICENSE"]
            assert (r["own_license"], r["license_file"], r["own_licenses"]) == (k, True, [k])
        below = got[f"named/{k}/src/x.py"]
        assert (below["own_license"], below["license"], below["inherited_from"]) == (None, k, f"named/{k}")
    assert got["both/LICENSE"]["license_file"] and set(got["both/LICENSE"]["own_licenses"]) == {"MIT", "Apache-2.0"}
    assert got["h/x.py"]["own_license"] == "MIT" and not got["h/x.py"]["license_file"]
    assert got["edited/LICENSE"]["own_license"] == "BSD-3-Clause" and got["edited/LICENSE"]["license_file"]


def test_units_equal_a_plain_cosine(spark):
    """Single lines against every template by dense vectors over all terms."""
    rng = random.Random(5)
    lines = []
    for _ in range(150):
        words = rng.choice(TEMPLATES)[1].split()
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(["word", "license", "other", "the", "2", "software"])
        lines.append(" ".join(words))
    held, n = Counter(w for t in lines for w in set(terms(t))), len(lines)
    known = {w for _, t in TEMPLATES for w in terms(t)}
    weight = lambda w: log((1 + n) / (1 + (held[w] if w in known else 1))) + 1
    vector = lambda t: {w: c * weight(w) for w, c in Counter(terms(t)).items()}
    norm = lambda v: sqrt(sum(x * x for x in v.values()))
    got = of(spark, [(f"p{i}", t) for i, t in enumerate(lines)])
    for i, t in enumerate(lines):
        a, best = vector(t), (0.0, None)
        for k, x in TEMPLATES:
            b = vector(x)
            c = sum(v * b.get(w, 0) for w, v in a.items()) / (norm(a) * norm(b))
            if c > best[0] + 1e-12:
                best = (c, k)
        r = got[f"p{i}"]
        if best[0] >= ALIKE:
            assert r["own_license"] == best[1] and abs(r["similarity"] - best[0]) < 1e-9
        else:
            assert r["own_license"] is None


def test_files_equal_a_plain_cosine(spark):
    """Edited full texts, as whole files, against every full text by dense vectors over all terms."""
    rng = random.Random(7)
    full = full_texts()
    known = {w for _, t in [*TEMPLATES, *full] for w in terms(t)}
    rows = {}
    for i in range(66):
        words = full[i % len(full)][1].split(" ")
        for _ in range(int(len(words) * rng.choice([0, 0.02, 0.1, 0.3]))):
            words[rng.randrange(len(words))] = rng.choice(["license", "", "the", *(f"river{rng.randrange(500)}" for _ in range(9))])
        rows[f"d{i}/LICENSE"] = " ".join(words)
    rows |= {f"plain/{i}": CODE + f"\nriver{i} evening stone" for i in range(60)}
    held, n = Counter(w for t in rows.values() for w in set(terms(t))), len(rows)
    weight = lambda w: log((1 + n) / (1 + (held[w] if w in known else 1))) + 1
    in_full = {w for _, t in full for w in terms(t)}
    vector = lambda t: {w: c * (weight(w) if w in in_full else log((1 + n) / 2) + 1) for w, c in Counter(terms(t)).items()}
    dot = lambda a, b: sum(v * b.get(w, 0) for w, v in a.items())
    vectors = [(k, vector(t)) for k, t in full]
    got, matched = of(spark, list(rows.items())), 0
    for path, t in rows.items():
        a = vector(t)
        c, k = max((dot(a, b) / sqrt(dot(a, a) * dot(b, b)), k) for k, b in vectors)
        if c >= FULL_ALIKE:
            matched += 1
            assert (got[path]["own_license"], got[path]["license_file"]) == (k, True) and abs(got[path]["similarity"] - c) < 1e-9
        elif path.startswith("plain"):
            assert got[path]["own_license"] is None
    assert matched > 40


def test_full_texts_in_longer_files(spark):
    full = dict(full_texts())
    prose = "\n".join(f"the road {i} goes on past the houses and the river to the sea, and nobody there asks who may use it" for i in range(40))
    rows = [("readme", f"{prose}\n{full['MIT']}\n{prose}"), ("two", f"{prose}\n{full['BSD-3-Clause']}\n{prose}\n{full['MIT']}"), ("equal", f"{full['MIT']}\n{full['BSD-2-Clause']}"), ("gnu", f"{full['GPL-3.0']}\n{full['LGPL-3.0']}")]
    got = of(spark, rows + [(f"p{i}", f"{prose}\nroad{i}") for i in range(40)])
    assert (got["readme"]["own_license"], got["readme"]["own_licenses"], got["readme"]["license_file"]) == ("MIT", ["MIT"], False)
    assert set(got["two"]["own_licenses"]) == {"MIT", "BSD-3-Clause"}
    assert set(got["equal"]["own_licenses"]) == {"MIT", "BSD-2-Clause"} and got["equal"]["license_file"]
    assert set(got["gnu"]["own_licenses"]) == {"GPL-3.0", "LGPL-3.0"} and got["gnu"]["license_file"]


def test_inheritance_equals_a_walk_up(spark):
    rng = random.Random(6)
    rows = {}
    for i in range(300):
        folder = "/".join(rng.choice("abc") for _ in range(rng.randint(0, 5)))
        rows[f"{folder}/f{i}".lstrip("/")] = rng.choice([CODE, CODE, CODE, MIT, APACHE, "Licensed under CC BY 4.0.", f"{MIT}\n{CODE}"])
    got = of(spark, list(rows.items()))
    files = {}
    for p, r in sorted(got.items()):
        if r["license_file"]:
            d = p.rpartition("/")[0]
            files[d] = min(files.get(d, (9, "", "")), (-r["similarity"], p, r["own_license"]))
    for p, r in got.items():
        want, d = (r["own_license"], None), p.rpartition("/")[0]
        while want[0] is None:
            if d in files:
                want = (files[d][2], d)
            if not d or want[0]:
                break
            d = d.rpartition("/")[0]
        assert (r["license"], r["inherited_from"]) == want


def test_very_long_texts_ties_and_repeats(spark):
    long = "\n".join([CODE] * 300) + f"\n{MIT}\n" + "x" * 500_000
    rows = [("a/LICENSE", MIT), ("a/COPYING", MIT), ("a/x", CODE), ("a/x", CODE), ("b/long", long)]
    df = spark.createDataFrame([(p, t, "s") for p, t in rows], "path string, text string, inherited_from string")
    got = licenses(df).collect()
    assert len(got) == 5 and [(r["license"], r["inherited_from"]) for r in got if r["path"] == "a/x"] == [("MIT", "a")] * 2
    assert [(r["license"], r["license_file"]) for r in got if r["path"] == "b/long"] == [("MIT", False)]


def test_short_notices(spark):
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    got = of(spark, [("isc", isc), ("un", "This is free and unencumbered software released into the public domain."), ("z", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors\nbe held liable for any damages arising from the use of this software."), ("b", "SPDX-License-Identifier: BSD-2-Clause")])
    assert {k: r["own_license"] for k, r in got.items()} == {"isc": "ISC", "un": "Unlicense", "z": "Zlib", "b": "BSD-2-Clause"}
