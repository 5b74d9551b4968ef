"""Scans against plain containment of word pairs."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from ebbline.llm import licenses


def plain(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def pairs(text):
    w = plain(text)
    return list(zip(w, w[1:]))


def brute(texts, part=80):
    """(n_found, first_word, past_word) by (doc, template), over all templates and whole texts."""
    out = {}
    every = licenses.TEMPLATES | licenses.whole_texts()
    own = {name: set(pairs(t)) for name, t in every.items()}
    for doc, text in texts.items():
        have = set(pairs(text))
        for name, template in every.items():
            if 100 * len(have & own[name]) >= part * len(own[name]):
                best = fullest(text, template)
                if 100 * best[0] >= part * len(own[name]):
                    out[(doc, name)] = best
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r.doc_id, r.template): r for r in licenses.scan(df).collect()}


def test_verbatim_and_edited_templates(spark):
    rng = random.Random(6)
    filler = "the of this work under license public version software and to in a b c d".split()
    some = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = []
    for name, template in licenses.TEMPLATES.items():
        rows.append((f"{some(rng.randrange(40))}\n{template.upper()}\n{some(20)}", name, 0))
        if len(plain(template)) > 20:
            for share in (0.04, 0.1):
                w = template.split()
                for i in rng.sample(range(len(w)), int(share * len(w))):
                    w[i] = rng.choice(["", "edited", f"{w[i]} more"])
                rows.append((f"{some(30)} {' '.join(w)} {some(rng.randrange(9))}", name, share))
    rows += [(some(200), None, 0), ("", None, 0), (None, None, 0), ("rights", None, 0)]
    texts = {i: r[0] for i, r in enumerate(rows)}
    got = found(spark, list(texts.items()))
    assert {k: (r.n_found, r.first_word, r.past_word) for k, r in got.items()} == brute(texts)
    assert all((i, name) in got for i, (_, name, share) in enumerate(rows) if name and not share)


def test_places_and_defined_results(spark):
    text = "a b Released under the MIT License. c\nAll rights reserved."
    df = spark.createDataFrame([(1, text, "k"), (1, text, "k"), (None, text, "k")], "doc_id long, text string, key string")
    rows = sorted((r.doc_id or 0, r.template, r.first_word, r.past_word, r.n_found, r.n_shingles) for r in licenses.scan(df).collect())
    three = [("all-rights-reserved", 8, 11, 2, 2), ("mit", 2, 7, 4, 4), ("mit-under", 3, 7, 3, 3)]
    assert rows == sorted([(0, *t) for t in three] + 2 * [(1, *t) for t in three])
    assert licenses.scan(df.limit(0)).count() == 0 and licenses.scan(df, texts={}).count() == 0


def test_rows_of_one_id_are_not_pooled(spark):
    """Halves of a notice in two rows give nothing, whether the id is missing or repeated."""
    w = licenses.TEMPLATES["mit-grant"].split()
    first, second = " ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])
    df = spark.createDataFrame([(None, first), (None, second), (7, first), (7, second)], "doc_id long, text string")
    assert licenses.scan(df).count() == 0
    whole = spark.createDataFrame([(7, " ".join(w)), (7, "nothing")], "doc_id long, text string")
    assert [(r.doc_id, r.template) for r in licenses.scan(whole).collect()] == [(7, "mit-grant")]


def test_what_no_key_retrieved_is_not_verified(spark, monkeypatch):
    texts = [(1, licenses.TEMPLATES["mit"]), (2, licenses.whole_texts()["isc-text"])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.template for r in licenses.scan(df).collect()} >= {"mit", "isc-text"}
    monkeypatch.setattr(licenses, "_within", lambda column, keys: F.array().cast("array<bigint>"))
    assert licenses.scan(df).count() == 0


def test_short_templates_always_have_a_key(spark):
    """Whatever a fifth of a short template's shingles are changed to, a key is left."""
    known = licenses._Known(spark, licenses.TEMPLATES, 80)
    sizes = {r.name: r.n_pairs for r in known.pairs.select("name", "n_pairs").distinct().collect()}
    keys = {}
    for r in known.keys.collect():
        keys.setdefault(r.name, []).append(r.short)
    for name, n in sizes.items():
        if len(plain(licenses.TEMPLATES[name])) <= licenses.SHORT:
            assert all(keys[name]) and len(keys[name]) > n - -(-80 * n // 100)
        else:
            assert not any(keys[name])


def test_bands_meet_as_often_as_they_should(spark):
    """Windows of half their shingles in common against 1 - (1 - s^ROWS)^BANDS."""
    rng = random.Random(2)
    n, met = 600, 0
    words = lambda k: " ".join(f"w{rng.randrange(10**9)}" for _ in range(k))
    rows, shares = [], []
    for i in range(n):
        base = words(licenses.WINDOW).split()
        other = base[:]
        other[3] = "changed"
        rows.append((i, " ".join(base), " ".join(other)))
        a, b = set(zip(base, base[1:])), set(zip(other, other[1:]))
        shares.append(len(a & b) / len(a | b))
    df = spark.createDataFrame(rows, "i long, a string, b string")
    bands = lambda c: licenses._bands(licenses.let(licenses._words(F.col(c)), licenses._pairs), licenses.STRIDE)
    met = df.select(F.arrays_overlap(bands("a"), bands("b")).alias("m")).filter("m").count()
    s = shares[0]
    want = 1 - (1 - s**licenses.ROWS) ** licenses.BANDS
    assert set(shares) == {s} and abs(met / n - want) < 0.07


def test_query_equals_plain_containment(spark):
    from ebbline.llm.queries import queries
    from tests.conftest import SMALL

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries()["op9_license_scan"](spark, SMALL).collect()
    assert {(r.doc_id, r.template): (r.n_found, r.first_word, r.past_word) for r in rows} == brute(texts) and rows


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def contained(text, template):
    """Plain containment: how many distinct pairs of the template the text has, of how many."""
    own = set(pairs(template))
    return len(own & set(pairs(text))), len(own)


def fullest(text, template):
    """(n_found, first_word, past_word): the fullest, shortest, first stretch of SPREAD times the template."""
    own, p = set(pairs(template)), pairs(text)
    at = [i for i, x in enumerate(p) if x in own]
    best = []
    for i in at:
        seen, past = set(), i
        for j in (j for j in at if i <= j <= i + licenses.SPREAD * len(pairs(template))):
            past = past if p[j] in seen else j + 2
            seen.add(p[j])
        best.append((-len(seen), past - i, i, past))
    n, _, first, past = min(best)
    return -n, first, past


def test_drifted_templates_are_found_wherever_they_stand(spark):
    template = licenses.TEMPLATES["mit-grant"]
    w = template.split()
    middle = len(w) // 2
    texts = [
        " ".join([*["pad"] * start, *w[:middle], *["extra"] * more, *w[middle:]])
        for more in (10, 12, 20, 60) for start in range(0, 16, 3)
    ]
    for mark in ("REM", "dnl"):
        texts.append("\n".join(f"{mark} {' '.join(w[i : i + 12])}" for i in range(0, len(w), 12)))
    texts.append("\n".join(f"{i} {' '.join(w[i : i + 12])}" for i in range(0, len(w), 12)))
    texts.append(f"of the software and {template} to the software {template} of the")
    got = found(spark, list(enumerate(texts)))
    for i, text in enumerate(texts):
        r = got[(i, "mit-grant")]
        assert (r.n_found, r.first_word, r.past_word) == fullest(text, template)
        assert (r.n_found, r.n_shingles) == contained(text, template)


def test_usual_wordings_and_whole_texts(spark):
    rng = random.Random(8)
    wordings = {
        "Licensed under the MIT License": "mit-under",
        "This file is distributed under the terms of the MIT license": "mit-terms",
        "Licensed under the Apache License 2.0": "apache-2.0-name",
        "it is available under the BSD 3-Clause License": "bsd-3-clause-name",
        "under the terms of the GNU Lesser General Public License": "lgpl-name",
        "# SPDX-License-Identifier: MPL-2.0": "mpl-2.0-spdx",
    }
    rows = [(f"some words {text} and more", name) for text, name in wordings.items()]
    for name, text in licenses.whole_texts().items():
        w = text.split()
        for i in rng.sample(range(len(w)), len(w) // 25):
            w[i] = f"{w[i]} more"
        rows += [(text, name), (" ".join(w), name)]
    got = found(spark, [(i, text) for i, (text, _) in enumerate(rows)])
    every = licenses.TEMPLATES | licenses.whole_texts()
    for i, (text, name) in enumerate(rows):
        assert (i, name) in got
    for (i, name), r in got.items():
        if len(every[name]) < 2000:
            assert (r.n_found, r.first_word, r.past_word) == fullest(rows[i][0], every[name])
        else:
            assert (r.n_found, r.n_shingles) == contained(rows[i][0], every[name])
    assert (4, "gpl-name") not in got and (3, "bsd-2-clause-name") not in got
