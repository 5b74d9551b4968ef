"""Repeated windows against a dictionary of all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from ebbline.llm import repeats
from ebbline.llm.repeats import Depth


def brute(rows, depth):
    """(spans, kept) by row: rows are (id, text); ids order documents."""
    data = [(-1 if d is None else d, (t or "").encode()) for d, t in rows]
    lead: dict = {}
    for d, b in data:
        for s in range(len(b) - depth + 1):
            w = b[s : s + depth]
            lead[w] = min(lead.get(w, (d, s)), (d, s))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 2, bool)
        for s in range(len(b) - depth + 1):
            if lead[b[s : s + depth]] < (d, s):
                gone[s + 1 : s + 1 + depth] = True
        turns = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
        kept = bytes(c for c, g in zip(b, gone[1:]) if not g)
        out.append((list(zip(turns[::2], turns[1::2])), kept))
    return out


def found(spark, rows, form):
    docs = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(rows)], "kept int, doc_id long, text string")
    got = repeats.repeated(docs, form=form).collect()
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got)


def expected(rows, depth):
    return sorted(
        (d is not None, d or 0, len((t or "").encode()), spans, kept)
        for (d, t), (spans, kept) in zip(rows, brute(rows, depth))
    )


def texts(rng, n):
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.choice([8, 30, 200]))) for _ in range(8)]
    made = []
    for _ in range(n):
        parts = [rng.choice([rng.choice(passages), "".join(rng.choice("abxyz ") for _ in range(rng.randrange(60)))]) for _ in range(rng.randrange(6))]
        made.append("".join(parts))
    return made


@pytest.mark.parametrize("form", [Depth(12, 4), Depth(12, 4, hot=3), Depth(20, 16), Depth(8, 8, hot=1)], ids=str)
def test_equal_to_all_windows(spark, form):
    rng = random.Random(form.depth)
    rows = [(rng.randrange(10_000) if i % 9 else None, t) for i, t in enumerate(texts(rng, 120))]
    rows += [(50_000, rows[5][1]), (50_001, rows[5][1]), (50_001, rows[5][1]), (50_002, rows[6][1] + rows[7][1])]
    rows += [(7, None), (8, ""), (9, "a" * 300), (3, "ab" * 200), (50_002, "a" * 290 + "b")]
    assert found(spark, rows, form) == expected(rows, form.depth)


def test_runs_cover_every_window_once_across_blocks():
    rng = random.Random(2)
    data = "".join(rng.choice("abcdefgh") for _ in range(2 * repeats._BLOCK + 500)).encode()
    form = Depth()
    digits, place, first, size = repeats.runs(data, form)
    assert first[0] == 0 and (first[1:] == (first + size)[:-1]).all()
    assert first[-1] + size[-1] == len(data) - form.depth + 1
    assert (first + size - 1 <= place).all() and (place + form.digit <= first + form.depth).all()
    moved = repeats.runs(b"zz" + data[100:], form)
    assert len(set(digits.tolist()) & set(moved[0].tolist())) > 0.95 * len(moved[0])


def test_long_text_and_defined_results(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(150_000))
    rows = [(2, long), (1, "x" + long[70_000:]), (5, None), (6, "short")]
    assert found(spark, rows, Depth()) == expected(rows, 100)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.repeated(none).count() == 0


def test_query_equals_all_windows(spark):
    from ebbline.llm.queries import queries
    from tests.conftest import SMALL

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = {
        d: (len(t.encode()), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
        for (d, t), (spans, kept) in zip(rows, brute(rows, 100))
    }
    got = queries()["op2_suffix_dedup"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert any(r.n_removed for r in got)
