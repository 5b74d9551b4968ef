"""The pipeline against brute force, stage by stage, and on awkward tables."""

from __future__ import annotations

import re

import corpus_pipeline as cp
from ebbline.llm import decontaminate, pii, segment
from ebbline.llm.rules import CURRENT, POLICIES
from tests.conftest import SMALL
from tests.llm.test_jaccard import brute as brute_classes
from tests.llm.test_pii import brute as brute_spans


def rules_keep(text):
    """The rules again, in plain Python."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)
    windows = [tuple(w[i : i + 3]) for i in range(n - 2)]
    repeated = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in (i, i + 1, i + 2)} if n < 400 else None
    if repeated is None:
        seen: dict = {}
        for x in windows:
            seen[x] = seen.get(x, 0) + 1
        repeated = {j for i, x in enumerate(windows) if seen[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    chars = sum(map(len, w))
    failed = {
        "few_words": n < 50,
        "repeated_words": 100 * len(repeated) > 50 * n,
        "symbols": 100 * len(re.findall(r"[#*$%&|<>]", text)) > 10 * chars,
        "repeated_lines": 100 * (len(lines) - len(set(lines))) > 30 * len(lines),
        "shouting": 100 * len(re.findall("[A-Z]", text)) > 50 * chars,
        "short_words": chars < 2 * n,
        "long_words": chars > 20 * n,
    }
    return not any(failed[r] for r in POLICIES[CURRENT])


def test_run_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = {d: t for d, t in docs.items() if rules_keep(t)}
    classes = brute_classes(docs, cp.NEAR)
    docs = {d: t for d, t in docs.items() if classes[d][1] == d}
    plain = {d: decontaminate.normal(t) for d, t in docs.items()}
    docs = {d: t for d, t in docs.items() if not any(i in plain[d] for i in items)}
    rows = cp.run(spark, SMALL).collect()
    own = segment.Decoder(segment.Pieces.load())
    assert {r.doc_id for r in rows} == set(docs) and 0 < len(docs) < 200
    for r in rows:
        text = own(r.ids)
        assert text == pii.redacted(docs[r.doc_id])
        assert (text == docs[r.doc_id]) == (not pii.spans(docs[r.doc_id]))
        assert bool(brute_spans(docs[r.doc_id])) <= (text != docs[r.doc_id])


def test_stages_keep_the_columns_and_stand_awkward_rows(spark):
    good = " ".join(f"word{i} other" for i in range(60))
    docs = spark.createDataFrame(
        [(1, good, "en", 5, "x", 1), (1, good, "en", 5, "x", 2), (None, good + " more", None, None, None, 3),
         (3, None, "en", 0, "y", 4), (4, "", "en", 0, "y", 5), (5, good.upper().lower() + " a@b.cd", "en", 1, "z", 6)],
        "doc_id long, text string, lang string, n_chars long, row string, failed int",
    )
    kept = docs
    for _, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
        assert kept.columns == docs.columns
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    rows = kept.collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1]
    assert cp.STAGES[-1][1](spark, docs, SMALL).filter("rank = 1").count() == docs.count()


def test_registered():
    import __spark_entry__ as contract

    assert "pipeline" in contract.queries() and [n for n, _ in cp.STAGES] == [
        "quality_rules", "near_duplicates", "decontamination", "personal_data", "segmentation",
    ]
