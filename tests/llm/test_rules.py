"""The ledger, its policies and ablations against plain Python."""

from __future__ import annotations

import random
import re

import pytest

from ebbline.llm import rules
from tests.conftest import SMALL


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else None
    if often is None:
        counts = {}
        for w in windows:
            counts[w] = counts.get(w, 0) + 1
        often = {w for w, n in counts.items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in often for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_upper": len(re.findall("[A-Z]", text)),
    }


def failed(m):
    return [
        m["n_words"] < 50,
        100 * m["n_repeat_words"] > 50 * m["n_words"],
        100 * m["n_symbols"] > 10 * m["word_chars"],
        100 * m["n_dup_lines"] > 30 * m["n_lines"],
        100 * m["n_upper"] > 50 * m["word_chars"],
        m["word_chars"] < 2 * m["n_words"],
        m["word_chars"] > 20 * m["n_words"],
    ]


def bits(text):
    return sum(1 << i for i, f in enumerate(failed(measured(text))) if f)


EDGES = [
    None, "", " \t\n\x0b\r", "a", "\n\n\n", "a b c a b c", "a a a a a", "x\nx\n\nx \n x", "#*$%&|<> #",
    "ÉÀ ABC déjà   vu là", "LOUD " * 60, "a " * 60, "w" * 5000, " ".join("v" * 30 + str(i) for i in range(60)),
    "one two three " * 40, "\r\n".join(["same line here"] * 9), " ".join(map(str, range(20_000))),
    " ".join(str(i % 7000) for i in range(20_000)),
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    vocabulary = ["a", "bb", "THE", "#x", "word", "longer", "é"]
    made = [
        "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "\t", "\x0b "]) for _ in range(rng.randrange(0, 90)))
        for _ in range(150)
    ]
    return EDGES + made


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, -1, "m") for i, t in enumerate(texts)] + [(None, "a b", 0, None), (1, "a", 0, None), (1, "a", 0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, m string").repartition(3)


def test_every_measure_and_bit_equals_plain_python(docs, texts):
    rows = rules.ledger(docs).filter("doc_id is not null").collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = texts[r.doc_id] if (r.n_words, r.word_chars) != (1, 1) or r.doc_id != 1 else "a"
        assert {k: r[k] for k in rules.MEASURES} == measured(text), text
        assert r.failed == bits(text), text


def test_rows_without_id_and_repeated_rows_stay(docs):
    book = rules.ledger(docs)
    assert book.columns == ["doc_id", *rules.MEASURES, "failed"]
    assert [r.n_words for r in book.filter("doc_id is null").collect()] == [2]
    assert sorted(r.n_words for r in book.filter("doc_id = 1").collect()) == [0, 1, 1]
    empty = rules.ledger(docs.limit(0))
    assert empty.count() == 0
    assert {r.n_failed + r.n_alone + r.n_kept_without for r in rules.ablation(empty).collect()} <= {0}


@pytest.mark.parametrize("policy", sorted(rules.POLICIES))
def test_policies_and_ablations_equal_plain_python(docs, texts, policy):
    """A policy judges a stored ledger, without the texts; so does its ablation."""
    from ebbline.llm.common import stored

    book = stored(rules.ledger(docs.filter("doc_id is not null and m is not null")), "ledger")
    names = [r.name for r in rules.RULES]
    wanted = [names.index(n) for n in rules.POLICIES[policy]]
    fails = [{i for i in wanted if failed(measured(t))[i]} for t in texts]
    got = {r.doc_id: (r.kept, r.policy) for r in rules.apply_policy(book, policy).collect()}
    assert got == {i: (not f, policy) for i, f in enumerate(fails)}
    found = {r.rule: (r.n_failed, r.n_alone, r.n_kept_without) for r in rules.ablation(book, policy).collect()}
    assert found == {
        names[i]: (sum(i in f for f in fails), sum(f == {i} for f in fails), sum(f <= {i} for f in fails)) for i in wanted
    }


def test_a_filter_keeps_rows_whole(docs, texts):
    kept = rules.filtered(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(texts) if not bits(t)]


def test_query_equals_plain_python(spark):
    from ebbline.llm.queries import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries()["op5_quality_rules"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        m, f = measured(texts[r.doc_id]), failed(measured(texts[r.doc_id]))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == tuple(m[k] for k in rules.MEASURES[:5])
        assert (r.base_failed, r.kept) == (any(f[:2]), not any(f))
