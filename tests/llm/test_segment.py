"""Sampled segmentations against enumeration, exact round trips and drawn frequencies."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from ebbline.llm import segment

TEXTS = ["", " ", "Hello world", "  a  b ▁ \n\t日本語 🙂 x ", "é", "\n", "aaaa aaaa", "x" * 3000, "THE!! " * 50]


@pytest.fixture(scope="module")
def pieces():
    return segment.Pieces.load()


@pytest.fixture(scope="module")
def lattices(pieces):
    return segment.Lattices(pieces)


@pytest.fixture(scope="module")
def small():
    texts = ("a", "b", "ab", "ba", " ", " a", "aab")
    weights = {i: -0.4 * (i + 1) for i in range(len(texts))}
    return segment.Pieces((*texts, *[""] * 256), weights, tuple(range(7, 263)), -9.0)


def every(pieces, text):
    """All segmentations of a text with their probabilities."""
    by_text = {pieces.texts[i]: (i, w) for i, w in pieces.weights.items()}

    def walk(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in by_text:
                i, w = by_text[rest[:n]]
                for ids, more in walk(rest[n:]):
                    yield (i, *ids), w + more

    found = list(walk(" " + text))
    total = sum(math.exp(w) for _, w in found)
    return {ids: math.exp(w) / total for ids, w in found}


@pytest.mark.parametrize("text", ["a", "ab", "aab b", "abab a"])
def test_drawing_all_gives_each_segmentation_once_with_its_probability(small, text):
    want = every(small, text)
    drawn = segment.samples(segment.Lattices(small), segment.row_keys([3]), [text], len(want) + 5)[0]
    assert len(drawn) == len(want)
    assert {tuple(ids.tolist()): pytest.approx(math.exp(lp), rel=1e-9) for ids, lp, _ in drawn} == want
    assert all(q == 1.0 for _, _, q in drawn)


def test_frequencies_and_inclusion_scores(small):
    want, n, k = every(small, "aab b"), 6000, 2
    drawn = segment.samples(segment.Lattices(small), segment.row_keys(list(range(n))), ["aab b"] * n, k)
    first = Counter(tuple(d[0][0].tolist()) for d in drawn)
    pairs = Counter(tuple(tuple(s[0].tolist()) for s in d) for d in drawn)
    for ids, p in want.items():
        assert abs(first[ids] / n - p) < 4.5 * math.sqrt(p / n) + 1e-3
    for (a, b), seen in pairs.items():
        p = want[a] * want[b] / (1 - want[a])
        assert abs(seen / n - p) < 4.5 * math.sqrt(p / n) + 1e-3
    totals = [sum(math.exp(lp) / q for _, lp, q in d) for d in drawn]
    assert abs(np.mean(totals) - 1) < 5 * np.std(totals) / math.sqrt(n)


def test_round_trip_in_both_decoders(pieces, lattices):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=segment.DEFAULT_MODEL)
    own = segment.Decoder(pieces)
    for text, drawn in zip(TEXTS, segment.samples(lattices, segment.row_keys(TEXTS), TEXTS, 3)):
        assert len({tuple(s[0].tolist()) for s in drawn}) == len(drawn) >= 1
        for ids, log_p, inclusion in drawn:
            assert own(ids.tolist()) == text and model.decode(ids.tolist()) == text
            assert log_p <= 0 and 0 < inclusion <= 1


def test_result_depends_on_the_row_alone(lattices):
    keys = segment.row_keys(list(range(len(TEXTS))))
    together = segment.samples(lattices, keys, TEXTS, 3)
    for i, text in enumerate(TEXTS):
        alone = segment.samples(lattices, keys[i : i + 1], [text], 3)[0]
        assert [s[0].tolist() for s in alone] == [s[0].tolist() for s in together[i]]
        assert [s[1:] for s in alone] == [pytest.approx(s[1:]) for s in together[i]]


def test_defined_results(spark, pieces):
    docs = spark.createDataFrame(
        [(1, "a b", 5), (1, "a b", 6), (None, None, 7), (4, "", 8)], "doc_id long, text string, ids int"
    )
    rows = segment.encode(docs, pieces, k=3).collect()
    assert Counter(r.doc_id for r in rows) == {1: 6, None: 1, 4: 1}
    once = sorted((r.rank, tuple(r.ids)) for r in rows if r.doc_id == 1)
    assert once[0::2] == once[1::2]
    assert [list(r.ids) for r in rows if r.doc_id in (None, 4)] == [[], []]
    assert segment.encode(docs.limit(0), pieces).count() == 0
    back = segment.decode(segment.encode(docs, pieces), pieces).collect()
    assert {r.text for r in back} == {"a b", ""}


def test_query_decodes_to_every_text(spark):
    from ebbline.llm.queries import queries
    from tests.conftest import SMALL

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries()["op10_sentencepiece"](spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.text_sha256 == hashlib.sha256((texts[r.doc_id]).encode()).hexdigest() for r in rows)
    assert len({(r.doc_id, r.ids_sha256) for r in rows}) == len(rows)


def test_runs_of_blanks_are_drawn(pieces, lattices):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=segment.DEFAULT_MODEL)
    runs = {i for i in range(model.get_piece_size()) if segment.MARK in model.id_to_piece(i)[1:]}
    assert runs and runs <= set(pieces.weights)
    for text in (" ", "   ", "a   b", "  a    (b"):
        want = every(pieces, text)
        drawn = segment.samples(lattices, segment.row_keys([1]), [text], len(want) + 3)[0]
        assert {tuple(ids.tolist()): pytest.approx(math.exp(lp), rel=1e-6) for ids, lp, _ in drawn} == want
        assert text == " " or any(runs & set(ids) for ids in want)
    assert "".join(lattices.units.findall("   a  b(    c")) == "   a  b(    c"


def test_steps_of_a_lone_word_draw_the_numbers_of_all_words():
    keys, word = np.array([77], np.uint64), np.array([5])
    many = segment._uniforms_of_steps(keys, 3, word, 40, 9)
    assert many.tolist() == [float(segment.uniforms(keys, 3, word, 40 + i)[0]) for i in range(9)]


def test_long_runs_without_blanks_take_linear_time(monkeypatch):
    import random
    import string
    import time

    pieces = segment.Pieces.load()
    lattices, decode, rng = segment.Lattices(pieces), segment.Decoder(pieces), random.Random(2)
    keys = segment.row_keys([9])
    long = "".join(rng.choices(string.ascii_letters + string.digits, k=3000))
    followed = segment.samples(lattices, keys, [f"{long} and words"], 3)[0]
    with monkeypatch.context() as m:
        m.setattr(segment, "_LONG_RUN", 1 << 40)
        sliced = segment.samples(lattices, keys, [f"{long} and words"], 3)[0]
    assert [s[0].tolist() for s in followed] == [s[0].tolist() for s in sliced]
    assert np.allclose([s[1:] for s in followed], [s[1:] for s in sliced])
    for run in ("".join(rng.choices(string.ascii_letters + string.digits + "+/", k=1_000_000)), "a" * 1_000_000):
        began = time.process_time()
        drawn = segment.samples(lattices, keys, [run], 2)[0]
        assert time.process_time() - began < 30
        assert all(decode(s[0].tolist()) == run for s in drawn) and len(drawn) == 2
