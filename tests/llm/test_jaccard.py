"""The Jaccard join against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from ebbline.llm import jaccard, shingles
from ebbline.llm.jaccard import Likeness
from ebbline.llm.links import components


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def plain_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(texts, like):
    """Size of the set, component and number of links by id, from all pairs."""
    links = dict.fromkeys(texts, 0)
    sets = {d: plain_set(t, like.k) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and like.whole * common >= like.part * len(sets[a] | sets[b]):
                links[a], links[b] = links[a] + 1, links[b] + 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), links[d]) for d in texts}


def near_copies(rng, n_groups, copies):
    texts, vocabulary = [], [f"w{i}" for i in range(400)]
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 5, 9, 40, 120, 300]))]
        for _ in range(rng.randrange(1, copies)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice(["{}", "{}\n", " {} tail", "{} X"]).format(" ".join(copy)))
    return texts


@pytest.mark.parametrize(
    "like",
    [Likeness(), Likeness(k=5, part=80), Likeness(block=3, often=2), Likeness(k=2, part=50, often=3), Likeness(k=1, part=95)],
    ids=str,
)
def test_components_equal_all_pairs(spark, like):
    rng = random.Random(3)
    texts = near_copies(rng, 50, 14) + ["", None, "\t ", "a", "A", "a b", "passage " * 30]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.classes(docs, like=like).collect()}
    assert got == brute(dict(enumerate(texts)), like)


def test_frequent_tokens_of_a_group_are_counted_like_others():
    rng, like = random.Random(4), Likeness(part=60)
    base = rng.sample(range(1 << 40), 150)
    sets = [np.sort(np.array(rng.sample(base, 110) + rng.sample(range(1 << 40), 20), np.uint64)) for _ in range(90)]
    group = jaccard.Group(sets)
    assert len(group.matrix) > 50
    for own, near in zip(sets, group.linked(sets, like)):
        want = [i for i, s in enumerate(sets) if 100 * len(c := set(own) & set(s)) >= 60 * (260 - len(c))]
        assert near.tolist() == want


def test_word_hashes_do_not_depend_on_place_or_blocks():
    block = shingles._BLOCK
    for before in (0, 1, block - 3, block - 1, block, 2 * block - 4):
        text = "x" * before + " Alpha bravo ALPHA é alpha"
        h = shingles.word_hashes(text)[-5:]
        assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3
        assert (h == shingles.word_hashes("Alpha bravo ALPHA é alpha")).all()
    for size in (block - 1, block, block + 1, 2 * block):
        long = "y" * size
        assert shingles.word_hashes(long)[0] == shingles.word_hashes(" " + long + " z")[0]
    assert len(shingles.word_hashes(None)) == len(shingles.word_hashes(" \t\n")) == 0
    assert len(shingles.shingle_set("a b c", 4)) == 1 and len(shingles.shingle_set("a b c d e", 4)) == 2
    assert (np.diff(shingles.shingle_set("a b c d e f g", 2).astype(np.int64)) > 0).all()


def test_components_of_links(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(500, rng.randrange(100, 400)) for _ in range(80)] + [(7, 7), (900, 901), (901, 900)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    rows = spark.createDataFrame([*links, (None, 4)], "a long, b long")
    assert {r.id: r.root for r in components(rows).collect()} == {x: find(x) for x in root}
    assert components(rows.limit(0)).count() == 0


def test_defined_results(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame(
        [(5, text, "a"), (5, text, "b"), (9, text.upper(), "c"), (None, text, "d"), (None, None, "e"), (3, None, "f"), (2, "", "g"), (8, "other words here now", None)],
        "doc_id long, text string, id string",
    )
    rows = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.n_links) for r in jaccard.classes(docs).collect() if r.doc_id)
    assert rows == [(2, 0, 2, 0), (3, 0, 3, 0), (5, 7, 5, 1), (5, 7, 5, 1), (8, 1, 8, 0), (9, 7, 5, 1)]
    assert [r.component_id for r in jaccard.classes(docs).filter("doc_id is null").collect()] == [None, None]
    kept = jaccard.one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.id is None) for r in kept.collect()) == [(0, False), (0, False), (2, False), (3, False), (5, False), (8, True)]
    assert jaccard.classes(docs.limit(0)).count() == 0 and jaccard.one_per_class(docs.limit(0)).count() == 0


def test_query_equals_all_pairs(spark):
    from ebbline.llm.queries import queries
    from tests.conftest import SMALL

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in queries()["op4_ngram_jaccard"](spark, SMALL).collect()}
    assert got == brute(texts, Likeness())
