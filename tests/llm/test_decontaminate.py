"""Leaks against a quadratic edit distance."""

from __future__ import annotations

import random
import time

from ebbline.llm import decontaminate as dc


def brute(item, text):
    """The smallest distance of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        at = rng.randrange(len(text) or 1)
        text[at : at + 1] = rng.choice([[], ["x"], [*text[at : at + 1], "y"]])
    return "".join(text)


def test_every_passage_within_budget_is_found():
    rng = random.Random(5)
    for turn in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 70))).strip() or "a"
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 60)))
        text = text + edited(rng, item, rng.randrange(0, 7)) + text[::-1]
        matcher = dc.Matcher([(1, item)])
        best = min((m[3] for m in matcher.matches(text)), default=None)
        want = brute(item, text)
        assert best == (want if want <= matcher.errors[0] else None), (item, text)


def test_passages_do_not_overlap_and_lie_at_their_distance():
    rng = random.Random(8)
    for _ in range(200):
        item = "".join(rng.choice("ab ") for _ in range(rng.randrange(16, 60))).strip() or "a"
        text = "".join(edited(rng, item, rng.randrange(0, 5)) + rng.choice(["", "b", item[:9]]) for _ in range(4))
        found = sorted(m[1:] for m in dc.Matcher([(1, item)]).matches(text))
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
        for start, end, distance in found:
            assert distance == whole(item, text[start:end]) <= len(item) // 16
        # What lies between them holds no further passage.
        gaps = zip([0, *(f[1] for f in found)], [*(f[0] for f in found), len(text)])
        assert all(brute(item, text[a:b]) > len(item) // 16 for a, b in gaps), (item, text, found)


def whole(item, text):
    row = list(range(len(text) + 1))
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_an_item_repeated_all_over_a_long_text_takes_linear_time():
    item = "the quick brown fox jumps over the lazy dog"
    matcher, seconds = dc.Matcher([(1, item)]), []
    for n in (2_000, 20_000):
        text = " ".join([item] * n)
        began = time.process_time()
        found = list(matcher.matches(text))
        places = dc.Places(text, text)
        spans = [places(start, end) for _, start, end, _ in found]
        seconds.append(time.process_time() - began)
        assert sorted(spans) == [(i * 44, i * 44 + 43) for i in range(n)]
    assert seconds[1] < 30 * seconds[0] + 1


def test_spans_point_at_the_passage():
    item = dc.normal("The quick brown fox, jumps over the lazy dog")
    text = "İ! été -- THE quick brown fox jumps; over the lazi dog... end. the quick brown fox jumps over the lazy dog"
    matcher = dc.Matcher([(7, item)])
    plain = dc.normal(text)
    found = sorted(dc.Places(text, plain)(s, e) for _, s, e, _ in matcher.matches(plain))
    assert [text[s:e] for s, e in found] == [
        "THE quick brown fox jumps; over the lazi dog", "the quick brown fox jumps over the lazy dog",
    ]


def test_defined_results(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame(
        [(1, f"a {passage} b", 0), (1, f"a {passage} b", 0), (2, None, 0), (None, passage.upper(), 0), (4, "", 0), (5, "clean", 0)],
        "doc_id long, text string, item_id int",
    )
    items = spark.createDataFrame(
        [(1, passage, 0), (1, passage, 0), (2, None, 0), (3, " ", 0)], "item_id long, text string, doc_id int"
    )
    found = sorted((r.doc_id or 0, r.item_id, r.distance) for r in dc.leaks(docs, items).collect())
    assert found == [(0, 1, 0), (1, 1, 0), (1, 1, 0)]
    assert sorted(r.doc_id for r in dc.clean(docs, items).collect()) == [2, 4, 5]
    assert dc.clean(docs, items).columns == docs.columns
    assert dc.leaks(docs, items.limit(0)).count() == 0 and dc.leaks(docs.limit(0), items).count() == 0
    small = dc.leaks(docs, items, block_chars=1)
    assert sorted((r.doc_id or 0, r.item_id, r.distance) for r in small.collect()) == found


def test_query_finds_what_a_plain_search_finds(spark):
    from ebbline.llm.queries import queries
    from tests.conftest import SMALL

    docs = {r.doc_id: dc.normal(r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = {r.item_id: dc.normal(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    plain = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    found = queries()["op3_decontamination"](spark, SMALL).collect()
    assert plain <= {(r.doc_id, r.item_id) for r in found} and plain
    for r in found:
        assert (r.distance == 0) == ((r.doc_id, r.item_id) in plain)
        assert brute(items[r.item_id], docs[r.doc_id]) <= r.distance <= r.budget
