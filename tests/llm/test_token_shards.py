"""Shards against the texts they hold, and the permutation against all numbers."""

from __future__ import annotations

import numpy as np
import pytest

from ebbline.llm import token_shards as ts
from ebbline.llm.token_shards import Layout, Permutation


@pytest.fixture(scope="module")
def ranks():
    return ts.load_ranks()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_permutation_is_a_keyed_bijection(n):
    numbers = np.arange(n)
    slots = Permutation(n, 5).slots(numbers)
    assert sorted(slots.tolist()) == numbers.tolist()
    assert (Permutation(n, 5).numbers(slots) == numbers).all()
    if n > 100:
        assert (slots != Permutation(n, 6).slots(numbers)).mean() > 0.9
        assert abs(np.corrcoef(numbers, slots)[0, 1]) < 0.15


def texts_of(rows, ranks, length):
    encoder, parts = ts.encoding(ranks), {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append((r.seq, r.n_tokens, np.frombuffer(r.record, np.uint16)))
    out = {}
    for doc, found in parts.items():
        found.sort(key=lambda p: p[0])
        assert [p[0] for p in found] == list(range(len(found)))
        assert all(len(p[2]) == length and (p[2][p[1] :] == ts.END).all() for p in found)
        ids = np.concatenate([p[2][: p[1]] for p in found]).tolist()
        assert ids.pop() == ts.END
        out[doc] = encoder.decode(ids)
    return out


def test_round_trip_strides_and_resuming(spark, ranks):
    from tests.conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    form = Layout(length=64, size=100)
    path = ts.write_shards(docs, ranks, form=form)
    rows = ts.read_slots(spark, path).collect()
    assert [r.slot for r in sorted(rows, key=lambda r: r.slot)] == list(range(len(rows)))
    assert all(r.shard == r.slot // 100 and r.place == r.slot % 100 * 128 for r in rows)
    assert texts_of(rows, ranks, 64) == {r.doc_id: r.text for r in docs.collect()}
    shards = spark.read.parquet(path).collect()
    assert all(len(s.data) == s.n_sequences * s.stride for s in shards)
    late = ts.read_slots(spark, path, 250, 431).collect()
    assert sorted(r.slot for r in late) == list(range(250, 431))
    by_slot = {r.slot: r for r in rows}
    assert all(by_slot[r.slot] == r for r in late)


def test_defined_results(spark, ranks):
    docs = spark.createDataFrame(
        [(1, "a b", 5), (1, "a b", 6), (None, None, 7), (4, "", 8), (5, "x" * 20_000, 9), (6, "<|endoftext|>", 1)],
        "doc_id long, text string, slot int",
    )
    path = ts.write_shards(docs, ranks, form=Layout(length=8, size=3))
    rows = ts.read_slots(spark, path).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows if r.doc_id != 5 and r.doc_id != 6) == [(0, 1), (1, 3), (1, 3), (4, 1)]
    assert texts_of([r for r in rows if r.doc_id in (5, 6)], ranks, 8) == {5: "x" * 20_000, 6: "<|endoftext|>"}
    empty = ts.write_shards(docs.limit(0), ranks)
    assert ts.read_slots(spark, empty).count() == 0


def test_query_equals_numbering_by_hand(spark, ranks):
    """Every column of the query from the texts alone: cut, numbered as read, permuted, hashed."""
    import hashlib

    from ebbline.llm.queries import queries
    from tests.conftest import SMALL

    form, encoder = Layout(), ts.encoding(ranks)
    records = []
    # one file is read by tasks in the order of its rows
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        ids = [*encoder.encode_ordinary(r.text or ""), ts.END]
        for seq, low in enumerate(range(0, len(ids), form.length)):
            part = ids[low : low + form.length]
            padded = part + [ts.END] * (form.length - len(part))
            records.append((r.doc_id, seq, len(part), hashlib.sha256(np.array(padded, "<u2").tobytes()).hexdigest()))
    slots = Permutation(len(records), form.key).slots(np.arange(len(records))).tolist()
    want = sorted(
        (slot, slot // form.size, slot % form.size * form.stride, *record) for slot, record in zip(slots, records)
    )
    columns = ["slot", "shard", "place", "doc_id", "seq", "n_tokens", "record_sha256"]
    got = queries()["op7_token_shards"](spark, SMALL).select(*columns).collect()
    assert sorted(map(tuple, got)) == want


def test_query_holds_every_document(spark):
    from ebbline.llm.queries import queries
    from tests.conftest import SMALL

    rows = queries()["op7_token_shards"](spark, SMALL).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert {r.doc_id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
