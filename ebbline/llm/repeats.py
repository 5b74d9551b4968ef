"""Repeated passages by a depth-limited radix sort of suffixes.

Only the first ``depth`` bytes of a suffix count: a window. Windows are ordered by most
significant digits, groups of one leave after every pass, and the groups that are still equal
after the last one are the repeated windows.

* The first digit of a window is the ``digit`` bytes at its anchor, the leftmost of its
  smallest hashes. It depends on the window's bytes alone, so equal windows agree on it, and
  neighbours share it: one row stands for a run of windows. Runs whose first digit occurs once
  in the corpus leave here, which is nearly all of unrepeated text.
* The second digit is the rest of the window. It is compared within tasks that hold whole
  groups of a first digit. Groups of more than ``hot`` runs are not gathered: their windows are
  dealt out one by one and settled by a partial minimum.

Digits are compared as 64-bit fingerprints. Texts that are equal as a whole count once; every
later copy is a repeat from end to end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import stored
from ebbline.llm.shingles import mixed

_BLOCK = 1 << 16
_RNG = np.random.Generator(np.random.PCG64(77))
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_MULT = _RNG.integers(0, 1 << 64, 8, np.uint64, endpoint=False) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_LOW = np.int64(-(1 << 63))


@dataclass(frozen=True)
class Depth:
    """Windows of ``depth`` bytes, first digits of ``digit`` (a power of two) bytes."""

    depth: int = 100
    digit: int = 32
    hot: int = 20_000


def _first_digits(raw: np.ndarray, digit: int) -> np.ndarray:
    """A fingerprint of the ``digit`` bytes from each byte on, by doubling."""
    h, width, i = _BYTE[raw], 1, 0
    while width < digit:
        h = h[:-width] * _MULT[i] + h[width:]
        width, i = 2 * width, i + 1
    return mixed(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def runs(data: bytes, form: Depth) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first digit, its place, first window, number of windows) of each run of windows with one
    anchor. A run that meets the end of a block of bytes is two."""
    raw = np.frombuffer(data, np.uint8)
    last = len(raw) - form.depth + 1
    parts = []
    for low in range(0, max(0, last), _BLOCK):
        high = min(last, low + _BLOCK)
        h = _first_digits(raw[low : high + form.depth - 1], form.digit)
        order = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        place = (_sliding_min(order, form.depth - form.digit + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        size = np.diff(np.concatenate([first, [len(place)]]))
        at = place[first]
        parts.append((h[at].view(np.int64), at + low, first + low, size))
    if not parts:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(p) for p in zip(*parts))


def _windows(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """A fingerprint of the window at each of the starts, from running sums."""
    n = len(data)
    powers = np.full(n, _BASE, np.uint64)
    powers[:1] = 1
    powers = np.multiply.accumulate(powers)
    back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    back[:1] = 1
    back = np.multiply.accumulate(back)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers, out=run[1:])
    return mixed((run[starts + depth] - run[starts]) * back[starts])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (null as the smallest), data as bytes, and 128 bits of the text."""
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(_LOW))).alias("doc"),
        F.col(id_col).alias("doc_id"),
        data.alias("data"),
        F.xxhash64(data).alias("t1"),
        F.xxhash64(data, F.lit(7)).alias("t2"),
    )


def _digits(texts: DataFrame, form: Depth) -> DataFrame:
    """(digit, place): one row per run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digits, places = [], []
            for t1, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                h, at, _, _ = runs(data.as_buffer(), form)
                digits.append(h)
                places.append(mixed(at.astype(np.uint64) + np.uint64(t1 % (1 << 64))).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (digits, places)], ["digit", "place"]
            )

    return texts.filter(F.length("data") >= form.depth).select("t1", "data").mapInArrow(
        run, "digit bigint, place bigint"
    )


def _digits_by_text(texts: DataFrame, form: Depth) -> DataFrame:
    """(digit, t1): one row per text and digit in it, however often a text repeats itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digits = [np.unique(runs(data.as_buffer(), form)[0]) for data in batch.column(1)]
            keys = np.repeat(batch.column(0).to_numpy(), [len(d) for d in digits])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(digits)), pa.array(keys)], ["digit", "t1"])

    return texts.filter(F.length("data") >= form.depth).select("t1", "data").mapInArrow(
        run, "digit bigint, t1 bigint"
    )


def _shared_digits(texts: DataFrame, form: Depth) -> DataFrame:
    """Per text (t1) the first digits that it shares with other places: lists ``plain``, ``hot``."""
    several = (
        _digits(texts, form)
        .groupBy("digit")
        .agg(F.min("place").alias("low"), F.max("place").alias("high"), F.count(F.lit(1)).alias("n"))
        .filter("low < high")
        .select("digit", (F.col("n") > form.hot).alias("hot"))
    )
    return (
        _digits_by_text(texts, form)
        .join(several, "digit")
        .groupBy("t1")
        .agg(
            F.collect_set(F.when(~F.col("hot"), F.col("digit"))).alias("plain"),
            F.collect_set(F.when(F.col("hot"), F.col("digit"))).alias("hot"),
        )
    )


def _contexts(firsts: DataFrame, form: Depth, hot: bool) -> DataFrame:
    """The runs with a shared first digit and the bytes under their windows, or the windows of
    runs with a hot one."""
    depth = form.depth

    def plain(data: bytes, digits: np.ndarray):
        h, _, first, size = runs(data, form)
        wanted = np.isin(h, digits)
        h, first, size = h[wanted], first[wanted], size[wanted]
        raw = np.frombuffer(data, np.uint8)
        for low in range(0, len(h), 4096):
            f, s = first[low : low + 4096], size[low : low + 4096] + depth - 1
            offsets = np.concatenate([[0], np.cumsum(s)])
            at = np.repeat(f - offsets[:-1], s) + np.arange(offsets[-1])
            under = pa.Array.from_buffers(
                pa.binary(), len(f), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw[at])]
            )
            yield h[low : low + 4096], f, under

    def dealt(data: bytes, digits: np.ndarray):
        h, _, first, size = runs(data, form)
        wanted = np.isin(h, digits)
        raw = np.frombuffer(data, np.uint8)
        for digit, f, s in zip(h[wanted].tolist(), first[wanted].tolist(), size[wanted].tolist()):
            for low in range(f, f + s, _BLOCK):
                n = min(f + s, low + _BLOCK) - low
                key = _windows(raw[low : low + n + depth - 1], np.arange(n), depth)
                yield np.full(n, digit, np.int64), np.arange(low, low + n), pa.array(key.view(np.int64))

    work = dealt if hot else plain
    names = ["digit", "doc", "start", "t1", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list] = [[] for _ in names]
            size = 0
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for (doc, t1), data, digits in zip(keys, batch.column(2), batch.column(3)):
                for digit, start, rest in work(data.as_buffer(), digits.values.to_numpy()):
                    same = [np.full(len(start), x, np.int64) for x in (doc, t1)]
                    for part, made in zip(parts, [*map(pa.array, (digit, same[0], start, same[1])), rest]):
                        part.append(made)
                    size += rest.nbytes
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.concat_arrays(p) for p in parts], names)
                        parts, size = [[] for _ in names], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(p) for p in parts], names)

    kind = "bigint" if hot else "binary"
    return firsts.select("doc", "t1", "data", F.col("hot" if hot else "plain").alias("digits")).mapInArrow(
        run, f"digit bigint, doc bigint, start bigint, t1 bigint, rest {kind}"
    )


def _equal_groups(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Bytes under windows that an earlier run of the same first digit holds as well. Rows come
    by digit, document and start; whole digits are worked on together."""
    held: list[pa.RecordBatch] = []

    def settle(rows: pa.RecordBatch) -> pa.RecordBatch:
        digit, doc, start, t1 = (rows.column(i).to_numpy() for i in range(4))
        rest = rows.column(4)
        offsets = np.frombuffer(rest.buffers()[1], np.int32)[rest.offset : rest.offset + len(rest) + 1].astype(np.int64)
        data = np.frombuffer(rest.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        size = np.diff(offsets) - depth + 1
        row = np.repeat(np.arange(len(size)), size)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        key = _windows(data, offsets[row] + inner, depth) ^ mixed(digit.astype(np.uint64))[row]
        order = np.argsort(key, kind="stable")
        same = np.concatenate([[False], key[order[1:]] == key[order[:-1]]])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        first, here = order[head], order
        at = start[row] + inner
        earlier = (doc[row[first]] < doc[row[here]]) | ((doc[row[first]] == doc[row[here]]) & (at[first] < at[here]))
        hit = np.zeros(len(row), bool)
        hit[here[earlier]] = True
        w = np.flatnonzero(hit)
        new = np.concatenate([[True], (np.diff(w) != 1) | (np.diff(row[w]) != 0)])[: len(w)]
        a = np.flatnonzero(new)
        b = np.concatenate([a[1:], [len(w)]])[: len(a)] - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (doc[row[w[a]]], t1[row[w[a]]], at[w[a]], at[w[b]] + depth)],
            ["doc", "t1", "start", "past"],
        )

    def joined(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([r.column(i) for r in rows]) for i in range(5)], rows[0].schema.names
        )

    def cut(rows: list[pa.RecordBatch]) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        """The rows of all digits but the last, and those of the last."""
        whole = joined(rows)
        digit = whole.column(0).to_numpy()
        at = int(np.flatnonzero(digit != digit[-1])[-1]) + 1 if digit[0] != digit[-1] else 0
        return (whole.slice(0, at) if at else None), [whole.slice(at)]

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size > 1 << 21:
            ready, held = cut(held)
            if ready is not None:
                yield settle(ready)
                size = sum(r.num_rows for r in held) * (depth + 60)
    if held:
        yield settle(joined(held))


def repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: Depth = Depth()
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, ``spans`` (maximal removed runs of bytes as first,
    past, in order) and ``kept``, the other bytes.

    A byte is removed if a window over it also starts earlier: in a smaller id, or in the same
    one at a smaller start. Null ids count as one document before all others, and rows that
    repeat an id as one document, whose windows at one start are not earlier than each other.
    Null and empty texts, and texts shorter than a window, lose nothing. Other columns are not
    carried; an empty table gives an empty one.
    """
    texts = _texts(docs, id_col, text_col)
    depth = form.depth
    shared = stored(_shared_digits(texts, form), "digits", "zstd")
    classes = texts.groupBy("t1", "t2").agg(F.min("doc").alias("first"))
    firsts = texts.join(
        classes.join(shared, "t1").withColumnsRenamed({"t1": "k1", "t2": "k2"}),
        F.expr("t1 = k1 and t2 = k2 and doc = first"),
    )
    # written, so that the moved texts are gone before their runs move
    firsts = stored(firsts, "firsts", "zstd")
    runs_of = _contexts(firsts.filter(F.size("plain") > 0), form, hot=False)
    spans = stored(
        runs_of.repartition("digit")
        .sortWithinPartitions("digit", "doc", "start")
        .mapInArrow(lambda batches: _equal_groups(batches, depth), "doc bigint, t1 bigint, start bigint, past bigint"),
        "spans",
    )
    if not shared.filter(F.size("hot") > 0).isEmpty():
        windows = stored(_contexts(firsts.filter(F.size("hot") > 0), form, hot=True), "windows")
        lead = windows.groupBy("digit", "rest").agg(F.min(F.struct("doc", "start")).alias("lead"))
        later = windows.join(lead, ["digit", "rest"]).filter(F.struct("doc", "start") > F.col("lead"))
        spans = spans.union(later.select("doc", "t1", "start", F.col("start") + depth))
    covered = spans.groupBy(F.col("t1").alias("c1"), F.col("doc").alias("c2")).agg(
        F.collect_list(F.struct("start", "past")).alias("spans")
    )
    known = classes.join(covered, F.expr("t1 = c1 and first = c2"), "left").select(
        F.col("t1").alias("k1"), F.col("t2").alias("k2"), "first", "spans"
    )
    whole = texts.join(known, F.expr("t1 = k1 and t2 = k2")).select(
        "doc_id", "data", (F.col("doc") > F.col("first")).alias("copy"), "spans"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                kept, removed, sizes = [], [], []
                for data, copy, spans in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                    if copy and len(data) >= depth:
                        spans = [{"start": 0, "past": len(data)}]
                    joined: list[list[int]] = []
                    for s in sorted(spans or [], key=lambda s: s["start"]):
                        if joined and s["start"] <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], s["past"])
                        else:
                            joined.append([s["start"], s["past"]])
                    bounds = [0, *[x for j in joined for x in j], len(data)]
                    kept.append(b"".join([data[a:b] for a, b in zip(bounds[::2], bounds[1::2])]))
                    removed.append([{"first": a, "past": b} for a, b in joined])
                    sizes.append(len(data))
                kind = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "spans", "kept"],
                )

    id_type = whole.schema["doc_id"].dataType.simpleString()
    return whole.mapInArrow(
        run, f"doc_id {id_type}, n_bytes bigint, spans array<struct<first: bigint, past: bigint>>, kept binary"
    )
