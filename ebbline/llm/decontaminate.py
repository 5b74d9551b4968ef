"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by ``m // CHARS_PER_ERROR`` edits. Cut
into one piece more than it has edits, at least one piece of it stands unchanged in the
passage. An Aho-Corasick pass finds exact pieces; Myers' bit-parallel distance verifies the
text around them. Both sides are compared in lower case with every run of ASCII characters
other than letters and digits as one blank.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from ebbline.llm.common import by_slices

CHARS_PER_ERROR = 16
# Items are searched in blocks of at most so many characters, one scan of the documents each,
# so what a task and the driver hold does not grow with the benchmark.
BLOCK_CHARS = 4_000_000

_TABLE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")

Item = tuple[object, str]


def normal(text: str | None) -> str:
    return b" ".join(
        (text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()
    ).decode("utf-8", "surrogatepass")


def budget(size: int, chars_per_error: int = CHARS_PER_ERROR) -> int:
    return size // chars_per_error


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item cut into ``errors + 1`` pieces, with their offsets."""
    cuts = [j * len(item) // (errors + 1) for j in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Bit-parallel edit distance of one pattern: bit i of a mask stands for its character i."""

    def __init__(self, pattern: str):
        self.size = len(pattern)
        self.bits: dict[str, int] = defaultdict(int)
        for i, c in enumerate(pattern):
            self.bits[c] |= 1 << i
        self.bits = dict(self.bits)

    def distances(self, text: Iterator[str] | str, anchored: bool) -> Iterator[int]:
        """After each character the distance of the whole pattern to the best passage that
        ends there; if ``anchored``, to all of the text so far."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score, first = full, 0, self.size, int(anchored)
        look = self.bits.get
        for c in text:
            eq = look(c, 0)
            diagonal = (((eq & up) + up) ^ up) | eq
            eq |= down
            plus = down | (full & ~(diagonal | up))
            minus = up & diagonal
            score += ((plus & top) != 0) - ((minus & top) != 0)
            plus = (plus << 1 | first) & full
            up = (minus << 1 & full) | (full & ~(eq | plus))
            down = plus & eq
            yield score


class Matcher:
    """Finds a block of items in normalised texts."""

    def __init__(self, items: list[Item], chars_per_error: int = CHARS_PER_ERROR):
        self.items = [(i, t) for i, t in items if t]
        self.errors = [budget(len(t), chars_per_error) for _, t in self.items]
        self.ahead: dict[int, Pattern] = {}
        self.back: dict[int, Pattern] = {}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text) in enumerate(self.items):
            for offset, piece in pieces(text, self.errors[n]):
                places[piece].append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def _windows(self, text: str) -> dict[int, list[list[int]]]:
        """Per item the stretches of the text that hold every passage around a piece hit."""
        found: dict[int, list[list[int]]] = defaultdict(list)
        if not self.items:
            return found
        for last, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                start, e = last - size + 1 - offset, self.errors[n]
                found[n].append([max(0, start - e), min(len(text), start + len(self.items[n][1]) + e)])
        return found

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(number of the item, start, end, distance) of every passage within its budget; of
        passages that overlap, the nearest and then the first."""
        for n, stretches in self._windows(text).items():
            merged: list[list[int]] = []
            for low, high in sorted(stretches):
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(high, merged[-1][1])
                else:
                    merged.append([low, high])
            for low, high in merged:
                yield from self._within(n, text, low, high)

    def _within(self, n: int, text: str, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
        """One pass over a stretch gives the distance at every end; the nearest ends are taken
        first and those that overlap them left out. Gaps that lost an end to this and could hold
        a passage are passed over again, so a stretch of repeated items is read once."""
        item, errors = self.items[n][1], self.errors[n]
        ahead = self.ahead.setdefault(n, Pattern(item))
        back = self.back.setdefault(n, Pattern(item[::-1]))
        todo = [(low, high)]
        while todo:
            low, high = todo.pop()
            if high - low < len(item) - errors:
                continue
            ends = [
                (d, low + i + 1) for i, d in enumerate(ahead.distances(text[low:high], False)) if d <= errors
            ]
            starts, pasts, lost = [], [], []
            for distance, end in sorted(ends):
                at = bisect_left(pasts, end)
                before = pasts[at - 1] if at else low
                inside = at < len(starts) and starts[at] < end
                if inside or end - len(item) + distance < before:
                    lost.append(end)
                    continue
                behind = text[max(low, end - len(item) - distance) : end][::-1]
                start = end - next(i + 1 for i, d in enumerate(back.distances(behind, True)) if d == distance)
                if start < before:
                    lost.append(end)
                    continue
                starts.insert(at, start)
                pasts.insert(at, end)
                yield n, start, end, distance
            lost.sort()
            for a, b in zip([low, *pasts], [*starts, high]):
                at = bisect_left(lost, a + len(item) - errors)
                if at < len(lost) and lost[at] <= b:
                    todo.append((a, b))


class Places:
    """Code points of the original words that stretches of a normalised text touch."""

    def __init__(self, text: str, plain: str):
        self.words = [m.span() for m in _WORD.finditer(text)]
        self.blanks = [m.start() for m in re.finditer(" ", plain)]

    def __call__(self, start: int, end: int) -> tuple[int, int]:
        first, last = bisect_left(self.blanks, start + 1), bisect_left(self.blanks, end - 1)
        return self.words[first][0], self.words[last][1]


def blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[Item]]:
    """The normalised items, a bounded number of characters at a time. Null ids are items like
    any other; null and blank texts match nothing; repeated rows count once."""
    block, size = [], 0
    rows = items.select(id_col, text_col).filter(F.col(text_col).isNotNull()).distinct()
    for key, text in rows.toLocalIterator():
        plain = normal(text)
        if block and size + len(plain) > block_chars:
            yield block
            block, size = [], 0
        if plain:
            block.append((key, plain))
            size += len(plain)
    if block:
        yield block


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    chars_per_error: int = CHARS_PER_ERROR,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per leaked passage: doc_id, item_id, start and past (code points of the text),
    ``distance`` in normalised characters and ``budget``.

    Null and empty texts hold no passage. A repeated document repeats its rows. Other columns
    are not carried; without documents or items the result is empty.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = [plain.schema["doc_id"].dataType, items.schema[item_col].dataType]
    schema = StructType().add("doc_id", ids[0]).add("item_id", ids[1])
    for name in ("start", "past", "distance", "budget"):
        schema = schema.add(name, LongType())
    out = to_arrow_schema(schema)
    parts = []
    for block in blocks(items, item_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, chars_per_error)

            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                rows = []
                for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                    short = normal(text)
                    places = None
                    for n, start, end, distance in matcher.matches(short):
                        places = places or Places(text, short)
                        first, past = places(start, end)
                        rows.append((key, matcher.items[n][0], first, past, distance, matcher.errors[n]))
                names = ["doc_id", "item_id", "start", "past", "distance", "budget"]
                return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], out)

            yield from by_slices(work)(batches)

        parts.append(plain.mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def clean(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_text_col: str = "text",
    chars_per_error: int = CHARS_PER_ERROR,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The documents without a leaked passage, with all their columns."""
    spark = docs.sparkSession
    for block in blocks(items, items.columns[0], item_text_col, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, chars_per_error)

            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                return batch.filter(pa.array([next(matcher.matches(normal(t)), None) is None for t in texts]))

            yield from by_slices(work)(batches)

        docs = docs.mapInArrow(run, docs.schema)
    return docs
