"""Token ids as fixed-stride binary shards in training order.

Documents become sequences of a fixed number of ids. Sequences are numbered as they are read; a
keyed Feistel permutation over the smallest even number of bits, walked until it falls inside,
sends each number to a global slot of its own. Slots are cut into ranges of equal size: shard s
holds slots s * size onwards, each at a fixed stride, so training reads shards front to back and
resumes at any slot by arithmetic.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.llm.common import shared_folder, stored, write
from ebbline.llm.shingles import mixed

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The split pattern of the vocabulary, and the id that ends a document and pads.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
_ROUNDS = 6
# Shards of a task that writes them, in bytes of their records.
TASK_BYTES = 32 << 20
# Up to so many tasks that read documents, what their numbers start at (16 bytes each) is broadcast.
MOST_TASKS = 1_000_000


@dataclass(frozen=True)
class Layout:
    """``length`` ids of two bytes per sequence, ``size`` sequences per shard, order by ``key``."""

    length: int = 512
    size: int = 4096
    key: int = 20240601

    @property
    def stride(self) -> int:
        return 2 * self.length


class Permutation:
    """A keyed bijection of 0 .. n-1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mixed(np.arange(1, _ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            if back:
                left, right = right ^ (mixed(left + k) & self.mask), left
            else:
                left, right = right, left ^ (mixed(right + k) & self.mask)
        return left << self.half | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        keys = self.keys[::-1] if back else self.keys
        out = np.array(x, np.uint64)
        todo = np.arange(len(out))
        while len(todo):
            out[todo] = self._once(out[todo], keys, back)
            todo = todo[out[todo] >= np.uint64(self.n)]
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


def load_ranks(path: str = DEFAULT_RANKS) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def encoding(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sequences(docs: DataFrame, shared, form: Layout) -> DataFrame:
    """part, place, doc_id, seq, n_tokens and ids (little-endian, not padded) of all sequences,
    numbered within the task that read their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(shared.value).encode_ordinary
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                piece = batch.slice(low, 64)
                docs_of, seqs, sizes, data = [], [], [], []
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    ids = encode(text or "")
                    ids.append(END)
                    n = -(-len(ids) // form.length)
                    raw = np.array(ids, np.uint16).tobytes()
                    docs_of += [doc] * n
                    seqs += range(n)
                    sizes += [form.length] * (n - 1) + [len(ids) - (n - 1) * form.length]
                    data += [raw[i * form.stride : (i + 1) * form.stride] for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(seqs), pa.int64()), pa.array(np.arange(at, at + len(seqs))),
                     pa.array(docs_of, pa.int64()), pa.array(seqs, pa.int32()), pa.array(sizes, pa.int32()),
                     pa.array(data, pa.binary())],
                    ["part", "place", "doc_id", "seq", "n_tokens", "data"],
                )
                at += len(seqs)

    return docs.mapInArrow(run, "part bigint, place bigint, doc_id bigint, seq int, n_tokens int, data binary")


def write_shards(
    docs: DataFrame,
    ranks: dict[bytes, int],
    id_col: str = "doc_id",
    text_col: str = "text",
    form: Layout = Layout(),
    path: str | None = None,
) -> str:
    """Write all sequences and return the path of the shards.

    One row per shard: shard, first_slot, n_sequences, stride, ``data`` (little-endian ids of two
    bytes at fixed strides) and by sequence doc_ids, seqs and n_tokens. Null and empty texts are
    the end id alone. Rows may repeat and ids be null; other columns are not carried; an empty
    table gives no shard. Texts are read and tokenised once; numbers follow the order of reading.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    cut = stored(sequences(plain, spark.sparkContext.broadcast(ranks), form), "sequences", "zstd")
    # one row per task that read the documents
    held = cut.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    tasks, total = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = -(-total // form.size)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Permutation(total, form.key)
        for batch in batches:
            slots = order.slots(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots), pa.array(slots // form.size), *batch.columns[1:]],
                ["slot", "shard", "doc_id", "seq", "n_tokens", "data"],
            )

    pad = np.full(form.length, END, np.uint16).tobytes()

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def row(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            slots = whole.column(0).to_numpy()
            if (np.diff(slots) != 1).any() or slots[0] % form.size:
                raise RuntimeError("a shard has a gap")
            lists = [whole.column(i).to_pylist() for i in (2, 3, 4)]
            records = b"".join(d + pad[len(d) :] for d in whole.column(5).to_pylist())
            return pa.RecordBatch.from_arrays(
                [whole.column(1).slice(0, 1), whole.column(0).slice(0, 1), pa.array([len(slots)], pa.int32()),
                 pa.array([form.stride], pa.int32()), pa.array([records], pa.binary()),
                 pa.array([lists[0]], pa.list_(pa.int64())), pa.array([lists[1]], pa.list_(pa.int32())),
                 pa.array([lists[2]], pa.list_(pa.int32()))],
                ["shard", "first_slot", "n_sequences", "stride", "data", "doc_ids", "seqs", "n_tokens"],
            )

        for batch in batches:
            while batch.num_rows:
                if held and held[0].column(1)[0] != batch.column(1)[0]:
                    yield row(held)
                    held = []
                shard = batch.column(1).to_numpy()
                n = int(np.searchsorted(shard, shard[0], side="right"))
                held.append(batch.slice(0, n))
                batch = batch.slice(n)
        if held:
            yield row(held)

    target = path or f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    per_task = max(1, TASK_BYTES // (form.size * form.stride))
    numbered = cut.join(F.broadcast(bases) if tasks <= MOST_TASKS else bases, "part").select(
        (F.col("base") + F.col("place")).alias("number"), "doc_id", "seq", "n_tokens", "data"
    )
    shown = (
        numbered.mapInArrow(number, "slot bigint, shard bigint, doc_id bigint, seq int, n_tokens int, data binary")
        .repartitionById(max(1, -(-shards // per_task)), F.floor(F.col("shard") / per_task).cast("int"))
        .sortWithinPartitions("slot")
        .mapInArrow(
            bound,
            "shard bigint, first_slot bigint, n_sequences int, stride int, data binary, "
            "doc_ids array<bigint>, seqs array<int>, n_tokens array<int>",
        )
    )
    write(shown, target, "zstd")
    return target


def read_slots(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """slot, shard, place (byte in its shard), doc_id, seq, n_tokens and ``record`` (the bytes of
    the sequence) of the slots from start to stop; only their shards are read."""
    shards = spark.read.parquet(path).filter(F.col("first_slot") + F.col("n_sequences") > start)
    if stop is not None:
        shards = shards.filter(F.col("first_slot") < stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, first, n, stride = (batch.column(c)[i].as_py() for c in range(4))
                data = batch.column(4)[i].as_buffer()
                low, high = max(0, start - first), n if stop is None else min(n, stop - first)
                for a in range(low, high, 1024):
                    b = min(high, a + 1024)
                    lists = [batch.column(c)[i].values.slice(a, b - a) for c in (5, 6, 7)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(first + a, first + b)), pa.array(np.full(b - a, shard)),
                         pa.array(np.arange(a, b) * stride), *lists,
                         pa.array([data[p * stride : (p + 1) * stride].to_pybytes() for p in range(a, b)], pa.binary())],
                        ["slot", "shard", "place", "doc_id", "seq", "n_tokens", "record"],
                    )

    return shards.mapInArrow(
        run, "slot bigint, shard bigint, place bigint, doc_id bigint, seq int, n_tokens int, record binary"
    )
