"""Trie of conversation prefixes by vertical bitmaps.

Conversations are dealt to shards of neighbouring ids. Within a shard an index holds, for every
(position, turn), the bitset of conversations that have this turn there. From the root downwards a
node's bitset meets the postings of the next position: each nonempty intersection is a child, its
popcount the child's conversations and its lowest bit the smallest of them, and the bits that
stop there are its end list. Nodes of all shards meet by the hash of their prefix.

Long conversations are cut into bands of positions, so a cell of (shard, band) is bounded; a band
starts from the hash of the prefix before it. Nothing is gathered per conversation or per node:
positions come from a range sort, and end lists of different shards are hashed as a stream.

Sums over subtrees need no walk between shards. A node belongs to its smallest conversation, and
a conversation owns a run of nodes down to its end. So the turns that a conversation has above
the nodes it owns are exactly those it saves, and leaves are ends owned by their conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.llm.common import stored

#: Conversations of a shard and positions of a band: what one cell holds at most.
SHARD = 512
BAND = 256
#: Shared beginnings: the first turns of the conversation at the start of each hundred, at most 5.
CENTURY = 100
BORROWED = 6

KEY = ["depth", "k1", "k2"]
NODES = "depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, n bigint, owner bigint, size bigint, shard bigint, ends string"
SUMS = "depth bigint, k1 bigint, k2 bigint, leaves bigint, saved bigint"


# ------------------------------------------------------------------ positions and rebuilding


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each sorted row among those of its conversation in this task, from 1."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        start = np.r_[last is None or conv[0] != last, conv[1:] != conv[:-1]]
        begin = np.maximum.accumulate(np.where(start, np.arange(len(conv)), 0))
        place = np.arange(len(conv)) - begin + 1
        if not start[0]:
            run = np.argmax(start) if start.any() else len(conv)
            place[:run] += seen
        last, seen = conv[-1], int(place[-1])
        kept = batch.drop_columns(["turn", "role", "text"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(place, pa.int64())], names=[*kept.schema.names, "place"])


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, part, place, c1, c2, size: a long conversation spreads over many parts."""
    columns = turns.select(
        "conv_id", "turn", "role", "text",
        F.xxhash64(F.lit(1), F.length("role"), "role", "text").alias("c1"),
        F.xxhash64(F.lit(2), F.length("role"), "role", "text").alias("c2"),
        F.length("text").cast("bigint").alias("size"),
    )
    ordered = columns.repartitionByRange("conv_id", F.asc_nulls_first("turn")).sortWithinPartitions(
        "conv_id", F.asc_nulls_first("turn"), "role", "text"
    )
    schema = "conv_id bigint, c1 bigint, c2 bigint, size bigint, part int, place bigint"
    return stored(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_place, schema), "trie-turns")


def _number(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            n = batch.num_rows
            shard = (batch.column("part").to_numpy().astype(np.int64) << 32) + (seen + np.arange(n)) // size
            seen += n
            kept = batch.drop_columns(["part"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(shard)], names=[*kept.schema.names, "shard"])

    return run


def _conversations(held: DataFrame, borrow: bool, shard: int) -> DataFrame:
    """conv_id, own (turns), skip, lent, total and shard of every conversation."""
    convs = held.groupBy("conv_id").agg(F.sum("n").alias("own"))
    skip = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED if borrow else F.lit(0)
    convs = convs.withColumn("skip", skip.cast("bigint"))
    base = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    lent = F.least("skip", F.coalesce("base_turns", F.lit(0)))
    convs = (
        convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % CENTURY)
        .join(base, "base", "left")
        .select(
            "conv_id", "base", "skip", lent.alias("lent"),
            (lent + F.greatest(F.col("own") - F.col("skip"), F.lit(0))).alias("total"),
        )
    )
    ordered = convs.repartitionByRange("conv_id").sortWithinPartitions("conv_id").withColumn("part", F.spark_partition_id())
    schema = "conv_id bigint, base bigint, skip bigint, lent bigint, total bigint, shard bigint"
    return stored(ordered.mapInArrow(_number(shard), schema), "trie-conversations")


def rebuilt(turns: DataFrame, borrow: bool, shard: int, band: int) -> DataFrame:
    """conv_id, pos, h1, h2, size, last, shard and band of every rebuilt turn; position 0 of every
    conversation stands for the root."""
    placed = placed_turns(turns)
    held = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    convs = _conversations(held, borrow, shard)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    about = ["conv_id", "skip", "lent", "total", "shard"]
    own = (
        placed.join(offsets.join(convs.select(*about), "conv_id"), ["conv_id", "part"])
        .withColumn("at", F.col("place") + F.col("offset"))
        .filter(F.col("at") > F.col("skip"))
        .withColumn("pos", F.col("at") - F.col("skip") + F.col("lent"))
    )
    first = (
        placed.filter((F.col("place") < BORROWED) & (F.col("conv_id") % CENTURY == 0))
        .join(offsets, ["conv_id", "part"])
        .withColumn("pos", F.col("place") + F.col("offset"))
        .filter(F.col("pos") < BORROWED)
        .select(F.col("conv_id").alias("base"), "pos", "c1", "c2", "size")
    )
    lent = convs.join(first, "base").filter(F.col("pos") <= F.col("lent"))
    turn = lambda seed: F.xxhash64(F.lit(seed), "pos", "c1", "c2")
    full = [F.col(c) for c in ("conv_id", "pos", "size", "total", "shard")]
    rows = own.select(*full, turn(1).alias("h1"), turn(2).alias("h2")).unionByName(
        lent.select(*full, turn(1).alias("h1"), turn(2).alias("h2"))
    )
    zero = F.lit(0).cast("bigint")
    roots = convs.select(
        "conv_id", zero.alias("pos"), zero.alias("size"), "total", "shard", zero.alias("h1"), zero.alias("h2")
    )
    rows = rows.unionByName(roots)
    last = F.col("pos") == F.col("total")
    return stored(
        rows.select("conv_id", "pos", "h1", "h2", "size", last.alias("last"), "shard", F.expr(f"pos div {band}").alias("band")),
        "trie-rebuilt",
    )


def _bands(rows: DataFrame, columns: list[Column], names: list[str], later: bool) -> DataFrame:
    """Sums of ``columns`` per conversation and band, over the bands before, or after, it.

    Only conversations of several bands have any; a window holds one row per band.
    """
    order = F.desc("band") if later else F.asc("band")
    over = Window.partitionBy("conv_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    merge = F.sum if later else F.bit_xor
    per = rows.groupBy("conv_id", "band").agg(*[merge(c).alias(n) for c, n in zip(columns, names)])
    return per.select("conv_id", "band", *[merge(n).over(over).alias(n) for n in names]).filter(F.col(names[0]).isNotNull())


def _with_starts(rows: DataFrame) -> DataFrame:
    starts = _bands(rows, [F.col("h1"), F.col("h2")], ["x1", "x2"], False)
    joined = rows.join(starts, ["conv_id", "band"], "left")
    return joined.fillna(0, ["x1", "x2"])


# ------------------------------------------------------------------ one shard


class _Shard:
    """The vertical index of a cell, and the nodes that a descent through it finds."""

    def __init__(self, table: pa.Table, band: int) -> None:
        self.band = band
        column = lambda c: table.column(c).to_pylist()
        conv, pos = column("conv_id"), column("pos")
        self.convs = sorted(set(conv))
        at = {c: i for i, c in enumerate(self.convs)}
        self.first = pos[0] // band * band
        self.index: dict[tuple[int, int, int], int] = {}
        self.sizes: dict[tuple[int, int, int], int] = {}
        self.turns: list[list] = [[None] * band for _ in self.convs]
        self.present: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        self.starts: dict[tuple[int, int], int] = {}
        for c, p, h1, h2, size, last, x1, x2 in zip(
            conv, pos, column("h1"), column("h2"), column("size"), column("last"), column("x1"), column("x2")
        ):
            i = at[c]
            bit, key = 1 << i, (p, h1, h2)
            self.index[key] = self.index.get(key, 0) | bit
            self.sizes[key] = size
            self.turns[i][p - self.first] = key
            self.present[p] = self.present.get(p, 0) | bit
            if last:
                self.ends[p] = self.ends.get(p, 0) | bit
            if p == self.first:
                self.starts[x1, x2] = self.starts.get((x1, x2), 0) | bit

    def nodes(self) -> Iterator[tuple]:
        """(place of the parent or -1, depth, k1, k2, p1, p2, members, turn), parents first."""
        n = 0
        todo = [(-1, self.first - 1, k1, k2, bits) for (k1, k2), bits in self.starts.items()]
        while todo:
            parent, depth, p1, p2, bits = todo.pop()
            rest = bits & self.present.get(depth + 1, 0)
            while rest:
                lowest = (rest & -rest).bit_length() - 1
                turn = self.turns[lowest][depth + 1 - self.first]
                child = bits & self.index[turn]
                rest &= ~child
                k1, k2 = p1 ^ turn[1], p2 ^ turn[2]
                yield parent, depth + 1, k1, k2, p1, p2, child, turn
                if depth + 2 < self.first + self.band:
                    todo.append((n, depth + 1, k1, k2, child))
                n += 1

    def members(self, bits: int) -> Iterator[int]:
        while bits:
            low = bits & -bits
            yield self.convs[low.bit_length() - 1]
            bits ^= low


def _arrow(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


def _nodes_of(table: pa.Table, band: int) -> pa.Table:
    shard, number = _Shard(table, band), table.column("shard")[0].as_py()
    out = []
    for _, depth, k1, k2, p1, p2, bits, turn in shard.nodes():
        ends = bits & shard.ends.get(depth, 0)
        listed = ",".join(map(str, shard.members(ends))) if ends else None
        owner = shard.convs[(bits & -bits).bit_length() - 1]
        out.append((depth, k1, k2, p1, p2, bits.bit_count(), owner, shard.sizes[turn], number, listed))
    return _arrow(out, NODES)


def _sums_of(table: pa.Table, band: int) -> pa.Table:
    """Leaves and saved code points below each node among the conversations of a shard."""
    shard = _Shard(table, band)
    at = {c: i for i, c in enumerate(shard.convs)}
    leaf, shared, beyond = 0, {}, {}
    for c, pos, mine, ends, rest in zip(
        *(table.column(n).to_pylist() for n in ("conv_id", "pos", "shared", "owns_leaf", "beyond"))
    ):
        bit = 1 << at[c]
        if ends:
            leaf |= bit
        if mine:
            shared[pos] = shared.get(pos, 0) | bit
        beyond[at[c]] = rest
    further = sum(1 << i for i, rest in beyond.items() if rest)
    found = list(shard.nodes())
    saved = []
    for _, depth, _, _, _, _, bits, turn in found:
        total = shard.sizes[turn] * (bits & shared.get(depth, 0)).bit_count()
        if depth == shard.first + shard.band - 1 and bits & further:
            total += sum(beyond[at[c]] for c in shard.members(bits & further))
        saved.append(total)
    for i in range(len(found) - 1, -1, -1):
        if found[i][0] >= 0:
            saved[found[i][0]] += saved[i]
    return _arrow([(f[1], f[2], f[3], (f[6] & leaf).bit_count(), s) for f, s in zip(found, saved)], SUMS)


# ------------------------------------------------------------------ all shards


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's end lists, which follow one another in the order of shards."""
    key, digest = None, None
    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        done = []
        for depth, k1, k2, ends in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ends"))):
            if (depth, k1, k2) == key:
                digest.update(b",")
            else:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (depth, k1, k2), hashlib.sha256()
            digest.update(ends.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, digest.hexdigest())], schema=schema)


def prefix_trie(
    conversations: DataFrame,
    borrow: bool = True,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    shard: int = SHARD,
    band: int = BAND,
) -> DataFrame:
    """One row per distinct sequence of first turns: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then role and text; null roles and texts count as
    empty. With ``borrow`` a conversation c first takes the first crc32(c) % 6 turns of
    conversation c - c % 100 in place of its own. conv_id is the smallest conversation that begins
    so and parent_conv_id its parent's, null at the root, which every conversation begins with,
    turnless ones too. saved_tokens sums (n_convs - 1) times the code points of a node's last text
    over its subtree; ends_sha256 hashes the sorted ids of conversations that end there.

    ``shard`` and ``band`` bound the cells and change no row. Turns are compared by 128-bit hashes. Rows with a null id take no part; repeated rows are
    repeated turns; an empty table gives an empty one. Other columns are not carried.
    """
    turns = conversations.select(
        F.col(id_col).cast("bigint").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).filter(F.col("conv_id").isNotNull())
    rows = rebuilt(turns, borrow, shard, band)
    cells = _with_starts(rows)
    partial = stored(cells.groupBy("shard", "band").applyInArrow(lambda t: _nodes_of(t, band), NODES), "trie-partial")

    nodes = partial.groupBy(*KEY).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum("n").alias("n_convs"),
        F.min("owner").alias("owner"), F.max("size").alias("size"),
    )
    nodes = stored(nodes, "trie-nodes")
    above = (F.col("depth") - 1).alias("depth")
    children = (
        nodes.filter("depth > 0")
        .select(above, F.col("p1").alias("k1"), F.col("p2").alias("k2"))
        .groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    nodes = stored(nodes.join(children, KEY, "left").fillna(0, ["n_children"]), "trie-nodes")

    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(
        F.min("depth").alias("own_from"), F.max_by(F.col("n_children") == 0, "depth").alias("owns_leaf")
    )
    told = rows.join(owned, "conv_id", "left").select(
        *rows.columns,
        F.coalesce(F.col("pos") < F.col("own_from"), F.lit(True)).alias("shared"),
        F.coalesce("owns_leaf", F.lit(False)).alias("owns_leaf"),
    )
    told = stored(told, "trie-told")
    rest = _bands(told, [F.when(F.col("shared"), F.col("size")).otherwise(0)], ["beyond"], True)
    cells = _with_starts(told).join(rest, ["conv_id", "band"], "left").fillna(0, ["beyond"])
    sums = cells.groupBy("shard", "band").applyInArrow(lambda t: _sums_of(t, band), SUMS)
    sums = sums.groupBy(*KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    lists = partial.filter(F.col("ends").isNotNull()).select(*KEY, "shard", "ends")
    hashed = lists.repartition(*KEY).sortWithinPartitions(*KEY, "shard").mapInArrow(
        _digests, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"
    )
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
        F.col("owner").alias("parent_conv_id"),
    )
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(sums, KEY)
        .join(hashed, KEY, "left")
        .join(parents, ["depth", "p1", "p2"], "left")
        .select(
            F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
            "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )
