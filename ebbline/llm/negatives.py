"""Hard negatives from candidate blocks along a Hilbert curve with zone maps.

Candidates are ordered along a Hilbert curve through their most varied dimensions and written as
Parquet blocks, each with the least and greatest value per dimension and label (its zone map).
From the zone map, interval arithmetic bounds every inner product with an anchor, so the zone
maps alone tell which blocks may hold rows of an anchor's score windows; only those blocks are
read. An anchor's own block is read first and gives scores that a later block must reach.

Anchors grow with the data, so nothing is broadcast: groups of anchors meet chunks of zone maps,
and then chunks of opened blocks, in cells of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.llm.common import stored
from ebbline.llm.vectors import first_per_row, ids_of, in_runs, matrix, products, usable, widened

#: Values of one block, of the anchors of a group, of a chunk of zone maps and of opened blocks.
BLOCK_VALUES = 1 << 15
GROUP_VALUES = 1 << 18
ZONE_VALUES = 1 << 19
OPEN_BLOCKS = 64
#: The curve runs through so many dimensions, the most varied ones, with so many bits each.
CURVE_DIMS = 15
CURVE_BITS = 4
#: Window bounds of a search without one.
LOWEST, HIGHEST = -(2**63), 2**63 - 1

ROWS = "vec_id bigint, label bigint, parts array<int>"
BLOCK = (
    "n int, ids array<bigint>, labels array<bigint>, values array<array<int>>, "
    "low array<int>, high array<int>, label_low bigint, label_high bigint"
)
ANCHOR = "a_block bigint, a_place int, anchor_id bigint, label bigint, parts array<int>"
FOUND = "a_block bigint, a_place int, window int, vec_id bigint, score bigint"


# ------------------------------------------------------------------ blocks along the curve


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of ``cells`` (n x dims, ``bits`` bits each) on the Hilbert curve.

    Walks from the coarsest bit down, turning and mirroring the axes below it, then spreads the
    bits of the turned axes over the key. Keys have dims * bits <= 63 bits.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        below = bit - 1
        for d in range(dims):
            mirrored = (x[d] & bit) != 0
            swap = np.where(mirrored, 0, (x[0] ^ x[d]) & below)
            x[0] ^= np.where(mirrored, below, swap)
            if d:
                x[d] ^= swap
        bit >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    keys = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            keys = (keys << 1) | ((x[d] >> b) & 1)
    return keys


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = matrix(batch.column("parts")).astype(np.float64)
        if v.size:
            yield pa.RecordBatch.from_pydict(
                {"d": np.arange(v.shape[1], dtype=np.int32), "s": v.sum(0), "ss": (v * v).sum(0),
                 "low": v.min(0), "high": v.max(0)}
            )


def _curve_axes(rows: DataFrame, n: int) -> list[tuple[int, float, float]]:
    """(dimension, low, high) of the most varied dimensions; one row per dimension is gathered."""
    sums = rows.select("parts").mapInArrow(_sums, "d int, s double, ss double, low double, high double")
    of = sums.groupBy("d").agg(F.sum("s"), F.sum("ss"), F.min("low"), F.max("high")).toDF("d", "s", "ss", "low", "high")
    spread = F.col("ss") - F.col("s") * F.col("s") / F.lit(float(max(n, 1)))
    top = of.select("d", "low", "high", spread.alias("spread")).orderBy(F.desc("spread"), "d").limit(CURVE_DIMS).collect()
    return [(a["d"], a["low"], a["high"]) for a in top]


def _with_key(axes: list[tuple[int, float, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("parts"))
            v = widened(v, max([v.shape[1], *(d + 1 for d, _, _ in axes)]))
            cells = np.zeros((len(v), max(len(axes), 1)), np.int64)
            for i, (d, low, high) in enumerate(axes):
                cells[:, i] = np.clip((v[:, d] - low) * ((1 << CURVE_BITS) / (high - low + 1)), 0, (1 << CURVE_BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(hilbert_keys(cells, CURVE_BITS))], names=[*batch.schema.names, "key"]
            )

    return run


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_runs(batches, size):
            v, labels = matrix(part.column("parts")), part.column("label").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "n": part.num_rows,
                        "ids": part.column("vec_id").to_pylist(),
                        "labels": labels,
                        "values": list(v),
                        "low": v.min(0),
                        "high": v.max(0),
                        "label_low": labels.min(),
                        "label_high": labels.max(),
                    }
                ],
                schema=_ARROW_BLOCK,
            )

    return run


_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_ARROW_BLOCK = pa.schema(
    [("n", pa.int32()), ("ids", _LONGS), ("labels", _LONGS), ("values", pa.list_(_INTS)), ("low", _INTS),
     ("high", _INTS), ("label_low", pa.int64()), ("label_high", pa.int64())]
)


def curve_blocks(rows: DataFrame, dims: int, n: int) -> DataFrame:
    """Blocks of neighbours on the curve, with their zone maps, as a table on disk.

    Equal vectors are told apart by id, so a vector that fills a third of the rows still spreads
    over many ranges.
    """
    keyed = rows.mapInArrow(_with_key(_curve_axes(rows, n)), f"{ROWS}, key bigint")
    placed = keyed.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id").drop("key")
    size = max(16, BLOCK_VALUES // max(dims, 1))
    packed = placed.mapInArrow(_pack(size), BLOCK)
    return stored(packed.select(F.monotonically_increasing_id().alias("block"), "*"), "negatives-blocks")


# ------------------------------------------------------------------ anchors and cells


def _anchors_of(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place = [p for p, i in enumerate(row["ids"]) if i is not None and i % every == 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]] * len(place), pa.int64()),
                        pa.array(place, pa.int32()),
                        pa.array([row["ids"][p] for p in place], pa.int64()),
                        pa.array([row["labels"][p] for p in place], pa.int64()),
                        pa.array([row["values"][p] for p in place], pa.list_(pa.int32())),
                    ],
                    names=["a_block", "a_place", "anchor_id", "label", "parts"],
                )

    return run


class _Anchors:
    """The anchors of a group in a fixed order, with their score windows."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by([("a_block", "ascending"), ("a_place", "ascending")])
        self.block = table.column("a_block").to_numpy()
        self.place = table.column("a_place").to_numpy()
        self.label = table.column("label").to_numpy()
        self.values = matrix(table.column("parts"))
        windows = table.column("windows").to_pylist()
        width = max([len(w) for w in windows], default=0)
        self.no = np.full((len(windows), width), -1, np.int64)
        self.low = np.full((len(windows), width), HIGHEST, np.int64)
        self.high = np.full((len(windows), width), LOWEST, np.int64)
        for i, of in enumerate(windows):
            for j, w in enumerate(of):
                self.no[i, j], self.low[i, j], self.high[i, j] = w["window"], w["low"], w["high"]

    def picked(self, at: np.ndarray) -> "_Anchors":
        part = object.__new__(_Anchors)
        for name, value in vars(self).items():
            setattr(part, name, value[at])
        return part


def _bounds(anchors: _Anchors, zones: pa.Table, same: bool) -> np.ndarray:
    """anchors x zones: may the block hold a row of one of the anchor's windows?"""
    low, high = (matrix(zones.column(c)) for c in ("low", "high"))
    dims = max(low.shape[1], anchors.values.shape[1])
    low, high, q = (widened(m, dims).astype(np.float64) for m in (low, high, anchors.values))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    most = up @ high.T + down @ low.T
    least = up @ low.T + down @ high.T
    margin = 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T) + 1.0
    first, last = (zones.column(c).to_numpy() for c in ("label_low", "label_high"))
    mine = anchors.label[:, None]
    if same:
        may = (first[None, :] <= mine) & (mine <= last[None, :])
    else:
        may = ~((first[None, :] == mine) & (last[None, :] == mine))
    inside = np.zeros_like(may)
    for j in range(anchors.no.shape[1]):
        inside |= (most + margin >= anchors.low[:, j, None]) & (least - margin <= anchors.high[:, j, None])
    return may & inside


def _choose(same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Blocks that anchors of a group must read, with one bit per anchor."""

    def run(left: pa.Table, zones: pa.Table) -> pa.Table:
        if not left.num_rows or not zones.num_rows:
            return _NEEDED.empty_table()
        may = _bounds(_Anchors(left), zones, same)
        block = zones.column("block").to_numpy()
        some = np.flatnonzero(may.any(0))
        bits = np.packbits(may[:, some].T, axis=1)
        return pa.table(
            [pa.array([left.column("g")[0].as_py()] * len(some), pa.int32()), pa.array(block[some]),
             pa.array([b.tobytes() for b in bits], pa.binary())],
            schema=_NEEDED,
        )

    return run


_NEEDED = pa.schema([("g", pa.int32()), ("block", pa.int64()), ("wanted", pa.binary())])
NEEDED = "g int, block bigint, wanted binary"


def _home(left: pa.Table) -> pa.Table:
    """Every anchor's own block."""
    anchors = _Anchors(left)
    blocks, of = np.unique(anchors.block, return_inverse=True)
    bits = [np.packbits(of == b).tobytes() for b in range(len(blocks))]
    return pa.table(
        [pa.array([left.column("g")[0].as_py()] * len(blocks), pa.int32()), pa.array(blocks), pa.array(bits, pa.binary())],
        schema=_NEEDED,
    )


def _read(k: int, same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best k rows of each window in the opened blocks of a cell."""

    def run(left: pa.Table, opened: pa.Table) -> pa.Table:
        every = _Anchors(left) if left.num_rows else None
        width = every.no.shape[1] if every else 0
        # one line per anchor and window: anchor * width + window
        line, score, ids, missing = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        for row in range(opened.num_rows if width else 0):
            bits = np.frombuffer(opened.column("wanted")[row].as_py(), np.uint8)
            at = np.flatnonzero(np.unpackbits(bits, count=len(every.block)))
            anchors = every.picked(at)
            values = matrix(opened.column("values")[row].values)
            labels = opened.column("labels")[row].values.to_numpy()
            own_ids, own_missing = ids_of(opened.column("ids")[row].values)
            dims = max(values.shape[1], anchors.values.shape[1])
            got = products(widened(anchors.values, dims), widened(values, dims))
            fits = (labels[None, :] == anchors.label[:, None]) == same
            here = np.flatnonzero(anchors.block == opened.column("block")[row].as_py())
            fits[here, anchors.place[here]] = False
            for j in range(width):
                inside = fits & (got >= anchors.low[:, j, None]) & (got <= anchors.high[:, j, None])
                r, c = np.nonzero(inside)
                line = np.r_[line, at[r] * width + j]
                score, ids = np.r_[score, got[r, c]], np.r_[ids, own_ids[c]]
                missing = np.r_[missing, own_missing[c]]
            keep = first_per_row(line, score, ids, missing, k)
            line, score, ids, missing = line[keep], score[keep], ids[keep], missing[keep]
        a, j = (line // width, line % width) if width else (line, line)
        return pa.table(
            {
                "a_block": pa.array(every.block[a] if every else a, pa.int64()),
                "a_place": pa.array(every.place[a] if every else a, pa.int32()),
                "window": pa.array(every.no[a, j] if every else a, pa.int32()),
                "vec_id": pa.array(ids, pa.int64(), mask=missing),
                "score": pa.array(score, pa.int64()),
            }
        )

    return run


# ------------------------------------------------------------------ searches


def _bucket(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


class Search:
    """Candidate blocks, and searches of score windows in them."""

    def __init__(self, blocks: DataFrame, dims: int, groups: int) -> None:
        self.blocks = blocks
        self.groups = groups
        held = blocks.count()
        cores = blocks.sparkSession.sparkContext.defaultParallelism
        wide = max(1, math.ceil(2 * cores / groups))
        per_chunk = max(1, ZONE_VALUES // max(dims, 1))
        self.zone_chunks = max(1, math.ceil(held / per_chunk), min(wide, math.ceil(held / 16)))
        self.open_chunks = max(1, math.ceil(held / OPEN_BLOCKS), min(held, wide))

    def _opened(self, anchors: DataFrame, needed: DataFrame, k: int, same: bool) -> DataFrame:
        """Scores of the needed blocks; the best k of each anchor and window."""
        needed = stored(needed.withColumn("c", _bucket("block", self.open_chunks)), "negatives-needed")
        right = needed.withColumnsRenamed({"g": "of_g", "c": "of_c"}).join(
            self.blocks.select("block", "ids", "labels", "values"), "block"
        )
        left = anchors.join(needed.select("g", "c").distinct(), "g")
        found = left.groupBy("g", "c").cogroup(right.groupBy("of_g", "of_c")).applyInArrow(_read(k, same), FOUND)
        of = Window.partitionBy("a_block", "a_place", "window")
        best = of.orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def best(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """a_block, a_place, window, rank, vec_id, score: the first k rows of each window, of the
        anchor's label or, unless ``same``, of any other.

        ``anchors`` has ``windows``, an array of (window, low, high). The own block is read
        first; where it fills a window, its k-th score is what other blocks must reach.
        """
        own = anchors.groupBy("g").applyInArrow(_home, NEEDED)
        seen = self._opened(anchors, own, k, same)
        reached = (
            seen.filter(F.col("rank") == k)
            .groupBy("a_block", "a_place")
            .agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))
        )
        raised = F.transform(
            "windows",
            lambda w: w.withField("low", F.greatest(w["low"], F.try_element_at("reached", w["window"]))),
        )
        told = stored(
            anchors.join(reached, ["a_block", "a_place"], "left")
            .withColumn("windows", F.when(F.col("reached").isNull(), F.col("windows")).otherwise(raised))
            .drop("reached"),
            "negatives-anchors",
        )
        zones = self.blocks.select("block", "low", "high", "label_low", "label_high")
        left = told.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(self.zone_chunks - 1))))
        right = zones.withColumn("c", _bucket("block", self.zone_chunks)).withColumn(
            "g", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1)))
        )
        needed = left.groupBy("g", "c").cogroup(right.groupBy("g", "c")).applyInArrow(_choose(same), NEEDED)
        return self._opened(told, needed, k, same)


def _window(number: Column, low: Column, high: Column) -> Column:
    return F.struct(number.cast("int").alias("window"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))


def mine(
    embeddings: DataFrame,
    positives: int = 5,
    negatives: int = 3,
    every: int = 50,
    relabel_every: int | None = 7,
    classes: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``every``. Their positives are the first
    ``positives`` other rows of the same label; each positive's hard negatives are the first
    ``negatives`` rows of other labels that score from 50 to 95 hundredths of it. Higher scores
    come first, ties by the smaller id, rows without an id last. A label of an id divisible by
    ``relabel_every`` first becomes (label + 1) % ``classes``.

    Rows with a null label or a vector that ``vectors`` leaves out take no part. A negative
    positive score has no window; a score of 0 has the window of 0 alone. Rows that share an id
    are rows of their own. An empty table, or one without anchors, gives an empty one. Other
    columns are not carried.
    """
    label = F.col(label_col).cast("bigint")
    if relabel_every:
        label = F.when(F.col(id_col) % relabel_every == 0, (label + 1) % classes).otherwise(label)
    known = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), label.alias("own_label"))
    rows = usable(known, "id", "vector", label="own_label").filter(F.col("label").isNotNull()).select("vec_id", "label", "parts")
    # the components are turned into integers once
    rows = stored(rows, "negatives-rows", "zstd")
    dims, n = rows.agg(F.coalesce(F.max(F.size("parts")), F.lit(0)), F.count(F.lit(1))).first()
    blocks = curve_blocks(rows, dims, n)
    anchors = stored(blocks.select("block", "ids", "labels", "values").mapInArrow(_anchors_of(every), ANCHOR), "negatives-anchors")
    groups = max(1, math.ceil(anchors.count() * max(dims, 1) / GROUP_VALUES))
    anchors = anchors.withColumn("g", _bucket("a_block", groups))
    search = Search(blocks, dims, groups)

    whole = F.array(_window(F.lit(0), F.lit(LOWEST), F.lit(HIGHEST)))
    key = ["a_block", "a_place"]
    near = stored(
        search.best(anchors.withColumn("windows", whole), positives, True).select(
            *key, "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        ),
        "negatives-positives",
    )
    # half of the score rounded up, and 19 / 20 of it rounded down
    score = F.col("positive_score")
    half = F.shiftright(score, 1) + score % 2
    most = score - F.expr("positive_score div 20") - F.when(score % 20 > 0, 1).otherwise(0)
    windows = (
        near.filter(score >= 0)
        .groupBy(*key)
        .agg(F.collect_list(_window(F.col("rank"), half, most)).alias("windows"))
    )
    hard = search.best(anchors.join(windows, key), negatives, False)
    near = near.withColumnRenamed("rank", "window")
    ids = anchors.select(*key, "anchor_id")
    return (
        hard.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        .join(near, [*key, "window"])
        .join(ids, key)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
