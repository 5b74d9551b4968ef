"""N-gram Jaccard join over a token-group matrix.

Texts with equal shingle sets become one. The others are searched through the first few
shingles of each set, frequent ones last: two sets that link share a known number of these.
Sets are partitioned into groups by the one of these that most sets have. The matrix holds the tokens
of each group's union; the overlap of a set with a group's union bounds its overlap with any
member, so only groups that reach the bound are opened, and only there are sets compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.llm.common import by_slices, stored
from ebbline.llm.links import components
from ebbline.llm.shingles import shingle_set

_FREQUENT = np.uint64(1 << 62)
# Cells of a group's matrix, and sets compared with it at a time.
_CELLS, _TURN = 1 << 24, 256


@dataclass(frozen=True)
class Likeness:
    """Two sets link when ``whole * intersection >= part * union``, over ``k``-word shingles.

    The order of tokens is guessed from a sample of about ``sample`` documents: at most
    ``frequent`` tokens that are seen ``often`` times come last. It steers speed alone. Groups
    of more than ``block`` sets are opened a block at a time.
    """

    k: int = 4
    part: int = 85
    whole: int = 100
    sample: int = 8192
    often: int = 8
    frequent: int = 65_536
    block: int = 4096

    @property
    def base(self) -> int:
        """No more than two different sets that link can fail to have in common."""
        return max(1, min(3, self.part // (self.whole - self.part)))

    def shared(self, size: int) -> int:
        """How many tokens the prefixes of two sets of this size that link have in common: any
        number up to their smallest overlap is right if prefixes are as much longer."""
        return max(self.base, size // 20)

    def prefix(self, size: int) -> int:
        least = -(-self.part * size // self.whole)
        return min(size, size - least + self.shared(size))

    def needed(self, size: Column) -> Column:
        """``shared`` for the smallest set that one of ``size`` links with."""
        return F.greatest(F.lit(self.base), F.floor(F.ceil(size * self.part / self.whole) / 20))

    def links(self, common, left, right):
        return self.whole * common >= self.part * (left + right - common)


def _frequent_tokens(docs: DataFrame, like: Likeness) -> np.ndarray:
    share = min(1.0, like.sample / max(1, docs.count()))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = shingle_set(text, like.k).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own)], ["token"])

    found = (
        docs.select("text")
        .sample(share, seed=11)
        .mapInArrow(tokens, "token bigint")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= like.often)
        .orderBy(F.desc("n"), "token")
        .limit(like.frequent)
    )
    return np.sort(np.array([r.token for r in found.collect()], np.int64).astype(np.uint64))


def _profiles(docs: DataFrame, like: Likeness) -> DataFrame:
    """(doc_id, n_shingles, set_id, prefix) of each text in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent_tokens(docs, like))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys, prefixes = [], [], []
        for text in batch.column(1).to_pylist():
            own = shingle_set(text, like.k)
            sizes.append(len(own))
            keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            ordered = own
            if len(shared.value):
                at = np.minimum(np.searchsorted(shared.value, own), len(shared.value) - 1)
                late = shared.value[at] == own
                ordered = np.concatenate([own[~late], own[late] | _FREQUENT])
            prefixes.append(ordered[: like.prefix(len(own))].astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
             pa.array(prefixes, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "set_id", "prefix"],
        )

    return docs.mapInArrow(
        by_slices(work), "doc_id bigint, n_shingles bigint, set_id binary, prefix array<bigint>"
    )


def _placed(sets: DataFrame, like: Likeness) -> DataFrame:
    """(id, n, token, group): the tokens that sets share, each with the group of its set. Sets
    that no other one can link with do not appear.

    Tokens move once by themselves and once by their set. Those that the sample knows as
    frequent are at most ``frequent`` and may be hot, so they are counted by partial sums; the
    others are rare enough for a window.
    """
    rare = F.filter("prefix", lambda t: t < int(_FREQUENT))
    late = F.filter("prefix", lambda t: t >= int(_FREQUENT))
    few = sets.select("id", "n", F.explode(rare).alias("token")).withColumn(
        "sets", F.count(F.lit(1)).over(Window.partitionBy("token"))
    )
    many = sets.select("id", "n", F.explode(late).alias("token"))
    counts = many.groupBy("token").agg(F.count(F.lit(1)).alias("sets"))
    kept = few.unionByName(many.join(F.broadcast(counts), "token")).filter("sets > 1")
    own = Window.partitionBy("id")
    return (
        kept.withColumn("group", F.max(F.struct("sets", "token")).over(own)["token"])
        .withColumn("enough", F.count(F.lit(1)).over(own) >= like.needed(F.col("n")))
        .filter("enough")
        .select("id", "n", "token", "group")
    )


def _opened(sets: DataFrame, like: Likeness) -> DataFrame:
    """(id, own, group): the group of each set and, with ``own`` false, every group of a larger
    key that it has to visit."""
    placed = stored(_placed(sets, like), "placed")
    matrix = placed.groupBy("token", F.col("group").alias("other")).agg(
        F.min("n").alias("low"), F.max("n").alias("high")
    )
    fits = (F.col("n") * like.part <= F.col("high") * like.whole) & (
        F.col("low") * like.part <= F.col("n") * like.whole
    )
    visits = (
        placed.join(matrix, "token")
        .filter((F.col("group") < F.col("other")) & fits)
        .groupBy("id", "other")
        .agg((F.count(F.lit(1)) >= F.min(like.needed(F.col("n")))).alias("enough"))
        .filter("enough")
    )
    every = placed.select("id", F.lit(True).alias("own"), "group").distinct().union(
        visits.select("id", F.lit(False), "other")
    )
    return stored(every, "groups")


def _in_blocks(opened: DataFrame, like: Likeness) -> DataFrame:
    """(id, own, group, block): large groups are cut into blocks of members. A set visits the
    blocks after its own, and visitors from outside visit all of them."""
    sizes = (
        opened.groupBy("group")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if("own").alias("members"))
        .filter("rows > 1 and members > 0")
        .select("group", F.ceil(F.col("members") / like.block).alias("blocks"))
    )
    home = F.when(F.col("own"), F.pmod(F.xxhash64("id"), F.col("blocks"))).otherwise(0)
    return (
        opened.join(sizes, "group")
        .withColumn("home", home)
        .withColumn("block", F.explode(F.sequence("home", F.col("blocks") - 1)))
        .select("id", (F.col("own") & (F.col("home") == F.col("block"))).alias("own"), "group", "block")
    )


class Group:
    """The sets of one group and the postings of its token union.

    Tokens that many members hold are columns of a matrix, so their overlaps are products; the
    others are counted from postings. ``_CELLS`` bounds the matrix and moves work, not results.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        self.union = flat[first]
        self.bounds = np.concatenate([first, [len(flat)]])
        held = np.diff(self.bounds)
        heavy = np.flatnonzero(held >= max(32, len(sets) // 16))
        heavy = heavy[np.argsort(-held[heavy], kind="stable")][: max(1, _CELLS // len(sets))]
        self.column = np.full(len(self.union), -1)
        self.column[heavy] = np.arange(len(heavy))
        self.matrix = np.zeros((len(heavy), len(sets)), np.float32)
        for c, t in enumerate(heavy):
            self.matrix[c, self.owner[self.bounds[t] : self.bounds[t + 1]]] = 1

    def linked(self, sets: list[np.ndarray], like: Likeness) -> Iterator[np.ndarray]:
        """Members that each of some sets links with; none without counting if its overlap with
        the union fails."""
        known = []
        for own in sets:
            at = np.minimum(np.searchsorted(self.union, own), len(self.union) - 1)
            at = at[self.union[at] == own]
            known.append(at if like.whole * len(at) >= like.part * len(own) else None)
        probe = np.zeros((len(sets), len(self.matrix)), np.float32)
        for i, at in enumerate(known):
            if at is not None:
                probe[i, self.column[at][self.column[at] >= 0]] = 1
        heavy = (probe @ self.matrix).astype(np.int64)
        for own, at, common in zip(sets, known, heavy):
            if at is None:
                yield np.empty(0, np.int64)
                continue
            at = at[self.column[at] < 0]
            low, size = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
            place = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            common = common + np.bincount(self.owner[place], minlength=len(self.sizes))
            yield np.flatnonzero(like.links(common, self.sizes, len(own)) & (common > 0))


class Block:
    """The members of a block, and how many documents each of them links with."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]], like: Likeness):
        self.like = like
        self.ids = np.array([i for i, _, _ in rows], np.int64)
        self.copies = np.array([n for _, n, _ in rows], np.int64)
        self.counts = np.zeros(len(rows), np.int64)
        self.label = np.arange(len(rows))
        sets = [s for _, _, s in rows]
        self.group = Group(sets)
        self.tree = []
        for low in range(0, len(sets), _TURN):
            for x, near in enumerate(self.group.linked(sets[low : low + _TURN], like), low):
                self.counts[x] = self.copies[near[self.ids[near] != self.ids[x]]].sum()
                labels, first = np.unique(self.label[near], return_index=True)
                if len(labels) > 1:
                    self.tree += [(int(self.ids[x]), int(self.ids[y])) for y in near[first]]
                    self.label[np.isin(self.label, labels)] = labels[0]

    def visit(self, rows: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int | None, int]]:
        """Links (a, b, 0) that join visitors to components, and counts (a, null, documents)."""
        for (doc, copies, _), near in zip(rows, self.group.linked([s for _, _, s in rows], self.like)):
            near = near[self.ids[near] != doc]
            if len(near):
                self.counts[near] += copies
                _, first = np.unique(self.label[near], return_index=True)
                yield from ((doc, int(self.ids[y]), 0) for y in near[first])
                yield doc, None, int(self.copies[near].sum())

    def settled(self) -> Iterator[tuple[int, int | None, int]]:
        yield from ((a, b, 0) for a, b in self.tree)
        yield from ((int(i), None, int(n)) for i, n in zip(self.ids, self.counts) if n)


def _compare(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """Links and numbers of links within blocks whose rows come together, members first."""
    key, last, block, rows, same, out = None, None, None, [], [], []

    def settle(members: bool):
        nonlocal block, rows
        if members and rows:
            block = Block(rows, like)
        elif block is not None and rows:
            out.extend(block.visit(rows))
        rows = []

    def leave():
        nonlocal block
        settle(block is None and members)
        if block is not None:
            out.extend(block.settled())
        block = None

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["a", "b", "links"]
        )
        out.clear()
        return made

    members = True
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for group, part, own, doc, copies, data in zip(*columns, batch.column(5)):
            if (group, part) != key:
                leave()
                key, last, members = (group, part), None, True
            if members and not own:
                settle(True)
                last, members = None, False
            tokens = np.frombuffer(data.as_buffer(), np.uint64)
            # Rows that repeat an id and its text count once.
            if doc != last:
                same, last = [], doc
            if any(np.array_equal(s, tokens) for s in same):
                continue
            same.append(tokens)
            rows.append((doc, copies, tokens))
            if not members and len(rows) >= _TURN:
                settle(False)
        yield flush()
    leave()
    yield flush()


def _links(docs: DataFrame, blocks: DataFrame, copies: DataFrame, like: Likeness) -> DataFrame:
    """Compare the sets of the documents in every block that they belong to or visit: links
    (a, b, 0) that span components, and counts (a, null, links)."""
    wanted = blocks.join(copies, "id").groupBy("id", "copies").agg(F.collect_list(F.struct("group", "block", "own")).alias("places"))
    # The places grow with the documents, so texts move to them at every size.
    texts = docs.join(wanted.hint("merge"), docs["doc_id"] == wanted["id"]).select("doc_id", "copies", "places", "text")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for doc, copies, places, text in zip(*(c.to_pylist() for c in batch.columns)):
            data = shingle_set(text, like.k).tobytes()
            yield pa.RecordBatch.from_pylist([{**p, "doc": doc, "copies": copies, "data": data} for p in places], form)

    form = pa.schema(
        [("group", pa.int64()), ("block", pa.int64()), ("own", pa.bool_()), ("doc", pa.int64()), ("copies", pa.int64()), ("data", pa.binary())]
    )
    sets = texts.mapInArrow(
        by_slices(work), "group bigint, block bigint, own boolean, doc bigint, copies bigint, data binary"
    )
    return (
        sets.repartition("group", "block")
        .sortWithinPartitions("group", "block", F.desc("own"), "doc")
        .mapInArrow(lambda batches: _compare(batches, like), "a bigint, b bigint, links bigint")
    )


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Likeness = Likeness()
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reached by links),
    n_links (other documents that it links with, copies of its set included).

    Null, empty and blank texts have no shingles and link with nothing; their component is
    their own id. Rows of one id count as one document for links; where an id has several
    texts, n_links adds up what its texts link with. Rows with a null id keep a null component
    and link with nothing. Other columns are not carried; an empty table gives an empty one.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    profiles = stored(_profiles(plain, like), "profiles")
    is_real = F.expr("doc_id is not null and n_shingles > 0")
    real = profiles.filter(is_real)
    first = (
        real.select("set_id", "doc_id").distinct()
        .groupBy("set_id").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    )
    sets = (
        real.join(first.withColumnRenamed("set_id", "key"), F.expr("doc_id = id and set_id = key"))
        .select("id", F.col("n_shingles").alias("n"), "prefix")
    )
    blocks = _in_blocks(_opened(sets, like), like)
    copies = first.groupBy("id").agg(F.max("copies").alias("copies"))
    found = stored(_links(plain.filter("doc_id is not null"), blocks, copies, like), "pairs")
    known = stored(
        real.select("doc_id", "n_shingles", "set_id").join(first, "set_id").drop("set_id").unionByName(
            profiles.filter(~is_real).select("doc_id", "n_shingles"), allowMissingColumns=True
        ),
        "known",
    )
    repeated = known.filter("doc_id <> id").select("doc_id", "id").distinct()
    roots = components(found.select("a", "b").union(repeated.toDF("a", "b")))
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    return (
        known.join(counts, "id", "left")
        .drop("id")
        .join(roots, F.col("doc_id") == roots["id"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("root", "doc_id").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
        )
    )


def one_per_class(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Likeness = Likeness()
) -> DataFrame:
    """The documents whose id is the smallest of their class, with all their columns. Of rows
    that repeat an id, one stays; rows with a null id stay."""
    found = classes(docs, id_col, text_col, like)
    others = (
        found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    )
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    left = row.join(others, F.col("_id") == F.col("_gone"), "left_anti")
    named = left.filter("_id is not null")
    rank = F.row_number().over(Window.partitionBy("_id").orderBy("_text"))
    return named.withColumn("_rank", rank).filter("_rank = 1").select("row.*").union(
        left.filter("_id is null").select("row.*")
    )
