"""Sampled SentencePiece segmentations without replacement, and their decoding.

A text is a lattice: every stretch that is a piece of the vocabulary is an edge, and pieces
never reach over the start of a word and the blanks before it, so lattices of words are chained. Weights of edges give
every segmentation a probability. Gumbel noise on whole segmentations ranks them; the search
always opens the unexplored part of the lattice whose perturbed bound is the highest, so the
first k leaves are the top k: k distinct segmentations drawn without replacement. Noise depends
on the row key alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.shingles import mixed

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: the mark that stands for a blank.
MARK = "▁"

# Characters or steps of a run without blanks from which on it is followed one by one.
_LONG_RUN = 512

_STEP = np.uint64(0xD1342543DE82EF95)
_ADD = np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: texts of pieces by id (blanks for marks), log weights, ids of bytes.

    The model ranks pieces by merges. Their log weights follow Zipf's law over these ranks:
    ``-sharpness * log(2 + rank)``; pieces without a rank, such as runs of blanks, come last.
    A character that is no piece costs its bytes.
    """

    texts: tuple[str, ...]
    weights: dict[int, float] = field(hash=False)
    byte_ids: tuple[int, ...]
    byte_weight: float

    @staticmethod
    def load(path: str = DEFAULT_MODEL, sharpness: float = 1.0) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        texts = ["" if special(i) else model.id_to_piece(i).replace(MARK, " ") for i in range(n)]
        found = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        weights = {
            i: -sharpness * math.log(2.0 + min(n, -model.get_score(i)))
            for i in range(n)
            if texts[i] and not model.is_byte(i)
        }
        if len(found) != 256:
            raise ValueError("the model needs a piece for every byte")
        return Pieces(tuple(texts), weights, tuple(found[b] for b in range(256)), -sharpness * math.log(2.0 + n))


def _units(texts: list[str]) -> re.Pattern:
    """A pattern that cuts texts where no piece can reach over: before characters that pieces
    have at most at their start, and from other characters to marks that never follow them."""
    follow: dict[str, set[str]] = {}
    for t in texts:
        for a, b in zip(t, t[1:]):
            follow.setdefault(b, set()).add(a)
    ascii_marks = {chr(c) for c in range(128) if not chr(c).isalpha()}
    marks, before = set(ascii_marks), None
    while marks != before:
        before = set(marks)
        marks = {c for c in before if follow.get(c, set()) <= before}
    starts = {c for c in marks if c not in follow}
    some = lambda chars: "".join(f"\\x{ord(c):02x}" for c in sorted(chars))
    inner = f"[{some(marks - starts)}]*" if marks - starts else ""
    glued = inner if any(follow[c] & starts for c in marks - starts) else ""
    return re.compile(f"[{some(starts)}]{glued}[^{some(marks)}]*|{inner}[^{some(marks)}]+|{inner[:-1]}+" if inner else f"[{some(starts)}][^{some(marks)}]*|[^{some(marks)}]+")


def _look_up(keys: np.ndarray, bucket: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes are among the sorted keys, in order, and where. ``bucket`` tells where
    the keys with given first 16 bits begin."""
    first = (h >> np.uint64(48)).astype(np.int64)
    low, high = bucket[first], bucket[first + 1]
    todo = np.flatnonzero(low < high)
    found = np.full(len(h), -1, np.int64)
    low, high, h = low[todo], high[todo], h[todo]
    while len(todo):
        hit = keys[low] == h
        found[todo[hit]] = low[hit]
        low = low + 1
        on = np.flatnonzero(~hit & (low < high))
        todo, low, high, h = todo[on], low[on], high[on], h[on]
    hit = np.flatnonzero(found >= 0)
    return hit, found[hit]


class Lattices:
    """Finds the edges of many words at once: pieces by length, as sorted hashes of prefixes."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.bytes = np.array(pieces.byte_ids)
        self.units = _units([pieces.texts[i] for i in pieces.weights])
        ids = np.array(sorted(pieces.weights), np.int64)
        texts = [pieces.texts[i] for i in ids]
        weights = np.array([pieces.weights[i] for i in ids.tolist()])
        sizes = np.array([len(t) for t in texts])
        # So many characters from the end of a word, products of probabilities stay far from underflow.
        heaviest = max(4 * abs(pieces.byte_weight), float(np.abs(weights).max(initial=0.0)), 1e-9)
        self.plain = int(min(600 / heaviest, 64))
        self.levels = []
        h = np.zeros(len(ids), np.uint64)
        for n in range(int(sizes.max())):
            inside = sizes > n
            ids, weights, sizes, h = ids[inside], weights[inside], sizes[inside], h[inside]
            texts = [t for t in texts if len(t) > n]
            codes = np.array([ord(t[n]) for t in texts], np.uint64)
            h = (h ^ mixed(codes + _ADD)) * _STEP
            keys, place = np.unique(h, return_inverse=True)
            piece, weight = np.full(len(keys), -1), np.zeros(len(keys))
            full = sizes == n + 1
            piece[place[full]], weight[place[full]] = ids[full], weights[full]
            bucket = np.searchsorted(keys >> np.uint64(48), np.arange((1 << 16) + 1, dtype=np.uint64)).astype(np.int32)
            self.levels.append((keys, bucket, piece, weight))

    def build(self, words: list[str]) -> Lattice:
        """The lattices of words, which are stretches that no piece reaches over."""
        whole = "".join(words)
        plain = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        codes = mixed(plain.astype(np.uint64) + _ADD)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(codes))
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        count = np.zeros(len(codes), np.int64)
        parts = []

        def add(nodes, length, ids, weights):
            parts.append((nodes, count[nodes], np.full(len(nodes), length), ids, weights))
            count[nodes] += 1

        for n, (keys, bucket, piece, weight) in enumerate(self.levels):
            h = (h ^ codes[at + n]) * _STEP
            hit, found = _look_up(keys, bucket, h)
            at, h = at[hit], h[hit]
            full = piece[found] >= 0
            add(at[full], n + 1, piece[found[full]], weight[found[full]])
            if not n and len(rest := np.flatnonzero(count == 0)):
                c = plain[rest].astype(np.int64)
                n_bytes = 1 + (c >= 0x80).astype(int) + (c >= 0x800) + (c >= 0x10000)
                single = np.where(c < 0x80, self.bytes[np.minimum(c, 0x7F)], -1 - c)
                add(rest, 1, single, n_bytes * self.pieces.byte_weight)
            more = np.flatnonzero(left[at] > n + 1)
            at, h = at[more], h[more]
            if not len(at):
                break
        edges = [np.concatenate(p) for p in zip(*parts)]
        parts.clear()
        return Lattice(ends - sizes, left, count, *edges, self.plain)


class Lattice:
    """Edges by node with the probability of each, given that a segmentation reaches its node.

    A node is a character; nodes of a word run up to its end.
    """

    def __init__(self, first_node, left, count, nodes, place, lengths, ids, weights, plain=0):
        """Edges lie in order of how far their nodes are from the ends of words, so bounds are
        summed over slices; those of one node lie together, the longest first. Up to ``plain``
        characters from the end probabilities are summed as they are, beyond as logarithms."""
        self.first_node = first_node
        far = left.astype(np.int16) if left.max() < 1 << 15 else left
        by_left = np.argsort(far, kind="stable")
        self.first = np.empty(len(left), np.int64)
        self.first[by_left] = np.cumsum(count[by_left]) - count[by_left]
        self.count = count
        order = np.empty(len(nodes), np.int64)
        order[self.first[nodes] + count[nodes] - 1 - place] = np.arange(len(nodes))
        nodes, lengths, weights = nodes[order], lengths[order], weights[order]
        self.node, self.ids = nodes, ids[order]
        self.next = nodes + lengths
        self.done = lengths == left[nodes]
        bound = np.zeros(len(left) + 1)
        low = self.first[by_left]
        turns = np.flatnonzero(np.diff(left[by_left])) + 1
        cuts = np.concatenate([[0], turns, [len(left)]]).tolist()
        edge_cuts = np.concatenate([low[cuts[:-1]], [len(nodes)]]).tolist()
        self.p, self.log_p = np.empty(len(nodes)), np.empty(len(nodes))
        self.cumulative = np.empty(len(nodes))
        after = np.where(self.done, len(left), self.next)
        sizes = count[by_left]
        # The far nodes of the one longest word come alone: a long run without blanks is followed
        # node by node, and its edges are scaled together.
        alone = int(np.searchsorted(-np.diff(cuts), -1))
        if len(cuts) - 1 - alone < _LONG_RUN:
            alone = len(cuts) - 1
        near = min(alone, int(np.searchsorted(left[by_left[cuts[:-1]]], plain, side="right")))
        self._sum_near(by_left, low, sizes, cuts[: near + 1], edge_cuts[: near + 1], weights, after, bound)
        for i in range(near, alone):
            a, b, x, y = cuts[i], cuts[i + 1], edge_cuts[i], edge_cuts[i + 1]
            own, size = low[a:b] - x, sizes[a:b]
            v = weights[x:y] + bound[after[x:y]]
            top = np.maximum.reduceat(v, own)
            v -= np.repeat(top, size)
            e = np.exp(v)
            sums = np.add.reduceat(e, own)
            logs = np.log(sums)
            bound[by_left[a:b]] = top + logs
            e /= np.repeat(sums, size)
            v -= np.repeat(logs, size)
            self.p[x:y], self.log_p[x:y] = e, np.minimum(v, 0.0)
            run = np.cumsum(e)
            run -= np.repeat(run[own] - e[own], size)
            run[own + size - 1] = np.inf
            self.cumulative[x:y] = run
        if alone < len(cuts) - 1:
            self._follow(by_left[cuts[alone] :], edge_cuts[alone], weights, after, bound)

    def _sum_near(self, by_left, low, sizes, cuts, edge_cuts, weights, after, bound) -> None:
        """What the slices compute, for the nodes near the ends of words and without logarithms."""
        nodes, edges = cuts[-1], edge_cuts[-1]
        cost, mass = np.exp(weights[:edges]), np.ones(len(bound))
        for a, b, x, y in zip(cuts, cuts[1:], edge_cuts, edge_cuts[1:]):
            own, size = low[a:b] - x, sizes[a:b]
            e = cost[x:y] * mass[after[x:y]]
            sums = np.add.reduceat(e, own)
            mass[by_left[a:b]] = sums
            e /= np.repeat(sums, size)
            self.p[x:y] = e
            run = np.cumsum(e)
            run -= np.repeat(run[own] - e[own], size)
            run[own + size - 1] = np.inf
            self.cumulative[x:y] = run
        self.log_p[:edges] = np.minimum(np.log(self.p[:edges]), 0.0)
        bound[by_left[:nodes]] = np.log(mass[by_left[:nodes]])

    def _follow(self, order: np.ndarray, x: int, weights: np.ndarray, after: np.ndarray, bound: np.ndarray) -> None:
        """What the slices compute, for nodes that come one at a time with edges from ``x`` on."""
        known, exp, log = bound.tolist(), math.exp, math.log
        far, cost = after[x:].tolist(), weights[x:].tolist()
        sizes, high = self.count[order], 0
        for node, size in zip(order.tolist(), sizes.tolist()):
            low, high = high, high + size
            v = [c + known[t] for c, t in zip(cost[low:high], far[low:high])]
            top = max(v)
            known[node] = top + log(sum([exp(a - top) for a in v]))
        bound[:] = known
        v = np.minimum(weights[x:] + bound[after[x:]] - np.repeat(bound[order], sizes), 0.0)
        e = np.exp(v)
        own = np.cumsum(sizes) - sizes
        run = np.cumsum(e)
        run -= np.repeat(run[own] - e[own], sizes)
        run[own + sizes - 1] = np.inf
        self.p[x:], self.log_p[x:], self.cumulative[x:] = e, v, run

    def pick(self, nodes: np.ndarray, uniform: np.ndarray) -> np.ndarray:
        e = self.first[nodes]
        late = np.flatnonzero(uniform >= self.cumulative[e])
        while len(late):
            e[late] += 1
            late = late[uniform[late] >= self.cumulative[e[late]]]
        return e


def _uniforms_of_steps(keys: np.ndarray, sample: int, word: np.ndarray, step: int, n: int) -> np.ndarray:
    """``uniforms`` of one key and word for ``n`` steps from ``step`` on."""
    turns = np.arange(step, step + n, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = keys[:1] + word[:1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = mixed(x ^ (turns + np.uint64(sample * 0x632BE59BD9B4E019 % (1 << 64))))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def uniforms(keys: np.ndarray, sample: int, word: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the row key, the sample, the word and the step."""
    x = keys + word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = mixed(x ^ np.uint64((sample * 0x632BE59BD9B4E019 + step * 0xC2B2AE3D27D4EB4F) % (1 << 64)))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _walk(lattice: Lattice, nodes, keys, word, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Sample from given nodes to the ends of their words, all words a step at a time: the edges
    in order of the words, and how many each word took."""
    n = len(nodes)
    active, counts, steps, step = np.arange(n), np.zeros(n, np.int64), [], 0
    while len(active) > 1 or len(active) and step < _LONG_RUN:
        e = lattice.pick(nodes, uniforms(keys, sample, word, step))
        steps.append((active, e))
        counts[active] += 1
        on = ~lattice.done[e]
        active, nodes, keys, word = active[on], lattice.next[e[on]], keys[on], word[on]
        step += 1
    tail: list[int] = []
    if len(active):
        tail = _walk_alone(lattice, int(nodes[0]), keys, word, sample, step)
        counts[active] += len(tail)
    offset = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    for i, (who, e) in enumerate(steps):
        out[offset[who] + i] = e
    if tail:
        begin = int(offset[active[0]]) + step
        out[begin : begin + len(tail)] = tail
    return out, counts


def _walk_alone(lattice: Lattice, node: int, keys, word, sample: int, step: int) -> list[int]:
    """The rest of a walk that only one word is left of, with the numbers of its steps."""
    out: list[int] = []
    first, cumulative, following, done = lattice.first, lattice.cumulative, lattice.next, lattice.done
    while True:
        for u in _uniforms_of_steps(keys, sample, word, step, _LONG_RUN).tolist():
            e = int(first[node])
            while u >= cumulative[e]:
                e += 1
            out.append(e)
            if done[e]:
                return out
            node = int(following[e])
        step += _LONG_RUN


class Path:
    """One sampled segmentation and, per decision on it, the perturbed bound of all that leaves
    it there. At decision ``turn`` the edges ``barred`` belong to earlier samples."""

    def __init__(self, lattice, edges, words, value, ratio, turn=0, barred=()):
        """``ratio`` is the logarithm of what leaves the path at each decision from ``turn`` on, over its noise."""
        self.edges, self.words, self.value, self.turn, self.barred = edges, words, value, turn, barred
        log_p = lattice.log_p[edges]
        run = np.cumsum(log_p)
        self.log_p = float(run[-1]) if len(run) else 0.0
        self.free = (run - log_p)[turn:] + ratio
        self._best()

    def _best(self) -> None:
        self.at, self.best = self.turn, -math.inf
        if len(self.free):
            i = int(np.argmax(self.free))
            self.at, free = self.turn + i, float(self.free[i])
            if free > -math.inf:
                self.best = -float(np.logaddexp(-self.value, -free))

    def leave(self) -> int:
        at = self.at
        self.free[at - self.turn] = -np.inf
        self._best()
        return at


def row_keys(ids: list) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(repr(i)) for i in ids], np.uint64)


def samples(lattices: Lattices, keys: np.ndarray, texts: list[str], k: int) -> list[list[tuple]]:
    """Per text up to k (ids, log probability, inclusion score), best perturbed value first.

    The inclusion score is the probability that the segmentation is among the drawn ones, given
    the perturbed value of the first one left out; 1 where none is left out.
    """
    parts = [lattices.units.findall(f" {t}") if t else [] for t in texts]
    flat = [w for p in parts for w in p]
    known = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    seen = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    found: list[list[Path]] = [[] for _ in texts]
    if not known:
        return [[(np.empty(0, np.int32), 0.0, 1.0)] for _ in texts]
    lattice = lattices.build(list(known))
    doc = np.repeat(np.arange(len(texts)), sizes)
    word = np.arange(len(seen)) - starts[doc]

    def add(tails: list[tuple], flat: np.ndarray, j: int):
        """Paths of (text, words, value, decision, edges barred there, edges before it, number of
        edges from it on) and the latter edges of all of them."""
        sizes = np.array([t[6] for t in tails])
        ends = np.cumsum(sizes)
        first = ends - sizes
        turns = np.array([t[3] for t in tails])
        place = np.arange(len(flat)) + np.repeat(turns - first, sizes)
        noise = uniforms(np.repeat(keys[[t[0] for t in tails]], sizes), -1 - j, place, 0)
        # Noise before a decision is bounded by the value of the sample; bounding keeps its order.
        left = -np.expm1(lattice.log_p[flat])
        for low, t in zip(first.tolist(), tails):
            if t[4]:
                left[low] -= lattice.p[list(t[4])].sum()
        left[left < 1e-12] = 0.0
        with np.errstate(divide="ignore"):
            ratio = np.log(left / -np.log(noise))
        for low, high, (d, words, value, turn, barred, before, _) in zip(first.tolist(), ends.tolist(), tails):
            edges = flat[low:high] if before is None else np.concatenate([before, flat[low:high]])
            found[d].append(Path(lattice, edges, words, value, ratio[low:high], turn, barred))

    nodes = lattice.first_node[seen]
    edges, counts = _walk(lattice, nodes, keys[doc], word, 0)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    of_word = np.repeat(word, counts)
    tails = []
    for d, u in enumerate(uniforms(keys, 0, np.array([-1]), 0).tolist()):
        low, high = int(cuts[starts[d]]), int(cuts[starts[d] + sizes[d]])
        tails.append((d, of_word[low:high], -math.log(-math.log(u)), 0, (), None, high - low))
    add(tails, edges, 0)
    for j in range(1, k):
        turns, more = [], []
        draws = uniforms(keys, j, np.array([-2]), 0)
        for d in range(len(texts)):
            parent = max(found[d], key=lambda p: p.best)
            if parent.best == -math.inf:
                continue
            value, at = parent.best, parent.leave()
            barred = (int(parent.edges[at]), *(parent.barred if at == parent.turn else ()))
            e0 = parent.edges[at]
            node = lattice.node[e0]
            low = int(lattice.first[node])
            p = lattice.p[low : low + int(lattice.count[node])].copy()
            p[[b - low for b in barred]] = 0.0
            run = np.cumsum(p)
            r = float(draws[d]) * run[-1]
            e = low + int(min(np.searchsorted(run, r, side="right"), np.flatnonzero(p)[-1]))
            here = int(parent.words[at])
            first = starts[d] + here + 1
            rest = np.arange(first, starts[d] + sizes[d])
            begin = lattice.first_node[seen[rest]]
            numbers = word[rest]
            if not lattice.done[e]:
                begin = np.concatenate([[lattice.next[e]], begin])
                numbers = np.concatenate([[here], numbers])
            turns.append((d, parent, at, e, here, value, barred, len(begin)))
            more.append((begin, numbers, np.full(len(begin), keys[d], np.uint64)))
        if not turns:
            break
        begin, numbers, key = map(np.concatenate, zip(*more))
        edges, counts = _walk(lattice, begin, key, numbers, j)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        of_word, low = np.repeat(numbers, counts), 0
        tails, flat = [], []
        for d, parent, at, e, here, value, barred, n in turns:
            a, b = int(cuts[low]), int(cuts[low + n])
            low += n
            flat += [[e], edges[a:b]]
            words = np.concatenate([parent.words[:at], [here], of_word[a:b]])
            tails.append((d, words, value, at, barred, parent.edges[:at], b - a + 1))
        add(tails, np.concatenate(flat), j)
    out = []
    for paths in found:
        left_out = max(p.best for p in paths)
        out.append(
            [(_ids(lattices.pieces, lattice.ids[p.edges]), p.log_p, -math.expm1(-math.exp(min(700.0, p.log_p - left_out)))) for p in paths]
        )
    return out


def _ids(pieces: Pieces, ids: np.ndarray) -> np.ndarray:
    """Ids of pieces, with a character that is none as the ids of its bytes."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids.astype(np.int32)
    parts, last = [], 0
    for i in odd.tolist():
        parts += [ids[last:i], [pieces.byte_ids[b] for b in chr(-1 - int(ids[i])).encode()]]
        last = i + 1
    return np.concatenate([*parts, ids[last:]]).astype(np.int32)


class Decoder:
    """Texts of ids: pieces are taken from a table and lie one after the other."""

    def __init__(self, pieces: Pieces):
        byte = {i: bytes([b]) for b, i in enumerate(pieces.byte_ids)}
        self.data = pa.array([byte.get(i, t.encode()) for i, t in enumerate(pieces.texts)], pa.binary())

    def __call__(self, ids: list[int]) -> str:
        return self.many(pa.array([ids], pa.list_(pa.int32())))[0]

    def many(self, lists: pa.ListArray) -> list[str | None]:
        found = self.data.take(lists.flatten())
        bounds = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
        data = memoryview(found.buffers()[2] or b"")
        sizes = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], np.int64)
        ends = np.cumsum(sizes)
        texts = []
        for known, low, high in zip(lists.is_valid().to_pylist(), (ends - sizes).tolist(), ends.tolist()):
            text = str(data[bounds[low] : bounds[high]], "utf-8", "replace")
            texts.append((text[1:] if text[:1] == " " else text) if known else None)
        return texts


def _cut(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes."""
    ends = np.cumsum(np.array(pc.binary_length(texts).fill_null(0)))
    low = 0
    while low < len(texts):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield low, high
        low = high


def encode(
    docs: DataFrame,
    pieces: Pieces,
    k: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = 400_000,
) -> DataFrame:
    """Up to k rows per input row: doc_id, rank (from 1), ids, log_prob, inclusion.

    Texts with fewer than k segmentations give all they have. Null and empty texts have one,
    without ids. Equal ids draw equal noise, so repeated rows repeat their result; null ids are
    a key like any other. Other columns are not carried; an empty table gives an empty one.
    Texts are worked on about ``batch_bytes`` bytes at a time, longer ones alone.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Lattices(pieces))
    id_type = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = shared.value
        # Freeing one large block lets the C library keep freed memory for the next array; otherwise
        # every array of a batch is mapped, cleared and unmapped anew.
        np.empty(31 << 20, np.uint8)
        for batch in batches:
            for low, high in _cut(batch.column(1), batch_bytes):
                part = batch.column(0).slice(low, high - low)
                texts = [t or "" for t in batch.column(1).slice(low, high - low).to_pylist()]
                drawn = samples(lattices, row_keys(part.to_pylist()), texts, k)
                rows = np.repeat(np.arange(high - low), [len(d) for d in drawn])
                flat = [s for d in drawn for s in d]
                offsets = np.concatenate([[0], np.cumsum([len(s[0]) for s in flat])]).astype(np.int32)
                values = np.concatenate([s[0] for s in flat]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.take(pa.array(rows)),
                        pa.array([r + 1 for d in drawn for r in range(len(d))], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                        pa.array([s[1] for s in flat], pa.float64()),
                        pa.array([s[2] for s in flat], pa.float64()),
                    ],
                    ["doc_id", "rank", "ids", "log_prob", "inclusion"],
                )

    return plain.mapInArrow(
        run, f"doc_id {id_type}, rank int, ids array<int>, log_prob double, inclusion double"
    )


def decode(encoded: DataFrame, pieces: Pieces, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The rows with the text of their ids as one more column; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = Decoder(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                made = text.many(part.column(part.schema.get_field_index(ids_col)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(made, pa.string())], [*part.schema.names, text_col]
                )

    from pyspark.sql.types import StringType, StructType

    schema = StructType([*encoded.schema.fields]).add(text_col, StringType())
    return encoded.mapInArrow(run, schema)
