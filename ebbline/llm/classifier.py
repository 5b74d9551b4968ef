"""Weak-label quality classifier.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation
maximisation over the counts of vote patterns, at most 3^labellers rows, estimates how often
each labeller votes what on good and bad documents, without any labelled row. Its posterior
labels train a linear scorer over hashed byte trigrams, which then scores every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import by_slices
from ebbline.llm.shingles import mixed, word_hashes

LABELLERS = (
    "length", "symbols", "letters", "plain_words", "repeats", "variety", "capitals", "function_words", "sentences",
    "word_size",
)

# Frequent function words of the languages at hand.
FUNCTION_WORDS = (
    "the of and to in a is that it for was on are as with be by this from at "
    "le la les de des et un une en est que dans qui pour au du sur par pas avec "
    "der die das und in zu den von mit ist im für auf ein eine sich dem nicht als "
    "el los las y una que en por con para no su es lo del se al"
)

_STOP = np.unique(word_hashes(FUNCTION_WORDS))
_PLAIN = re.compile(r"(?<!\S)[^\W\d_]++[.,;:?!]?(?!\S)")
_OTHER = np.array([c < 128 and not chr(c).isalpha() and c not in b" \t\n\x0b\x0c\r" for c in range(256)])
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"#*$%&|<>")] = 1
_KIND[65:91] = 2
_KIND[list(b".!?")] = 3
_KIND[[0x20, *range(0x09, 0x0E)]] = 4


@dataclass(frozen=True)
class Fit:
    """The scorer is fitted on about ``rows`` documents (never over four times as many), drawn by
    a hash of id and text, with ``2^bits`` weights. Votes are counted over all documents."""

    rows: int = 4096
    bits: int = 14
    em_rounds: int = 100
    steps: int = 300
    smoothing: float = 1.0


def votes(text: str | None) -> list[int]:
    """1 for good, -1 for bad, 0 for nothing, by labeller. Texts without words get one vote:
    bad, for their length."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return [-1, *[0] * (len(LABELLERS) - 1)]
    data = text.encode("utf-8", "surrogatepass")
    kind = _KIND[np.frombuffer(data, np.uint8)]
    symbols, upper, stops, blanks = np.bincount(kind, minlength=5)[1:5].tolist()
    solid = len(data) - blanks
    if n > 2:
        windows = mixed(w[2:] + mixed(w[1:-1] + mixed(w[:-2])))
        again = 1 - len(np.unique(windows)) / len(windows)
    else:
        again = 0.0
    ends = int(np.count_nonzero((kind[:-1] == 3) & (kind[1:] == 4))) + int(kind[-1] == 3)
    letters = solid - int(np.count_nonzero(_OTHER[np.frombuffer(data, np.uint8)]))
    plain = sum(1 for _ in _PLAIN.finditer(text))
    variety = len(np.unique(w)) / n
    stop = np.isin(w, _STOP).mean()
    vote = lambda bad, good: -1 if bad else int(good)
    return [
        vote(n < 20, n >= 50),
        vote(symbols > 0.1 * solid, symbols == 0),
        vote(letters < 0.8 * solid, letters > 0.93 * solid),
        vote(plain < 0.6 * n, plain > 0.9 * n),
        vote(again > 0.4, again < 0.1),
        vote(variety < 0.15, variety > 0.4),
        vote(upper > 0.5 * solid, upper < 0.15 * solid),
        vote(stop < 0.02, stop > 0.1),
        vote(ends > 0.6 * n, 0.02 * n <= ends <= 0.25 * n),
        vote(solid < 2 * n or solid > 15 * n, 3 * n <= solid <= 9 * n),
    ]


def _code(v: list[int]) -> int:
    return sum((x + 1) * 3**i for i, x in enumerate(v))


def _votes_of(code: np.ndarray) -> np.ndarray:
    return np.stack([code // 3**i % 3 for i in range(len(LABELLERS))], 1)


@dataclass(frozen=True)
class LabelModel:
    """``good``: the share of good documents; ``rates[j, c, v]``: how often labeller j votes
    v (bad, nothing, good) on class c (bad, good); ``posterior`` by pattern code."""

    good: float
    rates: np.ndarray
    posterior: np.ndarray

    @staticmethod
    def fit(codes: np.ndarray, counts: np.ndarray, form: Fit = Fit()) -> LabelModel:
        every = _votes_of(np.arange(3 ** len(LABELLERS)))
        seen = _votes_of(codes)
        hot = np.eye(3)[seen]
        p = 1 / (1 + np.exp(2.0 * (seen == 0).sum(1) - (seen == 2).sum(1)))
        weight = counts.astype(float)
        good, rates = 0.5, np.full((len(LABELLERS), 2, 3), 1 / 3)
        for _ in range(form.em_rounds if weight.sum() else 0):
            parts = np.stack([(1 - p) * weight, p * weight])
            rates = np.einsum("cn,njv->jcv", parts, hot) + form.smoothing
            rates /= rates.sum(2, keepdims=True)
            good = float((parts[1].sum() + form.smoothing) / (weight.sum() + 2 * form.smoothing))
            last, p = p, LabelModel._posterior(good, rates, seen)
            if np.abs(p - last).max() < 1e-9:
                break
        return LabelModel(good, rates, LabelModel._posterior(good, rates, every))

    @staticmethod
    def _posterior(good: float, rates: np.ndarray, v: np.ndarray) -> np.ndarray:
        logs = np.log(rates)
        gap = np.log(good) - np.log1p(-good)
        for j in range(v.shape[1]):
            gap = gap + logs[j, 1, v[:, j]] - logs[j, 0, v[:, j]]
        return 1 / (1 + np.exp(-np.clip(gap, -700, 700)))

    def accuracies(self) -> dict[str, float]:
        """How often a labeller is right when it votes."""
        share = np.array([1 - self.good, self.good])
        right = self.rates[:, 0, 0] * share[0] + self.rates[:, 1, 2] * share[1]
        wrong = self.rates[:, 0, 2] * share[0] + self.rates[:, 1, 0] * share[1]
        return dict(zip(LABELLERS, (right / (right + wrong)).tolist()))


def _trigrams(text: str, bits: int) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.uint32)
    h = (raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(2654435761)
    return h >> np.uint32(32 - bits)


@dataclass(frozen=True)
class Scorer:
    """A logistic model of the mean weight of a text's trigrams."""

    weights: np.ndarray
    bias: float
    bits: int

    def __call__(self, text: str | None) -> float:
        found = _trigrams(text or "", self.bits)
        mean = float(self.weights[found].mean()) if len(found) else 0.0
        return float(1 / (1 + np.exp(-np.clip(mean + self.bias, -700, 700))))

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], form: Fit) -> Scorer:
        """``rows``: (buckets, shares, posterior). Adam on the logistic loss, classes balanced."""
        if not rows:
            return Scorer(np.zeros(1 << form.bits), 0.0, form.bits)
        at = np.concatenate([r[0] for r in rows]).astype(np.int64)
        x = np.concatenate([r[1] for r in rows])
        row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        y = np.array([r[2] for r in rows])
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        weight = (y / share + (1 - y) / (1 - share)) / (2 * len(y))
        w, bias = np.zeros(1 << form.bits), 0.0
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for step in range(1, form.steps + 1):
            z = np.bincount(row, x * w[at], len(rows)) + bias
            gap = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y) * weight
            g = np.bincount(at, x * gap[row], len(w)) + 1e-7 * w
            gb = gap.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            a, b = 1 - 0.9**step, 1 - 0.999**step
            w = w - 0.3 * (m / a) / (np.sqrt(v / b) + 1e-9)
            bias -= 0.05 * (mb / a) / (np.sqrt(vb / b) + 1e-9)
        return Scorer(w, float(bias), form.bits)


def vote_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pattern codes and how many documents have each, over all documents; counted per task
    first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                total[_code(votes(batch.column(0)[i].as_py()))] += 1
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    counted = docs.select("text").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    rows = sorted((r.code, r.n) for r in counted.collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def _sample(docs: DataFrame, total: int, label: LabelModel, form: Fit) -> list[tuple]:
    """Hashed shares and posteriors of about ``form.rows`` documents, in order of their hash."""
    share = min(1.0, form.rows / max(1, total))
    h = F.xxhash64("doc_id", "text")
    some = docs.select(h.alias("h"), "text").filter(F.col("h") < int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else F.lit(True))
    shared = docs.sparkSession.sparkContext.broadcast(label.posterior)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for h, text in zip(*(c.to_pylist() for c in batch.columns)):
            at, n = np.unique(_trigrams(text or "", form.bits), return_counts=True)
            rows.append({"h": h, "at": at.astype(np.int32), "x": n / max(1, n.sum()), "y": shared.value[_code(votes(text))]})
        return pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("h", pa.int64()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float64())), ("y", pa.float64())])
    made = some.limit(4 * form.rows).mapInArrow(by_slices(work), "h bigint, at array<int>, x array<double>, y double")
    rows = sorted(made.collect(), key=lambda r: (r.h, r.y))
    return [(np.array(r["at"], np.int64), np.array(r.x), r.y) for r in rows]


def fit(docs: DataFrame, form: Fit = Fit()) -> tuple[LabelModel, Scorer]:
    codes, counts = vote_counts(docs)
    label = LabelModel.fit(codes, counts, form)
    return label, Scorer.fit(_sample(docs, int(counts.sum()), label, form), form)


def classify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    form: Fit = Fit(),
    models: tuple[LabelModel, Scorer] | None = None,
) -> DataFrame:
    """One row per input row: doc_id, votes (by LABELLERS), posterior (of the votes), score (of
    the scorer) and kept (score of a half or more).

    Null and empty texts have no words and score the bias alone; ids may be null or repeated;
    other columns are not carried; an empty table gives an empty one.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    label, scorer = models or fit(plain, form)
    shared = docs.sparkSession.sparkContext.broadcast((label.posterior, scorer))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        posterior, score = shared.value
        cast = [votes(t) for t in batch.column(1).to_pylist()]
        scores = np.array([score(t) for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(cast, pa.list_(pa.int32())),
             pa.array(posterior[[_code(v) for v in cast]]), pa.array(scores), pa.array(scores >= 0.5)],
            ["doc_id", "votes", "posterior", "score", "kept"],
        )

    id_type = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(
        by_slices(work), f"doc_id {id_type}, votes array<int>, posterior double, score double, kept boolean"
    )
