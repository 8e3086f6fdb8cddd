"""Quality by a generalised additive model with pairwise interactions.

Each text becomes a few counts and shares. Cyclic boosting fits shallow trees to one binned feature at a time,
then to the strongest pairs; every tree is added into its feature's lookup table, so a score is a sum of table
entries. The tables have a fixed size and are broadcast; the rows learned from are a bounded sample.

Cases: a null or empty text has all-zero features and still gets a score; without labels of both kinds the
score is the share of label 1 (0.5 without any label). Null ids are in no held-out fold. Documents that share an id
each get a score, and one of them is learned from. Equal texts have equal scores; of equally good cuts and pairs the
first is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossrank.llm.common import fold, table
from crossrank.llm.labelled import labelled

#: Labelled rows learned from, at most.
LEARN_ROWS = 12_000
BINS, PAIR_BINS, PAIRS = 32, 12, 10
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.15
#: A leaf has at least this many rows, and its value is damped by this much weight.
LEAF_ROWS, DAMP = 10, 2.0
MODULUS, HELD_OUT, CUT = 5, 0, 0.3

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
#: Bytes of marks that prose seldom has, and of ordinary punctuation.
_MARKS = np.frombuffer(b"#$%&*|!<>{}[]=\\/_~^@+", np.uint8)
_POINTS = np.frombuffer(b".,;:?'\"()-", np.uint8)

FEATURES = (
    "log_bytes", "log_words", "upper", "lower", "digit", "marks", "points", "space", "newlines", "not_ascii",
    "word_bytes", "word_spread", "distinct", "repeated", "top_word", "short_words", "distinct_lines", "log_line", "bars", "entropy",
)


def features(text: str) -> list[float]:
    """Counts and shares of one whole text, in the order of ``FEATURES``."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    lines = raw.split(b"\n")
    p = h[h > 0] / n
    return [
        np.log1p(n), np.log1p(len(words)), h[_UPPER].sum() / n, h[_LOWER].sum() / n, h[_DIGIT].sum() / n, h[_MARKS].sum() / n,
        h[_POINTS].sum() / n, h[32] / n, h[10] / n, h[128:].sum() / n, sizes.mean(), sizes.std(), len(seen) / w,
        sum(a == b for a, b in zip(words, words[1:])) / w, max(seen.values(), default=0) / w, (sizes <= 3).mean(),
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), h[124] / w, -(p * np.log(p)).sum(),
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t or "") for t in texts], float).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    """Edges of bins, and the tables that scores add up from."""

    base: float
    edges: list[np.ndarray]
    tables: np.ndarray  # features x BINS
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray  # pairs x PAIR_BINS x PAIR_BINS

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, e in enumerate(self.edges):
            total += self.tables[f][np.searchsorted(e, x[:, f], "right")]
        bins = {f: np.searchsorted(self.coarse[f], x[:, f], "right") for pair in self.pairs for f in pair}
        for t, (a, b) in zip(self.pair_tables, self.pairs, strict=True):
            total += t[bins[a], bins[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + DAMP)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + DAMP)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """A tree of the given depth over one feature's bins: the value of each bin."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    if not depth or len(g) < 2:
        return out
    cg, ch, cn = g.cumsum()[:-1], h.cumsum()[:-1], n.cumsum()[:-1]
    gain = _gain(cg, ch) + _gain(g.sum() - cg, h.sum() - ch) - _gain(g.sum(), h.sum())
    gain[(cn < LEAF_ROWS) | (n.sum() - cn < LEAF_ROWS)] = -1
    k = int(gain.argmax())
    if gain[k] > 1e-9:
        out[: k + 1] = _tree(g[: k + 1], h[: k + 1], n[: k + 1], depth - 1)
        out[k + 1 :] = _tree(g[k + 1 :], h[k + 1 :], n[k + 1 :], depth - 1)
    return out


def _cross(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut on each of two features: its gain and the value of each cell."""
    quads = []
    for a in (g, h, n):
        c = a.cumsum(0).cumsum(1)
        low, left, top, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        quads.append((low, left - low, top - low, all_ - left - top + low))
    gain = sum(_gain(x, y) for x, y in zip(quads[0], quads[1], strict=True)) - _gain(g.sum(), h.sum())
    gain = np.where(np.minimum.reduce(quads[2]) < LEAF_ROWS / 2, -1.0, gain)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    if gain[i, j] <= 0:
        return 0.0, np.zeros_like(g)
    v = [_leaf(x[i, j], y[i, j]) for x, y in zip(quads[0], quads[1], strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting: single features round by round, then the strongest pairs."""
    count = x.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = Model(float(np.log(share / (1 - share))), [np.zeros(0)] * count, np.zeros((count, BINS)), [np.zeros(0)] * count, [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [_edges(x[:, f], BINS) for f in range(count)]
    model.coarse = [_edges(x[:, f], PAIR_BINS) for f in range(count)]
    bins = [np.searchsorted(model.edges[f], x[:, f], "right") for f in range(count)]
    coarse = [np.searchsorted(model.coarse[f], x[:, f], "right") for f in range(count)]
    sizes = [np.bincount(b, minlength=BINS) for b in bins]
    total = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for f in range(count):
            p = 1 / (1 + np.exp(-total))
            g, h = np.bincount(bins[f], y - p, BINS), np.bincount(bins[f], p * (1 - p), BINS)
            step = RATE * _tree(g, h, sizes[f], 2)
            model.tables[f] += step
            total += step[bins[f]]
    p = 1 / (1 + np.exp(-total))
    cell = {(a, b): coarse[a] * PAIR_BINS + coarse[b] for a in range(count) for b in range(a)}
    grid = lambda w, c: np.bincount(c, w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    ones = np.ones(len(y))
    model.pairs = sorted(cell, key=lambda k: (-_cross(grid(y - p, cell[k]), grid(p * (1 - p), cell[k]), grid(ones, cell[k]))[0], k))[:PAIRS]
    model.pair_tables = np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for k, pair in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _cross(grid(y - p, cell[pair]), grid(p * (1 - p), cell[pair]), grid(ones, cell[pair]))[1]
            model.pair_tables[k] += step
            total += step.ravel()[cell[pair]]
    return model


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> Model:
    sample = labelled(docs, labels, "quality", MODULUS, HELD_OUT, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = sorted(sample.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<double>").collect())
    return fit(np.array([r.x for r in got]).reshape(len(got), len(FEATURES)), np.array([r.y for r in got], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(matrix(b.column(1).to_pylist())))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
