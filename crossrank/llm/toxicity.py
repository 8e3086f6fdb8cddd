"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words in lower case, without marks around them, and the words' beginnings.
Terms are hashed; the buckets that tell most about the label (chi-squared, on the sample learned from) become
features. Beside a weight for each feature the machine learns a vector for each, whose inner products weigh
pairs of terms that occur together. The model has a fixed size and is broadcast.

Cases: a null or empty text has no terms and gets the bias alone; without labels of both kinds every score is
the share of label 1 (0.5 without any label). Null ids are in no held-out fold. Documents that share an id each get
a score, and one of them is learned from. Equal texts have equal scores; of equally telling buckets the lower is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossrank.llm.common import fold, table
from crossrank.llm.labelled import labelled

#: Labelled rows learned from, at most; hash buckets; features kept; factors of a feature.
LEARN_ROWS = 8_000
BUCKETS, KEPT, FACTORS = 1 << 20, 1024, 8
#: Bytes of the beginnings of words that are terms too.
STEMS = (4, 5, 6, 7, 8)
EPOCHS, BATCH, RATE, DAMP = 40, 256, 0.1, 1e-5
MODULUS, HELD_OUT, CUT = 4, 2, 0.3
#: Words that a worker remembers.
REMEMBERED = 400_000

_AROUND = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def buckets(word: bytes) -> tuple[int, ...]:
    """Hash buckets of a word (lower case) and of its beginnings."""
    w = word.strip(_AROUND)
    if not w:
        return ()
    h = xxhash.xxh3_64_intdigest
    return (h(w) % BUCKETS, *(h(w[:k] + b"*") % BUCKETS for k in STEMS if len(w) >= k))


def words(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "surrogatepass").split())


def terms(text: str | None) -> list[int]:
    """Distinct hash buckets of a text."""
    return sorted({b for w in words(text) for b in buckets(w)})


@dataclass
class Model:
    bias: float
    buckets: np.ndarray  # kept hash buckets, sorted
    weights: np.ndarray
    factors: np.ndarray  # features x FACTORS

    def scorer(self):
        """A function from texts to scores that remembers words."""
        at = {int(b): k for k, b in enumerate(self.buckets)}
        known: dict[bytes, tuple[int, ...]] = {}

        def features(text: str | None) -> list[int]:
            out: set[int] = set()
            for w in words(text):
                f = known.get(w)
                if f is None:
                    f = tuple(at[b] for b in buckets(w) if b in at)
                    if len(known) < REMEMBERED:
                        known[w] = f
                if f:
                    out.update(f)
            return sorted(out)

        def score(texts: list[str | None]) -> np.ndarray:
            sets = [features(t) for t in texts]
            z = self.raw(np.fromiter((f for s in sets for f in s), np.int64), np.array([len(s) for s in sets], np.int64))
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return score

    def raw(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Bias, weights and pairwise products of each row's features (concatenated in ``flat``)."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        z = self.bias + np.bincount(row, self.weights[flat], len(sizes))
        for k in range(self.factors.shape[1]):
            v = self.factors[flat, k]
            s = np.bincount(row, v, len(sizes))
            z += 0.5 * (s * s - np.bincount(row, v * v, len(sizes)))
        return z


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Choose features by chi-squared, then learn by AdaGrad over shuffled mini-batches (seeded)."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    none = Model(float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    if not len(y) or y.min() == y.max():
        return none
    n, pos = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r, label in zip(rows, y.tolist(), strict=True):
        n[r] += 1
        if label:
            pos[r] += 1
    expected = n * share
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where(n >= 3, (np.abs(pos - expected) - 0.5).clip(0) ** 2 / (expected * (1 - n / len(y)).clip(1e-3) * (1 - share)), 0.0)
    kept = np.sort(np.argsort(-chi, kind="stable")[:KEPT])
    kept = kept[chi[kept] > 6.6]
    where = np.full(BUCKETS, -1)
    where[kept] = np.arange(len(kept))
    sets = [(a := where[r])[a >= 0] for r in rows]
    rng = np.random.default_rng(7)
    m = Model(none.bias, kept, np.zeros(len(kept)), rng.normal(0, 0.02, (len(kept), FACTORS)))
    gw, gv, gb = np.full(len(kept), 1e-6), np.full(m.factors.shape, 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for s in range(0, len(order), BATCH):
            at = order[s : s + BATCH]
            size = np.array([len(sets[i]) for i in at])
            f = np.concatenate([sets[i] for i in at]).astype(int)
            row = np.repeat(np.arange(len(at)), size)
            err = 1 / (1 + np.exp(-np.clip(m.raw(f, size), -30, 30))) - y[at]
            sums = np.stack([np.bincount(row, m.factors[f, k], len(at)) for k in range(FACTORS)], 1)
            e = err[row]
            dw = np.bincount(f, e, len(kept)) / len(at) + DAMP * m.weights
            dv = np.zeros_like(m.factors)
            np.add.at(dv, f, e[:, None] * (sums[row] - m.factors[f]))
            dv = dv / len(at) + DAMP * m.factors
            db = err.mean()
            gw += dw * dw
            gv += dv * dv
            gb += db * db
            m.weights -= RATE * 2 * dw / np.sqrt(gw)
            m.factors -= RATE * 0.2 * dv / np.sqrt(gv)
            m.bias -= RATE * db / np.sqrt(gb)
    return m


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> Model:
    sample = labelled(docs, labels, "toxic", MODULUS, HELD_OUT, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.array(terms(t), np.int32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(found, pa.binary())], ["doc_id", "y", "terms"])

    got = sorted(sample.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, terms binary").collect())
    return fit([np.frombuffer(r.terms, np.int32) for r in got], np.array([r.y for r in got], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer(b.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
