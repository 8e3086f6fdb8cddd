"""Packing token ids into windows of fixed length, with little padding.

A task deals its rows, as it reads them, into shards of a few MB of text; nothing is shuffled, and a task holds one
shard at a time. Each shard fills whole windows from its long documents first. The lengths that remain make a
histogram. Shallow combinations (one to three lengths that fill a window exactly) are its columns; their
repeat counts come from non-negative least squares against the histogram, are rounded down, and are taken
while pieces last. What is left is packed greedily, cut at window ends. So only a shard's last window is padded.

Ids are those of the tokenizer file's own library at its defaults: an added token that occurs in a text, such as
``<|endoftext|>``, is that token's id, and what stands before and after it is split apart.

Sequence ids follow from the number of the task's partition and the order of its rows, so the input should be a table
(or ``written``), which a task that is run again reads in the same order.

Cases: a null text counts as empty and gives the end id alone; an empty table gives no pieces; repeated or null ids
are separate documents (their pieces carry the same id) and gather nowhere; only id and text are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossrank.llm.common import table

WINDOW = 2048
#: The id that ends a document.
END_ID = 1
#: Characters of a shard, when it is full; a shard ends with at most one padded window.
SHARD_CHARS = 4 << 20
#: Lengths from which three-part combinations are made: the commonest, so many at most.
TRIPLE_LENGTHS = 48
STEPS = 300


@cache
def encoder(name: str):
    """The vocabulary of a tokenizer file, run by merge ranks; gives the ids that the file's own library gives."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        file = json.load(f)
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    if any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{name}: added tokens that match more or less than their own text are not supported")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(map(back.__getitem__, s)): i for s, i in file["model"]["vocab"].items() if s not in added}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def combinations(hist: np.ndarray) -> np.ndarray:
    """Rows of up to three lengths (0: unused) that sum to the window, of lengths that occur."""
    w = len(hist)
    there = np.flatnonzero(hist)
    a = there[(there <= w - there) & (hist[w - there] > 0)]
    rows = [np.stack([a, w - a, np.zeros_like(a)], 1)]
    top = there[np.argsort(-hist[there], kind="stable")[:TRIPLE_LENGTHS]]
    x, y = np.meshgrid(top, top, indexing="ij")
    keep = (x <= y) & (x + y < w)
    x, y = x[keep], y[keep]
    z = w - x - y
    keep = (z >= y) & (hist[z] > 0)
    rows.append(np.stack([x[keep], y[keep], z[keep]], 1))
    return np.concatenate(rows).astype(np.int64)


def repeats(hist: np.ndarray, combos: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative least squares by projected, accelerated gradient steps: counts of each combination."""
    if not len(combos):
        return np.zeros(0)
    w, parts = len(hist), combos.shape[1]
    target = hist.astype(float)
    target[0] = 0
    used = combos > 0
    flat = combos.ravel()

    def product(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, np.repeat(x, parts), w)
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return (r[combos] * used).sum(1)

    v = np.ones(len(combos))
    for _ in range(12):  # largest eigenvalue, for the step
        v = back(product(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * float(v @ back(product(v))) + 1e-9)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y + step * back(target - product(y)))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(lengths: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)``; sequences count from 0 and have no gaps."""
    out: list[tuple[int, int, int, int, int]] = []
    seq = 0
    rest: dict[int, list[int]] = {}
    for d, n in enumerate(lengths.tolist()):
        for k in range(n // window):
            out.append((d, k * window, window, seq, 0))
            seq += 1
        if n % window:
            rest.setdefault(n % window, []).append(d)
    hist = np.bincount([k for k, v in rest.items() for _ in v], minlength=window)
    combos = combinations(hist)
    counts = np.floor(repeats(hist, combos) + 1e-6).astype(int)
    for c in np.argsort(-counts, kind="stable"):
        if not counts[c]:
            break
        parts = [p for p in combos[c].tolist() if p]
        for _ in range(counts[c]):
            if any(len(rest.get(p, ())) < parts.count(p) for p in parts):
                break
            at = 0
            for p in parts:
                d = rest[p].pop()
                out.append((d, int(lengths[d]) - p, p, seq, at))
                at += p
            seq += 1
    at = 0
    for p in sorted(rest, reverse=True):
        for d in rest[p]:
            start, left = int(lengths[d]) - p, p
            while left:
                n = min(left, window - at)
                out.append((d, start, n, seq, at))
                start, left, at = start + n, left - n, at + n
                if at == window:
                    seq, at = seq + 1, 0
    return out


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Sequences that a partition can number.
_SEQUENCES = 1 << 40


def packed(of: list[int | None], docs: list[np.ndarray], first: int, window: int) -> pa.RecordBatch:
    """The pieces of one shard, whose sequences count from ``first``."""
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    pieces = plan(lengths, window)
    d, start, length, seq, at = map(np.array, zip(*pieces, strict=True))
    ids = [docs[i][s : s + k].tobytes() for i, s, k, _, _ in pieces]
    return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()).take(pa.array(d)), pa.array(start), pa.array(length), pa.array(ids, pa.binary()), pa.array(lengths[d]), pa.array(seq + first), pa.array(at)], schema=_ARROW)


def pack(df: DataFrame, name: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each piece; ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers."""
    small = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name)
        first = TaskContext.get().partitionId() * _SEQUENCES
        of, docs, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py()
                of.append(i)
                docs.append(np.append(enc.encode_to_numpy(text, allowed_special="all"), END_ID).astype("<u4"))
                held += len(text)
                if held >= SHARD_CHARS:
                    out = packed(of, docs, first, window)
                    yield out
                    first = out.column(5)[-1].as_py() + 1
                    of, docs, held = [], [], 0
        if docs:
            yield packed(of, docs, first, window)

    return small.mapInArrow(run, SCHEMA)


def pieces(df: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return pack(df).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"))
