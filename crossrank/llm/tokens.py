"""Byte-level BPE by merge ranks: encoding with a hierarchical-bitmap rank queue, and decoding.

Each pre-token's adjacent pairs are filed under their merge rank. A two-level bitmap over the ranks tells
the least rank that has entries by find-first-set; its bucket gives the leftmost position of the linked list
of symbols. Entries that a merge made stale are skipped when met. A pre-token of n bytes takes O(n) bucket
steps, so very long pre-tokens (one unbroken run of letters) do not become quadratic.

Ids of short pre-tokens are remembered, within a bound in bytes; long ones are merged each time.

Cases: a null text has no ids; an empty text has none either; any other text decodes to its own UTF-8 bytes.
Rows with null or repeated ids stay rows of their own; only id and text are read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossrank.llm.common import table

#: Bytes of pre-tokens and results that a worker remembers in each of two generations, what an entry takes beside them,
#: and the longest pre-token (in characters) that is remembered at all.
REMEMBERED, ENTRY, LONGEST = 160 << 20, 250, 64


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: least rank first, leftmost first among equals.

    ``buckets`` hold positions by rank; ``words`` hold 64 ranks each as bits, and ``top`` has a bit for each
    word that is not zero. The least rank is two find-first-sets away.
    """
    get = ranks.get
    if (whole := get(piece)) is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 1))  # start of the next symbol, n at the end
    before = list(range(-1, n))
    now = [-1] * (n + 1)  # rank of the pair that starts here
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    top = 0
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            now[i] = r
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                w = r >> 6
                words[w] = words.get(w, 0) | 1 << (r & 63)
                top |= 1 << w
    while top:
        w = (top & -top).bit_length() - 1
        x = words[w]
        r = (w << 6) + (x & -x).bit_length() - 1
        bucket = buckets[r]
        i = heappop(bucket)
        if not bucket:
            del buckets[r]
            x &= x - 1
            words[w] = x
            if not x:
                top &= top - 1
        if now[i] != r:  # stale
            continue
        j = after[i]
        end = after[i] = after[j]
        now[j] = now[i] = -1
        before[end] = i
        for at, to in ((i, after[end] if end < n else 0), (before[i], end)):
            if to and at >= 0:
                if (r := get(piece[at:to])) is None:
                    now[at] = -1
                    continue
                now[at] = r
                if r in buckets:
                    heappush(buckets[r], at)
                else:
                    buckets[r] = [at]
                    w = r >> 6
                    words[w] = words.get(w, 0) | 1 << (r & 63)
                    top |= 1 << w
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Remembered(dict):
    """A memory of two generations: when the newer one has ``most`` bytes the older one is dropped."""

    def __init__(self, make: Callable[[str], tuple[str, bytes]], most: int = REMEMBERED) -> None:
        super().__init__()
        self.make, self.most, self.held, self.old = make, most, 0, {}

    def __missing__(self, key: str) -> tuple[str, bytes]:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if self.held >= self.most:
                self.old, self.held = dict(self), 0
                self.clear()
            self[key] = value
            self.held += ENTRY + len(key) + len(value[0]) + len(value[1])
        return value


class Codec:
    """A vocabulary of merge ranks with its pre-token pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.known = Remembered(self._both)

    def _both(self, word: str) -> tuple[str, bytes]:
        ids = merge(word.encode(), self.ranks)
        return ",".join(map(str, ids)), b"".join([self.bytes_of[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [i for word in self.split(text) for i in merge(word.encode(), self.ranks)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def round_trip(self, text: str) -> tuple[str, bytes]:
        """The ids as decimals joined by commas, and the bytes that these ids stand for."""
        words = list(map(self.known.__getitem__, self.split(text)))
        return ",".join([w[0] for w in words]), b"".join([w[1] for w in words])


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker and vocabulary."""
    return Codec(path, pattern)


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(df: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, decoded binary``; ids and bytes are null where the text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        c = codec(vocabulary(name), public_tokenizers.PATTERN)
        for b in batches:
            ids = [None if t is None else c.encode(t) for t in b.column(1).to_pylist()]
            decoded = [None if x is None else c.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(df: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of ids and digests of ids and decoded bytes, without carrying the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        c = codec(vocabulary(name), public_tokenizers.PATTERN)
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                ids, decoded = c.round_trip(t or "")
                rows.append((ids.count(",") + 1 if ids else 0, sha256(ids.encode()).hexdigest(), sha256(decoded).hexdigest()))
            n, a, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
