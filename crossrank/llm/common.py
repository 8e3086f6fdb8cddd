"""What the corpus operators share: the shared folder, table reading, byte-level word splitting."""

from __future__ import annotations

import os
import re
import secrets
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest Arrow batch handed to a Python worker, so that very long texts do not add up in memory.
BATCH_BYTES = "16m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    A local session without that setting (tests) gets a temporary folder; on a cluster it must be set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "crossrank-shared")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and where it lies."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    return stored(spark, df, name)[0]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Removes the shuffle files of each table written inside as soon as it is written.

    Else they stay until the driver happens to collect garbage, beside those of the next query.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a stored table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, with Arrow batches held to ``BATCH_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id falls in fold -1, so in no named fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(-1).cast("bigint"))


#: Bytes handled at once, up to the next blank; longer words make longer pieces.
PIECE = 1 << 19
#: Longer words are hashed one by one.
LONGEST = 63

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_next_blank = re.compile(rb"[\x09-\x0d\x20]").search


def new_key() -> bytes:
    """A key for the word hashes of one run. It is drawn anew each time, so no text can be made to collide."""
    return secrets.token_bytes(16)


def digest(data: bytes, key: bytes, size: int = 16) -> bytes:
    """Keyed cryptographic digest."""
    return blake2b(data, digest_size=size, key=key).digest()


#: Modulus of the word polynomials, and bytes of a coefficient with the masks of shorter ones.
PRIME, LANE = np.uint64((1 << 61) - 1), 7
_MASK = np.array([(1 << 8 * k) - 1 for k in range(LANE + 1)], np.uint64)
_LOW32, _LOW29, _32, _29, _61 = np.uint64(0xFFFFFFFF), np.uint64(0x1FFFFFFF), np.uint64(32), np.uint64(29), np.uint64(61)


def _times(a: np.ndarray, r: np.uint64) -> np.ndarray:
    """``a * r`` modulo PRIME, up to a multiple of it; both are little above 2^61 at most."""
    high, low, r_high, r_low = a >> _32, a & _LOW32, r >> _32, r & _LOW32
    middle, low = high * r_low + low * r_high, low * r_low
    s = (high * r_high << np.uint64(3)) + (middle >> _29) + ((middle & _LOW29) << _32) + (low & PRIME) + (low >> _61)
    return (s & PRIME) + (s >> _61)


def word_hashes(raw: bytes, key: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of all words (runs without blanks) of a buffer, without a loop over words.

    A word is a polynomial over a prime field, with its length and then each ``LANE`` bytes as coefficients, taken at a
    secret point: any two words, however they were made, are equal at 10 of the 2^61 points at most. Words beyond
    ``LONGEST`` bytes have a keyed digest instead.
    """
    starts, ends, hashes, at = [], [], [], 0
    point = np.uint64(int.from_bytes(digest(b"point", key, 8), "little") % int(PRIME))
    while at < len(raw):
        end = at + PIECE
        if end >= len(raw):
            end = len(raw)
        elif (m := _next_blank(raw, end)) is not None:
            end = m.start()
        else:
            end = len(raw)
        piece = raw[at:end] + bytes(8)
        a = np.frombuffer(piece, np.uint8, end - at)
        edge = np.diff(np.concatenate([[True], _BLANK[a], [True]]).astype(np.int8))
        s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        eight = np.ndarray(len(a) + 1, "<u8", piece, strides=(1,))  # the 8 bytes from each place
        n = e - s
        h = n.astype(np.uint64)
        for k in range(0, min(LONGEST, int(n.max(initial=0))), LANE):
            more = np.flatnonzero(n > k) if k else slice(None)
            h[more] = _times(h[more], point) + (eight[s[more] + k] & _MASK[np.minimum(n[more] - k, LANE)])
        h = (h & PRIME) + (h >> _61)
        h[h >= PRIME] -= PRIME
        h = mix(h + np.uint64(1))
        for w in np.flatnonzero(n > LONGEST).tolist():
            h[w] = int.from_bytes(digest(piece[s[w] : e[w]], key, 8), "little")
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


@dataclass
class Words:
    """The words of a block of texts: one buffer, and for each word its place, hash and text."""

    raw: bytes
    key: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray  # of each word
    first: np.ndarray  # word at which each text begins; one more at the end

    def __init__(self, texts: list[bytes], key: bytes) -> None:
        self.raw, self.key = b"\n".join(texts), key
        self.start, self.end, self.hash = word_hashes(self.raw, key)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.text = np.searchsorted(begin, self.start, "right") - 1
        self.first = np.searchsorted(self.start, begin)

    def runs(self, n: int) -> np.ndarray:
        """Hashes of ``n`` consecutive words from each word, whatever texts they lie in."""
        return windows(self.hash, multipliers(self.key, n))

    def joined(self, first: int, last: int) -> bytes:
        """Words ``first`` to ``last`` (one past the end), with one blank between them."""
        return b" ".join(self.raw[self.start[first] : self.end[last - 1]].split()) if last > first else b""


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def multipliers(key: bytes, n: int) -> np.ndarray:
    """An odd multiplier for each place of a run, drawn from the key."""
    return np.frombuffer(b"".join(digest(b"place %d" % k, key, 8) for k in range(n)), np.uint64) | np.uint64(1)


def windows(h: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Hashes of all runs of as many consecutive word hashes as there are multipliers (empty if there are fewer words).

    Two different runs differ in some word's hash times a sum of drawn multipliers, that is by a product of two drawn
    numbers; it is 0 modulo 2^64 with a probability of 2^-57 at most, whatever the words.
    """
    if len(h) < len(odd):
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - len(odd) + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i, m in enumerate(odd):
            out += h[i : len(h) - len(odd) + 1 + i] * m
        return mix(out)
