"""Block exchange: blocks of documents ask buckets of hashes, and get their answers back.

Documents are dealt into blocks of a few MB by a hash of id and text, so that neither a repeated id nor a repeated text
gathers. A block sends each bucket the part of its hash array that falls there, as one binary value, and the bucket
answers each block with an array in the same order. Thus a shuffle moves few large rows in place of one row for each
hash, a hash that half of all documents hold reaches its bucket once for each block, and the answers need no ids. The
exchange that deals the texts is the same in each step, so Spark runs it once and reuses it.

Blocks and buckets have a fixed size at every scale. A block sends a message to each bucket that it has a hash of:
messages number blocks times buckets at most, and never more than the blocks' distinct hashes, which is what an
exchange of one row for each hash would move.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.llm.common import new_key

#: Text bytes of a block, and those whose hashes fill a bucket.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
#: Blocks and buckets that smaller inputs are dealt into, as far as each has LEAST_BYTES.
SPREAD, LEAST_BYTES = 64, 256 << 10
#: A null id sorts after all others.
NO_ID = np.iinfo(np.int64).max

MESSAGE = "bucket long, block long, data binary"


@dataclass(frozen=True)
class Dealt:
    """Documents in blocks: ``doc_id, text, block``, the numbers of blocks and buckets, and the key of word hashes."""

    docs: DataFrame
    blocks: int
    buckets: int
    key: bytes


def deal(df: DataFrame, id_col: str, text_col: str, carry: bool = False) -> Dealt:
    """Rows dealt into blocks; with ``carry`` also the whole row but its text, as ``rest``."""
    rest = [F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("rest")] if carry else []
    small = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *rest)
    total = int(small.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    blocks, buckets = (max(1, -(-total // size), min(SPREAD, total // LEAST_BYTES)) for size in (BLOCK_BYTES, BUCKET_BYTES))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks).cast("bigint"))
    return Dealt(small.withColumn("block", block), blocks, buckets, new_key())


def in_order(group: pa.Table) -> pa.Table:
    """A block's rows in an order that each step repeats."""
    return group.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def documents(group: pa.Table) -> tuple[pa.Array, np.ndarray, list[bytes]]:
    """A block's ids (as they are, and as sort keys) and texts as bytes, ``in_order``."""
    group = in_order(group.select(["doc_id", "text"]))
    ids = group.column("doc_id").combine_chunks() if group.num_rows else pa.array([], pa.int64())
    texts = group.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
    return ids, ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), texts


def part(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each hash; grows with the hash, so sorted hashes lie together by bucket."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def cuts(h: np.ndarray, n: int) -> np.ndarray:
    """Where each bucket begins in a sorted array of hashes (n + 1 places)."""
    return np.searchsorted(part(h, n), np.arange(n + 1, dtype=np.uint64))


def messages(block: int, at: np.ndarray, data: np.ndarray) -> list[tuple[int, int, bytes]]:
    """A block's messages: the stretch of ``data`` for each bucket that has one."""
    return [(b, block, data[at[b] : at[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(at)).tolist()]


def message_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    b, k, d = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"bucket": pa.array(b, pa.int64()), "block": pa.array(k, pa.int64()), "data": pa.array(d, pa.binary())})


def answers(group: pa.Table, size: int) -> np.ndarray:
    """A block's answers from all buckets, in the order of its sorted hashes, ``size`` in all."""
    rows = [x for x in zip(group.column("bucket").to_pylist(), group.column("data").to_pylist(), strict=True) if x[0] >= 0]
    out = np.frombuffer(b"".join(d for _, d in sorted(rows)), np.uint8)
    assert len(out) == size, (len(out), size)
    return out


def kept_state(group: pa.Table) -> bytes:
    """What a block sent to itself (bucket below 0)."""
    return next((d for b, d in zip(group.column("bucket").to_pylist(), group.column("data").to_pylist(), strict=True) if b < 0), b"")


def ask(sent: DataFrame, reply: Callable[[list[np.ndarray]], list[np.ndarray]], dtype: str) -> DataFrame:
    """Answers of all buckets to messages: ``reply`` gets the arrays that blocks sent to one bucket.

    Messages with a bucket below 0 are a block's own state; they come back unchanged.
    """

    def run(group: pa.Table) -> pa.Table:
        bucket, block = group.column("bucket").to_pylist(), group.column("block").to_pylist()
        data = group.column("data").to_pylist()
        if bucket[0] < 0:
            return group.select(["bucket", "block", "data"])
        out = reply([np.frombuffer(d, np.dtype(dtype)) for d in data])
        return message_table([(b, k, x.astype(np.uint8).tobytes()) for b, k, x in zip(bucket, block, out, strict=True)])

    return sent.groupBy("bucket").applyInArrow(run, MESSAGE)
