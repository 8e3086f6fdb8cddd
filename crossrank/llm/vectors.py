"""What the two searches share: usable vectors, lists of rows, and the meeting of lists with the queries that visit them.

Rows lie in cells, and cells in lists: runs of small cells, or parts of a large one, so a list has about ``SHARD_ROWS``
rows whatever the cells. A query goes to the lists that it visits, and rows of a list are read once for each
``TASK_QUERIES`` of its queries; lists that no query visits are not sent anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossrank.llm.common import mix, written

#: Rows of a list, and queries that meet a list in one task.
SHARD_ROWS, TASK_QUERIES = 8192, 4096
#: Lists that smaller tables are dealt into, as far as each has LEAST_ROWS.
SPREAD, LEAST_ROWS = 64, 512
#: Rows that codebooks and pivots are learned from, at most.
SAMPLE_ROWS = 16_384
#: Queries are the rows whose id this divides; results for each query.
EVERY, TOP = 100, 10


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", zero: bool = True) -> DataFrame:
    """``vec_id, vec array<double>`` of rows with an id and a whole finite vector of the commonest length.

    ``zero``: whether all-zero vectors take part.
    """
    v = F.col("vec")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    out = out.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(whole)
    if not zero:
        out = out.filter(F.exists(v, lambda x: x != 0))
    sizes = out.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return out.filter(F.size("vec") == (sizes[0].n if sizes else 0))


def stacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long vectors as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def sample(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most ``SAMPLE_ROWS`` rows, those with the least hash."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toArrow()
    return got.column("vec_id").to_numpy(), stacked(got.column("vec"))


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Centroids of k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c).argmin(1)
        size = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, d], k) for d in range(x.shape[1])], 1)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances to all centroids, each less the square of x."""
    return (centroids**2).sum(1) - 2 * x @ centroids.T


#: A function from vectors to their cells, and to what is to be maximal over a cell's rows.
Cells = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def tally(rows: DataFrame, cells_of: Cells, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each cell, and the greatest second value of each; only a row for each cell reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most = np.zeros(cells, np.int64), np.full(cells, -np.inf)
        for b in batches:
            if b.num_rows:
                cell, value = cells_of(stacked(b.column("vec")))
                np.add.at(n, cell, 1)
                np.maximum.at(most, cell, value)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at]), pa.array(most[at])], ["cell", "n", "most"])

    n, most = np.zeros(cells, np.int64), np.zeros(cells)
    for r in rows.mapInArrow(run, "cell long, n long, most double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("most").alias("most")).collect():
        n[r.cell], most[r.cell] = r.n, r.most
    return n, most


def list_rows(total: int) -> int:
    return int(min(SHARD_ROWS, max(LEAST_ROWS, -(-total // SPREAD))))


def lists(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The first list of each cell, and how many lists it is dealt over: cells share a list of ``rows``, large ones have several."""
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // rows))
    at, held = 0, 0
    for c, n in enumerate(sizes.tolist()):
        if held and held + n > rows:
            at, held = at + 1, 0
        first[c] = at
        held += n
        if parts[c] > 1:
            at, held = at + int(parts[c]), 0
    return first, parts


def listed(rows: DataFrame, cells_of: Cells, first: np.ndarray, parts: np.ndarray) -> DataFrame:
    """``list, vec_id, vec, cell``. A cell of several lists deals its rows by id and place, so one id spreads as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            if b.num_rows:
                cell = cells_of(stacked(b.column("vec")))[0]
                place = mix(b.column("vec_id").to_numpy().astype(np.uint64)) + np.arange(at, at + b.num_rows, dtype=np.uint64)
                at += b.num_rows
                own = first[cell] + (place % parts[cell].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), b.column("vec_id"), b.column("vec"), pa.array(cell, pa.int64())], ["list", "vec_id", "vec", "cell"])

    return rows.mapInArrow(run, "list long, vec_id long, vec array<double>, cell long")


def queries(rows: DataFrame) -> DataFrame:
    """One row of each id that ``EVERY`` divides."""
    return rows.filter(F.col("vec_id") % EVERY == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))


VISIT = "list long, vec_id long, vec array<double>, cells array<long>"


def visits(asked: DataFrame, cells_of_query: Callable[[int, np.ndarray], np.ndarray], first: np.ndarray, parts: np.ndarray) -> DataFrame:
    """``VISIT``: each query with each list that it visits, and the cells that it visits there. Written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, q in enumerate(stacked(b.column("vec"))):
                cells = np.sort(cells_of_query(b.column("vec_id")[i].as_py(), q))
                to = np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in cells.tolist()]) if len(cells) else np.empty(0, np.int64)
                of = np.repeat(cells, parts[cells])
                each, begin = np.unique(to, return_index=True)  # lists grow with cells
                n = len(each)
                offsets = pa.array(np.append(begin, len(to)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(each, pa.int64()), b.column("vec_id").take(pa.array([i] * n, pa.int32())), b.column("vec").take(pa.array([i] * n, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(of, pa.int64()))], ["list", "vec_id", "vec", "cells"])

    return written(asked.sparkSession, asked.mapInArrow(run, VISIT), "visits")


def meet(index: DataFrame, visit: DataFrame, scan: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``scan`` of the rows of each list and the queries that visit it, so many queries at a time."""
    load = visit.groupBy("list").agg(F.ceil(F.count("*") / TASK_QUERIES).alias("shares"))
    here = index.join(load, "list").select("list", "vec_id", "vec", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    asked = visit.join(load, "list").select("list", "vec_id", "vec", "cells", F.pmod(F.xxhash64("vec_id"), F.col("shares")).alias("share"))

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        return scan(a, b)

    return here.groupBy("list", "share").cogroup(asked.groupBy("list", "share")).applyInArrow(run, schema)


def best(found: DataFrame, score: Column, top: int = TOP) -> DataFrame:
    """Ranks of each query's best rows of all lists: by ``score``, then by the smaller id."""
    order = Window.partitionBy("query_id").orderBy(score, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
