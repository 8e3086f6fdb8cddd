"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, and each half has a codebook of its own (k-means on a bounded sample). A pair of
centroids is a cell; every row is in one, and rows of a cell lie together in lists. A query visits cells by the sum
of its two distances, with a heap over the two sorted codebooks, once, until the cells hold a share of all rows. It
goes only to the lists of these cells, where its exact distances to the rows of these cells, and no others, are taken.

The share is measured rather than fixed: it is the least with which queries from the sample meet ``RECALL`` of their
true neighbours within the sample. Clustered vectors need little of a table; vectors without any clusters much.

Cases: rows with a null id, a null or all-zero vector, null or non-finite components or another length than the
commonest take no part; a query's own id is no candidate; repeated rows are candidates each, and one query; ties go to
the smaller id; an empty table, or a lone row, gives no results.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossrank.llm.common import table
from crossrank.llm.vectors import TOP, best, codebook, list_rows, listed, lists, meet, nearest, queries, sample, stacked, tally, usable, visits

#: Centroids of a half; rows of the sample for each, at least.
CENTROIDS, ROWS_EACH = 64, 8
#: Recall that the sample's queries must reach, and how many of them are tried.
RECALL, TRIED = 0.97, 512


def visited(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, rows: int) -> np.ndarray:
    """Cells (as a mask) by ascending sum of distances until they hold ``rows`` rows: the multi-sequence traversal."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    fa, fb, la, lb = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist()
    out = np.zeros(sizes.shape, bool)
    done = [0] * len(la)  # cells taken from each row of the grid
    heap, have, size = [(fa[0] + fb[0], 0, 0)], 0, sizes.tolist()
    while heap and have < rows:
        _, i, j = heappop(heap)
        out[la[i], lb[j]] = True
        have += size[la[i]][lb[j]]
        done[i] = j + 1
        if i + 1 < len(la) and done[i + 1] == j:
            heappush(heap, (fa[i + 1] + fb[j], i + 1, j))
        if j + 1 < len(lb) and (i == 0 or done[i - 1] > j + 1):
            heappush(heap, (fa[i] + fb[j + 1], i, j + 1))
    return out


class Index:
    """The two codebooks, and what follows from them."""

    def __init__(self, x: np.ndarray) -> None:
        self.half = (x.shape[1] + 1) // 2
        k = max(1, min(CENTROIDS, len(x) // ROWS_EACH))
        self.one = codebook(x[:, : self.half], k, 1)
        self.two = codebook(x[:, self.half :], k, 2) if x.shape[1] > 1 else np.zeros((1, 0))
        self.cells = len(self.one) * len(self.two)

    def distances(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the centroids of both halves, each less a constant of the vector."""
        return nearest(v[:, : self.half], self.one), nearest(v[:, self.half :], self.two)

    def cells_of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.distances(v)
        return a.argmin(1) * len(self.two) + b.argmin(1), np.zeros(len(v))

    def share(self, x: np.ndarray, top: int) -> float:
        """Share of the sample ``x`` that its first rows must visit to meet ``RECALL`` of their nearest within it."""
        cell, asked = self.cells_of(x)[0], x[:TRIED]
        sizes = np.bincount(cell, minlength=self.cells)
        far = (x**2).sum(1) - 2 * asked @ x.T
        far[np.arange(len(asked)), np.arange(len(asked))] = np.inf
        n = min(top, len(x) - 1)
        near = np.argpartition(far, n - 1, 1)[:, :n]
        a, b = self.distances(asked)
        need = []
        for k, row in enumerate(near):
            order = np.argsort((a[k][:, None] + b[k][None]).ravel(), kind="stable")
            before = np.empty(self.cells, np.int64)
            before[order] = np.cumsum(sizes[order]) - sizes[order]
            need.append(before[cell[row]] + 1)
        return float(np.quantile(np.concatenate(need), RECALL, method="higher")) / len(x)


def rerank(v: np.ndarray, ids: np.ndarray, own: np.ndarray, q: np.ndarray, q_id: int, cells: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and distances of the nearest rows of the given cells, and how many distances that took."""
    at = np.flatnonzero(np.isin(own, cells) & (ids != q_id))
    far = np.sqrt(((v[at] - q) ** 2).sum(1))
    if len(at) > top:
        close = np.flatnonzero(far <= np.partition(far, top - 1)[top - 1])
        at, far, took = at[close], far[close], len(at)
    else:
        took = len(at)
    order = np.lexsort((ids[at], far))[:top]
    return ids[at][order], far[order], took


def search(df: DataFrame, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id ``EVERY`` divides."""
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col, zero=False)
    x = sample(rows)[1]
    if len(x) < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    made = Index(x)
    share = made.share(x, top)
    shared = spark.sparkContext.broadcast(made)  # two codebooks of a fixed size
    cells_of = lambda v: shared.value.cells_of(v)
    sizes = tally(rows, cells_of, made.cells)[0]
    want, grid = max(top + 1, int(np.ceil(share * sizes.sum()))), sizes.reshape(len(made.one), len(made.two))
    first, parts = lists(sizes, list_rows(sizes.sum()))

    def visit(q_id: int, q: np.ndarray) -> np.ndarray:
        a, b = shared.value.distances(q[None])
        return np.flatnonzero(visited(a[0], b[0], grid, want).ravel() & (sizes > 0))

    def scan(here: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if here.num_rows and asked.num_rows:
            v, ids, own = stacked(here.column("vec")), here.column("vec_id").to_numpy(), here.column("cell").to_numpy()
            for q_id, q, cells in zip(asked.column("vec_id").to_pylist(), stacked(asked.column("vec")), asked.column("cells"), strict=True):
                near, far, _ = rerank(v, ids, own, q, q_id, cells.values.to_numpy(), top)
                out.append((np.full(len(near), q_id), near, far))
        q_id, v_id, score = map(np.concatenate, zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"query_id": pa.array(q_id, pa.int64()), "vec_id": pa.array(v_id, pa.int64()), "score": pa.array(score, pa.float64())})

    seen = visits(queries(rows), visit, first, parts)
    return best(meet(listed(rows, cells_of, first, parts), seen, scan, "query_id long, vec_id long, score double"), F.col("score"), top)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
