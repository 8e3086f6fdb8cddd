"""Exact top-k by inner product: a dual-tree search over cover trees of rows and queries.

A node has a centre, which is one of its points, and a covering radius (the farthest of its points). Its children are
a net of its points: each point lies within ``cover`` of its child's centre, centres are at least ``cover`` apart,
and ``cover`` shrinks from level to level (the invariants of a simplified cover tree, with a scale for each node
rather than a fixed power). For a query node q and a row node p no product exceeds <cq, cp> + rq |cp| + rp |cq| + rq rp;
a pair of nodes whose bound lies below the worst kth score of the query node's group is pruned.

Components are whole numbers and leaves are multiplied as matrices, exactly: in double precision where no product of
two lengths reaches 2^53, in 64-bit integers below 2^63, and in Python's integers beyond. A score among the results
that no long can hold is an error, never a wrong number.

Rows are dealt by their nearest of a bounded number of pivots, and those of a pivot into lists; each list has a tree, and
each query's best of all lists are merged. A query goes only to lists whose pivot and radius can reach the kth score
that the query has within a bounded sample, which is a floor under its true kth score.

Cases: rows with a null id, a null vector, null or non-finite components or another length than the commonest take no
part; zero vectors do; a query's own id is no candidate; repeated rows are candidates each, and one query; ties go to
the smaller id; an empty table gives no results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossrank.llm.common import table
from crossrank.llm.vectors import TOP, best, codebook, list_rows, listed, lists, meet, nearest, queries, sample, stacked, tally, usable, visits

#: Points of a leaf of rows, of a leaf of queries (of which there are far fewer), and children of a node, at most.
LEAF, QUERY_LEAF, CHILDREN = 256, 32, 16
#: Pivots at most.
PIVOTS = 256
SCALE = 1024
#: Scores from -LONG to below LONG fit a long.
LONG = 1 << 63
#: Levels of a tree at most; what is left there is a leaf, whatever its size.
DEEPEST = 64
#: What rounding adds to a bound at most, as a share of the lengths that it multiplies.
SLACK = 1e-9


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    norm: float
    points: np.ndarray  # places in the matrix; the centre's first
    cover: float = 0.0  # how far its points are from their child's centre, at most
    children: list[Node] = field(default_factory=list)
    worst: float = -np.inf  # of a query node: the least kth score of its group


def cover_tree(x: np.ndarray, points: np.ndarray, leaf: int = LEAF, level: int = 0) -> Node:
    """A tree of the given rows (as doubles). The farthest point becomes the next centre until the radius is halved."""
    centre = x[points[0]]
    far = np.sqrt(((x[points] - centre) ** 2).sum(1))
    node = Node(centre, float(far.max()) * (1 + SLACK), float(np.sqrt((centre**2).sum())), points)
    if len(points) <= leaf or node.radius == 0 or level == DEEPEST:
        return node
    near, own, k = far.copy(), np.zeros(len(points), np.int64), 1
    while k < 2 or k < CHILDREN and near.max() > node.radius / 2:
        new = int(near.argmax())
        d = np.sqrt(((x[points] - x[points[new]]) ** 2).sum(1))
        own[d < near] = k
        near = np.minimum(near, d)
        k += 1
    node.cover = float(near.max())
    for c in range(k):
        part = np.flatnonzero(own == c)
        order = np.argsort(near[part], kind="stable")  # the centre comes first
        node.children.append(cover_tree(x, points[part][order], leaf, level + 1))
    return node


def whole(x: np.ndarray, object_too: bool) -> np.ndarray:
    """``floor(SCALE * x)`` as doubles, or as Python's integers, which hold it whatever its size."""
    if not object_too:
        return np.floor(SCALE * x)
    return np.array([[math.floor(SCALE * Fraction(c)) for c in row] for row in x.tolist()], object).reshape(x.shape)


def exact_type(rows: np.ndarray, asked: np.ndarray) -> type:
    """The cheapest type in which all products of the two sets are exact, by the lengths of their longest vectors."""
    with np.errstate(over="ignore"):
        most = [float(np.sqrt(((np.abs(SCALE * x) + 1) ** 2).sum(1)).max(initial=0)) for x in (rows, asked)]
        reach = most[0] * most[1] * (1 + SLACK)
    return np.float64 if reach < 2.0**53 and max(most) < 2.0**53 else np.int64 if reach < 2.0**62 and max(most) < 2.0**62 else object


def dual(rows: np.ndarray, ids: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, list[int], dict[str, int]]:
    """The best ``top`` rows of each query: query ids, row ids, scores, and what was done: pairs of nodes pruned, and products.

    ``rows`` and ``asked`` are vectors before scaling.
    """
    kind = exact_type(rows, asked)
    p_all, q_all = (whole(x, kind is object).astype(kind) for x in (rows, asked))
    none = np.iinfo(np.int64).min if kind is np.int64 else -np.inf  # below every score
    scores = np.full((len(asked), top), none, kind)
    found = np.full((len(asked), top), np.iinfo(np.int64).max)
    # Trees and bounds take doubles, scaled down together where squares might overflow.
    shrink = 1 << max(0, math.frexp(max(float(np.abs(x).max(initial=0)) for x in (rows, asked)))[1] - 400)
    p_tree, q_tree = (np.array([float(Fraction(c, shrink)) for c in y.ravel()]).reshape(y.shape) if kind is object else y.astype(float) for y in (p_all, q_all))
    done = {"pruned": 0, "products": 0}

    def leaves(q: Node, p: Node) -> None:
        done["products"] += len(q.points) * len(p.points)
        s = q_all[q.points] @ p_all[p.points].T
        s[asked_ids[q.points][:, None] == ids[p.points][None]] = none
        n = min(top, s.shape[1])
        for i in np.flatnonzero(s.max(1) >= scores[q.points, -1]).tolist():  # the others have better ones
            at, row = q.points[i], s[i]
            limit = max(np.partition(row, len(row) - n)[len(row) - n], scores[at, -1])
            new = np.flatnonzero((row >= limit) & (row > none))
            if not len(new):
                continue
            if kind is object:
                both = sorted(zip((-scores[at]).tolist() + (-row[new]).tolist(), found[at].tolist() + ids[p.points[new]].tolist()))[:top]
                scores[at], found[at] = [-x for x, _ in both], [k for _, k in both]
                continue
            all_s, all_i = np.concatenate([scores[at], row[new]]), np.concatenate([found[at], ids[p.points[new]]])
            order = np.lexsort((all_i, ~all_s if kind is np.int64 else -all_s))[:top]
            scores[at], found[at] = all_s[order], all_i[order]

    def bound(q: Node, p: Node) -> float:
        b = float(q.centre @ p.centre) + q.radius * p.norm + p.radius * q.norm + q.radius * p.radius
        return b + SLACK * (q.norm + q.radius) * (p.norm + p.radius)

    def worst(points: np.ndarray) -> float:
        """The least kth score of the given queries, in the trees' measure; not above it by rounding beyond SLACK."""
        low = scores[points, -1].min()
        return -np.inf if low == none else float(Fraction(low, shrink * shrink)) if kind is object else float(low)

    def visit(q: Node, p: Node) -> None:
        if bound(q, p) < q.worst:
            done["pruned"] += 1
            return
        if q.children:
            for c in q.children:
                visit(c, p)
            q.worst = min(c.worst for c in q.children)
        elif p.children:
            for c in sorted(p.children, key=lambda c: -bound(q, c)):
                visit(q, c)
        else:
            leaves(q, p)
            q.worst = worst(q.points)

    visit(cover_tree(q_tree, np.arange(len(asked)), QUERY_LEAF), cover_tree(p_tree, np.arange(len(rows))))
    at = np.flatnonzero(scores.ravel() > none)
    return np.repeat(asked_ids, top)[at], found.ravel()[at], [int(s) for s in scores.ravel()[at].tolist()], done


class Pivots:
    """Pivots that rows are dealt by, and for each query a floor under its kth score: the kth within a sample.

    A pivot whose rows all score below the floor is not visited. Where doubles overflow, all are.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            y = np.floor(SCALE * x)
            finite = y[np.isfinite((y**2).sum(1))]
        self.ids, self.y = ids, y
        self.pivots = codebook(finite, max(1, min(PIVOTS, len(finite) // LEAF)), 3) if len(finite) else np.zeros((1, x.shape[1]))

    def cells_of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot, and the distance to it."""
        with np.errstate(over="ignore", invalid="ignore"):
            y = np.floor(SCALE * v)
            cell = np.nan_to_num(nearest(y, self.pivots), nan=0.0).argmin(1)
            far = np.sqrt(((y - self.pivots[cell]) ** 2).sum(1))
        return cell, np.nan_to_num(far, nan=np.inf, posinf=np.inf)

    def visit(self, q_id: int, q: np.ndarray, radius: np.ndarray, top: int) -> np.ndarray:
        """Pivots whose rows may be among the best ``top``; ``radius``: the farthest row of each."""
        with np.errstate(over="ignore", invalid="ignore"):
            y = np.floor(SCALE * q)
            length = np.sqrt((y**2).sum())
            s = (self.y @ y)[self.ids != q_id]
            floor = np.partition(s, len(s) - top)[len(s) - top] if len(s) >= top else -np.inf
            floor -= SLACK * length * np.sqrt((self.y**2).sum(1)).max()
            reach = self.pivots @ y + length * radius
            reach += SLACK * length * (np.sqrt((self.pivots**2).sum(1)) + radius)
            return np.flatnonzero(~(reach < floor))


def search(df: DataFrame, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the scaled whole-number vectors, for the ids that ``EVERY`` divides."""
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col)
    ids, x = sample(rows)
    if len(x) < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    made = Pivots(ids, x)
    shared = spark.sparkContext.broadcast(made)  # a bounded sample
    cells_of = lambda v: shared.value.cells_of(v)
    sizes, radius = tally(rows, cells_of, len(made.pivots))
    first, parts = lists(sizes, list_rows(sizes.sum()))

    def scan(here: pa.Table, asked: pa.Table) -> pa.Table:
        q_id, v_id, score = np.empty(0, np.int64), np.empty(0, np.int64), []
        if here.num_rows and asked.num_rows:
            q_id, v_id, score, _ = dual(stacked(here.column("vec")), here.column("vec_id").to_numpy(), stacked(asked.column("vec")), asked.column("vec_id").to_numpy(), top)
        if score and max(score) >= LONG:
            raise OverflowError(f"the inner product {max(score)} is beyond a 64-bit integer")
        score = [s if s >= -LONG else None for s in score]  # an error only if it is among the best of all lists
        return pa.table({"query_id": pa.array(q_id, pa.int64()), "vec_id": pa.array(v_id, pa.int64()), "score": pa.array(score, pa.int64())})

    seen = visits(queries(rows), lambda i, q: (at := shared.value.visit(i, q, radius, top))[sizes[at] > 0], first, parts)
    found = best(meet(listed(rows, cells_of, first, parts), seen, scan, "query_id long, vec_id long, score long"), F.desc("score"), top)
    below = F.raise_error(F.lit("an inner product is below a 64-bit integer")).cast("long")
    return found.withColumn("score", F.when(F.col("score").isNull(), below).otherwise(F.col("score")))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
