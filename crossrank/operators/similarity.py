"""Similarities of all slides and reports, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossrank.operators.pooling import rows_of, unit_rows

#: Slides and reports of a block. Products run over tiles of this many rows and columns, padded with zeros, so that
#: a pair's value does not depend on its place: equal vectors get equal values, bit for bit.
BLOCK, TILE = 512, 64


def tiled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` from tiles of one shape."""
    pad = lambda x: np.concatenate([x, np.zeros((-len(x) % TILE, x.shape[1]))])
    pa_, pb = pad(a), pad(b)
    out = np.empty((len(pa_), len(pb)))
    for i in range(0, len(pa_), TILE):
        for j in range(0, len(pb), TILE):
            out[i : i + TILE, j : j + TILE] = pa_[i : i + TILE] @ pb[j : j + TILE].T
    return out[: len(a), : len(b)]


def similarities(pooled: DataFrame, banks: DataFrame, reports: DataFrame, slides: int, texts: int, cond: tuple[str, ...] = (), renormalise: bool = True) -> DataFrame:
    """``cond, slide_id, report_id, s_g, s_p`` for every slide and report of a condition.

    ``pooled``: ``cond, slide_id, emb``; ``banks``: ``cond, slide_id, emb`` (any number of prototypes a slide, at
    least one); ``reports``: ``cond, report_id, emb``. ``slides`` and ``texts`` are their counts within a condition:
    each block of slides meets each block of reports in a task of its own. ``s_g`` is the cosine with the pooled
    vector, ``s_p`` the largest with a prototype (null without a bank).
    """
    rows, cols = max(1, -(-slides // BLOCK)), max(1, -(-texts // BLOCK))
    row = F.pmod(F.hash("slide_id"), F.lit(rows)).alias("_row")
    every = F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("_col")
    left = pooled.select(*cond, row, "slide_id", F.lit(True).alias("pooled"), F.col("emb").cast("array<double>").alias("emb"))
    left = left.unionByName(banks.select(*cond, row, "slide_id", F.lit(False).alias("pooled"), F.col("emb").cast("array<double>").alias("emb"))).select("*", every)
    right = reports.select(*cond, F.pmod(F.hash("report_id"), F.lit(cols)).alias("_col"), "report_id", F.col("emb").cast("array<double>").alias("emb"))
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("_row"))
    schema = T.StructType([*[pooled.schema[c] for c in cond], pooled.schema["slide_id"], reports.schema["report_id"], T.StructField("s_g", T.DoubleType()), T.StructField("s_p", T.DoubleType())])

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by("slide_id"), b.sort_by("report_id")
        flag = a.column("pooled").to_numpy()
        x, y = rows_of(a.column("emb")), rows_of(b.column("emb"))
        if not flag.any() or not len(y):
            return pa.Table.from_pylist([], schema=pa.schema([pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in schema]))
        of_slide = a.column("slide_id").combine_chunks()
        ids = of_slide.filter(pa.array(flag))
        y = unit_rows(y)
        g = tiled(unit_rows(x[flag]) if renormalise else x[flag], y)
        p = np.full(g.shape, np.nan)
        place = {s: i for i, s in enumerate(ids.to_pylist())}
        own = np.array([place.get(s, -1) for s in of_slide.filter(pa.array(~flag)).to_pylist()], int)
        if len(own):
            full = np.where(own[:, None] >= 0, tiled(unit_rows(x[~flag]), y), -np.inf)
            order = np.argsort(own, kind="stable")
            order = order[own[order] >= 0]
            start = np.flatnonzero(np.concatenate([[True], np.diff(own[order]) > 0])) if len(order) else np.empty(0, int)
            if len(start):
                p[own[order][start]] = np.maximum.reduceat(full[order], start, axis=0)
        n, m = g.shape
        texts_ = b.column("report_id").combine_chunks()
        out = [pa.array([k.as_py()] * (n * m)) for k in key[: len(cond)]]
        out += [ids.take(pa.array(np.repeat(np.arange(n), m))), texts_.take(pa.array(np.tile(np.arange(m), n))), pa.array(g.ravel()), pa.array(p.ravel(), mask=np.isnan(p.ravel()))]
        return pa.table(out, names=[*cond, "slide_id", "report_id", "s_g", "s_p"])

    keys = [*cond, "_row", "_col"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def directed(pairs: DataFrame, slide_pos: str = "slide_pos", report_pos: str = "report_pos") -> DataFrame:
    """Both directions of retrieval: ``direction, query_id, cand_id, q_pos, c_pos`` in place of slides and reports."""
    to = lambda d, q, c, qp, cp: pairs.withColumns({"direction": F.lit(d), "query_id": F.col(q), "cand_id": F.col(c), "q_pos": F.col(qp), "c_pos": F.col(cp)}).drop("slide_id", "report_id", slide_pos, report_pos)
    return to("I2T", "slide_id", "report_id", slide_pos, report_pos).unionByName(to("T2I", "report_id", "slide_id", report_pos, slide_pos))
