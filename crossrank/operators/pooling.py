"""Mean and maximum pooling of a slide's patch vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossrank.functions.vectors import NORM_EPS

#: Patches summed in one task; a slide of any size is the sum of such parts, in their order.
PART = 4096


def rows_of(column: pa.ChunkedArray) -> np.ndarray:
    """Equally long vectors as a matrix of doubles."""
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    if not len(flat):
        return np.zeros((0, 0))
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(len(flat), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), NORM_EPS)


def pool(patches: DataFrame, keys: tuple[str, ...] = ("slide_id",), pos: str = "patch_idx", vec: str = "emb") -> DataFrame:
    """``keys, mean_pool, max_pool, n_patches``: unit rows, then their mean and maximum, made unit again.

    Sums run in the order of ``pos`` within parts of ``PART`` positions and then over the parts, so the result
    does not depend on how rows lie in partitions.
    """
    fields = [patches.schema[k] for k in keys]
    arrays = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("total", "most")]
    part = patches.select(*keys, F.col(pos).cast("long").alias("_pos"), F.col(vec).cast("array<double>").alias("_vec"))
    part = part.withColumn("_part", F.floor(F.col("_pos") / PART))

    def head(group: pa.Table) -> list[pa.Array]:
        return [group.column(k).combine_chunks().slice(0, 1) if not isinstance(group.column(k).combine_chunks(), pa.ChunkedArray) else group.column(k).chunk(0).slice(0, 1) for k in keys]

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by("_pos")
        x = unit_rows(rows_of(group.column("_vec")))
        kind = pa.list_(pa.float64())
        return pa.table([*head(group), group.column("_part").slice(0, 1), pa.array([x.cumsum(0)[-1]], kind), pa.array([x.max(0)], kind), pa.array([len(x)], pa.int64())], names=[*keys, "_part", "total", "most", "n"])

    def whole(group: pa.Table) -> pa.Table:
        group = group.sort_by("_part")
        n = int(np.sum(group.column("n").to_numpy()))
        kind = pa.list_(pa.float64())
        mean, most = unit_rows(rows_of(group.column("total")).cumsum(0)[-1] / n), unit_rows(rows_of(group.column("most")).max(0))
        return pa.table([*head(group), pa.array([mean], kind), pa.array([most], kind), pa.array([n], pa.int64())], names=[*keys, "mean_pool", "max_pool", "n_patches"])

    parts = part.groupBy(*keys, "_part").applyInArrow(one, T.StructType([*fields, T.StructField("_part", T.LongType()), *arrays, T.StructField("n", T.LongType())]))
    out = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("mean_pool", "max_pool")]
    return parts.groupBy(*keys).applyInArrow(whole, T.StructType([*fields, *out, T.StructField("n_patches", T.LongType())]))


def consistent_dimension(patches: DataFrame, vec: str = "emb") -> None:
    """Raises if vectors differ in length or one is missing."""
    r = patches.agg(F.min(F.size(vec)).alias("a"), F.max(F.size(vec)).alias("b"), F.count_if(F.col(vec).isNull()).alias("c")).first()
    if r.c or r.a != r.b:
        raise ValueError(f"expected vectors of one length, got {r.a} to {r.b} and {r.c} missing")
