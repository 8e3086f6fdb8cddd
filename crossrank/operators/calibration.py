"""Self-scaled log-softmax terms over candidates and over queries, and the scores made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossrank.functions.vectors import SCALE_EPS

#: Names of the score variants.
VARIANTS = (
    "mean_pooling",
    "global_only",
    "second_calibrated_channel",
    "local_only",
    "global_plus_reciprocal_local",
    "global_plus_direct_local",
    "rerank",
)


def _strip(pairs: DataFrame, keys: list[str], pos: str, values: dict[str, str], factor: float) -> DataFrame:
    """Adds to each row the log-softmax of its strip (all rows of ``keys``) for each value column.

    All windows have one partitioning and one order, so there is one shuffle and one sort, and sums fold by ``pos``:
    equal strips give equal results bit for bit, however rows were dealt. A strip is one row or column of the similarity
    matrix; its rows stay apart and may spill, so it need not fit in memory. A null score counts in no sum and stays null.
    """
    strip = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    value = {n: F.col(v).cast("double") for n, v in values.items()}
    with_mean = pairs.withColumns({f"_mean_{n}": F.sum(x).over(strip) / F.count(x).over(strip) for n, x in value.items()} | {f"_top_{n}": F.max(x).over(strip) for n, x in value.items()})
    off = {n: x - F.col(f"_mean_{n}") for n, x in value.items()}
    scale = {n: F.greatest(F.sqrt(F.sum(o * o).over(strip) / F.count(o).over(strip)) * factor, F.lit(SCALE_EPS)) for n, o in off.items()}
    scaled = with_mean.withColumns({f"_scale_{n}": s for n, s in scale.items()})
    top = {n: F.col(f"_top_{n}") / F.col(f"_scale_{n}") for n in values}  # scales are positive: the top stays the top
    total = {n: F.sum(F.exp(x / F.col(f"_scale_{n}") - top[n])).over(strip) for n, x in value.items()}
    summed = scaled.withColumns({f"_total_{n}": t for n, t in total.items()})
    made = {n: x / F.col(f"_scale_{n}") - (top[n] + F.log(F.col(f"_total_{n}"))) for n, x in value.items()}
    return summed.select(*[F.col(c) for c in pairs.columns], *[m.alias(n) for n, m in made.items()])


def direct(pairs: DataFrame, values: dict[str, str], cond: tuple[str, ...] = (), factor: float = 1.0) -> DataFrame:
    """Log-softmax over the candidates of each query: ``values`` maps new columns to score columns."""
    return _strip(pairs, [*cond, "query_id"], "c_pos", values, factor)


def reciprocal(pairs: DataFrame, values: dict[str, str], cond: tuple[str, ...] = (), factor: float = 1.0) -> DataFrame:
    """Log-softmax over the queries of each candidate."""
    return _strip(pairs, [*cond, "cand_id"], "q_pos", values, factor)


def calibrate(pairs: DataFrame, cond: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with the four terms ``d_g, d_p, r_g, r_p``."""
    return reciprocal(direct(pairs, {"d_g": "s_g", "d_p": "s_p"}, cond), {"r_g": "s_g", "r_p": "s_p"}, cond)


def rerank_score() -> Column:
    """The fused score of calibrated pairs."""
    return F.col("r_g") + 0.5 * (F.col("d_p") + F.col("r_p"))


def variant_scores() -> dict[str, Column]:
    d_g, d_p, r_g, r_p = map(F.col, ("d_g", "d_p", "r_g", "r_p"))
    scores = (F.col("s_g"), r_g, r_g + 0.5 * (d_g + r_g), 0.5 * (d_p + r_p), r_g + r_p, r_g + d_p, rerank_score())
    return dict(zip(VARIANTS, scores, strict=True))


def variants(calibrated: DataFrame, only: tuple[str, ...] = VARIANTS) -> DataFrame:
    """One row for each pair and variant: ``variant, score`` beside the pair's columns."""
    made = variant_scores()
    return calibrated.select("*", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), made[v].alias("score")) for v in only])).alias("_v")).select("*", "_v.variant", "_v.score").drop("_v")


