"""Ranks of candidates, per-query metrics, class means and their macro average."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cut-offs of the hit rate, and the depth of all metrics.
CUTS, DEPTH = (1, 3, 5, 10), 10
#: Metric columns. "Recall" is a hit rate: whether any of the first k is relevant.
METRICS = (*(f"Recall@{k}" for k in CUTS), f"MRR@{DEPTH}", f"mAP@{DEPTH}")


#: Shares of at most 1 as decimals: their sums and means are exact to the 18th place in any order of rows.
_EXACT = "decimal(22,18)"


def exact_mean(share: Column) -> Column:
    """Mean of numbers from 0 to 1 that does not depend on the order in which rows arrive."""
    return F.avg(share.cast(_EXACT)).cast("double")


def sortable(score: Column) -> Column:
    """NaN ranks last, so it becomes null (Spark puts NaN above all numbers)."""
    return F.when(F.isnan(score), None).otherwise(score)


def demote_own(pairs: DataFrame, score: str = "score") -> DataFrame:
    """The query's own item goes to the end of the ranking; it stays in the gallery."""
    return pairs.withColumn(score, F.when(F.col("query_id") == F.col("cand_id"), float("-inf")).otherwise(F.col(score)))


def top(pairs: DataFrame, cond: tuple[str, ...] = (), score: str = "score", tie: str = "c_pos", depth: int = DEPTH) -> DataFrame:
    """The first ``depth`` candidates of each query with their ``rank``; ties keep the order of ``tie``."""
    order = Window.partitionBy(*cond, "query_id").orderBy(sortable(F.col(score)).desc_nulls_last(), F.col(tie))
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)


def totals(labels: DataFrame, less: int = 0, cond: tuple[str, ...] = ()) -> DataFrame:
    """``label, total``: items of each label among all labelled items, less the query's own if that is excluded."""
    return labels.groupBy(*cond, "label").agg((F.count("*") - less).alias("total"))


def per_query(ranked: DataFrame, total: DataFrame, gallery: int | Column, cond: tuple[str, ...] = (), total_on: tuple[str, ...] = ()) -> DataFrame:
    """Metrics of each query: ``cond, query_id, label, eligible`` and ``METRICS``.

    ``ranked`` has ``label`` (of the query), ``cand_label`` and ``rank``. A query without anything relevant in the
    whole label table is not eligible and has null metrics. ``gallery``: candidates of a query, where fewer than
    ``DEPTH`` limit the denominator of the average precision.
    """
    rel = F.coalesce(F.col("label") == F.col("cand_label"), F.lit(False)).cast("int")
    run = Window.partitionBy(*cond, "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = ranked.withColumn("rel", rel).withColumn("hits", F.sum("rel").over(run))
    size = gallery if isinstance(gallery, Column) else F.lit(gallery)
    each = hits.groupBy(*cond, "query_id", "label").agg(
        *[F.max(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).cast("double").alias(f"_r{k}") for k in CUTS],
        F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("_mrr"),
        F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank")).otherwise(0.0).cast(_EXACT)).cast("double").alias("_sum"),
    )
    known = each.join(total, [*total_on, "label"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    ok = F.col("total") > 0
    ap = F.col("_sum") / F.least(F.col("total"), size, F.lit(DEPTH))
    values = [*(F.col(f"_r{k}") for k in CUTS), F.col("_mrr"), ap]
    return known.select(*cond, "query_id", "label", ok.alias("eligible"), *[F.when(ok, v).alias(m) for v, m in zip(values, METRICS, strict=True)])


def summary(queries: DataFrame, cond: tuple[str, ...] = ()) -> DataFrame:
    count = F.count("*")
    ok = F.count_if("eligible")
    return queries.groupBy(*cond).agg(count.alias("n_total_queries"), ok.alias("n_eligible_queries"), (count - ok).alias("n_zero_positive_queries"))


def class_level(queries: DataFrame, cond: tuple[str, ...] = (), metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean of each metric over the eligible queries of each class; queries without a label take no part."""
    kept = queries.filter(F.col("eligible") & F.col("label").isNotNull())
    return kept.groupBy(*cond, F.col("label").alias("class")).agg(F.count("*").alias("n_class"), *[exact_mean(F.col(f"`{m}`")).alias(m) for m in metrics])


def macro(classes: DataFrame, cond: tuple[str, ...] = (), metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Unweighted mean over classes: one row a condition (null metrics for none)."""
    return classes.groupBy(*cond).agg(*[exact_mean(F.col(f"`{m}`")).alias(m) for m in metrics])


def class_macro(values: DataFrame, value: str, label: str = "label", cond: tuple[str, ...] = ()) -> DataFrame:
    """Mean over classes of the class means of one value, without a test of eligibility."""
    return values.groupBy(*cond, label).agg(F.avg(value).alias("_m")).groupBy(*cond).agg(F.avg("_m").alias(value))


def relative_change(new: Column, base: Column) -> Column:
    """Change in percent of the base."""
    return 100.0 * (new - base) / base


def permutations(spark, gallery: int, seeds: int) -> DataFrame:
    """``seed, c_pos, perm_pos``: the place of each gallery position in NumPy's permutation of each seed.

    Made on the executors, a seed a row; a permutation holds one number for each gallery item.
    """
    import pandas as pd

    def draw(batches):
        for b in batches:
            for seed in b["id"]:
                order = np.random.default_rng(int(seed)).permutation(gallery)
                yield pd.DataFrame({"seed": int(seed), "c_pos": order.astype(np.int64), "perm_pos": np.arange(gallery, dtype=np.int64)})

    return spark.range(seeds).mapInPandas(draw, "seed long, c_pos long, perm_pos long")


def tie_neutral(pairs: DataFrame, orders: DataFrame, total: DataFrame, gallery: int, cond: tuple[str, ...] = (), total_on: tuple[str, ...] = ()) -> DataFrame:
    """Metrics averaged over random orders of exactly tied candidates; ``mAP@10_tie_sd`` is their deviation.

    ``orders``: ``seed, c_pos, perm_pos``, with ``c_pos`` numbered from 0 within a gallery. Only candidates that some
    order can bring among the first ``DEPTH``, those with a score no less than the query's ``DEPTH``-th, meet the orders.
    """
    place = Window.partitionBy(*cond, "query_id").orderBy(sortable(F.col("score")).desc_nulls_last())
    seeded = pairs.withColumn("_place", F.rank().over(place)).filter(F.col("_place") <= DEPTH).drop("_place").join(orders, "c_pos")
    runs = per_query(top(seeded, (*cond, "seed"), tie="perm_pos"), total, gallery, (*cond, "seed"), total_on)
    ap = METRICS[-1]
    return runs.groupBy(*cond, "query_id", "label", "eligible").agg(*[F.avg(m).alias(m) for m in METRICS], F.stddev_pop(ap).alias(f"{ap}_tie_sd"))
