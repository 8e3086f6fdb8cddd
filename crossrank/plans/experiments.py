"""Held-out benchmark, method grid, stress test and score ablation: each one plan over all its conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.operators import statistics
from crossrank.operators.calibration import calibrate, rerank_score, variants
from crossrank.operators.ranking import METRICS, class_level, class_macro, macro, per_query, relative_change, summary, tie_neutral, top

def scored(pairs: DataFrame, score, decimals: int | None = None) -> DataFrame:
    """Adds ``score`` as it is. ``decimals`` rounds it: only for comparisons with an engine that adds in another order."""
    return pairs.withColumn("score", score if decimals is None else F.round(score, decimals))


def labelled(ranked: DataFrame, labels: DataFrame, cond: tuple[str, ...] = ()) -> DataFrame:
    """Labels of the query and of the candidate; ``labels``: ``cond, id, label`` (an unpivoted label table)."""
    q = labels.select(*cond, F.col("id").alias("query_id"), "label")
    c = labels.select(*cond, F.col("id").alias("cand_id"), F.col("label").alias("cand_label"))
    return ranked.join(q, "query_id").join(c, [*cond, "cand_id"])


def evaluate(pairs: DataFrame, labels: DataFrame, gallery: int, cond: tuple[str, ...], by: tuple[str, ...] = ("granularity",), less: int = 0) -> DataFrame:
    """Per-query metrics of scored pairs for every condition and label granularity.

    The ranking is cut to its depth before labels multiply rows.
    """
    total = labels.groupBy(*by, "label").agg((F.count("*") - less).alias("total"))
    return per_query(labelled(top(pairs, cond), labels, by), total, gallery, (*cond, *by), by)


def held_out(pairs: DataFrame, labels: DataFrame, gallery: int, cond: tuple[str, ...] = ("backbone", "scenario", "direction"), orders: DataFrame | None = None, decimals: int | None = None) -> DataFrame:
    """A row for each direction: cases and macro metrics (``R@k`` for the hit rates) of the fused score.

    With ``orders`` (random gallery orders) exact ties count by their mean over these orders.
    """
    ready = scored(calibrate(pairs, cond), rerank_score(), decimals)
    by = ("granularity",)
    if orders is None:
        queries = evaluate(ready, labels, gallery, cond)
    else:
        total = labels.groupBy(*by, "label").agg(F.count("*").alias("total"))
        named = labelled(ready, labels, by)
        queries = tie_neutral(named, orders, total, gallery, (*cond, *by), by)
    keys = (*cond, *by)
    n = summary(queries, keys).select(*keys, F.col("n_eligible_queries").alias("n_cases"))
    return macro(class_level(queries, keys), keys).join(n, list(keys)).withColumnsRenamed({m: m.replace("Recall", "R") for m in METRICS})


def method_grid(pairs: DataFrame, labels: DataFrame, gallery: int, cond: tuple[str, ...] = ("backbone", "scenario", "direction"), decimals: int | None = None) -> DataFrame:
    """Mean pooling against the fused score in every condition: both mAPs and the change in percent."""
    made = variants(calibrate(pairs, cond), ("mean_pooling", "rerank"))
    queries = evaluate(scored(made, F.col("score"), decimals), labels, gallery, (*cond, "variant"))
    keys = (*cond, "granularity")
    wide = macro(class_level(queries, (*keys, "variant")), (*keys, "variant")).groupBy(*keys).pivot("variant", ["mean_pooling", "rerank"]).agg(F.first("mAP@10"))
    base, new = F.col("mean_pooling"), F.col("rerank")
    return wide.select(*keys, base.alias("base_mAP@10"), new.alias("rerank_mAP@10"), relative_change(new, base).alias("delta_pct"))


def stress_test(pairs: DataFrame, labels: DataFrame, gallery: int, cond: tuple[str, ...] = ("backbone", "scenario", "direction"), decimals: int | None = None) -> DataFrame:
    """Mean pooling alone in every condition."""
    queries = evaluate(scored(pairs, F.col("s_g"), decimals), labels, gallery, cond)
    keys = (*cond, "granularity")
    return macro(class_level(queries, keys), keys).select(*keys, "mAP@10")


def ablation_queries(pairs: DataFrame, labels: DataFrame, gallery: int, cond: tuple[str, ...] = ("direction",), decimals: int | None = None) -> DataFrame:
    """Per-query metrics of all score variants."""
    made = scored(variants(calibrate(pairs, cond)), F.col("score"), decimals)
    return evaluate(made, labels, gallery, (*cond, "variant"))


def score_ablation(queries: DataFrame, units: DataFrame, metrics: tuple[str, ...] = ("mAP@10", "Recall@1"), replicates: int = 20_000, seed: int = 42, hashed: bool = True) -> DataFrame:
    """Each variant's macro metrics, their difference from the full score with its interval, p, and Holm's decision.

    ``units``: ``query_id, unit``. Holm's family is a variant's directions. One bootstrap plan covers all comparisons.
    """
    ref = queries.filter("variant = 'rerank'")
    long = lambda df, name: df.select("direction", "variant", "query_id", "label", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in metrics])).alias("_m")).select("direction", "variant", "query_id", "label", "_m.*")
    other = long(queries, "b")
    rows = other.filter("variant <> 'rerank'").join(long(ref, "a").drop("variant", "label"), ["direction", "query_id", "metric"]).join(units, "query_id")
    cond = ("direction", "variant", "metric")
    test = statistics.bootstrap_hashed(rows, replicates, seed, cond) if hashed else statistics.bootstrap_numpy(rows, cond, replicates, seed)
    tested = statistics.holm(test.select(*cond, "diff", "ci_lo", "ci_hi", "p"), "p", "direction", ("variant", "metric")).withColumnRenamed("reject", "holm")
    return class_macro(other, "b", cond=cond).withColumnRenamed("b", "value").join(tested, list(cond), "left").withColumn("holm", F.coalesce("holm", F.lit(False)))
