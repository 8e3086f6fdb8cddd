"""All queries of the engine, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossrank.functions import text as tx
from crossrank.functions import vectors as vx
from crossrank.operators import calibration, cohort, pooling, prototypes, ranking, rewriting, spatial, statistics
from crossrank.plans import experiments, fixtures, sql
from crossrank.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BOTH = tuple(fixtures.BACKBONES)
#: Decimals at which queries rank scores, as their SQL does: engines that add in another order then find the same ties.
#: The library and its jobs rank scores as they are.
DECIMALS = 9


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def r6(c: Column | str) -> Column:
    """Rounded to six decimals, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def by_dim(df: DataFrame, vec: str, *keys: str) -> DataFrame:
    """A row for each component: ``keys, dim, value``."""
    return df.select(*keys, F.posexplode(vec).alias("d", "x")).select(*keys, (F.col("d") + 1).cast("long").alias("dim"), r6("x").alias("value"))


def _dims_sql(ctes: str, src: str, vec: str, *keys: str) -> str:
    k = ", ".join(keys)
    return f"WITH {ctes} SELECT {k}, CAST(dim AS BIGINT) AS dim, round(x, 6) + 0.0 AS value FROM (SELECT {k}, unnest({vec}) AS x, generate_subscripts({vec}, 1) AS dim FROM {src})"


def rounded(df: DataFrame, *keys: str, metrics: tuple[str, ...] = ranking.METRICS) -> DataFrame:
    return df.select(*keys, *[r6(F.col(f"`{m}`")).alias(m) for m in metrics])


def labels_of(s: SparkSession, d: str, granularities=("oncotree",), splits: tuple[str, ...] = ()) -> DataFrame:
    """``granularity, id, label``: the label table, a row for each slide and granularity."""
    t = fixtures.slides(s, d)
    t = t.filter(F.col("split").isin(*splits)) if splits else t
    return t.select(F.col("slide_id").alias("id"), F.explode(F.array(*[F.struct(F.lit(g).alias("granularity"), F.col(g).alias("label")) for g in granularities])).alias("_g")).select("_g.granularity", "id", "_g.label")


# --- vectors


@query(_dims_sql(f"e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS emb FROM embeddings), u AS (SELECT vec_id, {sql.unit('emb')} AS emb FROM e)", "u", "emb", "vec_id"))
def q_l2_normalize(s, d):
    return by_dim(fixtures.vectors(s, d).select("vec_id", vx.unit(F.col("emb")).alias("emb")), "emb", "vec_id")


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS emb FROM embeddings) SELECT a.vec_id, round(list_dot_product(a.emb, b.emb), 6) + 0.0 AS dot FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def q_vec_dot(s, d):
    e = fixtures.vectors(s, d).select("vec_id", "emb")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("emb").alias("next")), "vec_id").select("vec_id", r6(vx.dot(F.col("emb"), F.col("next"))).alias("dot"))


@query("SELECT event_id, round(CASE WHEN value IS NULL THEN 0.0 ELSE least(1.0, greatest(0.0, value / 50.0 - 0.5)) END, 6) + 0.0 AS clipped FROM events")
def q_clip01(s, d):
    return fixtures.read(s, d, "events").select("event_id", r6(vx.clip01(F.col("value") / 50.0 - 0.5)).alias("clipped"))


_STRIPS = f"WITH {sql.pairs()} SELECT report_id, round({{}}, 6) + 0.0 AS value FROM pairs GROUP BY report_id"


def _strip(s, d, f) -> DataFrame:
    got = fixtures.pairs(s, d).groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("slide_pos", "s_g"))).alias("x"))
    return got.select("report_id", r6(f(F.transform("x", lambda r: r["s_g"]))).alias("value"))


@query(_STRIPS.format("ln(sum(exp(s_g)))"))
def q_logsumexp(s, d):
    return _strip(s, d, vx.logsumexp)


@query(_STRIPS.format("greatest(stddev_pop(s_g), 1e-8)"))
def q_clipped_std(s, d):
    return _strip(s, d, vx.population_scale)


@query(f"""WITH {sql.VECTORS}, x AS (SELECT slide_id, rn - 4 AS patch_idx, emb[1] / 0.05 AS l FROM v WHERE rn > 3)
SELECT slide_id, patch_idx, round(exp(l - max(l) OVER w) / sum(exp(l)) OVER w * exp(max(l) OVER w), 6) + 0.0 AS weight FROM x WINDOW w AS (PARTITION BY slide_id)""")
def q_softmax_weights(s, d):
    got = fixtures.patches(s, d).groupBy("slide_id").agg(F.array_sort(F.collect_list(F.struct("patch_idx", F.col("emb")[0].alias("x")))).alias("a"))
    w = vx.softmax(F.transform("a", lambda r: r["x"]), prototypes.DEFAULTS.temperature)
    return got.select("slide_id", F.explode(F.arrays_zip(F.transform("a", lambda r: r["patch_idx"]).alias("p"), w.alias("w"))).alias("z")).select("slide_id", F.col("z.p").alias("patch_idx"), r6("z.w").alias("weight"))


@query(f"WITH {sql.pairs()} SELECT report_id, arg_min(slide_id, slide_id) FILTER (WHERE s = m) AS first_slide FROM (SELECT report_id, slide_id, round(s_g, 1) AS s, max(round(s_g, 1)) OVER (PARTITION BY report_id) AS m FROM pairs) GROUP BY report_id")
def q_argmax_first(s, d):
    got = fixtures.pairs(s, d).groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("slide_pos", F.round("s_g", 1).alias("x")))).alias("a"))
    return got.select("report_id", F.element_at("a", (vx.argmax_first(F.transform("a", lambda r: r["x"])) + 1).cast("int"))["slide_pos"].alias("first_slide"))


# --- pooling and prototypes


@query(_dims_sql(sql.pairs(BOTH), "pool", "mean_pool", "backbone", "slide_id"))
def q_mean_pool(s, d):
    return by_dim(fixtures.pooled(s, d, BOTH), "mean_pool", "backbone", "slide_id")


@query(_dims_sql(sql.pairs(BOTH), "pool", "max_pool", "backbone", "slide_id"))
def q_max_pool(s, d):
    return by_dim(fixtures.pooled(s, d, BOTH), "max_pool", "backbone", "slide_id")


_GRID = "grid AS (SELECT unnest([2, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 160, 200]) AS k)"
_FEASIBLE = f"n AS (SELECT CAST(label AS BIGINT) AS slide_id, count(*) AS n FROM embeddings GROUP BY label), {_GRID}, f AS (SELECT slide_id, n, k FROM n, grid WHERE k <= n AND n / k >= 6)"


@query(f"WITH {_FEASIBLE} SELECT slide_id, n AS n_patches, CAST(k AS INTEGER) AS k FROM f")
def q_feasible_k(s, d):
    return prototypes.feasible(fixtures.label_slides(s, d).groupBy("slide_id").agg(F.count("*").alias("n_patches")))


@query(f"WITH {sql.VECTORS}, n AS (SELECT slide_id, count(*) AS n FROM v WHERE rn > 3 GROUP BY ALL) SELECT slide_id, CAST(n AS INTEGER) AS n_patches, CAST(1 AS INTEGER) AS k_star, round(least(1.0, n / 20.0), 6) + 0.0 AS support, 'fallback_low_patch_support' AS notes FROM n WHERE n < 12")
def q_fallback_bank(s, d):
    b = prototypes.build_banks(fixtures.patches(s, d)).filter("selected_by = 'fallback'")
    return b.select("slide_id", "n_patches", "k_star", r6("support").alias("support"), "notes")


@query()
def q_kmeans_bank(s, d):
    return prototypes.build_banks(fixtures.label_slides(s, d)).drop("emb")


#: Clusters given by a rule, to check the arithmetic of banks: patch modulo k.
_FIXED = f"""{_FEASIBLE},
e AS (SELECT CAST(label AS BIGINT) AS slide_id, vec_id, CAST(embedding AS DOUBLE[]) AS emb FROM embeddings), u AS (SELECT slide_id, vec_id, {sql.unit('emb')} AS u FROM e),
a AS (SELECT u.slide_id, k, n, vec_id, vec_id % k AS h, u FROM u JOIN f ON u.slide_id = f.slide_id),
ad AS (SELECT slide_id, k, h, unnest(u) AS x, generate_subscripts(u, 1) AS j FROM a),
cd AS (SELECT slide_id, k, h, j, avg(x) AS m FROM ad GROUP BY ALL), cl AS (SELECT slide_id, k, h, list(m ORDER BY j) AS m FROM cd GROUP BY ALL),
pr AS (SELECT slide_id, k, h, {sql.unit('m')} AS p FROM cl),
best AS (SELECT a.slide_id, a.k, any_value(n) AS n, vec_id, max(list_dot_product(u, p)) AS s FROM a JOIN pr ON a.slide_id = pr.slide_id AND a.k = pr.k GROUP BY a.slide_id, a.k, vec_id),
st AS (SELECT slide_id, k, avg(s) AS coverage, least(1.0, any_value(n) / k / 20.0) AS support FROM best GROUP BY slide_id, k),
ut AS (SELECT *, coverage * support AS utility, max(coverage * support) OVER (PARTITION BY slide_id) AS top FROM st)"""


def _fixed(s, d) -> tuple[DataFrame, DataFrame]:
    """Assigned patches (``slide_id, k, vec_id, h, n_patches, emb``) and plain prototypes (``slide_id, k, h, emb``)."""
    e = fixtures.label_slides(s, d).withColumn("emb", vx.unit(F.col("emb")))
    k = prototypes.feasible(e.groupBy("slide_id").agg(F.count("*").alias("n_patches")))
    a = e.join(k, "slide_id").withColumn("h", F.col("vec_id") % F.col("k")).select("slide_id", "k", "vec_id", "h", "n_patches", "emb")
    return a, pooling.pool(a, ("slide_id", "k", "h"), "vec_id").select("slide_id", "k", "h", F.col("mean_pool").alias("emb"))


def _bank_stats(s, d) -> DataFrame:
    a, p = _fixed(s, d)
    both = a.select("slide_id", "k", "vec_id", "n_patches", "emb").join(p.select("slide_id", "k", F.col("emb").alias("p")), ["slide_id", "k"])
    best = both.groupBy("slide_id", "k", "vec_id", "n_patches").agg(F.max(vx.dot(F.col("emb"), F.col("p"))).alias("s"))
    got = best.groupBy("slide_id", "k", "n_patches").agg(F.avg("s").alias("coverage"))
    got = got.withColumn("support", prototypes.support_of(F.col("n_patches"), F.col("k")))
    return got.withColumn("utility", F.col("coverage") * F.col("support"))


@query(_dims_sql(_FIXED, "(SELECT slide_id, CAST(k AS INTEGER) AS k, h, p FROM pr)", "p", "slide_id", "k", "h"))
def q_plain_prototypes(s, d):
    return by_dim(_fixed(s, d)[1], "emb", "slide_id", "k", "h")


@query(f"WITH {_FIXED} SELECT slide_id, CAST(k AS INTEGER) AS k, round(coverage, 6) + 0.0 AS coverage, round(support, 6) + 0.0 AS support, round(utility, 6) + 0.0 AS utility FROM ut")
def q_coverage_support_utility(s, d):
    return _bank_stats(s, d).select("slide_id", "k", *[r6(c).alias(c) for c in ("coverage", "support", "utility")])


@query(f"WITH {_FIXED} SELECT slide_id, CAST(min(k) AS INTEGER) AS k, round(least(1.0, greatest(0.0, arg_min(utility, k))), 6) + 0.0 AS q_proto FROM ut WHERE utility >= 0.97 * top GROUP BY slide_id")
def q_near_best_k(s, d):
    return prototypes.near_best(_bank_stats(s, d)).select("slide_id", "k", r6("q_proto").alias("q_proto"))


def _refined_sql() -> str:
    return _dims_sql(_FIXED + f""",
w AS (SELECT a.slide_id, a.k, a.h, vec_id, u, exp(list_dot_product(u, p) / 0.05 - max(list_dot_product(u, p) / 0.05) OVER (PARTITION BY a.slide_id, a.k, a.h)) AS w FROM a JOIN pr ON a.slide_id = pr.slide_id AND a.k = pr.k AND a.h = pr.h),
wd AS (SELECT slide_id, k, h, w, unnest(u) AS x, generate_subscripts(u, 1) AS j FROM w), wm AS (SELECT slide_id, k, h, j, sum(w * x) / sum(w) AS m FROM wd GROUP BY ALL),
wl AS (SELECT slide_id, CAST(k AS INTEGER) AS k, h, list(m ORDER BY j) AS m FROM wm GROUP BY ALL), rf AS (SELECT slide_id, k, h, {sql.unit('m')} AS p FROM wl)""", "rf", "p", "slide_id", "k", "h")


@query(_refined_sql())
def q_refine_prototypes_all(s, d):
    a, _ = _fixed(s, d)
    return by_dim(a.groupBy("slide_id", "k").applyInPandas(_refined, "slide_id long, k int, h long, emb array<double>"), "emb", "slide_id", "k", "h")


def _refined(pdf):
    import pandas as pd

    pdf = pdf.sort_values("vec_id")
    x = np.stack(pdf.emb.to_list())
    h, own = np.unique(pdf.h.to_numpy(), return_inverse=True)  # a cluster may have no patch
    plain = pooling.unit_rows(np.stack([x[own == i].mean(0) for i in range(len(h))]))
    out = prototypes.refine(x, own, plain, prototypes.DEFAULTS.temperature)
    return pd.DataFrame({"slide_id": pdf.slide_id.iloc[0], "k": pdf.k.iloc[0], "h": h, "emb": list(out)})


#: A bank for each slide of the small kind: its first three patches.
_BANK3 = f"{sql.VECTORS}, u AS (SELECT slide_id, rn, {sql.unit('emb')} AS u FROM v), b AS (SELECT slide_id, CAST(rn - 4 AS INTEGER) AS h, u FROM u WHERE rn BETWEEN 4 AND 6)"


def _bank3(s, d) -> DataFrame:
    return fixtures.patches(s, d).filter("patch_idx < 3").select("slide_id", F.col("patch_idx").cast("int").alias("h"), vx.unit(F.col("emb")).alias("emb"))


@query(f"WITH {_BANK3} SELECT slide_id, patch_idx, h, round(sim, 6) + 0.0 AS sim FROM (SELECT u.slide_id, u.rn - 4 AS patch_idx, b.h, list_dot_product(u.u, b.u) AS sim, row_number() OVER (PARTITION BY u.slide_id, u.rn ORDER BY list_dot_product(u.u, b.u) DESC, b.h) AS n FROM u JOIN b ON u.slide_id = b.slide_id WHERE u.rn > 3) WHERE n = 1")
def q_assign_nearest(s, d):
    p = fixtures.patches(s, d).withColumn("emb", vx.unit(F.col("emb")))
    return spatial.assign(p, _bank3(s, d)).withColumn("sim", r6("sim"))


@query(f"""WITH {_BANK3}, asg AS (SELECT slide_id, rn, h FROM (SELECT u.slide_id, u.rn, b.h, row_number() OVER (PARTITION BY u.slide_id, u.rn ORDER BY list_dot_product(u.u, b.u) DESC, b.h) AS n FROM u JOIN b ON u.slide_id = b.slide_id WHERE u.rn > 3) WHERE n = 1),
hs AS (SELECT slide_id, h FROM (SELECT b.slide_id, b.h, row_number() OVER (PARTITION BY b.slide_id ORDER BY list_dot_product(b.u, r.u) DESC, b.h) AS n FROM b JOIN u r ON b.slide_id = r.slide_id AND r.rn = 2) WHERE n = 1)
SELECT hs.slide_id, hs.h AS h_star, count(asg.rn) AS n_patches FROM hs LEFT JOIN asg ON hs.slide_id = asg.slide_id AND hs.h = asg.h GROUP BY ALL""")
def q_hstar_count(s, d):
    p = fixtures.patches(s, d).withColumn("emb", vx.unit(F.col("emb")))
    own = fixtures.reports(s, d).filter("scenario = 'strict'").select("slide_id", F.col("slide_id").alias("report_id"), vx.unit(F.col("emb")).alias("emb"))
    star = spatial.best_prototype(_bank3(s, d), own).select("slide_id", "h")
    n = spatial.counts(spatial.assign(p, _bank3(s, d)))
    return star.join(n, ["slide_id", "h"], "left").select("slide_id", F.col("h").alias("h_star"), F.coalesce("n_patches", F.lit(0)).cast("long").alias("n_patches"))


# --- similarity, calibration, scores


def _values(df: DataFrame, *values: str, keys=("slide_id", "report_id")) -> DataFrame:
    return df.select("backbone", "scenario", *keys, *[r6(v).alias(v) for v in values])


@query(f"WITH {sql.pairs(BOTH, ('original', 'strict'))} SELECT backbone, scenario, slide_id, report_id, round(s_g, 6) + 0.0 AS s_g FROM pairs")
def q_global_similarity(s, d):
    return _values(fixtures.pairs(s, d, BOTH, ("original", "strict")), "s_g")


@query(f"WITH {sql.pairs()} SELECT backbone, scenario, slide_id, report_id, round(s_p, 6) + 0.0 AS s_p FROM pairs")
def q_prototype_similarity(s, d):
    return _values(fixtures.pairs(s, d), "s_p")


_WAY = ("direction", "query_id", "cand_id")
COND = ("backbone", "scenario", "direction")


@query(f"WITH {sql.calibrated()} SELECT backbone, scenario, direction, query_id, cand_id, round(d_g, 6) + 0.0 AS d_g, round(d_p, 6) + 0.0 AS d_p FROM cal")
def q_direct_term(s, d):
    return _values(calibration.direct(fixtures.both_ways(s, d), {"d_g": "s_g", "d_p": "s_p"}, COND), "d_g", "d_p", keys=_WAY)


@query(f"WITH {sql.calibrated()} SELECT backbone, scenario, direction, query_id, cand_id, round(r_g, 6) + 0.0 AS r_g, round(r_p, 6) + 0.0 AS r_p FROM cal")
def q_recip_term(s, d):
    return _values(calibration.reciprocal(fixtures.both_ways(s, d), {"r_g": "s_g", "r_p": "s_p"}, COND), "r_g", "r_p", keys=_WAY)


def _score_sql(expr: str, way: str | None = None) -> str:
    return f"WITH {sql.calibrated()} SELECT direction, query_id, cand_id, round({expr}, 6) + 0.0 AS score FROM cal" + (f" WHERE direction = '{way}'" if way else "")


def _scores(s, d, score: Column) -> DataFrame:
    return calibration.calibrate(fixtures.both_ways(s, d), COND).select(*_WAY, r6(score).alias("score"))


@query(_score_sql(sql.SCORES["rerank"], "I2T"))
def q_rerank_score_i2t(s, d):
    return _scores(s, d, calibration.rerank_score()).filter("direction = 'I2T'")


@query(_score_sql(sql.SCORES["rerank"], "T2I"))
def q_rerank_score_t2i(s, d):
    return _scores(s, d, calibration.rerank_score()).filter("direction = 'T2I'")


@query(_score_sql("r_g"))
def q_global_only(s, d):
    return _scores(s, d, F.col("r_g"))


@query(f"WITH {sql.calibrated()}, {sql.variants()} SELECT direction, query_id, cand_id, variant, round(score, 6) + 0.0 AS score FROM scored")
def q_score_variants(s, d):
    return calibration.variants(calibration.calibrate(fixtures.both_ways(s, d), COND)).select(*_WAY, "variant", r6("score").alias("score"))


# --- ranking and metrics


def _reranked(s, d, **kw) -> DataFrame:
    ready = calibration.calibrate(fixtures.both_ways(s, d, **kw), COND)
    return experiments.scored(ready, calibration.rerank_score(), DECIMALS).withColumn("variant", F.lit("rerank"))


_RERANKED = f"{sql.calibrated()}, {sql.variants(('rerank',))}"
KEYS = (*COND, "variant")


@query(f"WITH {_RERANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY direction, query_id ORDER BY round(score, 9) DESC, cand_id) AS rank FROM scored) SELECT direction, query_id, cand_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def q_rank_top10(s, d):
    return ranking.top(_reranked(s, d), KEYS).select(*_WAY, "rank")


#: Scores with exact ties, and every report twice.
_TIED = f"""WITH {sql.pairs()}, t AS (SELECT slide_id AS query_id, report_id + x AS cand_id, round(s_g, 1) AS score FROM pairs, (SELECT unnest([0, 100]) AS x))"""


def _tied(s, d, copies: bool = True) -> DataFrame:
    p = fixtures.pairs(s, d).select(F.col("slide_id").alias("query_id"), F.explode(F.array(F.lit(0), F.lit(100)) if copies else F.array(F.lit(0))).alias("x"), "report_id", F.round("s_g", 1).alias("score"))
    return p.select("query_id", (F.col("report_id") + F.col("x")).alias("cand_id"), "score").withColumn("c_pos", F.col("cand_id"))


@query(_TIED + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS rank FROM t) SELECT query_id, cand_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def q_rank_ties_stable(s, d):
    return ranking.top(_tied(s, d)).select("query_id", "cand_id", "rank")


def _metrics(s, d, own: bool = False) -> DataFrame:
    p = _reranked(s, d)
    return experiments.evaluate(ranking.demote_own(p) if own else p, labels_of(s, d, fixtures.GRANULARITIES), fixtures.SLIDES, KEYS, less=int(own))


_BOTH_G = tuple(fixtures.GRANULARITIES)
_PQ = f"{_RERANKED}, {sql.metrics(_BOTH_G)}"


@query(f"WITH {_RERANKED}, {sql.metrics(_BOTH_G, own=True)} SELECT direction, granularity, query_id, label, eligible, {sql.rounded_metrics()} FROM pq")
def q_rank_exact_pair_excluded(s, d):
    return rounded(_metrics(s, d, own=True), "direction", "granularity", "query_id", "label", "eligible")


@query(f"WITH {_PQ} SELECT direction, granularity, query_id, label, eligible, {sql.rounded_metrics()} FROM pq")
def q_per_query_metrics(s, d):
    return rounded(_metrics(s, d), "direction", "granularity", "query_id", "label", "eligible")


@query(f"WITH {_PQ} SELECT direction, granularity, count(*) AS n_total_queries, CAST(count_if(eligible) AS BIGINT) AS n_eligible_queries, CAST(count(*) - count_if(eligible) AS BIGINT) AS n_zero_positive_queries FROM pq GROUP BY ALL")
def q_summary(s, d):
    return ranking.summary(_metrics(s, d), ("direction", "granularity"))


@query(f"WITH {_PQ}, {sql.classes()} SELECT direction, granularity, class, n_class, {sql.rounded_metrics()} FROM cl")
def q_class_level(s, d):
    return rounded(ranking.class_level(_metrics(s, d), ("direction", "granularity")), "direction", "granularity", "class", "n_class")


@query(f"WITH {_PQ}, {sql.classes()} SELECT direction, granularity, {sql.rounded_metrics()} FROM mac")
def q_class_macro(s, d):
    keys = ("direction", "granularity")
    return rounded(ranking.macro(ranking.class_level(_metrics(s, d), keys), keys), *keys)


_MD5_ORDER = "row_number() OVER (PARTITION BY seed ORDER BY " + sql.md5_number("seed || '|' || c") + ", c) - 1"


def _tie_neutral_sql(seeds: int) -> str:
    return f"""{_TIED.replace("[0, 100]", "[0]")}, o AS (SELECT seed, c AS cand_id, {_MD5_ORDER} AS perm_pos FROM (SELECT unnest(range({seeds})) AS seed), (SELECT slide_id AS c FROM kept)),
s5 AS (SELECT t.*, seed, perm_pos FROM t JOIN o USING (cand_id)),
r AS (SELECT seed, query_id, cand_id, row_number() OVER (PARTITION BY seed, query_id ORDER BY score DESC, perm_pos) AS rank FROM s5),
h AS (SELECT *, CAST(query_id // 4 = cand_id // 4 AS INT) AS rel FROM r WHERE rank <= 10),
c AS (SELECT *, sum(rel) OVER (PARTITION BY seed, query_id ORDER BY rank) AS hits FROM h),
tot AS (SELECT slide_id // 4 AS label, count(*) AS total FROM kept GROUP BY ALL),
q AS (SELECT seed, query_id, CAST(max(CASE WHEN rank = 1 THEN rel ELSE 0 END) AS DOUBLE) AS r1, coalesce(1.0 / min(CASE WHEN rel = 1 THEN rank END), 0.0) AS rr, sum(CASE WHEN rel = 1 THEN CAST(hits AS DOUBLE) / rank ELSE 0.0 END) / least(any_value(total), 10) AS ap
  FROM c JOIN tot ON query_id // 4 = label GROUP BY seed, query_id)
SELECT query_id, round(avg(r1), 6) + 0.0 AS "Recall@1", round(avg(rr), 6) + 0.0 AS "MRR@10", round(avg(ap), 6) + 0.0 AS "mAP@10", round(stddev_pop(ap), 6) + 0.0 AS "mAP@10_tie_sd" FROM q GROUP BY query_id"""


def _tie_neutral_md5(s, d, seeds: int) -> DataFrame:
    order = ranking.Window.partitionBy("seed").orderBy(statistics.md5_number(F.col("seed"), F.col("c_pos")), "c_pos")
    orders = s.range(seeds).select(F.col("id").alias("seed"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(fixtures.SLIDES - 1).cast("long"))).alias("c_pos")).withColumn("perm_pos", F.row_number().over(order))
    return _neutral(s, d, orders, "Recall@1", "MRR@10", "mAP@10", "mAP@10_tie_sd")


@query(_tie_neutral_sql(5))
def q_tie_neutral_md5(s, d):
    return _tie_neutral_md5(s, d, 5)


@query(_tie_neutral_sql(50))
def q_tie_neutral_md5_full(s, d):
    return _tie_neutral_md5(s, d, 50)


def _neutral(s, d, orders: DataFrame, *columns: str) -> DataFrame:
    named = experiments.labelled(_tied(s, d, copies=False), labels_of(s, d), ("granularity",))
    got = ranking.tie_neutral(named, orders, ranking.totals(labels_of(s, d)), fixtures.SLIDES)
    return got.select("query_id", *[r6(F.col(f"`{c}`")).alias(c) for c in columns])


@query()
def q_tie_neutral_numpy(s, d):
    return _neutral(s, d, ranking.permutations(s, fixtures.SLIDES, 50), *ranking.METRICS, "mAP@10_tie_sd")


# --- experiments

_HELD = f"{sql.calibrated(scenarios=('strict',), splits=('test',))}, {sql.variants(('rerank',))}, {sql.metrics()}, {sql.classes()}"
_RK = {m: m.replace("Recall", "R") for m in ranking.METRICS}
_HELD_COLS = ", ".join(f'round("{m}", 6) + 0.0 AS "{r}"' for m, r in _RK.items())


@query(f"WITH {_HELD}, n AS (SELECT direction, CAST(count_if(eligible) AS BIGINT) AS n_cases FROM pq GROUP BY ALL) SELECT backbone, scenario, granularity, mac.direction, n_cases, {_HELD_COLS} FROM mac JOIN n USING (direction)")
def q_heldout(s, d):
    got = experiments.held_out(fixtures.both_ways(s, d, splits=("test",)), labels_of(s, d, splits=("test",)), 16, decimals=DECIMALS)
    return rounded(got, "backbone", "scenario", "granularity", "direction", "n_cases", metrics=tuple(_RK.values()))


_ALL = {"backbones": BOTH, "scenarios": fixtures.SCENARIOS}
_KEEP = ("train", "test")


@query(f"""WITH {sql.calibrated(**_ALL, splits=_KEEP)}, {sql.variants(('mean_pooling', 'rerank'))}, {sql.metrics(_BOTH_G)}, {sql.classes()},
g AS (SELECT backbone, scenario, direction, granularity, max("mAP@10") FILTER (WHERE variant = 'mean_pooling') AS a, max("mAP@10") FILTER (WHERE variant = 'rerank') AS b FROM mac GROUP BY ALL)
SELECT backbone, scenario, direction, granularity, round(a, 6) + 0.0 AS "base_mAP@10", round(b, 6) + 0.0 AS "rerank_mAP@10", round(100.0 * (b - a) / a, 6) + 0.0 AS delta_pct FROM g""")
def q_method_grid(s, d):
    got = experiments.method_grid(fixtures.both_ways(s, d, **_ALL, splits=_KEEP), labels_of(s, d, _BOTH_G, _KEEP), fixtures.SLIDES, decimals=DECIMALS)
    return rounded(got, *COND, "granularity", metrics=("base_mAP@10", "rerank_mAP@10", "delta_pct"))


@query(f'WITH {sql.calibrated(**_ALL)}, {sql.variants(("mean_pooling",))}, {sql.metrics(_BOTH_G)}, {sql.classes()} SELECT backbone, scenario, direction, granularity, round("mAP@10", 6) + 0.0 AS "mAP@10" FROM mac')
def q_stress_test(s, d):
    got = experiments.stress_test(fixtures.both_ways(s, d, **_ALL), labels_of(s, d, _BOTH_G), fixtures.SLIDES, decimals=DECIMALS)
    return rounded(got, *COND, "granularity", metrics=("mAP@10",))


# --- statistics

#: Metrics of two variants for each query, with the case as unit.
_AB = f"""{sql.calibrated()}, {sql.variants(('mean_pooling', 'rerank'))}, {sql.metrics()},
ab AS (SELECT a.direction, a.query_id, a.label, a.query_id // 2 AS unit, a."mAP@10" AS a, b."mAP@10" AS b FROM pq a JOIN pq b ON a.direction = b.direction AND a.query_id = b.query_id AND a.variant = 'rerank' AND b.variant = 'mean_pooling'),
us AS (SELECT direction, label, unit, sum(a) AS sum_a, sum(b) AS sum_b, count(*) AS n FROM ab GROUP BY ALL)"""


def _ab(s, d) -> DataFrame:
    made = calibration.variants(calibration.calibrate(fixtures.both_ways(s, d), COND), ("mean_pooling", "rerank"))
    q = experiments.evaluate(experiments.scored(made, F.col("score"), DECIMALS), labels_of(s, d), fixtures.SLIDES, KEYS)
    wide = q.groupBy("direction", "query_id", "label").agg(*[F.first(F.when(F.col("variant") == v, F.col("`mAP@10`")), ignorenulls=True).alias(n) for v, n in (("rerank", "a"), ("mean_pooling", "b"))])
    return wide.withColumn("unit", F.floor(F.col("query_id") / 2))


@query(f"WITH {_AB} SELECT unit, count(DISTINCT label) AS n_classes FROM ab GROUP BY unit")
def q_unit_nesting(s, d):
    rows = _ab(s, d)
    statistics.check_nesting(rows)
    return rows.groupBy("unit").agg(F.count_distinct("label").alias("n_classes"))


@query(f"WITH {_AB} SELECT direction, label, unit, round(sum_a, 6) + 0.0 AS sum_a, round(sum_b, 6) + 0.0 AS sum_b, n FROM us")
def q_unit_sums(s, d):
    return statistics.unit_sums(_ab(s, d), ("direction", "label", "unit")).select("direction", "label", "unit", r6("sum_a").alias("sum_a"), r6("sum_b").alias("sum_b"), "n")


@query(f"WITH {_AB}, c AS (SELECT direction, label, (sum(sum_b) - sum(sum_a)) / sum(n) AS d FROM us GROUP BY ALL) SELECT direction, round(avg(d), 6) + 0.0 AS diff FROM c GROUP BY ALL")
def q_point_diff(s, d):
    sums = statistics.unit_sums(_ab(s, d), ("direction", "label", "unit"))
    return statistics.point_difference(sums, ("direction",)).select("direction", r6("diff").alias("diff"))


def _boot_sql(us: str, cond: str, b: int, seed: int) -> str:
    """``bt``: percentile interval, p and deviation of replicate differences over the unit sums ``us``."""
    return f"""ar AS (SELECT {cond}, label, list(struct_pack(u := unit, a := sum_a, b := sum_b, n := n) ORDER BY unit) AS u FROM {us} GROUP BY ALL),
dr AS (SELECT {cond}, label, b, u[1 + CAST({sql.md5_number(f"'{seed}|' || b || '|' || label || '|' || i")} % len(u) AS BIGINT)] AS x FROM ar, (SELECT unnest(range({b})) AS b), (SELECT unnest(range(1000)) AS i) WHERE i < len(u)),
rc AS (SELECT {cond}, b, label, sum(x.b - x.a) / sum(x.n) AS d FROM dr GROUP BY ALL), rd AS (SELECT {cond}, b, avg(d) AS d FROM rc GROUP BY ALL),
bt AS (SELECT {cond}, quantile_cont(d, 0.025) AS ci_lo, quantile_cont(d, 0.975) AS ci_hi, stddev_samp(d) AS sd,
  least(1.0, greatest(2.0 * least(avg(CAST(d <= 0 AS INT)), avg(CAST(d >= 0 AS INT))), 1.0 / {b})) AS p FROM rd GROUP BY ALL)"""


def _bootstrap_sql(replicates: int) -> str:
    return f"""WITH {_AB}, {_boot_sql('us', 'direction', replicates, 42)}, c AS (SELECT direction, label, (sum(sum_b) - sum(sum_a)) / sum(n) AS d, sum(n) AS n, count(*) AS u FROM us GROUP BY ALL),
pt AS (SELECT direction, avg(d) AS diff, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(u) AS BIGINT) AS n_units FROM c GROUP BY ALL)
SELECT direction, round(diff, 6) + 0.0 AS diff, round(ci_lo, 6) + 0.0 AS ci_lo, round(ci_hi, 6) + 0.0 AS ci_hi, round(p, 6) + 0.0 AS p, n_rows, n_units, round(sd, 6) + 0.0 AS sd FROM bt JOIN pt USING (direction)"""


def _bootstrap_md5(s, d, replicates: int) -> DataFrame:
    got = statistics.bootstrap_hashed(_ab(s, d), replicates, 42, ("direction",))
    return got.select("direction", *[r6(c).alias(c) for c in ("diff", "ci_lo", "ci_hi", "p")], "n_rows", "n_units", r6("sd").alias("sd"))


@query(_bootstrap_sql(200))
def q_bootstrap_md5(s, d):
    return _bootstrap_md5(s, d, 200)


@query(_bootstrap_sql(2000))
def q_bootstrap_md5_full(s, d):
    return _bootstrap_md5(s, d, 2000)


@query()
def q_bootstrap_numpy(s, d):
    return statistics.bootstrap_numpy(_ab(s, d), ("direction",), 2000, 42)


@query()
def q_bootstrap_multi(s, d):
    return statistics.bootstrap_multi(_ab(s, d).withColumn("c", F.lit(0.5) * (F.col("a") + F.col("b"))), ("a", "b", "c"), "a", ("direction",))


@query("SELECT * FROM (VALUES ('a', 0, true), ('a', 1, true), ('a', 2, true), ('b', 0, true), ('b', 1, false), ('b', 2, false)) t(family, idx, reject)")
def q_holm(s, d):
    p = s.createDataFrame([("a", 0, 0.001), ("a", 1, 0.02), ("a", 2, 0.04), ("b", 0, 0.001), ("b", 1, 0.03), ("b", 2, 0.04)], "family string, idx int, p double")
    return statistics.holm(p, by=("family",)).select("family", "idx", "reject")


_ABLATION = f"""{sql.calibrated()}, {sql.variants()}, {sql.metrics()},
lg AS (SELECT direction, variant, query_id, label, 'mAP@10' AS metric, "mAP@10" AS v FROM pq UNION ALL SELECT direction, variant, query_id, label, 'Recall@1', "Recall@1" FROM pq),
cm AS (SELECT direction, variant, metric, label, avg(v) AS v FROM lg GROUP BY ALL), val AS (SELECT direction, variant, metric, avg(v) AS value FROM cm GROUP BY ALL),
ab AS (SELECT b.direction, b.variant, b.metric, b.label, b.query_id // 2 AS unit, a.v AS a, b.v AS b FROM lg b JOIN lg a ON a.variant = 'rerank' AND b.variant <> 'rerank' AND a.direction = b.direction AND a.query_id = b.query_id AND a.metric = b.metric),
us AS (SELECT direction, variant, metric, label, unit, sum(a) AS sum_a, sum(b) AS sum_b, count(*) AS n FROM ab GROUP BY ALL),
{_boot_sql('us', 'direction, variant, metric', 100, 42)},
pc AS (SELECT direction, variant, metric, label, (sum(sum_b) - sum(sum_a)) / sum(n) AS d FROM us GROUP BY ALL), pt AS (SELECT direction, variant, metric, avg(d) AS diff FROM pc GROUP BY ALL),
hk AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY variant, metric) AS m FROM bt WINDOW w AS (PARTITION BY variant, metric ORDER BY p, direction)),
hm AS (SELECT *, bool_and(p <= 0.05 / (m - k + 1)) OVER (PARTITION BY variant, metric ORDER BY k) AS reject FROM hk)"""


@query(f"""WITH {_ABLATION} SELECT val.direction, val.variant, val.metric, round(value, 6) + 0.0 AS value, round(diff, 6) + 0.0 AS diff, round(ci_lo, 6) + 0.0 AS ci_lo, round(ci_hi, 6) + 0.0 AS ci_hi, round(p, 6) + 0.0 AS p, coalesce(reject, false) AS holm
FROM val LEFT JOIN hm ON val.direction = hm.direction AND val.variant = hm.variant AND val.metric = hm.metric LEFT JOIN pt ON val.direction = pt.direction AND val.variant = pt.variant AND val.metric = pt.metric""")
def q_score_ablation(s, d):
    return _score_ablation(s, d, 100)


def _score_ablation(s, d, replicates: int) -> DataFrame:
    q = experiments.ablation_queries(fixtures.both_ways(s, d), labels_of(s, d), fixtures.SLIDES, COND, DECIMALS)
    units = fixtures.slides(s, d).select(F.col("slide_id").alias("query_id"), F.col("case_id").alias("unit"))
    got = experiments.score_ablation(q, units, replicates=replicates)
    return got.select("direction", "variant", "metric", *[r6(c).alias(c) for c in ("value", "diff", "ci_lo", "ci_hi", "p")], "holm")


@query()
def q_score_ablation_full(s, d):
    return _score_ablation(s, d, 20_000)


def _holm_by_variant(ablation: DataFrame) -> DataFrame:
    got = ablation.filter("variant <> 'rerank'")
    return statistics.holm(got, "p", "direction", ("variant", "metric")).select("direction", "variant", "metric", "p", "reject")


@query(f"WITH {_ABLATION} SELECT direction, variant, metric, round(p, 6) + 0.0 AS p, reject FROM hm")
def q_holm_by_variant(s, d):
    return _holm_by_variant(q_score_ablation(s, d))


@query()
def q_holm_by_variant_full(s, d):
    return _holm_by_variant(q_score_ablation_full(s, d))


# --- text


def _text_sql(expr: str, name: str) -> str:
    return f"WITH {sql.TEXTS} SELECT slide_id, {expr} AS {name} FROM rt"


@query(_text_sql(sql.one_paragraph("slide_reports"), "line"))
def q_one_paragraph(s, d):
    return fixtures.reports_text(s, d).select("slide_id", tx.one_paragraph(F.col("slide_reports")).alias("line"))


@query(f"WITH {sql.TEXTS}, l AS (SELECT slide_id, {sql.one_paragraph('slide_reports')} AS x FROM rt) SELECT slide_id, {sql.ensure_period('x')} AS sentence FROM l")
def q_ensure_period_whole(s, d):
    return fixtures.reports_text(s, d).select("slide_id", tx.ensure_period(tx.one_paragraph(F.col("slide_reports"))).alias("sentence"))


@query(f"WITH {sql.TEXTS} SELECT slide_id, slide_reports_no_diagnosis_strict IS NOT NULL AND length({sql.one_paragraph('slide_reports_no_diagnosis_strict')}) >= 15 AS useful FROM rt")
def q_useful_text(s, d):
    return fixtures.reports_text(s, d).select("slide_id", tx.useful(F.col("slide_reports_no_diagnosis_strict")).alias("useful"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS INTEGER) END AS seconds FROM documents")
def q_retry_seconds(s, d):
    msg = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Rate limit. Try again in "), F.col("doc_id").cast("string"), F.lit("s."))).otherwise("try later")
    return fixtures.read(s, d, "documents").select("doc_id", tx.retry_seconds(msg).alias("seconds"))


_STATIC = f"sh AS (SELECT slide_id, list_filter({sql.static_hits('slide_reports')}, lambda p: p IS NOT NULL) AS h FROM rt)"
_TERMS = f"tm AS (SELECT slide_id, {sql.terms('cancer_type_detailed', 'site_of_resection_or_biopsy')} AS terms FROM rt)"
_DYN = r"dy AS (SELECT slide_id, t FROM (SELECT slide_id, unnest(terms) AS t FROM tm) JOIN rt USING (slide_id) WHERE regexp_matches(slide_reports, '(^|[^\p{L}\p{N}_])' || t, 'i')), dl AS (SELECT slide_id, list(t ORDER BY t) AS h FROM dy GROUP BY slide_id)"
_HITS = f"{sql.TEXTS}, {_STATIC}, {_TERMS}, {_DYN}, lk AS (SELECT rt.slide_id, list_concat(coalesce(sh.h, []), coalesce(dl.h, [])) AS h FROM rt LEFT JOIN sh ON rt.slide_id = sh.slide_id LEFT JOIN dl ON rt.slide_id = dl.slide_id)"


@query(f"WITH {sql.TEXTS}, {_STATIC} SELECT rt.slide_id, coalesce(array_to_string(h, ' ; '), '') AS hits FROM rt LEFT JOIN sh ON rt.slide_id = sh.slide_id")
def q_static_leakage(s, d):
    return fixtures.reports_text(s, d).select("slide_id", F.array_join(tx.static_hits(F.col("slide_reports")), " ; ").alias("hits"))


def _terms() -> Column:
    return tx.dynamic_terms(F.col("cancer_type_detailed"), F.col("site_of_resection_or_biopsy"))


@query(f"WITH {sql.TEXTS}, {_TERMS} SELECT slide_id, array_to_string(terms, ' ; ') AS terms FROM tm")
def q_dynamic_terms(s, d):
    return fixtures.reports_text(s, d).select("slide_id", F.array_join(_terms(), " ; ").alias("terms"))


def _leaks(s, d) -> DataFrame:
    return fixtures.reports_text(s, d).withColumn("h", tx.leakage(F.col("slide_reports"), _terms()))


@query(f"WITH {_HITS} SELECT slide_id, array_to_string(h, ' ; ') AS hits FROM lk")
def q_leakage(s, d):
    return _leaks(s, d).select("slide_id", F.array_join("h", " ; ").alias("hits"))


_RETRY = tx.INSTRUCTIONS.replace("'", "''")


@query(f"WITH {_HITS} SELECT slide_id, '{_RETRY}' || chr(10) || 'The last answer still gave away: ' || array_to_string(list_slice(list_sort(list_distinct(h)), 1, 20), ', ') || '.' || chr(10) || 'Leave these out, even if the summary gets shorter.' AS prompt FROM lk")
def q_retry_prompt(s, d):
    return _leaks(s, d).select("slide_id", tx.retry_prompt(F.col("h")).alias("prompt"))


@query(f"WITH {sql.TEXTS} SELECT slide_id, 'Rewrite this report as morphology only.' || chr(10) || 'SOURCE:' || chr(10) || {sql.one_paragraph('slide_reports')} || chr(10) AS payload FROM rt")
def q_payload(s, d):
    return fixtures.reports_text(s, d).select("slide_id", tx.payload(F.col("slide_reports")).alias("payload"))


# --- cohort


@query(f"WITH {sql.TEXTS} SELECT slide_id, cancer_type_detailed AS diagnosis_only_text FROM rt WHERE slide_id IN (SELECT slide_id FROM li) AND cancer_type_detailed IS NOT NULL")
def q_diagnosis_only(s, d):
    return cohort.diagnosis_only(fixtures.reports_text(s, d), fixtures.ids(s, d))


@query(f"WITH {sql.TEXTS} SELECT slide_id, project_id FROM rt WHERE slide_id IN (SELECT slide_id FROM li)")
def q_select_universe(s, d):
    return cohort.universe(fixtures.reports_text(s, d), fixtures.ids(s, d)).select("slide_id", "project_id")


@query(f"WITH {sql.TEXTS} SELECT DISTINCT slide_id FROM li WHERE slide_id NOT IN (SELECT slide_id FROM rt)")
def q_missing_ids(s, d):
    return cohort.missing(fixtures.reports_text(s, d), fixtures.ids(s, d))


@query(f"WITH {sql.TEXTS} SELECT slide_id, quality FROM rt JOIN labels ON slide_id = doc_id")
def q_lookup(s, d):
    labels = fixtures.read(s, d, "labels").select(F.col("doc_id").alias("slide_id"), "quality")
    known = fixtures.reports_text(s, d).select("slide_id").join(labels.select("slide_id"), "slide_id", "left_semi")
    return cohort.lookup(known, labels)


@query(f"""WITH {sql.TEXTS}, sz AS (SELECT project_id, count(*) AS c FROM rt WHERE project_id IS NOT NULL GROUP BY ALL),
dr AS (SELECT slide_id, project_id, {sql.md5_number("'7|' || slide_id")} AS draw FROM rt WHERE project_id IS NOT NULL),
k AS (SELECT dr.*, c, row_number() OVER (PARTITION BY dr.project_id ORDER BY draw, slide_id) AS k FROM dr JOIN sz USING (project_id)),
p AS (SELECT slide_id, project_id, draw FROM k WHERE k <= greatest(1, round_even(c * (least(100, (SELECT count(*) FROM rt)) / (SELECT count(*) FROM rt)), 0)))
SELECT slide_id, project_id FROM p ORDER BY draw, slide_id LIMIT 100""")
def q_stratified_pilot(s, d):
    return cohort.stratified_pilot(fixtures.reports_text(s, d), 100, 7).select("slide_id", "project_id")


_USEFUL = f"(slide_reports_no_diagnosis_strict IS NOT NULL AND length({sql.one_paragraph('slide_reports_no_diagnosis_strict')}) >= 15)"


@query(f"WITH {sql.TEXTS} SELECT rt.slide_id, CASE WHEN au.slide_id IS NOT NULL AND NOT excluded_insufficient_source AND NOT {_USEFUL} THEN rewritten_text ELSE slide_reports_no_diagnosis_strict END AS rewrite FROM rt LEFT JOIN au ON rt.slide_id = au.slide_id")
def q_backfill(s, d):
    got = cohort.backfill(fixtures.reports_text(s, d), fixtures.audit(s, d))
    return got.select("slide_id", F.col(cohort.REWRITE).alias("rewrite"))


@query(f"WITH {sql.TEXTS} SELECT slide_id FROM rt WHERE NOT {_USEFUL} AND trim(regexp_replace(slide_reports, '\\s+', ' ', 'g')) <> '' AND slide_id NOT IN (SELECT slide_id FROM au)")
def q_resume_skip(s, d):
    return cohort.to_process(fixtures.reports_text(s, d), fixtures.audit(s, d)).select("slide_id")


@query(f"WITH {sql.TEXTS} SELECT slide_id, project_id, original_slide_reports AS slide_reports, rewritten_text AS slide_reports_no_diagnosis_strict, excluded_insufficient_source, leakage_flag_after_retries, attempts_used FROM au WHERE slide_id IN (SELECT slide_id FROM rt WHERE slide_id IN (SELECT slide_id FROM li))")
def q_review_projection(s, d):
    return cohort.review(fixtures.audit(s, d), cohort.universe(fixtures.reports_text(s, d), fixtures.ids(s, d)))


@query(f"WITH {sql.TEXTS} SELECT count(*) AS n_rows, CAST(count_if(excluded_insufficient_source) AS BIGINT) AS n_excluded, CAST(count_if(leakage_flag_after_retries AND NOT excluded_insufficient_source) AS BIGINT) AS n_leaked FROM au")
def q_run_counts(s, d):
    return cohort.run_counts(fixtures.audit(s, d))


@query()
def q_validated_summary(s, d):
    return rewriting.rewrite(fixtures.reports_text(s, d))


# --- spatial

_XY = "xy AS (SELECT CAST(label AS BIGINT) AS slide_id, (vec_id % 20) * 224 AS x, (vec_id // 20) * 224 AS y FROM embeddings)"


def _coords(s, d) -> DataFrame:
    e = fixtures.read(s, d, "embeddings")
    return e.select(F.col("label").cast("long").alias("slide_id"), (F.col("vec_id") % 20 * 224).alias("x"), (F.floor(F.col("vec_id") / 20) * 224).alias("y"))


@query(f"WITH {_XY}, u AS (SELECT DISTINCT slide_id, x FROM xy), g AS (SELECT slide_id, x - lag(x) OVER (PARTITION BY slide_id ORDER BY x) AS g FROM u) SELECT slide_id, CAST(floor(quantile_cont(g, 0.5)) AS INTEGER) AS stride FROM g WHERE g > 0 GROUP BY slide_id")
def q_patch_stride(s, d):
    return spatial.stride(_coords(s, d))


#: Pixels by a rule: a dark ellipse-like block on white.
_PX = "px AS (SELECT vec_id // 100 AS y, p AS x, CASE WHEN vec_id // 100 BETWEEN 1 AND 3 AND p BETWEEN 20 AND 70 + vec_id // 100 THEN 100 ELSE 250 END AS g FROM embeddings, (SELECT unnest(range(100)) AS p) WHERE vec_id % 100 = 0)"


def _pixels(s, d) -> DataFrame:
    rows = fixtures.read(s, d, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("y"), (F.col("vec_id") % 100).alias("x"))
    g = F.when(F.col("y").between(1, 3) & (F.col("x") >= 20) & (F.col("x") <= 70 + F.col("y")), 100).otherwise(250)
    return rows.select("y", "x", *[g.alias(c) for c in "rgb"])


@query(f"WITH {_PX}, r AS (SELECT y, avg(CAST(g < 235 AS INT)) AS f FROM px GROUP BY y), c AS (SELECT x, avg(CAST(g < 235 AS INT)) AS f FROM px GROUP BY x) SELECT (SELECT min(y) FROM r WHERE f > 0.003) AS r0, (SELECT max(y) FROM r WHERE f > 0.003) AS r1, (SELECT min(x) FROM c WHERE f > 0.003) AS c0, (SELECT max(x) FROM c WHERE f > 0.003) AS c1")
def q_tissue_bbox(s, d):
    return spatial.tissue_span(_pixels(s, d))  # nulls where no line has tissue, as its SQL


@query(f"WITH {_XY} SELECT slide_id, round(x / 16.0 - 20, 6) + 0.0 AS px, round(y / 16.0 - 1, 6) + 0.0 AS py, CAST(20 - floor(51 * 0.015) AS BIGINT) AS c0 FROM xy")
def q_crop_scale(s, d):
    px, py = spatial.to_crop(F.col("x"), F.col("y"), F.lit(16.0), F.lit(16.0), F.lit(20), F.lit(1))
    box = spatial.crop(s.range(1).select(F.lit(1).cast("long").alias("r0"), F.lit(3).cast("long").alias("r1"), F.lit(20).cast("long").alias("c0"), F.lit(71).cast("long").alias("c1")), F.lit(1000), F.lit(1000))
    return _coords(s, d).select("slide_id", r6(px).alias("px"), r6(py).alias("py")).crossJoin(box.select("c0"))  # one row


@query("SELECT doc_id, CAST(20.0 + doc_id % 21 AS DOUBLE) AS app_mag, CAST(0.25 AS DOUBLE) AS mpp, CAST(round(224 * 0.25, 6) + 0.0 AS DOUBLE) AS patch_um, round(224 * 0.25 / (0.25 * (20.0 + doc_id % 21) / 20.0), 6) + 0.0 AS px_20x FROM documents")
def q_footprint(s, d):
    mag = (F.lit(20) + F.col("doc_id") % 21).cast("double")
    got = fixtures.read(s, d, "documents").select("doc_id", spatial.slide_metadata(F.concat(F.lit("Scan 1|AppMag = "), mag.cast("string"), F.lit("|MPP = 0.25|x"))).alias("m")).select("doc_id", "m.*")
    f = spatial.footprint(F.lit(224), F.col("mpp"), F.col("app_mag"))
    return got.select("doc_id", "app_mag", "mpp", r6(f["patch_um"]).alias("patch_um"), r6(f["px_20x"]).alias("px_20x"))


@query(f"WITH {_XY} SELECT CAST(count_if(NOT (x / 16.0 - 20 BETWEEN -1 AND 214 AND y / 16.0 - 1 BETWEEN -1 AND 214)) AS BIGINT) AS n_outside, count(*) AS n_points FROM xy")
def q_inside_crop(s, d):
    px, py = spatial.to_crop(F.col("x"), F.col("y"), F.lit(16.0), F.lit(16.0), F.lit(20), F.lit(1))
    return spatial.check_inside(_coords(s, d).select(px.alias("px"), py.alias("py")), F.lit(200), F.lit(200), F.lit(14), F.lit(14))


@query("SELECT doc_id, doc_id % 2 = 0 AS enough, 'text ' || doc_id AS text FROM documents")
def q_parsed_reply(s, d):
    reply = F.to_json(F.struct((F.col("doc_id") % 2 == 0).alias("has_sufficient_morphology"), F.concat(F.lit("text "), F.col("doc_id").cast("string")).alias(cohort.REWRITE)))
    got = fixtures.read(s, d, "documents").select("doc_id", rewriting.parsed_reply(reply).alias("r"))
    return got.select("doc_id", F.col("r.has_sufficient_morphology").alias("enough"), F.col(f"r.{cohort.REWRITE}").alias("text"))


@query(f"WITH {sql.TEXTS} SELECT slide_id FROM rt WHERE slide_reports IS NOT NULL AND trim(regexp_replace(slide_reports, '\\s+', ' ', 'g')) <> ''")
def q_with_source(s, d):
    return cohort.with_source(fixtures.reports_text(s, d)).select("slide_id")


@query(f"WITH {sql.TEXTS} SELECT slide_id, excluded_insufficient_source FROM au WHERE slide_id NOT IN (SELECT slide_id FROM rt WHERE slide_id IN (SELECT slide_id FROM li))")
def q_kept_audit(s, d):
    mine = cohort.universe(fixtures.reports_text(s, d), fixtures.ids(s, d))
    return cohort.kept_audit(fixtures.audit(s, d), mine, overwrite=True).select("slide_id", "excluded_insufficient_source")


@query(f"WITH {sql.VECTORS}, {sql.SLIDES} SELECT slide_id, slide_id AS gallery_pos, case_id, split, oncotree, project FROM slides WHERE split IN ('train', 'test')")
def q_split_filter(s, d):
    return fixtures.slides(s, d).filter(F.col("split").isin("train", "test"))


@query(f"WITH {sql.pairs(BOTH)} SELECT backbone, scenario, 'T2I' AS direction, report_id AS query_id, slide_id AS cand_id, round(s_g, 6) + 0.0 AS s_g FROM pairs")
def q_directions(s, d):
    return fixtures.both_ways(s, d, backbones=BOTH).filter("direction = 'T2I'").select(*COND, "query_id", "cand_id", r6("s_g").alias("s_g"))


# --- sources and sinks


def _place(s, name: str) -> str:
    return f"{files.scratch_dir(s)}/{name}-{uuid.uuid4().hex}"


@query(_dims_sql(sql.VECTORS, "(SELECT slide_id, rn - 4 AS patch_idx, emb FROM v WHERE rn > 3)", "emb", "slide_id", "patch_idx"))
def q_npy_scan(s, d):
    files.write_arrays(fixtures.patches(s, d), where := _place(s, "npy"))
    return by_dim(files.read_arrays(s, where).select(F.col("slide_id").cast("long").alias("slide_id"), "patch_idx", F.col("emb").cast("array<double>").alias("emb")), "emb", "slide_id", "patch_idx")


@query(_dims_sql(f"{sql.VECTORS}, u AS (SELECT slide_id, {sql.unit('emb')} AS emb FROM v WHERE rn = 2)", "u", "emb", "slide_id"))
def q_text_vectors(s, d):
    strict = fixtures.reports(s, d).filter("scenario = 'strict'").select("slide_id", F.lit(0).alias("patch_idx"), "emb")
    files.write_arrays(strict, where := _place(s, "vectors"))
    return by_dim(files.read_text_vectors(s, where).withColumn("slide_id", F.col("slide_id").cast("long")), "emb", "slide_id")


@query(_dims_sql(f"{sql.pairs()}, f AS (SELECT slide_id, CAST(CAST(mean_pool AS FLOAT[]) AS DOUBLE[]) AS m FROM pool), u AS (SELECT slide_id, {sql.unit('m')} AS emb FROM f)", "u", "emb", "slide_id"))
def q_pool_cache(s, d):
    where = _place(s, "pool")
    made = fixtures.pooled(s, d).drop("backbone")
    files.write_pool_cache(made, where)
    files.write_pool_cache(made.limit(0), where)  # an existing cache stays
    return by_dim(files.read_pool_cache(s, where, fixtures.slides(s, d).select("slide_id")), "emb", "slide_id")


@query()
def q_bank_sink_resume(s, d):
    where, p = _place(s, "banks"), fixtures.label_slides(s, d)
    files.append_banks(prototypes.build_banks(files.missing_banks(s, p.filter("slide_id < 5"), where)), where)
    files.append_banks(prototypes.build_banks(files.missing_banks(s, p, where)), where)
    return files.read_banks(s, where).groupBy("slide_id").agg(F.count("*").alias("n"), F.count_distinct("h").alias("n_h"))


@query(f"WITH {sql.VECTORS}, {sql.SLIDES} SELECT CAST(slide_id AS VARCHAR) AS slide_id, CAST(case_id AS VARCHAR) AS case_id, split, CASE WHEN slide_id % 5 <> 0 THEN 'x' END AS note FROM slides")
def q_csv_roundtrip(s, d):
    where = _place(s, "splits")
    files.write_results(fixtures.slides(s, d).select("slide_id", "case_id", "split", F.when(F.col("slide_id") % 5 == 0, "NA").otherwise("x").alias("note")), where)
    return files.read_table(s, where)


_READ_BACK = ", ".join(f"CASE WHEN CAST({c} AS VARCHAR) NOT IN ({', '.join(repr(m) for m in files.MISSING)}) THEN CAST({c} AS VARCHAR) END AS {c}" for c in ("slide_id", "case_id", "project_id", "slide_reports", "cancer_type_detailed", "site_of_resection_or_biopsy", "slide_reports_no_diagnosis_strict"))


@query(f"WITH {sql.TEXTS} SELECT {_READ_BACK} FROM rt")
def q_csv_master_scan(s, d):
    where = _place(s, "master")
    files.write_reports(fixtures.reports_text(s, d), where)
    return files.read_reports(s, where)


@query()
def q_audit_roundtrip(s, d):
    where, a = _place(s, "audit"), rewriting.rewrite(fixtures.reports_text(s, d))
    files.write_audit(a, where)
    return files.read_audit(s, where, rewriting.AUDIT.format("long"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Fused score of all slides and reports, ranked, and its class-macro metrics."""
    return q_class_macro(s, d)
