import numpy as np
import pytest
from pyspark.sql import functions as F

from crossrank.operators import calibration, ranking, statistics
from crossrank.operators.pooling import consistent_dimension, pool
from crossrank.operators.prototypes import Settings, bank, feasible, kmeans
from crossrank.operators.similarity import directed, similarities
from crossrank.plans import experiments

RNG = np.random.default_rng(0)


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def pair_frame(spark, g, p=None):
    p = g if p is None else p
    rows = [(i, j, i, j, float(g[i, j]), float(p[i, j])) for i in range(g.shape[0]) for j in range(g.shape[1])]
    return spark.createDataFrame(rows, "query_id long, cand_id long, q_pos long, c_pos long, s_g double, s_p double")


def dense(df, value, shape):
    out = np.full(shape, np.nan)
    for r in df.select("query_id", "cand_id", value).collect():
        out[r[0], r[1]] = r[2]
    return out


def log_softmax(x, axis):
    y = x / np.clip(x.std(axis=axis, keepdims=True), 1e-8, None)
    m = y.max(axis=axis, keepdims=True)
    return y - m - np.log(np.exp(y - m).sum(axis=axis, keepdims=True))


def test_prototype_similarity_is_the_largest_over_a_bank(spark):
    banks = [unit(RNG.normal(size=(int(RNG.integers(1, 9)), 16))) for _ in range(12)]
    texts, pooled = unit(RNG.normal(size=(12, 16))), unit(RNG.normal(size=(12, 16)))
    frame = lambda rows, name: spark.createDataFrame([(i, v.tolist()) for i, v in rows], f"{name} long, emb array<double>")
    got = similarities(frame(list(enumerate(pooled)), "slide_id"), frame([(i, v) for i, b in enumerate(banks) for v in b], "slide_id"), frame(list(enumerate(texts)), "report_id"), 12, 12).collect()
    g, p = np.zeros((12, 12)), np.zeros((12, 12))
    for r in got:
        g[r.slide_id, r.report_id], p[r.slide_id, r.report_id] = r.s_g, r.s_p
    assert len(got) == 144 and np.allclose(p, np.stack([(b @ texts.T).max(0) for b in banks]), rtol=0, atol=1e-12)
    assert np.allclose(g, pooled @ texts.T, rtol=0, atol=1e-12)


def test_calibrations_are_distributions_and_ignore_scale(spark):
    x = RNG.normal(size=(7, 9))
    a, b = calibration.calibrate(pair_frame(spark, x)), calibration.calibrate(pair_frame(spark, 3.0 * x + 2.0))
    d, r = dense(a, "d_g", x.shape), dense(a, "r_g", x.shape)
    assert np.allclose(np.exp(d).sum(1), 1) and np.allclose(np.exp(r).sum(0), 1)
    assert np.allclose(d, log_softmax(x, 1)) and np.allclose(r, log_softmax(x, 0))
    assert np.allclose(dense(b, "d_g", x.shape), d) and np.allclose(dense(b, "r_g", x.shape), r)


def test_score_formula_variants_and_constant_rows(spark):
    g, p = RNG.normal(size=(6, 6)), RNG.normal(size=(6, 6))
    c = calibration.calibrate(pair_frame(spark, g, p))
    want = log_softmax(g, 0) + 0.5 * (log_softmax(p, 1) + log_softmax(p, 0))
    assert np.allclose(dense(c.withColumn("s", calibration.rerank_score()), "s", g.shape), want)
    v = calibration.variants(c)
    assert np.allclose(dense(v.filter("variant = 'global_plus_direct_local'"), "score", g.shape), log_softmax(g, 0) + log_softmax(p, 1))
    assert v.count() == 36 * 7
    flat = calibration.calibrate(pair_frame(spark, np.ones((4, 5)))).withColumn("s", calibration.rerank_score())
    assert np.isfinite(dense(flat, "s", (4, 5))).all()


def test_a_null_score_counts_in_no_sum_and_stays_null(spark):
    x = RNG.normal(size=(5, 6))
    hole = (F.col("query_id") == 2) & (F.col("cand_id") == 3)
    holed = pair_frame(spark, x).withColumn("s_g", F.when(~hole, F.col("s_g")))
    got = {(r.query_id, r.cand_id): r.d_g for r in calibration.direct(holed, {"d_g": "s_g"}).collect()}
    want = log_softmax(x, 1)
    want[2, [0, 1, 2, 4, 5]] = log_softmax(x[2:3, [0, 1, 2, 4, 5]], 1)[0]
    assert got.pop((2, 3)) is None
    assert all(np.isclose(v, want[k]) for k, v in got.items()) and len(got) == 29


def test_a_strip_never_becomes_one_row_and_costs_one_shuffle_and_sort(spark):
    plan = calibration.calibrate(pair_frame(spark, RNG.normal(size=(4, 5))))._jdf.queryExecution().sparkPlan().toString()
    whole = calibration.calibrate(pair_frame(spark, RNG.normal(size=(4, 5))))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Generate" not in plan and "Join" not in plan
    assert whole.count("Exchange hashpartitioning") == 2 and whole.count("+- Sort [") == 2


def test_equal_reports_score_equal_bit_for_bit_in_any_partitioning(spark):
    slides, texts = unit(RNG.normal(size=(9, 16))), unit(RNG.normal(size=(7, 16)))
    texts = np.concatenate([texts, texts])
    frame = lambda rows, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], f"{name} long, emb array<double>")
    seen = []
    for n in (1, 4, 7):
        s = frame(slides, "slide_id").repartition(n)
        got = similarities(s, s, frame(texts, "report_id").repartition(n), 9, 14).withColumns({"slide_pos": F.col("slide_id"), "report_pos": F.col("report_id")})
        c = calibration.calibrate(directed(got).repartition(n).filter("direction = 'I2T'"), ("direction",)).withColumn("s", calibration.rerank_score())
        m = dense(c, "s", (9, 14))
        assert (m[:, :7] == m[:, 7:]).all()
        seen.append(m)
    assert (seen[0] == seen[1]).all() and (seen[0] == seen[2]).all()


def evaluated(spark, s, labels, own=False):
    df = pair_frame(spark, s).withColumn("score", F.col("s_g"))
    df = ranking.demote_own(df) if own else df
    lab = spark.createDataFrame(list(enumerate(labels)), "id long, label long")
    r = ranking.top(df).join(lab.select(F.col("id").alias("query_id"), "label"), "query_id").join(lab.select(F.col("id").alias("cand_id"), F.col("label").alias("cand_label")), "cand_id")
    return ranking.per_query(r, ranking.totals(lab, int(own)), s.shape[1])


def test_metrics_and_stable_ties(spark):
    labels = [0, 0, 1, 1]
    assert {r["Recall@1"] for r in evaluated(spark, np.eye(4), labels).collect()} == {1.0}
    tied = {r.query_id: r["Recall@1"] for r in evaluated(spark, np.zeros((4, 4)), labels).collect()}
    assert tied[0] == 1 and tied[2] == 0


def brute(s, labels, own=False):
    out = {}
    s = s.copy()
    if own:
        np.fill_diagonal(s, -np.inf)
    for q in range(len(s)):
        rel = np.array([labels[c] == labels[q] for c in np.argsort(-s[q], kind="stable")[:10]])
        total = sum(x == labels[q] for x in labels) - own
        if total <= 0:
            out[q] = None
            continue
        hits = [rel[: k + 1].sum() / (k + 1) for k in np.flatnonzero(rel)]
        out[q] = [float(rel[:k].any()) for k in (1, 3, 5, 10)] + [1 / (rel.argmax() + 1) if rel.any() else 0.0, sum(hits) / min(total, len(rel))]
    return out


@pytest.mark.parametrize("own", [False, True])
@pytest.mark.parametrize("n", [6, 25])
def test_metrics_equal_brute_force(spark, n, own):
    s, labels = RNG.normal(size=(n, n)), [*RNG.integers(0, 4, n - 1).tolist(), 9]  # label 9 has one item
    want = brute(s, labels, own)
    for r in evaluated(spark, s, labels, own).collect():
        if want[r.query_id] is None:
            assert not r.eligible and r["mAP@10"] is None
        else:
            assert np.allclose([r[m] for m in ranking.METRICS], want[r.query_id])


def test_nan_scores_rank_last(spark):
    df = spark.createDataFrame([(0, 0, float("nan")), (0, 1, -5.0), (0, 2, float("inf"))], "query_id long, c_pos long, score double")
    assert [r.c_pos for r in ranking.top(df).orderBy("rank").collect()] == [2, 1, 0]


def test_tie_neutral(spark):
    labels = [i % 2 for i in range(6)]
    lab = spark.createDataFrame(list(enumerate(labels)), "id long, label long")

    def neutral(s, seeds):
        df = pair_frame(spark, s).withColumn("score", F.col("s_g")).join(lab.select(F.col("id").alias("query_id"), "label"), "query_id").join(lab.select(F.col("id").alias("cand_id"), F.col("label").alias("cand_label")), "cand_id")
        return {r.query_id: r for r in ranking.tie_neutral(df, ranking.permutations(spark, 6, seeds), ranking.totals(lab), 6).collect()}

    s = RNG.normal(size=(6, 6))
    plain, free = {r.query_id: r for r in evaluated(spark, s, labels).collect()}, neutral(s, 10)
    assert all(np.isclose(plain[q]["mAP@10"], free[q]["mAP@10"]) and free[q]["mAP@10_tie_sd"] < 1e-12 for q in plain)
    assert 0.35 < neutral(np.zeros((6, 6)), 200)[1]["Recall@1"] < 0.65


def test_class_level_leaves_out_ineligible_queries(spark):
    rows = [(0, "a", True, 1.0), (1, "a", True, 0.0), (2, "b", True, 1.0), (3, "c", False, None), (4, None, True, 1.0)]
    q = spark.createDataFrame([(i, c, e, *[v] * 6) for i, c, e, v in rows], "query_id long, label string, eligible boolean, " + ", ".join(f"`{m}` double" for m in ranking.METRICS))
    c = ranking.class_level(q)
    assert {r["class"]: (r.n_class, r["mAP@10"]) for r in c.collect()} == {"a": (2, 0.5), "b": (1, 1.0)}
    assert ranking.macro(c).first()["mAP@10"] == 0.75
    assert ranking.macro(ranking.class_level(q.filter("false"))).first()["mAP@10"] is None


def test_pooling_equals_numpy_in_any_partitioning(spark):
    x = {k: RNG.normal(size=(n, 5)) for k, n in (("a", 1), ("b", 40))}
    df = spark.createDataFrame([(k, i, v.tolist()) for k, m in x.items() for i, v in enumerate(m)], "slide_id string, patch_idx long, emb array<double>")
    first = {r.slide_id: r for r in pool(df).collect()}
    for k, m in x.items():
        assert np.allclose(first[k].mean_pool, unit(unit(m).mean(0))) and np.allclose(first[k].max_pool, unit(unit(m).max(0))) and first[k].n_patches == len(m)
    assert {r.slide_id: r.mean_pool for r in pool(df.repartition(5)).collect()} == {k: r.mean_pool for k, r in first.items()}
    with pytest.raises(ValueError):
        consistent_dimension(df.union(spark.createDataFrame([("c", 0, [1.0])], df.schema)))


def test_banks(spark):
    assert bank(np.zeros((0, 4)))["prototypes"].shape == (1, 4)
    small = bank(RNG.normal(size=(5, 4)))
    assert small["selected_by"] == "fallback" and small["support"] == 0.25 and small["coverage"] is None
    centres = unit(RNG.normal(size=(2, 8)))
    x = np.concatenate([c + 0.01 * RNG.normal(size=(40, 8)) for c in centres])
    b = bank(x)
    assert b["k_star"] == 2 and b["selected_by"] == "near_best_utility" and b["coverage"] > 0.99
    assert np.allclose(np.linalg.norm(b["prototypes"], axis=1), 1) and (b["prototypes"] @ centres.T).max(1).min() > 0.99
    again = bank(x)
    assert (again["prototypes"] == b["prototypes"]).all()
    c, own = kmeans(unit(x), 2, Settings(batch=16))
    assert len(set(own[:40])) == len(set(own[40:])) == 1 and own[0] != own[40]
    sizes = spark.createDataFrame([(11,), (12,), (100,)], "n_patches long")
    got = feasible(sizes).groupBy("n_patches").agg(F.collect_list("k").alias("k")).collect()
    assert {r.n_patches: sorted(r.k) for r in got} == {12: [2], 100: [2, 4, 6, 8, 12, 16]}


def test_bootstrap_and_holm(spark):
    labels, units = np.repeat([0, 1, 2], 20), np.repeat(np.arange(30), 2)
    a = RNG.random(60)
    r = statistics.paired_bootstrap(a, a + 0.2, labels, units, 500, 1)
    assert r["diff"] == pytest.approx(0.2) and r["p"] == pytest.approx(1 / 500) and r["n_units"] == 30
    rows = spark.createDataFrame([("x", i, int(c), int(u), float(v), float(v + 0.2)) for i, (c, u, v) in enumerate(zip(labels, units, a))], "c string, query_id int, label int, unit int, a double, b double")
    for f in (lambda: statistics.bootstrap_hashed(rows, 200, 1, ("c",)), lambda: statistics.bootstrap_numpy(rows, ("c",), 200, 1)):
        got = f().first()
        assert got["diff"] == pytest.approx(0.2) and got.p == pytest.approx(1 / 200) and got.n_units == 30 and got.n_rows == 60
    multi = statistics.bootstrap_multi(rows, ("a", "b"), "b", ("c",), 300, 1, 100).orderBy("method").collect()
    assert multi[0]["diff"] == pytest.approx(0.2) and multi[0].p == pytest.approx(1 / 300) and multi[1].p == 1.0 and multi[1]["diff"] == 0.0
    with pytest.raises(ValueError):
        statistics.check_nesting(spark.createDataFrame([(1, 1), (1, 2)], "unit int, label int"))
    for p, want in (([0.004, 0.018, 0.045], [True, True, True]), ([0.011, 0.027, 0.03], [True, False, False]), ([0.2, 0.012, 0.03], [False, True, False])):
        t = statistics.holm(spark.createDataFrame(list(enumerate(p)), "idx int, p double"))
        assert [r.reject for r in t.orderBy("idx").collect()] == want


def test_folds_average_over_folds():
    a, b = np.zeros(8), np.array([1, 1, 0, 0, 1, 1, 1, 1.0])
    r = statistics.paired_bootstrap(a, b, [0, 0, 1, 1, 0, 0, 1, 1], [0, 1, 2, 3, 0, 1, 2, 3], 50, 1, [0] * 4 + [1] * 4)
    assert r["diff"] == pytest.approx(0.75)


def test_multi_equals_a_plain_loop():
    """Two classes of unequal units; draws class by class within a chunk, ratios of drawn sums, mean over classes."""
    import pandas as pd

    rng = np.random.default_rng(4)
    sums = pd.DataFrame({"label": ["x"] * 3 + ["y"] * 5, "unit": range(8), "n": rng.integers(1, 5, 8), "a": rng.random(8), "b": rng.random(8)})
    got = statistics.paired_bootstrap_multi(sums.sample(frac=1, random_state=1), ["a", "b"], "a", 25, 9, 10).set_index("method")
    draws, d = np.random.default_rng(9), []
    for size in (10, 10, 5):
        w = {c: draws.multinomial(len(t), [1 / len(t)] * len(t), size=size) for c, t in sums.groupby("label")}
        for r in range(size):
            mean = {m: np.mean([sum(w[c][r][i] * v for i, v in enumerate(t[m])) / sum(w[c][r][i] * v for i, v in enumerate(t.n)) for c, t in sums.groupby("label")]) for m in "ab"}
            d.append(mean["a"] - mean["b"])
    assert got.loc["b", "ci_lo"] == pytest.approx(np.percentile(d, 2.5)) and got.loc["b", "ci_hi"] == pytest.approx(np.percentile(d, 97.5))
    assert got.loc["b", "diff"] == pytest.approx(np.mean([t.a.sum() / t.n.sum() - t.b.sum() / t.n.sum() for _, t in sums.groupby("label")]))
    with pytest.raises(ValueError, match="class"):
        statistics.paired_bootstrap_multi(sums.assign(unit=0), ["a", "b"], "a", 5)


def test_sizes_are_chosen_alike_in_both_forms(spark):
    """A rule in a plain loop against both; the second group has negative utilities only."""
    from crossrank.operators.prototypes import choose, near_best

    groups = {"p": [0.5, 0.7, 0.71, 0.6], "q": [-0.3, -0.1, -0.2, -0.4], "r": [0.0, 0.0, 0.0, 0.0], "s": [0.2, 1.4, 1.39, 1.2]}
    want = {"p": (4, 0.7), "q": (4, 0.0), "r": (2, 0.0), "s": (4, 1.0)}
    rows = [(g, k, float(u)) for g, us in groups.items() for k, u in zip((2, 4, 6, 8), us)] + [("p", 12, float("nan")), ("p", 16, None)]
    got = near_best(spark.createDataFrame(rows, "slide_id string, k int, utility double")).collect()
    assert {r.slide_id: (r.k, r.q_proto) for r in got} == want
    assert {g: ((2, 4, 6, 8)[choose(np.array(u))[0]], choose(np.array(u))[1]) for g, u in groups.items()} == want


def test_near_ties_are_ranked_as_they_are(spark):
    """Scores 1e-12 apart are no ties, in the library's ranking and in its experiments."""
    s = np.array([[0.5, 0.5 + 1e-12, 0.1], [0.2, 0.3, 0.4], [0.9, 0.8, 0.7]])
    df = pair_frame(spark, s)
    made = experiments.scored(df, F.col("s_g"))
    assert [r.c_pos for r in ranking.top(made).filter("query_id = 0").orderBy("rank").collect()] == [1, 0, 2]
    assert [r.c_pos for r in ranking.top(experiments.scored(df, F.col("s_g"), 9)).filter("query_id = 0").orderBy("rank").collect()] == [0, 1, 2]


def test_means_do_not_depend_on_the_order_of_rows(spark):
    values = [1 / 3, 0.1, 0.7, 1 / 7, 0.25, 1.0] * 50
    rows = [(k, "a" if k % 3 else "b", True, *[v] * 6) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "query_id long, label string, eligible boolean, " + ", ".join(f"`{m}` double" for m in ranking.METRICS))
    got = {str(ranking.macro(ranking.class_level(df.repartition(n).orderBy(F.xxhash64("query_id", F.lit(n))))).first()) for n in (1, 3, 7, 8)}
    assert len(got) == 1


def test_hashed_draws_equal_a_plain_loop(spark):
    """More comparisons and replicates than share a row; comparisons with fewer units have draws of their own."""
    import hashlib

    rng = np.random.default_rng(5)
    rows = [(f"k{k:02}", label, f"{label}{u}", float(a), float(b)) for k in range(36) for label, n in (("x", 3), ("y", 4 + k % 2)) for u in range(n) for a, b in rng.random((1 + u % 2, 2))]
    frame = spark.createDataFrame(rows, "c string, label string, unit string, a double, b double")
    replicates, seed = 130, 7

    def number(b, label, i):
        return int(hashlib.md5(f"{seed}|{b}|{label}|{i}".encode()).hexdigest()[:8], 16)

    want = {}
    for c in {r[0] for r in rows}:
        sums = {}
        for _, label, u, a, b in (r for r in rows if r[0] == c):
            s, n = sums.setdefault(label, {}).get(u, (0.0, 0))
            sums[label][u] = (s + b - a, n + 1)
        listed = {label: [v for _, v in sorted(t.items())] for label, t in sums.items()}
        ratio = lambda picks: np.mean([sum(t[i][0] for i in p) / sum(t[i][1] for i in p) for t, p in zip(listed.values(), picks, strict=True)])
        d = np.array([ratio([[number(b, label, i) % len(t) for i in range(len(t))] for label, t in listed.items()]) for b in range(replicates)])
        tail = min((d <= 0).mean(), (d >= 0).mean())
        want[c] = (ratio([range(len(t)) for t in listed.values()]), *np.percentile(d, [2.5, 97.5]), min(1.0, max(2 * tail, 1 / replicates)), d.std(ddof=1), sum(v[1] for t in listed.values() for v in t), sum(map(len, listed.values())))
    seen = []
    for n in (1, 5):
        got = {r.c: (r["diff"], r.ci_lo, r.ci_hi, r.p, r.sd, r.n_rows, r.n_units) for r in statistics.bootstrap_hashed(frame.repartition(n), replicates, seed, ("c",)).collect()}
        assert set(got) == set(want) and all(np.allclose(got[c], want[c], rtol=0, atol=1e-12) for c in want)
        seen.append(got)
    assert all(np.allclose(seen[0][c], seen[1][c], rtol=0, atol=1e-14) for c in want)
    one = statistics.bootstrap_hashed(frame.filter("c = 'k00'").drop("c"), replicates, seed).first()
    assert np.allclose([one["diff"], one.ci_lo], want["k00"][:2]) and one.n_rows == want["k00"][5]
    assert statistics.bootstrap_hashed(frame.limit(0), 10, 1, ("c",)).count() == 0
