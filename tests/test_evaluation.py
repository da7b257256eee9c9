import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from renewlens.functions.scalars import platform_exp, sigmoid
from renewlens.operators import calibration as C
from renewlens.operators import decision as D
from renewlens.operators import drift as DR
from renewlens.operators import metrics as M
from renewlens.operators import ranking as R
from renewlens.operators.quantiles import exact_quantiles, value_counts
from renewlens.plans.compose import compared
from renewlens.plans.oracle_tables import SIGMOID
from renewlens.session import stage


def pairs(df):
    rows = df.orderBy("user_id").collect()
    return np.array([r["is_churn"] for r in rows]), np.array([r["p"] for r in rows])


def frame(spark, y, p):
    rows = [(i, int(a), float(b), "repeat") for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "user_id bigint, is_churn int, p double, segment string")


def fixed(spark, r=1.0, ltv=1000.0, c=500.5):
    row = (float(r), float(c), float(ltv), D.decision_threshold(r_save=r, ltv_saved=ltv, c_offer=c))
    return spark.createDataFrame([row], "r_save double, c_offer double, ltv_saved double, p_star double")


# --- metrics ----------------------------------------------------------------


def test_log_loss_is_clipped(spark):
    loss = M.log_loss_report(frame(spark, [1, 0], [0.0, 0.0])).first()["log_loss"]
    assert loss == pytest.approx(-math.log(1e-15) / 2, rel=1e-9)


def test_empty_input_is_an_error(spark):
    with pytest.raises(Exception, match="no rows"):
        M.log_loss_report(frame(spark, [], [])).collect()


def test_auc_counts_ties_half(scores):
    y, p = pairs(scores)
    wins = sum((a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0])
    want = wins / ((y == 1).sum() * (y == 0).sum())
    assert M.roc_auc(scores).first()["auc"] == pytest.approx(want, abs=1e-12)


def test_auc_needs_both_classes(spark):
    with pytest.raises(Exception, match="both classes"):
        M.roc_auc(frame(spark, [1, 1], [0.2, 0.4])).collect()


def test_segment_report_total_and_shares(scores):
    rows = {r["segment"]: r for r in M.segment_report(scores).collect()}
    assert set(rows) == {"all", "repeat", "new"}
    assert rows["all"]["n"] == 300 and rows["all"]["share"] == 1.0
    mixed = sum(rows[s]["n"] * rows[s]["log_loss"] for s in ("repeat", "new")) / 300
    assert rows["all"]["log_loss"] == pytest.approx(mixed)


def test_constant_loss(spark):
    df = frame(spark, [1, 0, 0, 0], [0.5] * 4)
    want = -(0.25 * math.log(0.1) + 0.75 * math.log(0.9))
    assert M.constant_log_loss(df, 0.1).first()["constant_log_loss"] == pytest.approx(want)


# --- ranking ----------------------------------------------------------------


def test_rank_matches_a_plain_sort_with_a_hot_score(scores):
    got = D.rank_by_score(scores).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 301))
    rows = sorted(got, key=lambda r: r["rank"])
    assert all(a["p"] >= b["p"] for a, b in zip(rows, rows[1:]))
    assert [r["cum_is_churn"] for r in rows] == list(np.cumsum([r["is_churn"] for r in rows]))
    assert rows[-1]["cum_p_units"] == sum(round(r["p"] * 1e6) for r in rows)


def test_hot_score_gets_its_own_divided_bucket(scores):
    edges, hot = R.order_edges(scores, "p", 64)
    assert hot == [0.5]
    assert math.nextafter(0.5, 1) in edges
    tagged = R._bucketed(scores.withColumn("t", F.md5(F.col("user_id").cast("string"))), "p", 64, "t")
    hot_slots = tagged.filter("p = 0.5").select("slot").distinct().count()
    assert hot_slots > 50


def test_rank_does_not_depend_on_partitioning(scores):
    a = {r["user_id"]: r["rank"] for r in D.rank_by_score(scores.repartition(1)).collect()}
    b = {r["user_id"]: r["rank"] for r in D.rank_by_score(scores.repartition(9)).collect()}
    assert a == b


def test_all_scores_equal(spark):
    df = frame(spark, [1, 0] * 20, [0.3] * 40)
    assert sorted(r["rank"] for r in D.rank_by_score(df).collect()) == list(range(1, 41))


def test_top_fraction_rounds_half_to_even_and_keeps_one(scores):
    ranked = D.rank_by_score(scores)
    assert R.top_fraction(ranked, 0.005).count() == 2
    assert R.top_fraction(ranked, 0.0001).count() == 1
    with pytest.raises(ValueError):
        R.top_fraction(ranked, 0)


def test_equidistant_sample_spans_the_list(scores):
    ranks = sorted(r["rank"] for r in R.equidistant_sample(D.rank_by_score(scores), 5).collect())
    assert ranks == [1 + int(v) for v in np.rint(np.linspace(0, 299, 5))]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    data = [(k, float(v)) for k in ("a", "b") for v in np.round(rng.gamma(2, 3, 400), 1)]
    df = spark.createDataFrame(data, "feature string, v double")
    counts = value_counts(df, "v", keys=["feature"]).cache()
    probs = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    for r in exact_quantiles(counts, probs, keys=["feature"], buckets=8).collect():
        values = [v for k, v in data if k == r["feature"]]
        assert r["quantile"] == pytest.approx(np.quantile(values, r["q"]), abs=1e-9)


# --- calibration ------------------------------------------------------------


@pytest.mark.parametrize("strategy", ["quantile", "uniform"])
def test_reliability_curve_matches_numpy(scores, strategy):
    y, p = pairs(scores)
    edges = np.unique(np.quantile(p, np.linspace(0, 1, 11))) if strategy == "quantile" else np.linspace(0, 1, 11)
    idx = np.clip(np.digitize(p, edges[1:-1]), 0, len(edges) - 2)
    want = {b + 1: ((idx == b).sum(), p[idx == b].mean(), y[idx == b].mean()) for b in set(idx)}
    got = C.reliability_curve(scores, strategy=strategy, min_count=20).collect()
    assert {r["bin"] for r in got} == set(want)
    for r in got:
        n, mean, rate = want[r["bin"]]
        assert (r["n"], r["enough"]) == (n, n >= 20)
        assert r["mean_pred"] == pytest.approx(mean) and r["actual_rate"] == pytest.approx(rate)


def test_unknown_strategy(scores):
    with pytest.raises(ValueError, match="strategy"):
        C.reliability_curve(scores, strategy="other")


def test_thin_bins_do_not_set_the_mce(spark):
    curve = spark.createDataFrame(
        [(1, 10, 0.9, 0.1, False), (2, 90, 0.5, 0.4, True)],
        "bin int, n bigint, mean_pred double, actual_rate double, enough boolean",
    )
    row = C.ece(curve).first()
    assert row["mce"] == pytest.approx(0.1)
    assert row["ece"] == pytest.approx((10 * 0.8 + 90 * 0.1) / 100)
    assert C.mce(curve.filter("bin = 1")).first()["mce"] is None


def test_isotonic_is_monotone_bounded_and_no_worse_on_its_fit(scores):
    cal = C.fit_isotonic(scores)
    out = cal.apply(scores).orderBy("p").collect()
    values = [r["p_calibrated"] for r in out]
    assert values == sorted(values) and min(values) >= cal.floor and max(values) <= cal.ceiling
    y, p = pairs(scores)
    by_user = {r["user_id"]: r["p_calibrated"] for r in out}
    q = np.array([by_user[i] for i in range(300)])
    assert ((q - y) ** 2).mean() <= ((p - y) ** 2).mean()


def test_isotonic_bounds(spark):
    y = [0] * 9 + [0, 1] * 5 + [1] * 4
    p = [0.1] * 9 + [0.5] * 10 + [0.9] * 4
    cal = C.fit_isotonic(frame(spark, y, p))
    assert cal.floor == pytest.approx(0.5 / 10) and cal.ceiling == pytest.approx(1 - 0.5 / 5)
    assert cal.n_zero_block == 9
    assert C.edge_bounds(0, 0) == (0.0, 1.0)
    outside = cal.apply(frame(spark, [0, 0], [0.01, 0.99])).orderBy("p").collect()
    assert [r["p_calibrated"] for r in outside] == [cal.floor, cal.ceiling]


def test_isotonic_refuses_bad_labels(spark):
    with pytest.raises(ValueError, match="single class"):
        C.fit_isotonic(frame(spark, [0, 0], [0.1, 0.2]))
    with pytest.raises(ValueError, match="0 or 1"):
        C.fit_isotonic(frame(spark, [0, 2], [0.1, 0.2]))
    with pytest.raises(ValueError, match="no rows"):
        C.fit_isotonic(frame(spark, [], []))


def test_tie_profile(spark):
    row = C.tie_profile(frame(spark, [0] * 5, [0.1, 0.1, 0.1, 0.2, 0.3])).first()
    assert (row["n_distinct"], row["max_tie_share"], row["tied_share"]) == (3, 0.6, 0.6)


def test_loss_parts_add_up(scores):
    rows = scores.withColumn("p_calibrated", F.greatest("p", F.lit(0.2)))
    parts = C.loss_decomposition(rows, F.col("p") <= 0.2)
    total = M.log_loss_report(scores).first()["log_loss"]
    assert parts.agg(F.sum("contribution_raw")).first()[0] == pytest.approx(total)


# --- decision ---------------------------------------------------------------


def test_threshold_and_months():
    assert D.decision_threshold(c_offer=150, r_save=0.15, ltv_saved=2000) == pytest.approx(0.5)
    assert D.expected_months(0.063915) == pytest.approx(15.65, abs=0.01)
    for bad in (dict(c_offer=1, r_save=0, ltv_saved=1), dict(c_offer=-1, r_save=1, ltv_saved=1)):
        with pytest.raises(ValueError):
            D.decision_threshold(**bad)
    with pytest.raises(ValueError):
        D.expected_months(1.0)


def test_curve_has_one_point_per_step():
    assert (D.curve_steps(0.002), D.curve_steps(0.01), D.curve_steps(1.0)) == (500, 100, 1)
    for step in (0.002, 0.01, 0.05, 0.3, 0.7, 1.0):
        assert D.curve_steps(step) == len(np.arange(step, 1.0 + step / 2, step))
    with pytest.raises(ValueError):
        D.curve_steps(0)


def test_peak_of_the_curve_is_the_threshold(spark):
    p = np.arange(1, 1001) / 1000
    df = frame(spark, [0, 1] * 500, p)
    best = D.optimal_point(D.campaign_curve(df, fixed(spark), step=0.001)).first()
    assert best["n_targeted"] == 500 and best["threshold_p"] == pytest.approx(0.501)
    assert D.above_threshold(df, fixed(spark)).count() == 500


def test_perfect_scores_settle_as_expected(spark):
    y = [1, 0, 0, 1, 0] * 20
    curve = D.campaign_curve(frame(spark, y, [float(v) for v in y]), fixed(spark, c=10), step=0.05)
    for r in curve.collect():
        assert r["expected_net"] == pytest.approx(r["settled_net"])
    assert D.optimal_point(curve).first()["n_targeted"] == 40


def test_grid_agrees_with_counting(scores, spark):
    y, p = pairs(scores)
    a = fixed(spark, r=0.15, ltv=400.0, c=30.0)
    for r in D.sensitivity_grid(scores, a).collect():
        star = r["c_offer"] / (r["r_save"] * 400.0)
        hit = p > star
        assert r["n_targeted"] == hit.sum()
        assert r["expected_net"] == pytest.approx(p[hit].sum() * r["r_save"] * 400 - hit.sum() * r["c_offer"])
        assert r["settled_net"] == pytest.approx(y[hit].sum() * r["r_save"] * 400 - hit.sum() * r["c_offer"])


def test_doubling_the_save_rate_equals_halving_the_cost(scores, spark):
    rows = {
        (r["r_save"], r["c_offer"]): r["n_targeted"]
        for r in D.sensitivity_grid(scores, fixed(spark, 0.1, 900.0, 10.0)).collect()
    }
    assert rows[(0.1, 50.0)] == rows[(0.2, 100.0)] and rows[(0.15, 150.0)] == rows[(0.3, 300.0)]


def test_rule_and_empty_rule(scores, spark):
    row = D.fixed_rule_point(scores, F.col("segment") == "new", fixed(spark, c=1), label="new").first()
    assert row["n_targeted"] == 75 and row["lift"] == pytest.approx(row["precision"] / pairs(scores)[0].mean())
    with pytest.raises(Exception, match="selects nobody"):
        D.fixed_rule_point(scores, F.lit(False), fixed(spark), label="none").collect()


def test_assumptions_chain_and_refusals(spark):
    now = spark.createDataFrame([(5.0,), (None,), (7.0,)], "price_per_day double")
    before = spark.createDataFrame([(0,), (1,), (0,), (0,)], "is_churn int")
    a = D.resolve_assumptions(now, before, D.BusinessParams(c_offer=30)).first()
    assert a["ltv_saved"] == pytest.approx(6 * 30.4 * 4) and a["p_star"] == pytest.approx(30 / (0.15 * a["ltv_saved"]))
    with pytest.raises(Exception, match="null everywhere"):
        D.resolve_assumptions(now.filter("price_per_day is null"), before).collect()
    with pytest.raises(Exception, match="must lie in"):
        D.resolve_assumptions(now, before.filter("is_churn = 0")).collect()


def test_average_precision_by_hand(scores, spark):
    y, p = pairs(scores)
    levels = sorted(set(p), reverse=True)
    want = sum((y[p == v].sum() / y.sum()) * (y[p >= v].sum() / (p >= v).sum()) for v in levels)
    assert M.pr_auc(scores).first()["pr_auc"] == pytest.approx(want, abs=1e-12)
    with pytest.raises(Exception, match="needs a positive"):
        M.pr_auc(frame(spark, [0, 0], [0.1, 0.2])).collect()


# --- drift ------------------------------------------------------------------


def test_psi_by_hand(spark):
    ref = spark.createDataFrame([(0,)] * 50 + [(1,)] * 50, "x int")
    cur = spark.createDataFrame([(0,)] * 60 + [(1,)] * 40, "x int")
    row = DR.psi_table(ref, cur, ["x"], categorical=()).first()
    assert row["psi"] == pytest.approx(0.040546, abs=1e-5)
    assert (row["kind"], row["band"], row["epsilon_floored"], row["n_bins"]) == ("discrete", "stable", False, 4)


def test_new_category_is_floored_and_counted(spark):
    ref = spark.createDataFrame([(1,)] * 100, "c int")
    cur = spark.createDataFrame([(1,)] * 80 + [(7,)] * 20, "c int")
    row = DR.psi_table(ref, cur, ["c"], categorical=("c",)).first()
    assert row["epsilon_floored"] and row["band"] == "significant" and row["top_bin"] == DR.UNSEEN


def test_same_table_has_no_drift_and_counts_missing(spark):
    df = spark.createDataFrame([(float(i),) for i in range(99)] + [(None,)], "x double")
    row = DR.psi_table(df, df, ["x"], categorical=()).first()
    assert (row["psi"], row["kind"], row["epsilon_floored"]) == (0.0, "quantile", False)
    assert row["reference_missing"] == 0.01 and row["missing_delta"] == 0.0


def test_ranges_are_left_closed_like_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = np.round(rng.normal(size=500), 1), np.round(rng.normal(0.4, 1, 400), 1)
    edges = np.unique(np.quantile(a, np.arange(1, 10) / 10))
    cuts = [-np.inf, *edges, np.inf]
    p, q = np.histogram(a, cuts)[0] / 500, np.histogram(b, cuts)[0] / 400
    keep = (p > 0) | (q > 0)
    p, q = np.clip(p[keep], 1e-6, None), np.clip(q[keep], 1e-6, None)
    want = ((p - q) * np.log(p / q)).sum()
    ref = spark.createDataFrame([(float(v),) for v in a], "x double")
    cur = spark.createDataFrame([(float(v),) for v in b], "x double")
    assert DR.psi_table(ref, cur, ["x"], categorical=()).first()["psi"] == pytest.approx(want)


def test_all_null_reference_is_an_error(spark):
    ref = spark.createDataFrame([(None,), (None,)], "x double")
    with pytest.raises(Exception, match="null everywhere"):
        DR.psi_table(ref, ref, ["x"], categorical=()).collect()


def test_missing_column_is_an_error(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError, match="lacks"):
        DR.psi_table(df, df.withColumnRenamed("x", "y"), ["x"])


def plain_psi(a, b):
    """PSI of numbers by decile ranges of ``a``, empty bins left out."""
    cuts = [-np.inf, *np.unique(np.quantile(a, np.arange(1, 10) / 10)), np.inf]
    p, q = np.histogram(a, cuts)[0] / len(a), np.histogram(b, cuts)[0] / len(b)
    keep = (p > 0) | (q > 0)
    p, q = np.clip(p[keep], 1e-6, None), np.clip(q[keep], 1e-6, None)
    return ((p - q) * np.log(p / q)).sum()


def test_noise_floor_equals_halves_by_hand(spark):
    rng = np.random.default_rng(4)
    x, y = np.round(rng.gamma(2, 3, 1500), 2), rng.normal(size=1500) * 1e-9
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "user_id int, x double, y double")
    got = {r["feature"]: r for r in DR.noise_floor(df, ["x", "y"], rounds=4, seed=7, categorical=(), key="user_id").collect()}
    bits = np.array([int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:15], 16) for i in range(1500)])
    for name, values in (("x", x), ("y", y)):
        want = [plain_psi(values[bits >> r & 1 == 1], values[bits >> r & 1 == 0]) for r in range(4)]
        assert got[name]["psi_mean"] == pytest.approx(np.mean(want)) and got[name]["psi_max"] == pytest.approx(max(want))


def test_quantiles_outside_their_brackets_take_another_pass(spark, monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=700), rng.normal(0.2, 1, 500)
    ref, cur = (spark.createDataFrame([(float(v),) for v in z], "x double") for z in (a, b))
    # brackets that hold none of the wanted values
    monkeypatch.setattr(DR, "_brackets", lambda *_: [-0.01, -0.009, 0.3, 0.301, 5.0, 5.1])
    assert DR.psi_table(ref, cur, ["x"], categorical=()).first()["psi"] == pytest.approx(plain_psi(a, b))


def test_values_that_agree_in_six_decimals_have_bins_of_their_own(spark):
    ref = spark.createDataFrame([(1e-9,)] * 50 + [(2e-9,)] * 50, "x double")
    cur = spark.createDataFrame([(1e-9,)] * 80 + [(2e-9,)] * 20, "x double")
    row = DR.psi_table(ref, cur, ["x"], categorical=()).first()
    assert row["n_bins"] == 4 and row["psi"] == pytest.approx(0.3 * math.log(1.6) + 0.3 * math.log(2.5))


def test_a_half_with_few_values_is_discrete_where_the_other_is_not(spark):
    df = spark.createDataFrame([(i, float(i // 40)) for i in range(480)], "user_id int, x double")  # 12 values
    split = DR.halves(df, ["x"], 3, 1, "user_id")
    few = split.withColumn("side1", (F.col("x") < 5).cast("int"))
    kinds = {s.round: s.kind for s in DR.fit_bins(few, ["x"], categorical=())}
    assert kinds == {0: "quantile", 1: "discrete", 2: "quantile"}


def test_no_row_is_shuffled_by_the_bin_passes(spark):
    df = spark.range(1000).select("id", F.rand(1).alias("x"), F.rand(2).alias("y"), (F.col("id") % 2).cast("int").alias("side0"))
    schemes = DR.fit_bins(df, ["x", "y"], categorical=())
    plan = DR.apply_bins(df, schemes)._jdf.queryExecution().executedPlan().toString()
    below = [part.split("Exchange")[0] for part in plan.split("Exchange hashpartitioning")[1:]]
    unpivoted = [part for part in below if "Expand" in part]
    assert unpivoted and all(-1 < part.find("partial_") < part.find("Expand") for part in unpivoted)


def test_noise_floor_is_small_and_shared(spark):
    df = spark.createDataFrame([(i, float(i % 97)) for i in range(3000)], "user_id int, x double")
    row = DR.noise_floor(df, ["x"], rounds=3, categorical=()).first()
    assert 0 < row["psi_mean"] < 0.05 and row["rounds"] == 3 and row["psi_max"] >= row["psi_mean"]
    with pytest.raises(ValueError):
        DR.noise_floor(df, ["x"], rounds=1)


def test_empty_curve_has_no_optimum(spark):
    from renewlens.operators.decision import optimal_point

    empty = spark.createDataFrame([], "k double, expected_net double")
    with pytest.raises(ValueError, match="empty curve"):
        optimal_point(empty)


def test_edges_are_looked_up_once_per_value(spark, monkeypatch):
    """A filter on the bucket, pushed below, repeated the search for a feature's edges per edge."""
    plans = []

    def seen(df, name="stage"):
        if name == "brackets":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(DR, "stage", seen)
    df = spark.range(2000).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") % 9 > 0, -F.col("id")).alias("y"))
    (x, y) = DR.fit_bins(DR.paired(df, df, ["x", "y"]), ["x", "y"])
    assert list(x.edges) == pytest.approx([199.9 * i for i in range(1, 10)]) and len(y.edges) == 9
    assert plans and all(p.count("element_at(") <= 3 for p in plans)


def test_compared_scores_are_rounded_as_in_sql(spark):
    """Near halves, rounding in decimals and in doubles differ; ranks of tied scores then differ too."""
    duckdb = pytest.importorskip("duckdb")
    values = [*[0.5381744812295, 0.8516145682064999, 0.8960357334994999], 0.5, 0.0, 1.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "p double").select(compared(F.col("p"))).collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 12)", [v]).fetchone()[0] for v in values]
    plain = [r[0] for r in spark.createDataFrame([(v,) for v in values], "p double").select(F.round("p", 12)).collect()]
    assert plain != got  # what was done before


def test_compared_scores_have_the_last_bit_of_exp_that_sql_has(spark):
    """Log-odds whose score lies next to a half of the 12th decimal: the portable ``exp`` misses it."""
    duckdb = pytest.importorskip("duckdb")
    values = [-2.3479826333333333, -1.5379079666666666, -0.2823159666666667, 0.3933200333333333, 1.0682387, 3.7465613666666666]
    df = spark.createDataFrame([(v,) for v in values], "z double")
    got = df.select(compared(sigmoid(F.col("z"), platform_exp)), compared(sigmoid(F.col("z")))).collect()
    want = [duckdb.execute(f"SELECT round({SIGMOID}, 12) FROM (SELECT CAST(? AS DOUBLE) AS z)", [v]).fetchone()[0] for v in values]
    assert [r[0] for r in got] == want
    assert all(r[1] != w for r, w in zip(got, want, strict=True))  # what was done before
    assert spark.range(1).select(platform_exp(F.lit(None).cast("double"))).first()[0] is None
