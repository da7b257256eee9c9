import pytest
from helpers import tx_rows

from renewlens.operators import cohort as C
from renewlens.operators import guards as G
from renewlens.operators import labels as L
from renewlens.operators import logs
from renewlens.sources import demo

SPEC = L.LabelSpec("feb", 20170101, 20170131, 20170201, 20170228)


def gap_of(make_tx, *rows):
    tx = demo.as_text(make_tx(tx_rows("u", *rows)))
    got = L.build_labels(tx, SPEC).collect()
    return (got[0]["gap"], got[0]["is_churn"]) if got else None


def test_renewal_within_thirty_days(make_tx):
    assert gap_of(make_tx, (20170105, {"expire": 20170205}), (20170210, {"expire": 20170310})) == (5, 0)


def test_no_renewal_is_churn(make_tx):
    assert gap_of(make_tx, (20170105, {"expire": 20170205})) == (9999, 1)


def test_cancel_before_renewal_moves_the_start_back(make_tx):
    rows = (
        (20170105, {"expire": 20170220}),
        (20170205, {"cancel": 1, "expire": 20170205}),
        (20170310, {"expire": 20170410}),
    )
    assert gap_of(make_tx, *rows) == (33, 1)


def test_cancel_after_renewal_is_ignored(make_tx):
    rows = (
        (20170105, {"expire": 20170220}),
        (20170222, {"expire": 20170322}),
        (20170223, {"cancel": 1, "expire": 20170101}),
    )
    assert gap_of(make_tx, *rows) == (2, 0)


def test_early_renewal_gives_a_negative_gap(make_tx):
    rows = ((20170105, {"expire": 20170220}), (20170201, {"expire": 20170320}))
    assert gap_of(make_tx, *rows) == (-19, 0)


def test_same_day_order_uses_text_keys_descending(make_tx):
    # As text "99..." > "149...", so price 99 sorts first and price 149 is the last row.
    rows = (
        (20170105, {"price": 99, "expire": 20170210}),
        (20170105, {"price": 149, "expire": 20170220}),
    )
    tx = demo.as_text(make_tx(tx_rows("u", *rows)))
    assert L.last_expire(tx, SPEC).first()["last_expire"] == 20170220


def test_prefix_text_keys_still_sort_descending(spark, make_tx):
    # "1493041" starts with "149304": the longer text is larger and must come first.
    rows = ((20170105, {"method": 4, "expire": 20170210}), (20170105, {"method": 41, "expire": 20170220}))
    tx = demo.as_text(make_tx(tx_rows("u", *rows)))
    assert L.last_expire(tx, SPEC).first()["last_expire"] == 20170210


def test_same_key_cancels_sort_by_expiry_descending(make_tx):
    rows = (
        (20170105, {"cancel": 1, "expire": 20170210}),
        (20170105, {"cancel": 1, "expire": 20170225}),
        (20170105, {"expire": 20170228}),
    )
    tx = demo.as_text(make_tx(tx_rows("u", *rows)))
    # Non-cancel first, then cancels from late to early expiry: the last row expires 20170210.
    assert L.last_expire(tx, SPEC).first()["last_expire"] == 20170210


LOGS = (
    "user_id string, date int, num_25 int, num_50 int, num_75 int, num_985 int, num_100 int,"
    " num_unq int, total_secs double"
)


def log_row(user, day, secs=100.0, full=2, some=1):
    return (user, day, some, 0, 0, 0, full, 3, secs)


def features(spark, rows, cutoff=20170228):
    cut = spark.createDataFrame([("u", cutoff)], "user_id string, cutoff int")
    got = logs.build_log_features(spark.createDataFrame(rows, LOGS), cut).collect()
    return got[0] if got else None


def test_windows_include_day_zero_and_stop_at_w(spark):
    rows = [log_row("u", 20170228), log_row("u", 20170222), log_row("u", 20170221), log_row("u", 20161201)]
    r = features(spark, rows)
    assert (r["log7_active_days"], r["log14_active_days"], r["log90_active_days"]) == (2, 3, 4)
    assert (r["log_min_days_before"], r["log_max_days_before"]) == (0, 89)
    assert r["log7_secs"] == 200.0 and r["log7_plays"] == 6 and r["log7_unq"] == 6
    assert r["log7_completion"] == pytest.approx(4 / 6)


def test_empty_window_is_zero_but_its_ratios_are_null(spark):
    r = features(spark, [log_row("u", 20170110)])
    assert (r["log7_active_days"], r["log7_secs"], r["log7_plays"]) == (0, 0.0, 0)
    assert r["log7_completion"] is None and r["log7_secs_per_active_day"] is None
    assert r["log_trend_7_30"] is None
    assert r["log_trend_30_90"] == 0.0


def test_rows_after_cutoff_or_too_old_leave_no_trace(spark):
    assert features(spark, [log_row("u", 20170301), log_row("u", 20161101)]) is None


def test_trend_compares_daily_averages(spark):
    rows = [log_row("u", 20170228, 70.0), log_row("u", 20170205, 230.0)]
    r = features(spark, rows)
    assert r["log_trend_7_30"] == pytest.approx((70 / 7) / (300 / 30))


def test_seconds_do_not_depend_on_partitioning(spark):
    rows = [log_row("u", 20170101 + i % 28, 0.1 * i) for i in range(200)]
    cut = spark.createDataFrame([("u", 20170228)], "user_id string, cutoff int")
    df = spark.createDataFrame(rows, LOGS)
    got = {logs.build_log_features(df.repartition(n), cut).first()["log90_secs"] for n in (1, 3, 7)}
    assert len(got) == 1


def test_window_bounds_anchor_on_the_cutoff():
    specs = [C.COHORTS["feb"], C.COHORTS["mar_t7"], C.COHORTS["apr_fixed"]]
    assert logs.window_bounds(specs) == (20161103, 20170331)
    assert logs.window_bounds([C.COHORTS["apr_fixed"]]) == (20161231, 20170331)


def test_group_names_cover_every_log_column():
    groups = {c: logs.feature_group_of(c) for c in logs.log_columns()}
    assert len(groups) == 38
    assert [c for c, g in groups.items() if g is None] == ["log_has_logs"]
    assert logs.feature_group_of("n_tx") is None


def test_narrowing_prunes_before_it_joins(spark, tmp_path):
    path = str(tmp_path / "logs")
    spark.createDataFrame([log_row("u", 20170101), log_row("v", 20170401)], LOGS).write.parquet(path)
    users = spark.createDataFrame([("u",)], "user_id string")
    narrowed = logs.narrow_logs(spark.read.parquet(path), users, 20161201, 20170228)
    plan = narrowed._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(date,20161201)" in plan and "LessThanOrEqual(date,20170228)" in plan
    out = str(tmp_path / "narrow")
    logs.write_narrow_logs(narrowed, out)
    assert spark.read.parquet(out).select("user_id", "month").collect() == [("u", 201701)]


def test_guard_logs_within_cutoff(spark):
    bad = spark.createDataFrame([("u", -3)], "user_id string, log_min_days_before int")
    with pytest.raises(G.GuardViolation, match="worst: 3"):
        G.run_guards(bad, [G.logs_within_cutoff_guard()])


def test_guard_logs_of_another_cohort(spark):
    a = spark.createDataFrame([("u", 20170228)], "user_id string, cutoff int")
    b = spark.createDataFrame([("u", 20170328)], "user_id string, cutoff int")
    with pytest.raises(G.GuardViolation, match="another cohort"):
        G.check_logs_match_cohort(a, b)
    with pytest.raises(KeyError):
        G.check_logs_match_cohort(a, b.drop("cutoff"))
