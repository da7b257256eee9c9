import hashlib

import pytest
from helpers import tx_rows
from pyspark.sql import functions as F

from renewlens.functions import dates
from renewlens.operators import cohort as C
from renewlens.operators import guards as G
from renewlens.operators.contracts import content_fingerprint

SPEC = C.CohortSpec("feb", 20170201, 20170228)


def members_of(spark, *rows):
    return spark.createDataFrame(rows, "user_id string, is_churn int, cutoff int")


def asof(spark, tx, *cutoffs):
    users = cutoffs or (("u", 0, 20170228),)
    return {r["user_id"]: r for r in C.aggregate_asof(tx, members_of(spark, *users)).collect()}


def test_dates_shift_across_months(spark):
    assert dates.add_days(20170301, -7) == 20170222
    assert dates.add_days(20170228, -7) == 20170221
    got = spark.createDataFrame([(20170301,), (20170228,)], "c int").selectExpr(
        f"{dates.shift_ymd_sql('c', -7)} as s"
    )
    assert [r["s"] for r in got.collect()] == [20170222, 20170221]


def test_lenient_dates_reject_impossible_days(spark):
    got = spark.createDataFrame([(20170230,), (20170228,), (None,)], "c int").selectExpr(
        f"cast({dates.date_sql('c')} as string) as d"
    )
    assert [r["d"] for r in got.collect()] == [None, "2017-02-28", None]


def test_last_day_wins_over_earlier_days(spark, make_tx):
    tx = make_tx(tx_rows("u", (20170210, {"cancel": 1, "paid": 99}), (20170220, {})))
    r = asof(spark, tx)["u"]
    assert (r["last_is_cancel"], r["last_actual_amount_paid"]) == (0, 149)
    assert (r["last_day_n_tx"], r["last_day_has_conflict"]) == (1, False)
    assert (r["n_tx"], r["n_cancel_hist"], r["mean_paid"]) == (2, 1, 124.0)


def test_equal_rows_on_last_day_are_no_conflict(spark, make_tx):
    r = asof(spark, make_tx(tx_rows("u", *[(20170220, {})] * 3)))["u"]
    assert (r["last_day_n_tx"], r["last_is_cancel"], r["last_day_has_conflict"]) == (3, 0, False)


def test_conflict_is_per_column(spark, make_tx):
    r = asof(spark, make_tx(tx_rows("u", (20170220, {}), (20170220, {"cancel": 1}))))["u"]
    assert r["last_is_cancel"] is None
    assert r["last_plan_list_price"] == 149
    assert r["last_day_has_conflict"] is True


def test_rows_after_cutoff_never_count_and_cutoff_day_does(spark, make_tx):
    tx = make_tx(tx_rows("u", (20170228, {"paid": 50}), (20170301, {"cancel": 1, "paid": 1})))
    r = asof(spark, tx)["u"]
    assert (r["n_tx"], r["last_tx"], r["last_actual_amount_paid"], r["n_cancel_hist"]) == (
        1,
        20170228,
        50,
        0,
    )


def test_null_beside_value_is_no_conflict(spark, make_tx):
    tx = make_tx(tx_rows("u", (20170220, {"method": None}), (20170220, {"method": 40})))
    r = asof(spark, tx)["u"]
    assert (r["last_payment_method_id"], r["last_day_has_conflict"]) == (40, False)


def test_back_dated_record_sets_no_cutoff(make_tx):
    tx = make_tx(
        tx_rows("late", (20170305, {"expire": 20170220})),
        tx_rows("ok", (20170101, {"expire": 20170210}), (20170201, {"expire": 20170220})),
        tx_rows("sentinel", (20170101, {"expire": 19700101})),
    )
    got = {r["user_id"]: r["cutoff"] for r in C.cutoff_by_expiry(tx, SPEC).collect()}
    assert got == {"ok": 20170220}


def test_declared_expiry_is_the_last_one_not_the_largest(make_tx):
    tx = make_tx(
        tx_rows("far", (20160101, {"expire": 20230817}), (20170120, {"expire": 20170215})),
        tx_rows("clash", (20170120, {"expire": 20170215}), (20170120, {"expire": 20170220})),
        tx_rows("sentinel", (20170120, {"expire": 19700101})),
        tx_rows("future", (20170110, {"expire": 20170205}), (20170210, {"expire": 20170310})),
    )
    got = {r["user_id"]: r["expire_date"] for r in C.declared_expiry_asof(tx, 20170131).collect()}
    assert got == {"far": 20170215, "clash": None, "sentinel": None, "future": 20170205}


def test_fixed_date_keeps_unknown_and_drops_other_months(spark, make_tx):
    spec = C.CohortSpec("f", 20170201, 20170228, score_date=20170131)
    tx = make_tx(
        tx_rows("in", (20170120, {"expire": 20170215})),
        tx_rows("out", (20170120, {"expire": 20170515})),
        tx_rows("unknown", (20170120, {"expire": 19700101})),
    )
    labels = spark.createDataFrame([("in", 0), ("out", 0), ("unknown", 1)], "user_id string, is_churn int")
    got = {r["user_id"] for r in C.cohort_fixed_score_date(labels, tx, spec).collect()}
    assert got == {"in", "unknown"}


def test_lead_time_drops_users_without_history(spark, make_tx):
    spec = C.CohortSpec("t7", 20170201, 20170228, lead_days=7)
    tx = make_tx(
        tx_rows("old", (20170101, {"expire": 20170220})),
        tx_rows("fresh", (20170218, {"expire": 20170220})),
    )
    labels = spark.createDataFrame([("old", 0), ("fresh", 1)], "user_id string, is_churn int")
    members = spark.createDataFrame(
        [("old", 1, 30, "male", 7, 20150101)],
        "user_id string, city int, bd int, gender string, registered_via int, registration_init_time int",
    )
    rows = C.build_cohort(spec, tx, labels, members).collect()
    assert [(r["user_id"], r["cutoff"], r["in_members"]) for r in rows] == [("old", 20170213, True)]


def test_spec_rules_exclude_each_other():
    with pytest.raises(ValueError, match="exclude"):
        C.CohortSpec("x", 1, 2, lead_days=7, score_date=20170131)


def test_definitions_and_windows():
    specs = C.COHORTS
    assert C.cutoff_definition(specs["feb"]) == "expire_date"
    assert C.cutoff_definition(specs["mar_t7"]) == "expire_date_minus_7d"
    assert C.cutoff_definition(specs["apr_fixed"]) == "fixed_score_date_20170331"
    assert C.cutoff_window(specs["mar_t7"]) == (20170222, 20170324)
    assert C.cutoff_window(specs["feb_fixed"]) == (20170131, 20170131)


def test_result_does_not_depend_on_partitioning(spark, make_tx):
    rows = tx_rows("u", *[(20170101 + i % 28, {"paid": i}) for i in range(60)])
    tx = make_tx(rows, tx_rows("v", (20170220, {}), (20170220, {"cancel": 1})))
    users = members_of(spark, ("u", 1, 20170220), ("v", 0, 20170228))
    prints = [
        content_fingerprint(C.aggregate_asof(tx.repartition(n), users)).first() for n in (1, 7)
    ]
    assert prints[0] == prints[1]


def test_hot_user_is_compacted_before_the_join(spark, make_tx):
    tx = make_tx(tx_rows("hot", *[(20170101 + i % 20, {}) for i in range(2000)]))
    days = C.daily_transactions(tx)
    assert days.count() == 20
    assert days.agg(F.sum("day_n")).first()[0] == 2000


# --- guards must raise ------------------------------------------------------


def test_guard_asof(cohort):
    with pytest.raises(G.GuardViolation, match="asof: 1 rows"):
        G.run_guards(cohort, [G.asof_guard()])


def test_guard_missing_column(cohort):
    with pytest.raises(KeyError, match="last_tx"):
        G.run_guards(cohort.drop("last_tx"), [G.asof_guard()])


def test_guard_cutoff_window(spark):
    df = members_of(spark, ("a", 0, 20170310))
    with pytest.raises(G.GuardViolation, match="cutoff_window"):
        G.run_guards(df, [G.cutoff_window_guard(SPEC)])


def test_guard_data_end(spark):
    df = members_of(spark, ("a", 0, 20170410))
    with pytest.raises(G.GuardViolation, match="data_end"):
        G.run_guards(df, [G.data_end_guard(20170331, SPEC, 90)])


def test_guard_unique_key(spark):
    df = members_of(spark, ("a", 0, 20170210), ("a", 0, 20170210))
    with pytest.raises(G.GuardViolation, match="unique_key"):
        G.check_unique_key(df)


def test_guard_labels_are_real():
    with pytest.raises(G.GuardViolation, match="apr_fixed"):
        G.check_labels_are_real(C.COHORTS["mar"], C.COHORTS["apr_fixed"])


def test_good_table_passes_all(spark):
    df = spark.createDataFrame([("a", 0, 20170210, 20170201)], "user_id string, is_churn int, cutoff int, last_tx int")
    assert G.check_cohort(df, SPEC, 20170331) is df


def test_a_repeated_row_and_a_moved_value_change_the_fingerprint(spark):
    rows = [(1, "a", None), (2, None, "b"), (2, None, "b")]
    schema = "user_id int, x string, y string"
    base = content_fingerprint(spark.createDataFrame(rows, schema)).first()
    assert base == content_fingerprint(spark.createDataFrame(rows[::-1], schema).repartition(3)).first()
    for other in (rows + [rows[0]], rows[:2], rows[:1] + [(2, "b", None)] * 2, rows + [rows[1]] * 2):
        assert content_fingerprint(spark.createDataFrame(other, schema)).first() != base
    half = lambda s: int(s, 16)
    cells = [hashlib.md5(("".join(f"{len(str(v))}:{v}" if v is not None else "-" for v in r)).encode()).hexdigest() for r in rows]
    assert base["sum_high"] == str(sum(half(c[:16]) for c in cells) % 2**64)


def test_guards_ride_on_a_build(spark):
    log = G.GuardLog()
    df = spark.createDataFrame([("a", 5, 3), ("b", 2, 3), ("c", 9, 3)], "user_id string, last_tx int, cutoff int")
    watched = log.watch(df, [G.asof_guard()], "t")
    watched.write.format("noop").mode("overwrite").save()
    (found,) = log.findings()
    assert (found.rule, found.rows, found.worst) == ("asof", 2, 6.0)
    with pytest.raises(G.GuardViolation, match="asof: 2 rows of t"):
        log.verify()


def test_cohort_and_features_are_watched_while_they_are_written(spark):
    from renewlens.plans import compose
    from renewlens.sources.demo import Q3

    src, log = compose.Sources.demo(spark, "/root/testdata/sf0.001"), G.GuardLog()
    table = compose.guarded_feature_table(src, Q3, log)
    assert [(f.rule, f.rows) for f in log.findings()] == [
        (r, 0) for r in ("asof", "cutoff_window", "data_end", "logs_within_cutoff", "logs_match_cohort")
    ]
    assert table.columns == compose.feature_table(src, Q3).columns
    assert sorted(map(str, table.collect())) == sorted(map(str, compose.feature_table(src, Q3).collect()))
