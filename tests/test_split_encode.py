import pytest
from pyspark.sql import functions as F

from renewlens.operators import encode as E
from renewlens.operators import ranking as R
from renewlens.operators import split as S
from renewlens.operators.guards import GuardViolation


@pytest.fixture(scope="module")
def merged(two_cohorts):
    return S.merge_cohorts(two_cohorts).cache()


def segments(df):
    return {(r["cohort"], r["user_id"]): r["segment"] for r in df.collect()}


def test_merge_keeps_origin_and_counts_shared(merged):
    assert merged.count() == 400
    assert S.shared_users(merged).count() == 150
    assert sorted(map(tuple, S.cohort_summary(merged).select("cohort", "n").collect())) == [
        ("feb", 200),
        ("mar", 200),
    ]


def test_merge_refusals(spark, two_cohorts):
    a, b = two_cohorts["feb"], two_cohorts["mar"]
    with pytest.raises(ValueError, match="at least two"):
        S.merge_cohorts({"a": a})
    with pytest.raises(ValueError, match="columns"):
        S.merge_cohorts({"a": a, "b": b.select(*reversed(b.columns))})
    with pytest.raises(ValueError, match="types"):
        S.merge_cohorts({"a": a, "b": b.withColumn("n_tx", F.col("n_tx").cast("double"))})
    with pytest.raises(ValueError, match="null labels"):
        S.merge_cohorts({"a": a, "b": b.withColumn("is_churn", F.lit(None).cast("int"))})
    with pytest.raises(ValueError, match="more than once"):
        S.merge_cohorts({"a": a, "b": b.union(b)})
    with pytest.raises(ValueError, match="categories"):
        S.merge_cohorts({"a": a, "b": b}, categorical={"a": ("city",), "b": ()})


def test_strata_cover_all_five_kinds(merged):
    kinds = {r["stratum"] for r in S.group_strata(merged).select("stratum").distinct().collect()}
    assert kinds == {"1-0", "1-1", "2-0", "2-1", "2-2"}


def test_four_way_split_is_disjoint_exhaustive_and_sized(merged):
    out = S.split_four_group(merged)
    S.check_groups_disjoint(out)
    assert out.count() == 400
    users = {r["segment"]: r["n_users"] for r in S.split_summary(out).collect()}
    assert sum(users.values()) == 250
    assert users == {"train": 175, "es": 25, "sel": 25, "cal": 25}


def test_split_depends_on_seed_not_on_order(merged):
    base = segments(S.split_four_group(merged))
    assert segments(S.split_four_group(merged.repartition(7).orderBy("price_per_day"))) == base
    assert segments(S.split_four_group(merged, seed=7)) != base


def test_split_three_fractions_and_rates(two_cohorts):
    out = S.split_three(two_cohorts["feb"])
    n = {r["segment"]: r["n"] for r in S.split_summary(out).collect()}
    assert n["sel"] == 30 and n["es"] == 30 and sum(n.values()) == 200
    rates = [r["churn_rate"] for r in S.split_summary(out).collect()]
    assert max(rates) - min(rates) < 0.02


def test_bad_fractions():
    with pytest.raises(KeyError, match="lack"):
        S.check_fractions({"train": 1.0})
    with pytest.raises(KeyError, match="unknown"):
        S.check_fractions({**S.FOUR_WAY, "test": 0.0})
    with pytest.raises(ValueError, match="add up"):
        S.check_fractions({**S.FOUR_WAY, "train": 0.8})


def test_empty_segment_is_an_error(merged):
    with pytest.raises(ValueError, match="empty"):
        S.split_four_group(
            merged, fractions={"train": 1 - 3e-6, "es": 1e-6, "sel": 1e-6, "cal": 1e-6}
        )


def test_grouped_folds_never_cross_and_random_ones_do(merged):
    good = S.fold_report(S.folds_grouped(merged, k=4)).collect()
    bad = S.fold_report(S.folds_random_control(merged, k=4)).collect()
    assert all(r["crossing_users"] == 0 for r in good)
    assert all(r["crossing_users"] > 20 for r in bad)
    assert sum(r["valid_rows"] for r in good) == 400
    rates = [r["valid_rate"] for r in good]
    assert max(rates) - min(rates) < 0.06


def test_guard_groups_disjoint(spark):
    df = spark.createDataFrame([("u", "a"), ("u", "b")], "user_id string, segment string")
    with pytest.raises(GuardViolation, match="groups_disjoint"):
        S.check_groups_disjoint(df)


def test_unassigned_row_fails(spark, merged):
    nobody = spark.createDataFrame([], "user_id string, segment string")
    with pytest.raises(Exception, match="not assigned"):
        S.segment_assign_join(merged, nobody).collect()
    twice = spark.createDataFrame([("s0001", "a"), ("s0001", "b")], "user_id string, segment string")
    with pytest.raises(GuardViolation):
        S.segment_assign_join(merged, twice)


def test_hash_rank_is_exact_per_stratum(merged):
    ranks = R.hash_rank(merged, seed=1, strata=["is_churn"], key=["cohort", "user_id"], digits=1)
    for r in ranks.groupBy("is_churn").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("hash_rank").alias("d"),
        F.max("hash_rank").alias("m"),
        F.max("stratum_n").alias("s"),
    ).collect():
        assert r["n"] == r["d"] == r["m"] == r["s"]


def test_common_subset_rejects_changed_labels(spark):
    a = spark.createDataFrame([("u", 1, 0.5)], "user_id string, is_churn int, p double")
    b = spark.createDataFrame([("u", 0, 0.4)], "user_id string, is_churn int, p double")
    with pytest.raises(Exception, match="different labels"):
        S.common_subset(a, b).collect()


# --- encoding ---------------------------------------------------------------


def test_smoothing_formula(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(2, 0)] * 4, "c int, is_churn int")
    got = {r["c"]: r["encoding"] for r in E.target_encode_fit(df, "c").collect()}
    prior = 3 / 8
    assert got[1] == pytest.approx((3 + prior * 100) / 104)
    assert got[2] == pytest.approx((0 + prior * 100) / 104)


def test_unseen_and_null_categories(spark):
    train = spark.createDataFrame([(None, 1), (1, 0)], "c int, is_churn int")
    enc = E.target_encode_fit(train, "c")
    apply = spark.createDataFrame([(None,), (1,), (9,)], "c int")
    got = {r["c"]: r["c_te"] for r in E.target_encode_apply(apply, enc, "c").collect()}
    assert got[9] == pytest.approx(0.5)
    assert got[None] == pytest.approx((1 + 50) / 101)


def test_oof_of_unique_categories_is_the_fold_prior(spark):
    rows = [(f"u{i}", i, i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id string, c int, is_churn int")
    out = E.target_encode_oof(df, "c").collect()
    assert all(r["c_te"] == pytest.approx(0.5) for r in out)
    naive = E.target_encode_naive(df, "c").withColumn("c_te", F.round("c_te", 1))
    E.check_encoding_is_oof(naive, "c_te")


def test_oof_matches_brute_force(two_cohorts):
    df, col = two_cohorts["feb"], "last_payment_method_id"
    rows = E.target_encode_oof(df, col).collect()
    for r in rows[::17]:
        rest = [x for x in rows if x["fold"] != r["fold"]]
        same = [x for x in rest if x[col] == r[col]]
        prior = sum(x["is_churn"] for x in rest) / len(rest)
        want = (sum(x["is_churn"] for x in same) + prior * 100) / (len(same) + 100)
        assert r[f"{col}_te"] == pytest.approx(want)


def test_identifier_is_refused(two_cohorts):
    with pytest.raises(ValueError, match="single user"):
        E.target_encode_oof(two_cohorts["feb"], "user_id")


def test_guard_encoding_equals_label(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0)], "is_churn int, te double")
    with pytest.raises(GuardViolation):
        E.check_encoding_is_oof(df, "te")


def test_levels_skip_missing(spark):
    df = spark.createDataFrame([(-1,), (None,), (3,), (3,)], "c int")
    assert [r["level"] for r in E.category_levels(df, "c").collect()] == [3]
