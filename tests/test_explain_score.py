import pytest
from pyspark.sql import functions as F

from renewlens.operators import attribution as A
from renewlens.operators import contracts, reasons
from renewlens.operators import score as SC
from renewlens.operators.attribution import LinearScorer
from renewlens.operators.features import build_features
from renewlens.operators.guards import GuardViolation
from renewlens.operators.logs import log_columns
from renewlens.plans.compose import FIXED_SCORER, Sources, feature_table, stored_feature_table
from renewlens.session import staging_root
from renewlens.sources import demo, readers, sinks
from renewlens.sources.store import FeatureTableStore, params_version
from renewlens.streaming.scoring import request_stream, score_stream

SF = "/root/testdata/sf0.001"
SCORER = LinearScorer(
    0.0, {"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0}, {"c": 1.0}, {"d": 0.25}
)
GROUPS = {"a": "first", "b": "first", "c": "second", "d": "third"}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [("x", 2.0, -0.5, 2.0, None), ("y", -1.0, -1.0, 0.0, -2.0), ("z", 0.0, 0.02, 3.0, 0.05)],
        "user_id string, a double, b double, c double, d double",
    )


def test_contributions_add_up(rows):
    scored = SCORER.score(rows)
    total = A.attribute(scored, SCORER).groupBy("user_id").agg((F.sum("shap") + F.max("base")).alias("z"))
    for r in scored.join(total, "user_id").collect():
        assert 1 / (1 + 2.718281828459045 ** -r["z"]) == pytest.approx(r["p"], abs=1e-9)
    assert A.assert_local_accuracy(scored, SCORER) < 1e-9


def test_guard_local_accuracy(rows):
    wrong = SCORER.score(rows).withColumn("p", F.col("p") * 0.9)
    with pytest.raises(GuardViolation):
        A.assert_local_accuracy(wrong, SCORER)


def test_groups_sum_before_they_compete(rows):
    got = {(r["user_id"], r["rank"]): r for r in A.top_contributors(rows, SCORER, groups=GROUPS).collect()}
    assert {k for k in got if k[0] == "x"} == {("x", 1), ("x", 2), ("x", 3)}
    top = got[("x", 1)]
    assert (top["group"], top["group_shap"], top["feature"], top["feature_shap"]) == ("first", 1.5, "a", 2.0)
    assert (got[("x", 3)]["group"], got[("x", 3)]["value"]) == ("third", None)


def test_only_positive_groups_and_never_padded(rows):
    top = A.top_contributors(rows, SCORER, groups=GROUPS)
    assert top.filter("user_id = 'y'").count() == 0
    assert A.top_contributors(rows, SCORER, groups=GROUPS, k=1).filter("user_id = 'x'").count() == 1
    with pytest.raises(ValueError):
        A.top_contributors(rows, SCORER, k=0)
    with pytest.raises(KeyError, match="without a group"):
        A.top_contributors(rows, SCORER, groups={"a": "first"})


def test_weak_reasons_are_marked_not_deleted(rows):
    top = A.top_contributors(rows, SCORER, groups=GROUPS)
    marked = {(r["user_id"], r["rank"]): r for r in reasons.mark_display(top).collect()}
    z = [marked[k] for k in sorted(marked) if k[0] == "z"]
    assert [r["displayed"] for r in z] == [True, False, False]
    assert z[1]["suppression_reason"] == "below_relative_floor(0.05)"
    assert [r["relative_to_top"] for r in z] == [1.0, 0.025, 0.01]
    with pytest.raises(ValueError):
        reasons.mark_display(top, -1)


def sentence(spark, feature, value, context=None):
    top = spark.createDataFrame(
        [("u", 1, feature, value, context)],
        "user_id string, rank int, feature string, value double, context_values map<string,double>",
    )
    return reasons.add_reasons(top).first()["reason"]


def test_sentences(spark):
    assert sentence(spark, "n_tx", 1234.0) == "Transactions so far 1,234 transactions"
    assert sentence(spark, "cancel_rate", 0.125) == "Share of cancellations 12.5%"
    assert sentence(spark, "last_is_auto_renew", 0.0) == "Auto-renewal is off"
    assert sentence(spark, "city", -1.0) == "City is unknown"
    assert sentence(spark, "gender_code", 1.0) == "Gender is female"
    assert sentence(spark, "price_per_day", None) == "Price per day is missing"
    assert sentence(spark, "log7_secs", None, {"log_has_logs": 0.0}) == "No activity in the last 90 days"
    assert sentence(spark, "n_tx", None, {"log_has_logs": 0.0}) == "Transactions so far is missing"
    assert sentence(spark, "log_trend_7_30", 0.1234).endswith("is 0.12 times that of 30 days")
    assert sentence(spark, "log30_plays", 4.0, {"log90_plays": 10.0}) == (
        "Last 30 days: plays 4 plays (average per 30 days over the 60 days before: 3 plays)"
    )
    assert sentence(spark, "log30_plays", 4.0, {"log90_plays": 1.0}) == "Last 30 days: plays 4 plays"
    assert "(" not in sentence(spark, "log30_unq", 4.0, {"log90_unq": 10.0})
    with pytest.raises(Exception, match="no wording"):
        sentence(spark, "made_up", 1.0)


def test_every_feature_has_wording(cohort):
    names = [c for c in build_features(cohort).columns if c not in ("user_id", "is_churn")]
    assert reasons.missing_metadata([*names, *log_columns(), "days_to_expire"]) == []


# --- requests ---------------------------------------------------------------


def requests_of(cohort):
    return cohort.select("user_id", *SC.REQUEST_FIELDS)


def test_request_path_equals_offline_path(cohort):
    offline = build_features(cohort)
    order = [c for c in offline.columns if c not in ("user_id", "is_churn")]
    online = SC.rows_to_features(requests_of(cohort), order, with_logs=False)
    assert {tuple(r) for r in online.collect()} == {tuple(r) for r in offline.drop("is_churn").collect()}
    one = SC.rows_to_features(requests_of(cohort.filter("user_id = 'u4'")), order, with_logs=False)
    assert one.first() == online.filter("user_id = 'u4'").first()


def test_request_columns_are_checked(cohort):
    good = requests_of(cohort)
    with pytest.raises(ValueError, match="unknown"):
        SC.check_request(good.withColumn("last_is_cancle", F.lit(1)))
    with pytest.raises(ValueError, match="lack"):
        SC.check_request(good.drop("bd"))
    with pytest.raises(ValueError, match="derived"):
        SC.check_request(good.withColumn("is_churn", F.lit(0)))
    with pytest.raises(ValueError, match="missing"):
        SC.rows_to_features(good, ["n_tx", "nope"], with_logs=False)


def test_feature_order_guard(cohort):
    df = build_features(cohort)
    names = [c for c in df.columns if c not in ("user_id", "is_churn")]
    SC.check_features_match(df, names)
    with pytest.raises(GuardViolation):
        SC.check_features_match(df, names[::-1])


def assumptions(spark):
    return spark.createDataFrame(
        [(0.15, 50.0, 600.0, 50 / 90)], "r_save double, c_offer double, ltv_saved double, p_star double"
    )


def test_score_table_and_warnings(spark, cohort):
    order = [
        *[c for c in build_features(cohort).columns if c not in ("user_id", "is_churn")],
        *log_columns(),
    ]
    req = requests_of(cohort)
    features = SC.rows_to_features(req, order, warnings="warnings")
    out = SC.score_table(features, FIXED_SCORER, assumptions(spark), warnings="warnings")
    rows = {r["user_id"]: r for r in out.collect()}
    assert len(rows) == 8
    assert any("no activity supplied" in w for w in rows["u0"]["warnings"])
    assert any("registered after" in w for w in rows["u5"]["warnings"])
    assert any("expiry day itself" in w for w in rows["u0"]["warnings"])
    for r in rows.values():
        assert r["above_threshold"] == (r["p"] > r["p_star"])
        assert r["expected_net"] == pytest.approx(round(r["p"] * 90 - 50, 1), abs=0.051)


def test_two_requests_of_one_user_keep_their_own_warnings(spark, cohort):
    order = [c for c in build_features(cohort).columns if c not in ("user_id", "is_churn")]
    req = requests_of(cohort.filter("user_id in ('u0', 'u5')")).withColumn("user_id", F.lit("same"))
    features = SC.rows_to_features(req, order, with_logs=False, warnings="warnings")
    scorer = LinearScorer(0.1, {"n_tx": -0.1, "cancel_rate": 0.8})
    out = SC.score_table(features, scorer, assumptions(spark), warnings="warnings").collect()
    assert len(out) == 2 and sorted(any("registered after" in w for w in r["warnings"]) for r in out) == [False, True]


def test_probabilities_only_and_additivity(spark, cohort):
    order = [c for c in build_features(cohort).columns if c not in ("user_id", "is_churn")]
    features = SC.rows_to_features(requests_of(cohort), order, with_logs=False)
    scorer = LinearScorer(0.1, {"n_tx": -0.1, "cancel_rate": 0.8})
    whole = {r["user_id"]: r for r in SC.score_table(features, scorer, assumptions(spark)).collect()}
    plain = SC.score_table(features, scorer, assumptions(spark), reasons=False)
    assert "reasons" not in plain.columns
    assert {r["user_id"]: (r["p"], r["expected_net"]) for r in plain.collect()} == {
        u: (r["p"], r["expected_net"]) for u, r in whole.items()
    }
    broken = LinearScorer(0.1, {"n_tx": -0.1, "cancel_rate": 0.8})
    object.__setattr__(broken, "probability", lambda z: F.lit(0.5) + 0 * z)
    object.__setattr__(broken, "score", lambda df, out="p", contributions=True: df.withColumn(out, F.lit(0.4)))
    with pytest.raises(Exception, match="local_accuracy"):
        SC.score_table(features, broken, assumptions(spark)).collect()


def test_row_local_sentences_equal_the_joined_wording(spark, cohort):
    features = build_features(cohort)
    scorer = LinearScorer(0.1, {c: (0.3 if i % 2 else -0.2) for i, c in enumerate(features.columns[2:])})
    rows = features.withColumn("context_values", reasons.context_struct(features))
    top = A.top_contributors(rows, scorer, groups=reasons.GROUPS, k=9, carry=["context_values"])
    joined = reasons.mark_display(reasons.add_reasons(top))
    local = reasons.explain(features, scorer, k=9)
    assert local.columns == joined.columns
    assert sorted(map(str, local.collect())) == sorted(map(str, joined.collect()))
    assert local.count() > 20
    plan = reasons.explain(features, scorer)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_submission_fills_prior_and_is_checked(spark, tmp_path):
    asked = spark.createDataFrame([("a",), ("b",)], "user_id string")
    scored = spark.createDataFrame([("a", 0.3)], "user_id string, p double")
    out = sinks.write_submission(asked, scored, 0.07, str(tmp_path / "sub"))
    assert sorted(map(tuple, out.collect())) == [("a", 0.3), ("b", 0.07)]
    back = spark.read.option("header", True).csv(str(tmp_path / "sub"))
    assert back.columns == ["user_id", "is_churn"] and back.count() == 2
    with pytest.raises(GuardViolation, match="out_of_range"):
        sinks.write_submission(asked, scored, 1.0, str(tmp_path / "bad"))
    with pytest.raises(GuardViolation, match="rows for"):
        sinks.write_submission(asked, scored.union(scored), 0.1, str(tmp_path / "bad2"))


# --- sources, sinks, store --------------------------------------------------


def test_csv_sources_and_member_refusal(spark, tmp_path):
    tx = tmp_path / "tx.csv"
    head = "msno,payment_method_id,payment_plan_days,plan_list_price,actual_amount_paid,is_auto_renew,transaction_date,membership_expire_date,is_cancel"
    tx.write_text(head + "\nu,041,30,149,149,1,20170101,20170131,0\n")
    more = tmp_path / "tx_v2.csv"
    more.write_text(head + "\nu,41,30,149,149,1,20170201,20170228,0\n")
    both = readers.scan_transactions(spark, [str(tx), str(more)])
    assert both.count() == 2 and dict(both.dtypes)["payment_method_id"] == "int"
    text = readers.scan_transactions_str(spark, [str(tx), str(more)])
    assert {r["payment_method_id"] for r in text.collect()} == {"041", "41"}
    members = tmp_path / "members.csv"
    members.write_text("msno,city,bd,gender,registered_via,registration_init_time\nu,1,30,male,7,20150101\n")
    assert readers.read_members(spark, str(members)).first()["user_id"] == "u"
    old = tmp_path / "old.csv"
    old.write_text("msno,city,bd,gender,registered_via,registration_init_time,expiration_date\nu,1,30,male,7,20150101,20170301\n")
    with pytest.raises(ValueError, match="leaks"):
        readers.read_members(spark, str(old))
    labels = tmp_path / "labels.csv"
    labels.write_text("msno,is_churn\nu,0\n")
    assert readers.read_labels(spark, str(labels)).first()["is_churn"] == 0
    assert readers.read_labels(spark, str(labels), labels_are_real=False).first()["is_churn"] is None
    with pytest.raises(ValueError, match="mixed"):
        readers.scan_logs(spark, [str(labels), "x.parquet"])


def test_store_reuses_rebuilds_and_rechecks(spark, tmp_path):
    store = FeatureTableStore(spark, str(tmp_path / "store"))
    built = []

    def build():
        built.append(1)
        return spark.range(3).withColumnRenamed("id", "user_id")

    store.get_or_build("t", {"w": 90}, build)
    store.get_or_build("t", {"w": 90}, build)
    assert len(built) == 1
    store.get_or_build("t", {"w": 60}, build)
    store.get_or_build("t", {"w": 90}, build, columns=["user_id", "new"])
    store.get_or_build("t", {"w": 90}, build, force=True)
    assert len(built) == 4 and params_version({"w": 90}) != params_version({"w": 60})

    def refuse(df):
        raise GuardViolation("no")

    with pytest.raises(GuardViolation):
        store.get_or_build("t", {"w": 90}, build, check=refuse)
    with pytest.raises(GuardViolation):
        store.get_or_build("other", {"w": 90}, build, check=refuse)
    assert store.manifest("other", {"w": 90}) is None


def test_two_builds_have_equal_content(spark):
    src = Sources.demo(spark, SF)
    a = stored_feature_table(FeatureTableStore(spark, staging_root(spark) + "/a"), src, demo.Q2, force=True)
    b = feature_table(src, demo.Q2).repartition(5)
    assert contracts.same_content(a, b)


def test_reports_and_lists_are_written(spark, tmp_path):
    sinks.write_metrics_report(spark, {"log_loss": 0.5}, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().asDict() == {"metric": "log_loss", "value": 0.5}
    wide = spark.createDataFrame([("a", 0.2), ("b", 0.9)], "user_id string, p double")
    sinks.write_offer_list(wide, str(tmp_path / "list"))
    assert [r["user_id"] for r in spark.read.option("header", True).csv(str(tmp_path / "list")).collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        sinks.write_offer_list(wide, str(tmp_path / "x"), fmt="xlsx")


def test_contract_mismatch_is_reported(spark):
    src = Sources.demo(spark, SF)
    measured = contracts.data_contract({"q2": src.labels(demo.Q2)}, src.transactions, src.members)
    contracts.assert_contract(measured, {("labels_q2", "rows"): 44, ("transactions", "rows"): 1500})
    with pytest.raises(GuardViolation):
        contracts.assert_contract(measured, {("labels_q2", "rows"): 45})


def test_streamed_requests_equal_batch(spark, cohort, tmp_path):
    order = [
        *[c for c in build_features(cohort).columns if c not in ("user_id", "is_churn")],
        *log_columns(),
    ]
    req = requests_of(cohort)
    folder = str(tmp_path / "requests")
    req.repartition(2).write.parquet(folder)
    query = score_stream(
        request_stream(spark, folder, req.schema),
        FIXED_SCORER,
        assumptions(spark),
        order,
        out=str(tmp_path / "out"),
        checkpoint=str(tmp_path / "cp"),
    )
    query.awaitTermination(120)
    assert query.exception() is None
    streamed = {r["user_id"]: r["p"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = SC.score_table(SC.rows_to_features(req, order), FIXED_SCORER, assumptions(spark))
    assert streamed == {r["user_id"]: r["p"] for r in batch.collect()}


def test_scores_keep_full_precision(spark):
    """A probability of 3e-7 stays itself through scoring, loss, the submission check and calibration."""
    import math

    from renewlens.operators import calibration as C
    from renewlens.operators.attribution import LinearScorer
    from renewlens.operators.metrics import log_loss

    z = math.log(3e-7 / (1 - 3e-7))
    rows = spark.createDataFrame([("u1", 1, z), ("u2", 0, -z)], "user_id string, is_churn int, x double")
    scored = LinearScorer(0.0, {"x": 1.0}).score(rows)
    p = {r.user_id: r.p for r in scored.collect()}
    assert p["u1"] == pytest.approx(3e-7, rel=1e-9) and p["u2"] == pytest.approx(1 - 3e-7, rel=1e-12)
    assert scored.agg(log_loss()).first()[0] == pytest.approx(-math.log(3e-7), rel=1e-6)
    SC.assert_submission(rows, scored.select("user_id", F.col("p").alias("is_churn")))
    points = [(float(i % 2), 1e-7 * (1 + i)) for i in range(6)] + [(1.0, 1 - 1e-7)]
    fitted = C.fit_isotonic(spark.createDataFrame(points, "is_churn double, p double"))
    assert fitted.n_fit == 7 and len({x for x in fitted.model.boundaries}) > 2


def test_two_requests_of_one_user_stay_two(cohort):
    from renewlens.operators.features import transaction_features

    req = requests_of(cohort.filter("user_id = 'u4'"))
    names = [c for c in transaction_features(cohort).columns if c not in ("user_id", "is_churn")]
    both = SC.rows_to_features(req.unionByName(req), names, with_logs=False)
    assert both.count() == 2
    with pytest.raises(ValueError, match="no requests"):
        SC.rows_to_features(req.filter("false"), names, with_logs=False)


def test_repeated_log_rows_are_refused(spark, cohort):
    from renewlens.operators.features import attach_logs, transaction_features

    logs = spark.createDataFrame([("u1", 20170301, 1.0)] * 2, "user_id string, cutoff int, log_has_logs double")
    with pytest.raises(Exception, match="several log rows"):
        attach_logs(transaction_features(cohort), logs).collect()
