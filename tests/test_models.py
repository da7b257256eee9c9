import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from renewlens.operators import compiled as C
from renewlens.operators import encode
from renewlens.operators import experiments as X
from renewlens.operators import models as M
from renewlens.operators.attribution import assert_local_accuracy
from renewlens.operators.cohort import COHORTS
from renewlens.operators.compiled import compile_scorer
from renewlens.operators.guards import GuardViolation
from renewlens.plans import catalog, jobs
from renewlens.plans import queries_models as QM
from renewlens.operators.decision import BusinessParams

FEATURES = ("signal", "noise", "gappy")
FAST = {"maxIter": 3, "maxDepth": 2}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for i in range(240):
        y = i % 2
        seg = ("train", "train", "train", "es", "sel", "cal")[(i // 2) % 6]
        gappy = None if rng.random() < 0.3 else float(y) + rng.gauss(0, 2)
        data.append((f"u{i}", y, y + rng.gauss(0, 0.7), rng.gauss(0, 1), gappy, seg))
    return spark.createDataFrame(
        data, "user_id string, is_churn int, signal double, noise double, gappy double, segment string"
    ).cache()


@pytest.fixture(scope="module")
def boosted(rows):
    return M.fit_scorer(rows, FEATURES, params=FAST)


def test_scores_are_probabilities_and_nulls_are_kept(rows, boosted):
    out = boosted.predict(rows)
    assert out.filter("p is null or p < 0 or p > 1").count() == 0
    assert out.filter("gappy is null").count() == rows.filter("gappy is null").count() > 0
    assert set(out.columns) == {*rows.columns, "p"}


def test_importance_finds_the_signal_and_keeps_zeros(spark, boosted):
    table = {r["feature"]: r for r in boosted.importance(spark).collect()}
    assert set(table) == set(FEATURES)
    assert max(table, key=lambda f: table[f]["gain"]) == "signal"
    assert sum(r["gain_share"] for r in table.values()) == pytest.approx(1.0)


def test_validation_rows_do_not_change_the_fit(rows, boosted):
    other = rows.withColumn(
        "is_churn", F.when(F.col("segment").isin("sel", "cal"), 1 - F.col("is_churn")).otherwise(F.col("is_churn"))
    )
    again = M.fit_scorer(other, FEATURES, params=FAST)
    a = boosted.predict(rows).orderBy("user_id").select("p").collect()
    assert a == again.predict(rows).orderBy("user_id").select("p").collect()


def test_ensemble_is_the_mean(rows):
    parts = [
        M.fit_scorer(rows, FEATURES, family=f, params=p)
        for f, p in (("forest", {"numTrees": 3, "maxDepth": 2}), ("logistic", {"maxIter": 5}))
    ]
    out = M.mean_ensemble(rows, parts).first()
    assert out["p_ensemble"] == pytest.approx((out["p_forest"] + out["p_logistic"]) / 2)


@pytest.mark.parametrize("family,params", [("forest", {"numTrees": 3, "maxDepth": 2}), ("logistic", {"maxIter": 5})])
def test_fitted_models_score_after_a_table_was_observed(rows, family, params):
    seen = Observation("before the fit")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 240
    fitted = M.fit_scorer(rows, FEATURES, family=family, params=params)
    assert fitted.predict(rows).filter("p between 0 and 1").count() == 240
    assert fitted.rounds > 0 and max(M.gains(fitted), key=M.gains(fitted).get) == "signal"


def test_logistic_model_explains_itself_exactly(rows):
    fitted = M.fit_scorer(rows, FEATURES, family="logistic", params={"maxIter": 20})
    scorer = M.linear_scorer(fitted, rows.filter("segment = 'train'"))
    assert assert_local_accuracy(fitted.predict(rows), scorer) < 1e-6
    with pytest.raises(ValueError):
        M.linear_scorer(M.Fitted("gbt", fitted.model, FEATURES, 1), rows)


def test_permuted_labels_keep_the_rate_and_lose_the_link(rows):
    out = M.permuted_labels(rows, 3).collect()
    assert len(out) == 240 and all(r["side0"] == r["is_churn"] for r in out)
    for k in (1, 2, 3):
        assert sum(r[f"side{k}"] for r in out) == 120
        assert 90 < sum(r[f"side{k}"] == r["side0"] for r in out) < 150
    again = M.permuted_labels(rows.repartition(7), 3).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_steps_are_primes_that_do_not_divide_the_rows():
    first = M.run_steps(10, 3)
    assert first == [1000003, 1000033, 1000037] and M.run_steps(1000033 * 2, 2) == [1000003, 1000037]


def test_histogram_gains_are_the_explained_variance(rows):
    import numpy as np

    got = {(r["feature"], r["run"]): r["gain"] for r in M.histogram_gains(rows, ["signal", "gappy"], 2).collect()}
    out = M.permuted_labels(rows, 2).collect()
    for f in ("signal", "gappy"):
        x = np.array([np.nan if r[f] is None else r[f] for r in out])
        edges = np.unique(np.quantile(x[~np.isnan(x)], np.arange(1, 10) / 10))
        bins = np.where(np.isnan(x), -1, np.searchsorted(edges, x, side="right"))
        for run in range(3):
            y = np.array([r[f"side{run}"] for r in out], float)
            want = sum((bins == b).mean() * (y[bins == b].mean() - y.mean()) ** 2 for b in set(bins))
            assert got[f, run] == pytest.approx(want, abs=1e-10)
    assert got["signal", 0] > 5 * max(got["signal", 1], got["signal", 2])


def test_null_importance_keeps_only_signal(rows):
    actual, null = M.null_importance(rows, FEATURES, rounds=3, n_runs=3)
    kept = [r["feature"] for r in X.keep_features(actual, null, 100).collect()]
    assert "signal" in kept and null.count() == 9


def counted_assemblies(monkeypatch):
    seen, plain = [], M.prepare_matrix
    monkeypatch.setattr(M, "prepare_matrix", lambda df, inputs: seen.append(1) or plain(df, inputs))
    return seen


def test_label_permutations_share_one_assembled_table(rows, monkeypatch):
    seen = counted_assemblies(monkeypatch)
    _, null = M.null_importance(rows, FEATURES, rounds=2, n_runs=3)
    assert len(seen) == 2  # the labels' own fit and all permutations
    label = M.permuted_labels(rows, 3).select("user_id", *FEATURES, F.col("side2").alias("is_churn"))
    alone = M.gains(M.fit_scorer(label, FEATURES, params={"maxIter": 2}, fixed_rounds=True))
    got = {r["feature"]: r["gain"] for r in null.filter("run = 2").collect()}
    assert got == pytest.approx(alone)


def test_folds_share_one_assembled_table_while_their_levels_agree(rows, monkeypatch):
    name = "last_payment_method_id"
    # fold 2 alone holds code 9: without it the training rows have other levels
    folds = rows.select(
        "*", F.expr("cast(substr(user_id, 2) as int) % 3 as fold"), F.expr("cast(substr(user_id, 2) as int) % 2 as code")
    ).withColumn(name, F.expr("case when fold = 2 then 9 else code end")).drop("code")
    features = [*FEATURES, name]
    want = {}
    for k in range(3):
        fitted = M.fit_scorer(folds.filter(f"fold <> {k}"), features, params=FAST, fixed_rounds=True)
        want[k] = M.evaluate(fitted, folds.filter(f"fold = {k}"))
    seen = counted_assemblies(monkeypatch)
    got = {r["fold"]: r["log_loss"] for r in M.cv_variance(folds, features, params=FAST).collect()}
    assert got == pytest.approx(want) and len(seen) == 2


def test_encodings_stand_in_one_table_and_lose_what_single_fits_lose(rows, monkeypatch):
    name = jobs.ENCODED_COLUMN
    coded = rows.withColumn(name, F.expr("case when noise < -1 then null else cast(noise * 2 as int) end"))
    features = [*FEATURES, name]
    late = coded.drop("segment").withColumn("signal", F.col("signal") + 0.1)
    train, others = coded.filter("segment = 'train'"), coded.filter("segment <> 'train'")
    want = {}
    for label, source, column in (
        ("native", None, None), ("oof", train, name), ("naive", train, name),
        ("naive_user", train, "user_id"), ("naive_user_presplit", coded, "user_id"),
    ):
        data, last, cols = coded, late, features
        if column:
            table = encode.target_encode_fit(source, column)
            first = encode.target_encode_oof(train, column).drop("fold") if label == "oof" else encode.target_encode_apply(train, table, column)
            data = first.unionByName(encode.target_encode_apply(others, table, column))
            last, cols = encode.target_encode_apply(late, table, column), [c for c in features if c != column] + [f"{column}_te"]
        fitted = M.fit_scorer(data, cols, params=FAST)
        want[label] = (fitted.rounds, M.evaluate(fitted, data.filter("segment = 'sel'")), M.evaluate(fitted, last))
    assemblies, levels, stored = counted_assemblies(monkeypatch), [], []
    plain, store = M.training_levels, jobs.stage
    monkeypatch.setattr(M, "training_levels", lambda df, names: levels.append(1) or plain(df, names))
    monkeypatch.setattr(jobs, "stage", lambda df, what: stored.append(what) or store(df, what))
    out = jobs.target_encoding_experiment(coded.select("user_id", "is_churn", *features, "segment"), late.select("user_id", "is_churn", *features), params=FAST)
    got = {r["label"]: (r["rounds"], r["sel_log_loss"], r["valid_log_loss"]) for r in out.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    # per fit one table for training and selection rows and one for the later cohort
    assert len(levels) == 1 and len(assemblies) == 10 and stored.count("encoded") == stored.count("late") == 1


def test_bundle_round_trip_and_refusals(spark, rows, boosted, tmp_path):
    meta = jobs.bundle_metadata(
        COHORTS["feb_t7"],
        COHORTS["mar_t7"],
        train_churn_rate=0.06,
        ltv_saved=2000.0,
        params=BusinessParams(),
        model_params=FAST,
    )
    path = str(tmp_path / "bundle")
    M.save_bundle(boosted, path, meta, spark)
    bundle = M.load_bundle(path, spark)
    assert bundle.deployable and bundle.p_star == pytest.approx(0.5)
    assert M.round_trip_check(boosted, path, rows) == 0.0
    bundle.check(rows.select("user_id", "is_churn", *FEATURES))
    with pytest.raises(GuardViolation):
        bundle.check(rows.select("user_id", "is_churn", *FEATURES[::-1]))
    with pytest.raises(KeyError):
        M.save_bundle(boosted, path, {"params": {}}, spark)
    broken = {**meta, "cohort": {"train": "x"}}
    with pytest.raises(KeyError, match="cutoff_definition"):
        M.save_bundle(boosted, path, broken, spark)
    with pytest.raises(FileNotFoundError):
        M.load_bundle(str(tmp_path / "none"), spark)
    with pytest.raises(GuardViolation):
        jobs.bundle_metadata(
            COHORTS["mar_fixed"], COHORTS["apr_fixed"], train_churn_rate=0.1, ltv_saved=1.0,
            params=BusinessParams(), model_params={},
        )


def test_parameter_draws_stay_in_range():
    space = {
        "a": {"type": "loguniform", "low": 0.01, "high": 1},
        "b": {"type": "int", "low": 2, "high": 5},
        "c": {"type": "uniform", "low": 0, "high": 1},
    }
    rng = random.Random(0)
    for _ in range(50):
        d = M.sample_params(rng, space)
        assert 0.01 <= d["a"] <= 1 and d["b"] in range(2, 6) and 0 <= d["c"] <= 1
    with pytest.raises(ValueError):
        M.sample_params(rng, {"x": {"type": "other", "low": 0, "high": 1}})


# --- reading runs -----------------------------------------------------------


def runs(spark, *rows):
    return spark.createDataFrame(rows, "seed int, model string, log_loss double")


def test_paired_comparison(spark):
    table = runs(spark, *[(s, "a", 0.15 + s * 0.01) for s in range(8)], *[(s, "b", 0.153 + s * 0.01 + (s % 2) * 1e-4) for s in range(8)])
    r = X.multi_seed_paired(table).first()
    assert (r["model_a"], r["n_seeds"], r["a_wins"], r["b_wins"], r["verdict"]) == ("a", 8, 8, 0, "trusted")
    assert r["hi"] - r["mean_diff"] == pytest.approx(2.364624251592784 * r["sigma"] / 8**0.5)
    close = runs(spark, (1, "a", 0.1), (2, "a", 0.2), (1, "b", 0.2), (2, "b", 0.1))
    assert X.multi_seed_paired(close).first()["verdict"] == "undecided"


def test_swap_verdicts(spark):
    def d(*losses):
        return spark.createDataFrame(list(zip("abc", losses)), "model string, log_loss double")

    got = {
        (r["model_a"], r["model_b"]): r["verdict"]
        for r in X.reverse_validation(d(0.1, 0.2, 0.1001), d(0.3, 0.4, 0.3001)).collect()
    }
    assert got == {("a", "b"): "trusted", ("a", "c"): "noise", ("b", "c"): "trusted"}
    flipped = X.reverse_validation(d(0.1, 0.2, 0.3), d(0.3, 0.2, 0.1)).collect()
    assert {r["verdict"] for r in flipped} == {"doubtful"}


def test_fold_arms_resolution(spark):
    def arm(*v):
        return spark.createDataFrame([(float(x),) for x in v], "log_loss double")

    r = X.grouped_vs_random(arm(0.150, 0.152), arm(0.1501, 0.1521)).first()
    assert r["below_resolution"] and r["absolute"] == pytest.approx(-1e-4)
    assert not X.grouped_vs_random(arm(0.10, 0.11), arm(0.2, 0.21)).first()["below_resolution"]


def test_rank_agreement_averages_only_known_ranks(spark):
    def imp(**g):
        return spark.createDataFrame(list(g.items()), "feature string, gain double")

    got = {r["feature"]: r["mean_rank"] for r in X.rank_agreement({"m": imp(a=3.0, b=2.0), "n": imp(b=9.0)}).collect()}
    assert got == {"a": 1.0, "b": 1.5}


def test_only_compliant_encodings_may_win(spark):
    table = spark.createDataFrame(
        [("native", True, 0.2), ("oof", True, 0.19), ("naive", False, 0.1)],
        "label string, compliant boolean, valid_log_loss double",
    )
    assert [r["label"] for r in X.encoding_variants_report(table).filter("best_compliant").collect()] == ["oof"]


def test_t_quantiles():
    """Table values of Student's t, and the expansion beyond the table."""
    from renewlens.operators.experiments import t_critical

    known = {1: 12.7062, 2: 4.3027, 9: 2.2622, 11: 2.2010, 17: 2.1098, 25: 2.0595, 60: 2.0003, 120: 1.9799}
    assert {k: round(t_critical(k), 4) for k in known} == known


def test_critical_values_have_no_holes(spark):
    from renewlens.operators.experiments import t_critical, t_critical_column

    rows = spark.range(1, 200).select("id", t_critical_column(F.col("id")).alias("t")).collect()
    assert all(abs(r.t - t_critical(r.id)) < 1e-5 for r in rows)


@pytest.fixture(scope="module")
def coded(spark):
    """Rows whose label depends on a category: codes 3, 11 and 20 churn, 5 and 8 do not."""
    rng = random.Random(5)
    data = []
    for i in range(600):
        city = rng.choice([3, 5, 8, 11, 20, None])
        y = int(rng.random() < (0.85 if city in (3, 11, 20) else 0.2))
        seg = ("train", "train", "train", "es", "sel", "cal")[i % 6]
        data.append((f"u{i}", y, rng.gauss(0, 1), None if i % 7 == 0 else rng.gauss(y, 2), city, seg))
    return spark.createDataFrame(
        data, "user_id string, is_churn int, noise double, gappy double, city int, segment string"
    ).cache()


CODED = ("noise", "gappy", "city")


def recoded(df):
    codes = F.create_map(*[F.lit(x) for x in (3, 8, 5, 20, 8, 3, 11, 5, 20, 11)])
    return df.withColumn("city", codes[F.col("city")])


@pytest.mark.parametrize("family", M.FAMILIES)
def test_renamed_categories_change_nothing(coded, family):
    params = {"gbt": {"maxIter": 4, "maxDepth": 3}, "forest": {"numTrees": 4, "maxDepth": 3, "seed": 1}}.get(family)
    a = M.fit_scorer(coded, CODED, family=family, params=params)
    b = M.fit_scorer(recoded(coded), CODED, family=family, params=params)
    assert a.levels == {"city": (3, 5, 8, 11, 20)}
    assert M.gains(a) == pytest.approx(M.gains(b)) and M.gains(a)["city"] > 0
    p = {r.user_id: r.p for r in a.predict(coded).collect()}
    assert p == pytest.approx({r.user_id: r.p for r in b.predict(recoded(coded)).collect()})


def test_levels_are_the_training_rows_and_unseen_codes_are_scored(spark, coded):
    held = coded.withColumn("city", F.when(F.col("segment") == "sel", 99).otherwise(F.col("city")))
    fitted = M.fit_scorer(held, CODED, params=FAST)
    assert fitted.levels["city"] == (3, 5, 8, 11, 20)
    assert fitted.predict(held).filter("p is null").count() == 0


@pytest.mark.parametrize("family", M.FAMILIES)
def test_compiled_scorers_equal_their_models(spark, coded, family, tmp_path):
    params = {"gbt": {"maxIter": 5, "maxDepth": 4}, "forest": {"numTrees": 5, "maxDepth": 4, "seed": 1}}.get(family)
    fitted = M.fit_scorer(coded, CODED, family=family, params=params)
    meta = jobs.bundle_metadata(
        COHORTS["feb_t7"], COHORTS["mar_t7"], train_churn_rate=0.1, ltv_saved=600.0, params=BusinessParams(), model_params={}
    )
    M.save_bundle(fitted, str(tmp_path / "b"), meta, spark)
    scorer = compile_scorer(M.load_bundle(str(tmp_path / "b"), spark).fitted)
    odd = coded.withColumn("city", F.when(F.col("user_id") == "u3", 77).otherwise(F.col("city")))
    both = scorer.score(fitted.predict(odd, "q"))
    gap = both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0]
    assert gap <= 1e-12
    assert_local_accuracy(both, scorer, tolerance=1e-9)
    plan = scorer.score(odd, contributions=False)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "UDF" not in plan
    with pytest.raises(GuardViolation, match="order"):
        scorer.score(odd.select("user_id", "noise", "city", "gappy"))


def test_tree_contributions_are_shapley_values_by_definition(spark):
    """All coalitions of one tree, with training shares for the features left out."""
    import itertools
    import math

    leaf = lambda n, v: C.Node(n, v)
    a2 = C.Node(30, 0.0, "a", "`a` <= 2.0D", leaf(10, 5.0), leaf(20, -1.0))
    b = C.Node(70, 0.0, "b", "`b` <= 0.0D", leaf(30, 2.0), leaf(40, 0.5))

    root = C.Node(100, 0.0, "a", "`a` <= 1.0D", b, a2)
    scorer = C.CompiledScorer("t", ("a", "b", "c"), "logit", C._expected(root), (root,), (1.0,))

    def value(node, row, known):
        if node.left is None:
            return node.value
        limit = float(node.test.split()[-1][:-1])
        if node.feature in known:
            return value(node.left if row[node.feature] <= limit else node.right, row, known)
        return sum(c.rows * value(c, row, known) for c in (node.left, node.right)) / node.rows

    rows = [dict(a=x, b=y, c=0.0) for x in (0.5, 1.5, 3.0) for y in (-1.0, 1.0)]
    got = scorer.score(spark.createDataFrame([tuple(r.values()) for r in rows], "a double, b double, c double")).collect()
    for r, g in zip(rows, got):
        for f, other in (("a", "b"), ("b", "a")):
            want = sum(
                math.factorial(n) * math.factorial(1 - n) / 2 * (value(root, r, {*k, f}) - value(root, r, {*k}))
                for n in (0, 1)
                for k in itertools.combinations([other], n)
            )
            assert g[f"shap__{f}"] == pytest.approx(want)


def grown(rng, depth, rows, limits):
    """A tree whose every way down has ``depth`` tests."""
    if depth == 0 or rows < 2:
        return C.Node(rows, rng.gauss(0, 1))
    f = rng.choice(sorted(limits))
    lo, hi = limits[f]
    at = rng.uniform(lo, hi)
    n = max(1, min(rows - 1, int(rows * rng.uniform(0.2, 0.8))))
    left, right = (grown(rng, depth - 1, k, {**limits, f: b}) for k, b in ((n, (lo, at)), (rows - n, (at, hi))))
    return C.Node(rows, 0.0, f, f"`{f}` <= {at!r}D", left, right)


def chain(rng, splits, rows, features):
    f, at = rng.choice(features), rng.uniform(0, 1)
    leaf = C.Node(rows // 3, rng.gauss(0, 1))
    rest = C.Node(rows - rows // 3, rng.gauss(0, 1)) if splits == 1 else chain(rng, splits - 1, rows - rows // 3 + 40, features)
    return C.Node(leaf.rows + rest.rows, 0.0, f, f"`{f}` <= {at!r}D", *((leaf, rest) if rng.random() < 0.5 else (rest, leaf)))


@pytest.mark.parametrize("shape", ["full 6", "full 8", "chain 70"])
def test_large_trees_are_explained_by_definition(spark, shape):
    """Trees of more than 31 splits were scored without contributions; F1."""
    import itertools
    import math

    rng, names = random.Random(len(shape)), ("a", "b", "c", "d")
    kind, size = shape.split()
    if kind == "full":
        root = grown(rng, int(size), 1_000_000, dict.fromkeys(names, (0.0, 1.0)))
    else:
        root = chain(rng, int(size), 1000, names)
    assert C._splits(root) >= 63
    weight = 0.7
    scorer = C.CompiledScorer("t", names, "identity", weight * C._expected(root), (root,), (weight,))

    def value(node, row, known):
        if node.left is None:
            return node.value
        limit = float(node.test.split()[-1][:-1])
        if node.feature in known:
            return value(node.left if row[node.feature] <= limit else node.right, row, known)
        return sum(c.rows * value(c, row, known) for c in (node.left, node.right)) / node.rows

    rows = [{f: rng.random() for f in names} for _ in range(6)]
    got = scorer.score(spark.createDataFrame([tuple(r.values()) for r in rows], "a double, b double, c double, d double")).collect()
    for r, g in zip(rows, got, strict=True):
        assert g["p"] == pytest.approx(weight * value(root, r, set(names)), abs=1e-12)
        of = {k: value(root, r, set(k)) for n in range(5) for k in itertools.combinations(names, n)}
        for f in names:
            others = [x for x in names if x != f]
            want = sum(
                math.factorial(n) * math.factorial(3 - n) / 24 * (of[tuple(sorted((*k, f)))] - of[k])
                for n in range(4)
                for k in itertools.combinations(others, n)
            )
            assert g[f"shap__{f}"] == pytest.approx(weight * want, abs=1e-12)


def test_score_bundle_stores_whole_decisions_of_all_families(spark, monkeypatch):
    """Forests had no contributions, the stream no reasons, and the batch dropped its own; F1."""
    stored, streamed = [], []

    def stage(df, name="stage", f=QM.stage):
        out = f(df, name)
        if name == "batch":
            stored.append(out)
        return out

    def stream(*args, f=QM.score_stream, **options):
        streamed.append(options["out"])
        return f(*args, **options)

    monkeypatch.setattr(QM, "stage", stage)
    monkeypatch.setattr(QM, "score_stream", stream)
    got = {r.family: tuple(r)[1:] for r in catalog.QUERIES["score_bundle"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(M.FAMILIES) and len({r[0] for r in got.values()}) == 1
    assert {r[1:] for r in got.values()} == {(1, 1, 1)}
    for batch, path in zip(stored, streamed, strict=True):
        stream = spark.read.parquet(path)
        assert batch.count() == stream.count() == got["forest"][0]
        assert batch.filter(F.size("reasons") > 0).count() > 0
        told = [df.select("user_id", F.col("reasons.reason").alias("r"), F.col("suppressed.reason").alias("s")) for df in (batch, stream)]
        assert told[0].exceptAll(told[1]).count() == 0
    assert len(stored) == len(M.FAMILIES)


def test_indicators_compare_one_code_each(spark):
    """The text of all indicators grew with the square of the levels; beyond some thirty the plan was not compiled."""
    codes = list(range(-3, 400, 7))
    levels = tuple(c for c in codes if c != M.MISSING_CATEGORY)
    inputs = M.model_inputs("logistic", ["code"], {"code": levels})
    assert len(inputs) == len(levels) + 1 and all(len(x.sql) < 100 for x in inputs)
    df = spark.createDataFrame([(c,) for c in [*codes, None, M.MISSING_CATEGORY, 10_000]], "code int")
    at = F.expr(M.level_number("code", levels))
    wrong = [F.sum((F.expr(x.sql) != (at == float(i)).cast("double")).cast("int")) for i, x in enumerate(inputs)]
    assert set(df.agg(*wrong).first()) == {0}
