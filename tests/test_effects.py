"""Effect operators against small numpy re-derivations and planted effects."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from taufold.operators import calibration as C
from taufold.operators import linear as O
from taufold.operators import uplift as U
from taufold.operators.bagging import bagged_tree_errors
from taufold.operators.cate import EffectForest, ForestParams, grid_points, residual_targets
from taufold.operators.dr import arm_positions, average_effect, dr_long
from taufold.plans.estimate import attach_weights, weigh_units
from taufold.plans.validate import DRScorer, Validation
from taufold.roles import Roles


def frame(spark, columns):
    names = list(columns)
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in zip(*columns.values())]
    return spark.createDataFrame(rows, names)


# --- doubly-robust scores ------------------------------------------------------------------


def test_dr_clips_small_propensities(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0, 0.2, 0.5), (0, 1.0, 1.0, 0.2, 0.5)], "d int, y double, e double, m0 double, m1 double")
    long = dr_long(df.withColumn("e0", 1 - F.col("e")), "y", "d", [0, 1], ["m0", "m1"], ["e0", "e"])
    got = [r["dr"] for r in long.collect()]
    assert got == pytest.approx([0.5 + 0.5 / 0.01 - 0.2, 0.5 - (0.2 + 0.8 / 0.01)])


def test_missing_nuisances_give_no_score(spark):
    df = spark.createDataFrame([(1, 1.0, None, 0.2)], "d int, y double, e double, m double")
    assert dr_long(df, "y", "d", [0, 1], ["m", "m"], ["e", "e"]).first()["dr"] is None


def test_arms_need_not_be_consecutive(spark):
    rng = np.random.default_rng(4)
    n = 3000
    arm = rng.choice([3, 5, 9], n)
    x = rng.normal(size=n)
    y = x + np.select([arm == 5, arm == 9], [1.0, 2.0], 0.0) + 0.1 * rng.normal(size=n)
    df = frame(spark, {"unit_id": np.arange(n), "arm": arm, "x": x, "y": y, "c5": x * 0 + x, "c9": x})
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    assert arm_positions(df, "arm") == [3, 5, 9]
    scorer = DRScorer(LinearRegression(), LogisticRegression(), ("c5", "c9"))
    got = {r["arm"]: r["ate"] for r in scorer.fit(df, "unit_id", "arm", "y").average_effect().collect()}
    assert got == {5: pytest.approx(1.0, abs=0.05), 9: pytest.approx(2.0, abs=0.05)}


def test_mean_score_is_the_effect(spark):
    long = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "arm int, dr double")
    got = {r["arm"]: (r["ate"], r["se_pop"], r["se_samp"]) for r in average_effect(long).collect()}
    assert got[1] == pytest.approx((2.0, 1 / math.sqrt(2), 1.0))
    assert got[2] == (5.0, 0.0, None)


# --- least squares -------------------------------------------------------------------------


def hc3(design, y):
    pinv = np.linalg.pinv(design)
    beta = pinv @ y
    hat = np.einsum("ij,ji->i", design, pinv)
    e = (y - design @ beta) / (1 - hat)
    return beta, np.sqrt(np.diag(pinv @ np.diag(e**2) @ pinv.T))


def test_hc3_with_different_scales(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) * [1, 1e-3, 1e5]
    y = x @ [2.0, 500.0, 1e-5] + rng.normal(size=400) * (1 + np.abs(x[:, 0]))
    df = frame(spark, {"y": y, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}).repartition(5)
    fit = O.fit_ols(df, "y", ["a", "b", "c"])
    beta, se = hc3(np.column_stack([np.ones(400), x]), y)
    assert fit.estimate == pytest.approx(beta, rel=1e-8)
    assert fit.std_error == pytest.approx(se, rel=1e-8)


def test_hc3_with_all_levels_and_a_constant(spark):
    rng = np.random.default_rng(2)
    level = rng.integers(0, 4, 300)
    flags = (level[:, None] == np.arange(4)).astype(float)
    x = rng.normal(size=300)
    y = x + level + rng.normal(size=300)
    df = frame(spark, {"y": y, "x": x, **{f"f{i}": flags[:, i] for i in range(4)}})
    fit = O.fit_ols(df, "y", ["x", "f0", "f1", "f2", "f3"])
    beta, se = hc3(np.column_stack([np.ones(300), x, flags]), y)
    assert fit.estimate == pytest.approx(beta, rel=1e-8)
    assert fit.std_error == pytest.approx(se, rel=1e-8)


def test_contrasts_of_dependent_columns(spark):
    rng = np.random.default_rng(4)
    level = rng.integers(0, 3, 500)
    flags = (level[:, None] == np.arange(3)).astype(float)
    y = 1e6 + level + rng.normal(size=500)
    df = frame(spark, {"y": y, **{f"f_{i}": flags[:, i] for i in range(3)}, "none": np.zeros(500)}).repartition(20)
    fit = O.fit_ols(df, "y", ["f_0", "f_1", "f_2", "none"])
    wanted = O.level_contrasts({"f_0": "f", "f_1": "f", "f_2": "f"}) | {"alone": {"f_1": 1.0}, "zero": {"none": 1.0}, "mean": {"const": 1.0, "f_2": 1.0}}
    got = {r["contrast"]: (r["estimate"], r["std_error"]) for r in fit.contrasts(df, wanted).collect()}
    means = [y[level == i].mean() for i in range(3)]
    spread = [((y[level == i] - means[i]) ** 2).sum() / (1 - 1 / (level == i).sum()) ** 2 / (level == i).sum() ** 2 for i in range(3)]
    assert got["f_1 - f_0"] == pytest.approx((means[1] - means[0], math.sqrt(spread[0] + spread[1])), rel=1e-6)
    assert got["f_2 - f_0"] == pytest.approx((means[2] - means[0], math.sqrt(spread[0] + spread[2])), rel=1e-6)
    assert got["mean"] == pytest.approx((means[2], math.sqrt(spread[2])), rel=1e-6)
    assert got["alone"] == got["zero"] == (None, None)


def test_nearly_dependent_columns_keep_their_rank(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=300)
    b = a + 1e-6 * rng.normal(size=300)  # cross products would lose the difference
    y = a + rng.normal(size=300)
    fit = O.fit_ols(frame(spark, {"y": y, "a": a, "b": b}), "y", ["a", "b"])
    beta, se = hc3(np.column_stack([np.ones(300), a, b]), y)
    assert fit.undetermined.shape[1] == 0
    assert fit.estimate == pytest.approx(beta, rel=1e-6)
    assert fit.std_error == pytest.approx(se, rel=1e-6)


def test_more_terms_than_units(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 40))
    y = rng.normal(size=30)
    names = [f"x{i}" for i in range(40)]
    df = frame(spark, {"y": y, **{c: x[:, i] for i, c in enumerate(names)}}).repartition(3)
    fit = O.fit_ols(df, "y", names)
    assert fit.estimate == pytest.approx(np.linalg.pinv(np.column_stack([np.ones(30), x])) @ y, rel=1e-6, abs=1e-9)
    with pytest.raises(ValueError, match="no units"):
        O.fit_ols(df.filter("false"), "y", names)


def test_plain_and_hc1_errors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    y = 0.5 * x + rng.normal(size=200)
    df = frame(spark, {"arm": np.ones(200, int), "dr": y, "cate": x})
    design = np.column_stack([np.ones(200), x])
    inverse = np.linalg.inv(design.T @ design)
    e = y - design @ inverse @ design.T @ y
    plain = math.sqrt(e @ e / 198 * inverse[1, 1])
    hc1 = math.sqrt((200 / 198 * inverse @ (design.T * e**2) @ design @ inverse)[1, 1])
    assert O.effect_slopes(df, robust=False).first()["se"] == pytest.approx(plain)
    assert O.effect_slopes(df, robust=True).first()["se"] == pytest.approx(hc1)
    assert O.fit_ols(df, "dr", ["cate"], robust="plain").std_error[1] == pytest.approx(plain)
    assert O.fit_ols(df, "dr", ["cate"], robust="HC1").std_error[1] == pytest.approx(hc1)


def test_constant_prediction_has_no_slope(spark):
    df = spark.createDataFrame([(1, 1.0, 0.5), (1, 2.0, 0.5), (1, 4.0, 0.5)], "arm int, dr double, cate double")
    for n_arms in (1, 2):
        row = O.blp_test(df, n_arms).first()
        assert row["blp_est"] is None and row["blp_se"] is None and row["blp_pval"] is None


def test_projection_roll_up(spark):
    rows = [("const", 9.0, 9.0, 0.0), ("g_a", 1.0, 0.1, 0.2), ("g_b", 3.0, 0.3, 0.0001), ("x", 5.0, 1.0, 0.5), ("z", 1.0, 1.0, 0.9)]
    table = spark.createDataFrame(rows, "term string, estimate double, std_error double, p_value double")
    got = {r["covariate"]: tuple(r)[1:] for r in O.projection_by_covariate(table, {"g_a": "g", "g_b": "g", "x": "x"}).collect()}
    assert got["g"] == (2.0, pytest.approx(0.2), 0.0001, "***")
    assert set(got) == {"g", "x", "Other"}


# --- uplift --------------------------------------------------------------------------------


def direct_uplift(train, cate, dr, percentiles, metric):
    """Unit by threshold influence matrix, as the definition reads."""
    qs = np.percentile(train, percentiles)
    n, ate = len(dr), dr.mean()
    inside = qs[:, None] <= cate[None, :]
    p = inside.mean(axis=1)
    gain = np.array([dr[i].mean() for i in inside]) - ate
    if metric == "qini":
        value, weight = p * gain, inside - p[:, None]
    else:
        value, weight = gain, inside / p[:, None] - 1
    psi = (dr - ate) * weight - value[:, None]
    steps = np.diff(percentiles) / 100
    area = psi[:-1].T @ steps
    return value, np.sqrt((psi**2).mean(axis=1) / n), (value[:-1] * steps).sum(), math.sqrt((area**2).mean() / n)


@pytest.fixture(scope="module")
def uplift_data(spark):
    rng = np.random.default_rng(8)
    train = np.round(rng.normal(size=900), 2)
    cate = np.round(rng.normal(size=700), 2)
    dr = 0.4 * cate + rng.normal(size=700)
    one = np.ones(700, int)
    return train, cate, dr, frame(spark, {"arm": np.ones(900, int), "cate": train}), frame(spark, {"arm": one, "cate": cate, "dr": dr})


@pytest.mark.parametrize("metric", U.METRICS)
def test_uplift_against_the_definition(spark, uplift_data, metric):
    train, cate, dr, train_df, val_df = uplift_data
    percentiles = [5 + 90 * i / 49 for i in range(50)]
    value, err, area, area_err = direct_uplift(train, cate, dr, np.array(percentiles), metric)
    moments = U.bucket_moments(val_df, U.thresholds(train_df))
    curve = U.uplift_curve(moments, metric=metric).orderBy(F.desc("pct_treated")).collect()
    assert [r["value"] for r in curve] == pytest.approx(value, abs=1e-12)
    assert [r["err"] for r in curve] == pytest.approx(err, abs=1e-12)
    row = U.uplift_coefficient(moments, metric=metric).first()
    assert (row["est"], row["se"]) == pytest.approx((area, area_err), abs=1e-12)
    assert row["pval"] == pytest.approx(0.5 * math.erfc(abs(area / area_err) / math.sqrt(2)))


def test_bands_have_the_right_law(spark, uplift_data):
    train, cate, dr, train_df, val_df = uplift_data
    moments = U.bucket_moments(val_df, U.thresholds(train_df))
    row = U.uniform_bands(moments, metric="toc", replicates=4000, seed=1).first()
    qs = np.percentile(train, U.PERCENTILES)
    inside = qs[:, None] <= cate[None, :]
    value = np.array([dr[i].mean() for i in inside]) - dr.mean()
    psi = (dr - dr.mean()) * (inside / inside.mean(axis=1, keepdims=True) - 1) - value[:, None]
    err = np.sqrt((psi**2).mean(axis=1) / len(dr))
    draws = (psi / err[:, None]) @ np.random.default_rng(0).normal(size=(700, 4000)) / 700
    assert row["crit_two_sided"] == pytest.approx(np.percentile(np.abs(draws).max(axis=0), 95), abs=0.1)
    assert row["crit_one_sided"] == pytest.approx(abs(np.percentile(draws.min(axis=0), 5)), abs=0.1)


def test_threshold_above_every_prediction(spark):
    val = spark.createDataFrame([(1, 0.1, 1.0), (1, 0.2, 2.0)], "arm int, cate double, dr double")
    moments = U.bucket_moments(val, {1: [0.15, 5.0]})
    got = [(r["value"], r["err"]) for r in U.uplift_curve(moments, [10, 90], "toc").orderBy(F.desc("pct_treated")).collect()]
    assert got[0][0] == pytest.approx(0.5)
    assert got[1] == (None, None)
    first = U.uplift_coefficient(U.bucket_moments(val, {1: [5.0, 6.0]}), [10, 90], "toc").first()
    assert first["est"] is None and first["se"] is None and first["pval"] is None


def test_qini_is_share_times_toc(spark, uplift_data):
    _, cate, _, train_df, val_df = uplift_data
    cuts = U.thresholds(train_df)
    moments = U.bucket_moments(val_df, cuts)
    both = U.uplift_curve(moments, metric="qini").withColumnRenamed("value", "q").join(
        U.uplift_curve(moments, metric="toc").drop("err"), ["arm", "pct_treated"]
    )
    shares = {round(100 - p, 6): (cate >= q).mean() for p, q in zip(U.PERCENTILES, cuts[1])}
    for r in both.collect():
        assert r["q"] == pytest.approx(shares[round(r["pct_treated"], 6)] * r["value"], abs=1e-12)


def test_error_bars(spark):
    curve = spark.createDataFrame([(1.0, 0.5, 2.0, 3.0)], "value double, err double, crit_two_sided double, crit_one_sided double")
    reach = {k: U.with_error_bars(curve, k).first() for k in (None, "ucb2", "ucb1")}
    assert reach[None]["upper"] == pytest.approx(1.98) and reach["ucb2"]["lower"] == 0.0
    assert (reach["ucb1"]["lower"], reach["ucb1"]["upper"]) == (-0.5, 1.0)
    with pytest.raises(ValueError, match="invalid error type"):
        U.with_error_bars(curve, "x")
    with pytest.raises(ValueError, match="unsupported metric"):
        U.uplift_curve(curve, metric="auc")


# --- calibration ---------------------------------------------------------------------------


def test_calibration_counts_inner_cuts_twice(spark):
    val = spark.createDataFrame([(1, c, d) for c, d in ((0.0, 1.0), (1.0, 3.0), (2.0, 2.0), (9.0, 7.0))], "arm int, cate double, dr double")
    got = {r["ind"]: r for r in C.calibration_groups(val, {1: [0.0, 1.0, 2.0]}).collect()}
    assert [got[i]["prob"] for i in (0, 1)] == [0.5, 0.5]
    assert [got[i]["gate"] for i in (0, 1)] == [2.0, 2.5]
    assert got[0]["se_gate"] == pytest.approx(np.std([1.0, 3.0]) / math.sqrt(2))


def test_empty_calibration_group_gives_no_score(spark):
    val = spark.createDataFrame([(1, 0.5, 1.0)], "arm int, cate double, dr double")
    groups = C.calibration_groups(val, {1: [0.0, 1.0, 2.0]})
    assert groups.count() == 2
    assert C.calibration_score(groups).first()["cal_r_squared"] is None


def test_calibration_line_matches_numpy(spark):
    rng = np.random.default_rng(6)
    n = 1500
    cate, t = rng.normal(size=n), rng.integers(0, 2, n)
    y = cate * t + rng.normal(size=n)
    bins = C.calibration_bins(frame(spark, {"cate": cate, "t": t, "y": y}), "cate", "t", "y", 5)
    got = {r["coefficient"]: r for r in C.calibration_regression(bins).collect()}
    cuts = np.quantile(cate, [0.2, 0.4, 0.6, 0.8])
    group = np.searchsorted(cuts, cate, side="left")
    gate = [y[(group == b) & (t == 1)].mean() - y[(group == b) & (t == 0)].mean() for b in range(5)]
    beta, se = hc3(np.column_stack([np.ones(5), [cate[group == b].mean() for b in range(5)]]), np.array(gate))
    assert [got[k]["estimate"] for k in (C.CONSTANT, C.MEAN_PREDICTION)] == pytest.approx(beta)
    assert [got[k]["std_error"] for k in (C.CONSTANT, C.MEAN_PREDICTION)] == pytest.approx(se)
    assert got[C.DIFFERENCE]["degenerate"] and got[C.DIFFERENCE]["estimate"] is None


def test_calibration_needs_two_bins(spark):
    df = spark.createDataFrame([(0.1, 1, 1.0), (0.1, 0, 0.0), (0.1, 1, 0.0), (0.1, 0, 1.0)], "cate double, t int, y double")
    with pytest.raises(ValueError, match="two usable bins"):
        C.calibration_regression(C.calibration_bins(df, "cate", "t", "y", 5))


# --- validation ----------------------------------------------------------------------------


def test_tests_need_training_units(spark):
    val = spark.createDataFrame([(1, 1, 0.1, 0.2)], "unit_id int, arm int, dr double, cate double")
    with pytest.raises(ValueError, match="scored training units"):
        Validation((0, 1), val).calibration()


def test_scorer_needs_one_prediction_per_arm(spark):
    df = spark.createDataFrame([(1, 0), (2, 1)], "unit_id int, t int")
    with pytest.raises(ValueError, match="one prediction column"):
        DRScorer(LinearRegression(), LogisticRegression(), ()).fit(df, "unit_id", "t", "t")


@pytest.fixture(scope="module")
def planted(spark):
    """Effect 1.5 for x > 0 and 0 otherwise; treatment depends on the second covariate."""
    rng = np.random.default_rng(11)
    n = 6000
    x, z = rng.normal(size=n), rng.normal(size=n)
    t = (rng.random(n) < 1 / (1 + np.exp(-0.7 * z))).astype(int)
    tau = 1.5 * (x > 0)
    y = 0.5 * z + tau * t + 0.5 * rng.normal(size=n)
    df = frame(spark, {"unit_id": np.arange(n), "x": x, "z": z, "t": t, "y": y, "tau": tau, "w": np.ones(n)})
    return VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(df)


def test_effect_forest_finds_the_planted_effect(spark, planted):
    small = RandomForestRegressor(featuresCol="features", numTrees=10, maxDepth=5, seed=1)
    targets = residual_targets(planted, "unit_id", "t", "y", small, LogisticRegression(featuresCol="features"), weight="w")
    forest = EffectForest.fit(targets, "unit_id", ForestParams(num_trees=20, max_depth=4, min_leaf=20), groups=4)
    got = forest.effect_interval(planted).toPandas()
    assert np.corrcoef(got["cate"], got["tau"])[0, 1] > 0.95
    assert got.loc[got["tau"] > 0, "cate"].mean() == pytest.approx(1.5, abs=0.15)
    assert (got["cate_lower"] <= got["cate"]).all() and (got["cate"] <= got["cate_upper"]).all()


def test_validation_accepts_the_planted_effect(spark, planted):
    scorer = DRScorer(
        RandomForestRegressor(featuresCol="features", numTrees=10, maxDepth=5, seed=1), LogisticRegression(featuresCol="features"), ("tau",)
    )
    train, val = planted.filter("unit_id % 2 = 0"), planted.filter("unit_id % 2 = 1")
    fitted = scorer.fit(val, "unit_id", "t", "y", train)
    assert fitted.average_effect().first()["ate"] == pytest.approx(0.75, abs=0.1)
    row = fitted.blp().first()
    assert row["blp_est"] == pytest.approx(1.0, abs=0.1) and row["blp_pval"] < 1e-6
    coefficients, curve = fitted.uplift("qini", replicates=50)
    assert coefficients.first()["pval"] < 1e-6
    assert curve.count() == 50


def test_single_arm_summary_joins(spark, planted):
    scorer = DRScorer(LinearRegression(), LogisticRegression(), ("x",))
    train, val = planted.filter("unit_id % 2 = 0"), planted.filter("unit_id % 2 = 1")
    rows = scorer.fit(val, "unit_id", "t", "y", train).evaluate_all().collect()
    assert len(rows) == 1 and rows[0]["treatment"] == 1 and rows[0]["autoc_est"] > 0


def test_bagging_errors_fall(spark, planted):
    df = planted.withColumn("label", (F.col("x") + F.col("z") > 0).cast("int"))
    train, test = df.filter("unit_id % 5 > 0"), df.filter("unit_id % 5 = 0")
    got = bagged_tree_errors(train, test, "unit_id", "label", rounds=25, max_depth=4).collect()
    assert [r["round"] for r in got] == list(range(1, 26))
    assert got[-1]["oob_error"] < got[0]["oob_error"] < 0.25
    again = bagged_tree_errors(train.repartition(3), test, "unit_id", "label", rounds=1, max_depth=4).first()
    assert again["oob_error"] == pytest.approx(got[0]["oob_error"], abs=0.02)


def test_weights_follow_the_imbalance(spark, planted):
    roles = Roles(treatment="t", outcome="y", numeric=("x", "z"))
    weights = weigh_units(planted, roles)
    joined = attach_weights(planted.drop("w"), weights, roles)
    assert 0.98 < joined.count() / planted.count() < 1
    # Dropping the largest weights leaves some of the imbalance.
    before, after = [
        d.groupBy("t").agg((F.sum(F.col("z") * w) / F.sum(w)).alias("m")).orderBy("t").collect()
        for d, w in ((planted, F.lit(1.0)), (joined, F.col("weights")))
    ]
    assert abs(after[1]["m"] - after[0]["m"]) < 0.3 * abs(before[1]["m"] - before[0]["m"])
    with pytest.raises(ValueError, match="no covariate"):
        weigh_units(planted, roles, smd_limit=10)


def test_grid_has_all_points():
    points = grid_points()
    assert len(points) == 18 and len(set(points)) == 18


def test_roles(spark):
    df = spark.createDataFrame([(1, 0, 1, 2.0, 1)], "unit_id int, treatment int, outcome int, n double, flag int")
    roles = Roles(numeric=("n",)).infer_covariates(df)
    assert roles.covariates == ("n", "flag")
    with pytest.raises(ValueError, match="not in the table"):
        Roles(numeric=("missing",)).check(df)
