"""Fitted models.

Most queries here use single trees and a logistic model on two 0/1 covariates
and their product.  Three levels of splits, or three coefficients, tell all four
cells apart, so the fits have a closed form (cell means and shares) and the whole
chain of fitting, cross-fitting and scoring can be checked exactly.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from taufold.operators import balance as B
from taufold.operators.bagging import bagged_tree_errors
from taufold.operators.cate import (
    ArmModels,
    EffectForest,
    ForestParams,
    dr_learner,
    grid_points,
    predict_arms,
    residual_targets,
    t_learner,
    tune_forest,
)
from taufold.operators.classify import forest_scores_by_arm, outcome_forest, score_by_arm
from taufold.operators.effect_trees import NuisanceTrees, fit_effect_bags, tune_nested
from taufold.operators.impute import fill, means, modes
from taufold.operators.metrics import classification_report
from taufold.operators.split import train_test_split
from taufold.operators.subgroup import subgroup_table
from taufold.plans import study
from taufold.plans.validate import DRScorer
from taufold.queries.effects import AUC, BLP_TWO, CAL_TWO, VAL, _uplift_sql
from taufold.queries.fixtures import AS_OF, COHORT, SCORED, cohort, hash32_sql, raw_records, scored, uniform_sql
from taufold.queries.registry import query
from taufold.sources import tables as S
from taufold.sources.stage import new_stage_path, stage


def one_tree(depth: int = 3) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="features", numTrees=1, maxDepth=depth, bootstrap=False, subsamplingRate=1.0)


def shares() -> LogisticRegression:
    return LogisticRegression(featuresCol="features", maxIter=200, tol=1e-12)


def units(spark, sf):
    """All units, missing covariates imputed; two 0/1 covariates, their product and the cell they make."""
    kept = ["unit_id", "treatment", "arm", "outcome", "returned", "fold", "weights", "cate"]
    df = stage(scored(spark, sf).select(*kept, "n_lines", "price"), "scored-units")
    df = fill(df, means(df, ["n_lines"], 0) | modes(df, ["returned"]))
    flags = {"many": (F.col("n_lines") >= 4).cast("double"), "dear": (F.col("price") >= DEAR).cast("double")}
    df = df.withColumns(flags).withColumns(
        {
            "both": F.col("many") * F.col("dear"),
            "cell": (F.col("many") + 2 * F.col("dear")).cast("int"),
            "cate2": 0.05 + 0.5 * F.col("cate"),
        }
    )
    cells = VectorAssembler(inputCols=["many", "dear", "both"], outputCol="features").transform(df)
    return cells.select(*kept, "cate2", "cell", "features")


DEAR = 250_000


def _units_sql(fold: str = "fold") -> str:
    return f"""{SCORED},
u AS (SELECT unit_id, treatment, arm, outcome, {fold} AS fold, weights, cate, 0.05 + 0.5 * cate AS cate2,
    coalesce(returned, (SELECT returned FROM scored WHERE returned IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS returned,
    CASE WHEN coalesce(n_lines, (SELECT round_even(avg(n_lines), 0) FROM scored)) >= 4 THEN 1 ELSE 0 END
      + CASE WHEN price >= {DEAR} THEN 2 ELSE 0 END AS cell FROM scored)"""


UNITS = _units_sql()


@query(
    "K1 D3 B6",
    "treatment:i, segment:s, units:i, mean_e:d, ess:d",
    f"""WITH RECURSIVE {COHORT},
    x AS (SELECT treatment AS y, segment, price / 100000 AS a, coalesce(qty, (SELECT avg(qty) FROM cohort)) / 10 AS b FROM cohort),
    it(k, b0, b1, b2) AS (
      SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
      UNION ALL
      SELECT k + 1,
        b0 - (g0 * (h11 * h22 - h12 * h12) - g1 * (h01 * h22 - h12 * h02) + g2 * (h01 * h12 - h11 * h02)) / det,
        b1 - (-g0 * (h01 * h22 - h02 * h12) + g1 * (h00 * h22 - h02 * h02) - g2 * (h00 * h12 - h01 * h02)) / det,
        b2 - (g0 * (h01 * h12 - h02 * h11) - g1 * (h00 * h12 - h02 * h01) + g2 * (h00 * h11 - h01 * h01)) / det
      FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM (
        SELECT k, b0, b1, b2, sum(p - y) AS g0, sum((p - y) * a) + b1 AS g1, sum((p - y) * b) + b2 AS g2,
          sum(p * (1 - p)) AS h00, sum(p * (1 - p) * a) AS h01, sum(p * (1 - p) * b) AS h02,
          sum(p * (1 - p) * a * a) + 1 AS h11, sum(p * (1 - p) * a * b) AS h12, sum(p * (1 - p) * b * b) + 1 AS h22
        FROM (SELECT it.*, x.*, 1 / (1 + exp(-(b0 + b1 * a + b2 * b))) AS p FROM it, x) s GROUP BY k, b0, b1, b2) g) h
      WHERE k < 12),
    e AS (SELECT y AS treatment, segment, 1 / (1 + exp(-(b0 + b1 * a + b2 * b))) AS e FROM x, (SELECT * FROM it WHERE k = 12) f),
    w AS (SELECT *, CASE WHEN treatment = 1 THEN 1 / e ELSE 1 / (1 - e) END AS w FROM e)
    SELECT treatment, segment, count(*) AS units, avg(e) AS mean_e, pow(sum(w), 2) / sum(w * w) AS ess FROM w GROUP BY treatment, segment""",
)
def propensity_weights(spark, sf):
    df = cohort(spark, sf).select("treatment", "segment", (F.col("price") / 100000).alias("a"), (F.col("qty") / 10).alias("b"))
    df = stage(df, "propensity")
    model, values = B.fit_propensity(df, "treatment", ["a", "b"])
    e = B.score_propensity(df, model, values, ["a", "b"])
    w = e.withColumn("w", B.iptw_weight(F.col("treatment"), F.col("e")))
    return w.groupBy("treatment", "segment").agg(
        F.count(F.lit(1)).alias("units"), F.avg("e").alias("mean_e"), B.effective_size(F.col("w")).alias("ess")
    )


@query(
    "A4",
    "unit_id:i, mu:d",
    f"WITH {UNITS} SELECT unit_id, avg(outcome) OVER (PARTITION BY cell) AS mu FROM u",
)
def stored_model(spark, sf):
    df = stage(units(spark, sf).select("unit_id", "outcome", "features"), "units")
    path = new_stage_path(spark, "model")
    S.save_model(one_tree().setLabelCol("outcome").fit(df), path)
    return S.load_model(path).transform(df).select("unit_id", F.col("prediction").alias("mu"))


def _nuisance_sql(rest: str, arms: tuple[str, ...] = ("1", "2"), cate: tuple[str, ...] = ("cate", "cate2")) -> str:
    """Means and shares of all units that satisfy ``rest`` (f: unit scored, o: other unit), and the scores."""
    return f"""keys AS (SELECT DISTINCT fold AS kf, cell AS km FROM u),
    nu AS (SELECT kf, km,
        avg(outcome) FILTER (arm = 0) AS m0, avg(outcome) FILTER (arm = 1) AS m1, avg(outcome) FILTER (arm = 2) AS m2,
        avg(CASE WHEN arm = 0 THEN 1.0 ELSE 0.0 END) AS q0, avg(CASE WHEN arm = 1 THEN 1.0 ELSE 0.0 END) AS q1,
        avg(CASE WHEN arm = 2 THEN 1.0 ELSE 0.0 END) AS q2
      FROM keys JOIN u ON cell = km AND {rest} GROUP BY kf, km),
    sc AS (SELECT u.*, m1 + (CASE WHEN arm = 1 THEN 1 ELSE 0 END) / greatest(q1, 0.01) * (outcome - m1) - base AS dr1,
        m2 + (CASE WHEN arm = 2 THEN 1 ELSE 0 END) / greatest(q2, 0.01) * (outcome - m2) - base AS dr2
      FROM (SELECT u.*, nu.*, m0 + (CASE WHEN arm = 0 THEN 1 ELSE 0 END) / greatest(q0, 0.01) * (outcome - m0) AS base
        FROM u JOIN nu ON kf = fold AND km = cell) u),
    long AS (SELECT unit_id, fold, {arms[0]} AS arm, {cate[0]} AS cate, dr1 AS dr FROM sc
      UNION ALL SELECT unit_id, fold, {arms[1]}, {cate[1]}, dr2 FROM sc)"""


MEAN_EFFECTS = """SELECT arm, count(dr) AS n, avg(dr) AS ate, stddev_pop(dr) / sqrt(count(dr)) AS se_pop,
      stddev_samp(dr) / sqrt(count(dr)) AS se_samp FROM long GROUP BY arm"""


def scorer(fold: str | None = None) -> DRScorer:
    return DRScorer(one_tree(), shares(), ("cate", "cate2"), fold=fold)


@query(
    "K6 K9 K4",
    "arm:i, n:i, ate:d, se_pop:d, se_samp:d",
    f"WITH {UNITS}, {_nuisance_sql('fold <> kf')} {MEAN_EFFECTS}",
)
def cross_fitted_effects(spark, sf):
    return scorer(fold="fold").fit(units(spark, sf), "unit_id", "arm", "outcome").average_effect()


@query(
    "K6 K4 K9",
    "arm:i, n:i, ate:d, se_pop:d, se_samp:d",
    f"""WITH {_units_sql(f'(row_number() OVER (PARTITION BY arm ORDER BY {hash32_sql(123, "unit_id")}, unit_id) - 1) % 5')},
    {_nuisance_sql('fold <> kf')} {MEAN_EFFECTS}""",
)
def stratified_cross_fit(spark, sf):
    return scorer().fit(units(spark, sf), "unit_id", "arm", "outcome").average_effect()


def _tests_sql(nuisances: str) -> str:
    return f"""WITH {UNITS}, {nuisances}, {VAL}, {BLP_TWO}, {CAL_TWO}, {_uplift_sql("qini")}, {_uplift_sql("toc")}
    SELECT treatment, round_even(blp_est, 3) AS blp_est, round_even(blp_se, 3) AS blp_se, round_even(blp_pval, 3) AS blp_pval,
      round_even(q.est, 3) AS qini_est, round_even(q.se, 3) AS qini_se, round_even(q.pval, 3) AS qini_pval, round_even(t.est, 3) AS autoc_est,
      round_even(t.se, 3) AS autoc_se, round_even(t.pval, 3) AS autoc_pval, round_even(cal_r_squared, 3) AS cal_r_squared
    FROM blp_p JOIN qini_coef q USING (treatment) JOIN toc_coef t USING (treatment) JOIN cal USING (treatment)"""


TESTS = "blp_est:d, blp_se:d, blp_pval:d, qini_est:d, qini_se:d, qini_pval:d, autoc_est:d, autoc_se:d, autoc_pval:d, cal_r_squared:d"


@query(
    "K7 K9 K24 K16 K19 K20 K21 F3",
    f"treatment:i, {TESTS}",
    _tests_sql(_nuisance_sql("fold <> 0")),
)
def validated_effects(spark, sf):
    df = units(spark, sf)
    train, val = df.filter("fold <> 0"), df.filter("fold = 0")
    return scorer().fit(val, "unit_id", "arm", "outcome", train).evaluate_all()


@query(
    "K9 K24 K10 K12 K16 K19 K20 K21",
    f"treatment:s, {TESTS}",
    _tests_sql(_nuisance_sql("fold <> 0", ("'arm 1'", "'arm 2'"), ("m1 - m0", "m2 - m0"))),
)
def text_arm_tests(spark, sf):
    """Arms named by text, effects from a fitted estimator."""
    df = stage(units(spark, sf).withColumn("arm", F.concat(F.lit("arm "), "arm")), "units")
    train, val = df.filter("fold <> 0"), df.filter("fold = 0")
    learner = ArmModels(t_learner(train, "arm", "outcome", ["arm 0", "arm 1", "arm 2"], one_tree()))
    return DRScorer(one_tree(), shares(), learner).fit(val, "unit_id", "arm", "outcome", train).evaluate_all()


def _targets_sql() -> str:
    """Cross-fitted weighted means and shares on three hash folds, then target and weight of each unit."""
    return f"""f3 AS (SELECT *, {hash32_sql(42, "unit_id")} % 3 AS f FROM u),
    nu AS (SELECT k.f AS kf, k.cell AS km, sum(o.outcome * o.weights) / sum(o.weights) AS m, sum(o.treatment * o.weights) / sum(o.weights) AS e
      FROM (SELECT DISTINCT f, cell FROM f3) k JOIN f3 o ON o.cell = k.cell AND o.f <> k.f GROUP BY k.f, k.cell),
    tg AS (SELECT f3.*, (outcome - m) / (treatment - e) AS t, weights * pow(treatment - e, 2) AS w FROM f3 JOIN nu ON kf = f AND km = cell)"""


def targets(spark, sf):
    return residual_targets(units(spark, sf), "unit_id", "treatment", "outcome", one_tree(), shares(), weight="weights")


ONE_TREE = ForestParams(num_trees=1, min_leaf=1, max_depth=3, sample_share=1.0)


@query(
    "K10",
    "unit_id:i, cate:d",
    f"WITH {UNITS}, {_targets_sql()} SELECT unit_id, sum(t * w) OVER (PARTITION BY cell) / sum(w) OVER (PARTITION BY cell) AS cate FROM tg",
)
def residual_forest(spark, sf):
    t = stage(targets(spark, sf), "targets")
    return EffectForest.fit(t, "unit_id", ONE_TREE).effect(t.select("unit_id", "features"))


@query(
    "K11",
    "cell:i, cate:d, cate_lower:d, cate_upper:d",
    f"""WITH {UNITS}, {_targets_sql()},
    full_ AS (SELECT cell, sum(t * w) / sum(w) AS cate FROM tg GROUP BY cell),
    half AS (SELECT cell, g, sum(t * w) / sum(w) AS c FROM tg, range(4) r(g)
      WHERE CAST('0x' || substr(md5(CAST(43 + g AS VARCHAR) || ':' || CAST(unit_id AS VARCHAR)), 1, 8) AS BIGINT) % 2 = 0 GROUP BY cell, g),
    s AS (SELECT cell, stddev_samp(c) AS sd FROM half GROUP BY cell)
    SELECT cell, cate, cate - 1.96 * sd AS cate_lower, cate + 1.96 * sd AS cate_upper FROM full_ JOIN s USING (cell)""",
)
def forest_limits(spark, sf):
    t = stage(targets(spark, sf), "targets")
    forest = EffectForest.fit(t, "unit_id", ONE_TREE, groups=4)
    return forest.effect_interval(t.select("cell", "features").distinct())


@query(
    "K5 K27 K4",
    "loss:s, point:i, max_depth:i, score:d",
    f"""WITH {UNITS}, {_targets_sql()}, c AS (SELECT *, {hash32_sql(43, "unit_id")} % 5 AS cv FROM tg),
    fit AS (SELECT k.cv AS kc, k.cell AS km, sum(o.t * o.w) / sum(o.w) AS cate
      FROM (SELECT DISTINCT cv, cell FROM c) k JOIN c o ON o.cell = k.cell AND o.cv <> k.cv GROUP BY k.cv, k.cell),
    root AS (SELECT k.cv AS kc, sum(o.t * o.w) / sum(o.w) AS cate FROM (SELECT DISTINCT cv FROM c) k JOIN c o ON o.cv <> k.cv GROUP BY k.cv),
    x AS (SELECT c.* EXCLUDE (cate), 0 AS point, 3 AS max_depth, fit.cate AS cate_hat FROM c JOIN fit ON kc = cv AND km = cell
      UNION ALL SELECT c.* EXCLUDE (cate), 1, 0, root.cate FROM c JOIN root ON kc = cv),
    l AS (SELECT point, max_depth, cv, avg(pow(outcome - cate_hat * treatment, 2)) AS proxy, sum(w * pow(t - cate_hat, 2)) / count(*) AS residual
      FROM x GROUP BY point, max_depth, cv)
    SELECT 'proxy' AS loss, point, max_depth, avg(proxy) AS score FROM l GROUP BY point, max_depth
    UNION ALL SELECT 'residual', point, max_depth, avg(residual) FROM l GROUP BY point, max_depth""",
)
def forest_tuning(spark, sf):
    t = stage(targets(spark, sf), "targets")
    grid = [ForestParams(num_trees=1, min_leaf=1, max_depth=d, sample_share=1.0) for d in (3, 0)]
    parts = [
        tune_forest(t, "unit_id", "treatment", "outcome", grid, loss=loss).withColumn("loss", F.lit(loss))
        for loss in ("proxy", "residual")
    ]
    return parts[0].unionByName(parts[1])


#: Trees of a forest; the grid's own number is 1,000, which SQL would have to draw unit by unit.
GRID_TREES = 4


@query(
    "K5 K6 K10 K27 K4",
    "point:i, num_trees:i, min_leaf:i, max_depth:i, sample_share:d, score:d",
    f"""WITH {UNITS}, c AS (SELECT unit_id, cell, treatment AS t, outcome AS y,
      {hash32_sql(43, "unit_id")} % 5 AS cv, {hash32_sql(44, "unit_id")} % 3 AS nf FROM u),
    f AS (SELECT unnest(range(5)) AS f),
    nu AS (SELECT f, g, cell, avg(y) AS m, avg(t) AS e FROM c, f, (SELECT unnest(range(3)) AS g) WHERE cv <> f AND nf <> g GROUP BY f, g, cell),
    r AS (SELECT c.*, f, y - m AS ry, t - e AS rt FROM c JOIN nu ON g = nf AND nu.cell = c.cell WHERE cv <> f),
    d AS (SELECT r.*, share, j FROM r, (SELECT unnest([0.3, 0.5]) AS share), (SELECT unnest(range({GRID_TREES})) AS j)
      WHERE {uniform_sql(42, "'e' || j || ':' || unit_id")} < share),
    leaf AS (SELECT share, f, j, cell, sum(ry * rt) / sum(rt * rt) AS effect FROM d GROUP BY share, f, j, cell),
    forest AS (SELECT share, f, cell, avg(effect) AS effect FROM leaf GROUP BY share, f, cell),
    l AS (SELECT share, cv, avg(pow(y - effect * t, 2)) AS mse FROM c JOIN forest ON f = cv AND forest.cell = c.cell GROUP BY share, cv),
    s AS (SELECT share, avg(mse) AS score FROM l GROUP BY share)
    SELECT row_number() OVER (ORDER BY min_leaf, max_depth, share) - 1 AS point, {GRID_TREES} AS num_trees, min_leaf, max_depth, share AS sample_share, score
    FROM s, (SELECT unnest([3, 5, 9]) AS min_leaf), (SELECT unnest([2, 3, 5]) AS max_depth)""",
)
def forest_grid(spark, sf):
    """All points of the grid, nuisances refitted in every tuning fold; two 0/1 covariates, so two levels tell all cells apart."""
    df = units(spark, sf).withColumn("flags", F.slice(vector_to_array("features"), 1, 2))
    points = [replace(p, num_trees=GRID_TREES) for p in grid_points()]
    return tune_nested(df, "unit_id", "treatment", "outcome", points, features="flags", nuisance=NuisanceTrees(1, 3, 1))


@query(
    "K10 K12",
    "unit_id:i, t_effect:d, dr_effect:d",
    f"""WITH {UNITS}, {_nuisance_sql('fold <> kf')},
    m AS (SELECT cell, avg(outcome) FILTER (arm = 1) - avg(outcome) FILTER (arm = 0) AS t_effect FROM u GROUP BY cell),
    d AS (SELECT cell, avg(dr1) AS dr_effect FROM sc GROUP BY cell)
    SELECT unit_id, t_effect, dr_effect FROM u JOIN m USING (cell) JOIN d USING (cell)""",
)
def learner_effects(spark, sf):
    df = stage(units(spark, sf), "units")
    by_arm = predict_arms(df.select("unit_id", "features"), t_learner(df, "arm", "outcome", [0, 1], one_tree()), "mu")
    scores = scorer(fold="fold").fit(df, "unit_id", "arm", "outcome").val.filter("arm = 1")
    long = scores.select("unit_id", "arm", "dr").join(df.select("unit_id", "features"), "unit_id")
    both = predict_arms(by_arm, dr_learner(long, one_tree()), "dr")
    return both.select("unit_id", (F.col("mu1") - F.col("mu0")).alias("t_effect"), F.col("dr1").alias("dr_effect"))


REPORT = """c AS (SELECT count(*) FILTER (outcome = 1 AND score >= 0.5)::DOUBLE AS tp, count(*) FILTER (outcome = 0 AND score >= 0.5) AS fp,
      count(*) FILTER (outcome = 1 AND score < 0.5) AS fn, count(*) FILTER (outcome = 0 AND score < 0.5) AS tn FROM s)
    SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
      2 * tp / (2 * tp + fp + fn) AS f1, roc_auc FROM c, auc"""


@query(
    "K28 K29 C24",
    "accuracy:d, precision:d, recall:d, f1:d, roc_auc:d",
    f"""WITH {UNITS}, s AS (SELECT returned AS outcome, avg(returned) OVER (PARTITION BY treatment, cell) AS score FROM u), {AUC},
    {REPORT}""",
)
def arm_classifiers(spark, sf):
    df = stage(units(spark, sf).select("unit_id", "treatment", "returned", "features"), "units")
    scored_units = score_by_arm(df, df, "treatment", "returned", one_tree())
    return classification_report(stage(scored_units.select("returned", "score"), "scores"), "returned", "score")


@query(
    "K28 K29",
    "accuracy:d, precision:d, recall:d, f1:d, roc_auc:d",
    f"""WITH {UNITS}, h AS (SELECT treatment, cell, returned, {uniform_sql(42, "unit_id")} >= 0.2 AS in_train FROM u),
    leaf AS (SELECT treatment, cell, avg(returned) AS score FROM h WHERE in_train GROUP BY treatment, cell),
    s AS (SELECT returned AS outcome, score FROM h JOIN leaf USING (treatment, cell) WHERE NOT in_train), {AUC},
    {REPORT}""",
)
def arm_forests(spark, sf):
    train, test = train_test_split(stage(units(spark, sf), "units"), "unit_id")
    forest = outcome_forest(trees=1, depth=3, bootstrap=False, per_split="all")
    scored_units = score_by_arm(train, test, "treatment", "returned", forest)
    return classification_report(stage(scored_units.select("returned", "score"), "scores"), "returned", "score")


def _poisson_sql(u: str) -> str:
    total, term, cases = 0.0, 0.0, []
    for k in range(13):
        term = 0.36787944117144233 if k == 0 else term / k
        total += term
        cases.append(f"(CASE WHEN {u} >= {total!r}::DOUBLE THEN 1 ELSE 0 END)")
    return " + ".join(cases)


FOREST_TREES = 10


@query(
    "K28 K29 C24",
    "accuracy:d, precision:d, recall:d, f1:d, roc_auc:d",
    f"""WITH {UNITS}, h AS (SELECT unit_id, treatment, cell, returned, {uniform_sql(42, "unit_id")} >= 0.2 AS in_train FROM u),
    dr_ AS (SELECT h.*, j, {uniform_sql(42, "j || ':' || unit_id")} AS un FROM h, (SELECT unnest(range({FOREST_TREES})) AS j) WHERE in_train),
    d AS (SELECT *, {_poisson_sql("un")} AS drawn FROM dr_),
    leaf AS (SELECT treatment, cell, j, sum(drawn * returned) / sum(drawn) AS p FROM d GROUP BY treatment, cell, j),
    forest AS (SELECT treatment, cell, avg(p) AS score FROM leaf GROUP BY treatment, cell),
    s AS (SELECT returned AS outcome, score FROM h JOIN forest USING (treatment, cell) WHERE NOT in_train), {AUC},
    {REPORT}""",
)
def bootstrapped_arm_forests(spark, sf):
    df = stage(units(spark, sf).withColumn("flags", F.slice(vector_to_array("features"), 1, 2)).drop("features"), "units")
    train, test = train_test_split(df, "unit_id")
    found = forest_scores_by_arm(train, test, "unit_id", "treatment", "returned", trees=FOREST_TREES, depth=2, features="flags")
    return classification_report(stage(found.select("returned", "score"), "scores"), "returned", "score")


BAGS, BAG_SIZE = 20, 2


@query(
    "K10 K11 K12",
    "unit_id:i, cate:d, cate_lower:d, cate_upper:d",
    f"""WITH {UNITS}, c AS (SELECT unit_id, cell, treatment AS t, outcome AS y, {hash32_sql(44, "unit_id")} % 3 AS nf FROM u),
    nu AS (SELECT g, cell, avg(y) AS m, avg(t) AS e FROM c, (SELECT unnest(range(3)) AS g) WHERE nf <> g GROUP BY g, cell),
    r AS (SELECT c.*, y - m AS ry, t - e AS rt FROM c JOIN nu ON g = nf AND nu.cell = c.cell),
    d AS (SELECT r.*, j, j // {BAG_SIZE} AS bag FROM r, (SELECT unnest(range({BAGS * BAG_SIZE})) AS j)
      WHERE {uniform_sql(42, f"'g' || (j // {BAG_SIZE}) || ':' || unit_id")} < 0.5 AND {uniform_sql(42, "'e' || j || ':' || unit_id")} < 0.8),
    leaf AS (SELECT cell, bag, j, sum(ry * rt) / sum(rt * rt) AS effect FROM d GROUP BY cell, bag, j),
    b AS (SELECT cell, bag, avg(effect) AS mean, var_samp(effect) AS noise FROM leaf GROUP BY cell, bag),
    f AS (SELECT cell, avg(mean) AS cate, 1.96 * sqrt(greatest(var_samp(mean) - avg(noise) / {BAG_SIZE}, 0)) AS reach FROM b GROUP BY cell)
    SELECT unit_id, f.cate AS cate, f.cate - reach AS cate_lower, f.cate + reach AS cate_upper FROM u JOIN f USING (cell)""",
)
def little_bag_limits(spark, sf):
    df = units(spark, sf).select("unit_id", "treatment", "outcome", F.slice(vector_to_array("features"), 1, 2).alias("features"))
    params = ForestParams(num_trees=BAGS * BAG_SIZE, min_leaf=1, max_depth=2, sample_share=0.4)
    bags = fit_effect_bags(df, "unit_id", "treatment", "outcome", params, BAG_SIZE, nuisance=NuisanceTrees(1, 3, 1))
    return bags.effect_interval(df)


ROUNDS = 200


@query(
    "K26 E5",
    "round:i, oob_error:d, test_error:d",
    f"""WITH {UNITS}, s AS (SELECT unit_id, cell, returned AS y, {uniform_sql(42, "unit_id")} >= 0.2 AS in_train FROM u),
    dr_ AS (SELECT s.*, round, {uniform_sql(42, "round || ':' || unit_id")} AS un FROM s, range(1, {ROUNDS + 1}) r(round) WHERE in_train),
    d AS (SELECT *, {_poisson_sql("un")} AS drawn FROM dr_),
    leaf AS (SELECT round, cell, CASE WHEN 2 * sum(drawn * y) > sum(drawn) THEN 1 ELSE 0 END AS pred FROM d GROUP BY round, cell),
    v AS (SELECT unit_id, round, y, pred FROM d JOIN leaf USING (round, cell) WHERE drawn = 0),
    c AS (SELECT *, sum(pred) OVER w AS ones, count(*) OVER w AS votes FROM v WINDOW w AS (PARTITION BY unit_id ORDER BY round)),
    oob AS (SELECT round, avg(CASE WHEN (CASE WHEN 2 * ones > votes THEN 1 ELSE 0 END) <> y THEN 1.0 ELSE 0.0 END) AS oob_error FROM c GROUP BY round),
    t AS (SELECT round, avg(CASE WHEN pred <> y THEN 1.0 ELSE 0.0 END) AS test_error FROM s JOIN leaf USING (cell) WHERE NOT in_train GROUP BY round)
    SELECT * FROM oob JOIN t USING (round)""",
)
def bagged_trees(spark, sf):
    train, test = train_test_split(stage(units(spark, sf), "units"), "unit_id")
    return bagged_tree_errors(train, test, "unit_id", "returned", rounds=ROUNDS, max_depth=3)


@query(
    "K1 K2 K3 K5 K10 K11 K13 F2 E8 G8",
    "subgroup_var:s, subgroup_value:s, mean:d, sd:d, n:i, z_sd:d, p_value:d, significant:b",
)
def estimated_effects(spark, sf):
    table_, roles = study.prepare(raw_records(spark, sf), AS_OF)
    grid = [ForestParams(num_trees=10, min_leaf=m, max_depth=2, sample_share=0.3) for m in (3, 5)]
    small = RandomForestRegressor(featuresCol="features", numTrees=10, maxDepth=4, seed=42)
    found = study.estimate(table_, roles, grid=grid, smd_limit=0.005, interval_groups=2, outcome_model=small)
    return subgroup_table(found.scored_test, roles.subgroups)
