"""Balance, weights, doubly-robust scores and effect tests on closed-form scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from taufold.functions.numeric import normal_tail
from taufold.operators import balance as B
from taufold.operators import calibration as C
from taufold.operators import linear as O
from taufold.operators import uplift as U
from taufold.operators.bagging import vote_errors
from taufold.operators.cate import arm_effect, proxy_score
from taufold.operators.dr import average_effect
from taufold.operators.metrics import classification_report, roc_auc, threshold_metrics
from taufold.operators.subgroup import subgroup_error_bars, subgroup_table
from taufold.plans.validate import combined_summary
from taufold.queries.fixtures import (
    COHORT,
    ONE_ARM,
    SCORED,
    TWO_ARMS,
    cohort,
    one_arm,
    scored,
    table,
    tail_sql,
    train_val,
    two_arms,
    uniform_sql,
)
from taufold.queries.registry import query
from taufold.sources.stage import stage


def _smd_sql(column: str) -> str:
    return f"""SELECT '{column}' AS covariate, abs(avg({column}) FILTER (treatment = 1) - avg({column}) FILTER (treatment = 0))
      / sqrt((var_samp({column}) FILTER (treatment = 1) + var_samp({column}) FILTER (treatment = 0)) / 2) AS smd FROM cohort"""


def _share_gap_sql(name: str, condition: str) -> str:
    return f"""SELECT '{name}' AS covariate, abs(avg(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END) FILTER (treatment = 1)
      - avg(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END) FILTER (treatment = 0)) AS smd FROM cohort"""


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SMD_SQL = "\nUNION ALL ".join(
    [_smd_sql(c) for c in ("price", "bal", "qty", "n_lines")]
    + [_share_gap_sql(f"segment_{s}", f"segment = '{s}'") for s in SEGMENTS]
)


@query("G8 E4 H6", "covariate:s, smd:d", f"WITH {COHORT} {SMD_SQL}")
def smd_balance(spark, sf):
    from taufold.operators.encode import one_hot

    numeric = ["price", "bal", "qty", "n_lines"]
    df = one_hot(cohort(spark, sf).select("treatment", *numeric, "segment"), ["segment"], known={"segment": SEGMENTS})
    return B.smd_table(df, "treatment", numeric, [f"segment_{s}" for s in SEGMENTS])


@query(
    "G8 B6",
    "covariate:s, smd:d",
    f"WITH {COHORT} SELECT * FROM ({SMD_SQL}) s WHERE smd > 0.005",
)
def imbalanced_covariates(spark, sf):
    return B.imbalanced(smd_balance(spark, sf), 0.005)


@query("K2", "unit_id:i, weights:d", f"WITH {SCORED} SELECT unit_id, weights FROM scored")
def iptw_weights(spark, sf):
    return scored(spark, sf).select("unit_id", "weights")


@query(
    "G9 G10 G11 K2 B6 S8",
    "stage:s, n:i, mean:d, sd:d, min:d, max:d, ess:d",
    f"""WITH {SCORED}, kept AS (SELECT * FROM scored WHERE weights <= (SELECT quantile_cont(weights, 0.99) FROM scored))
    SELECT 'all' AS stage, count(weights) AS n, avg(weights) AS mean, stddev_pop(weights) AS sd, min(weights) AS min, max(weights) AS max,
      pow(sum(weights), 2) / sum(weights * weights) AS ess FROM scored
    UNION ALL SELECT 'trimmed', count(weights), avg(weights), stddev_samp(weights), min(weights), max(weights),
      pow(sum(weights), 2) / sum(weights * weights) FROM kept""",
)
def weight_summaries(spark, sf):
    df = stage(scored(spark, sf).select("weights"), "weights")
    before = B.weight_summary(df, "weights").withColumn("stage", F.lit("all"))
    after = B.weight_summary(B.trim_weights(df, "weights"), "weights", sample_sd=True).withColumn("stage", F.lit("trimmed"))
    return before.unionByName(after)


@query(
    "K2 G11",
    "unit_id:i, weights:d",
    f"WITH {SCORED} SELECT unit_id, least(weights, (SELECT quantile_cont(weights, 0.99) FROM scored)) AS weights FROM scored",
)
def capped_weights(spark, sf):
    return B.trim_weights(scored(spark, sf).select("unit_id", "weights"), "weights", cap=True)


@query("K8", "unit_id:i, arm:i, dr:d, cate:d", f"WITH {ONE_ARM} SELECT * FROM long")
def dr_scores(spark, sf):
    return one_arm(spark, sf)


@query("K8 K12", "unit_id:i, arm:i, dr:d, cate:d", f"WITH {TWO_ARMS} SELECT * FROM long")
def dr_scores_two_arms(spark, sf):
    return two_arms(spark, sf)


@query(
    "K9 G12",
    "arm:i, n:i, ate:d, se_pop:d, se_samp:d",
    f"""WITH {TWO_ARMS} SELECT arm, count(dr) AS n, avg(dr) AS ate, stddev_pop(dr) / sqrt(count(dr)) AS se_pop,
      stddev_samp(dr) / sqrt(count(dr)) AS se_samp FROM long GROUP BY arm""",
)
def average_effects(spark, sf):
    return average_effect(two_arms(spark, sf))


@query(
    "K12",
    "unit_id:i, effect:d",
    f"WITH {SCORED} SELECT unit_id, (mu0 + 0.05 + 0.5 * cate) - (mu0 + cate) AS effect FROM scored",
)
def effect_between_arms(spark, sf):
    df = scored(spark, sf).withColumn("mu2", F.col("mu0") + 0.05 + 0.5 * F.col("cate"))
    return arm_effect(df, {0: "mu0", 1: "mu1", 2: "mu2"}, 1, 2)


SUBGROUPS = ("segment", "region", "returned", "n_lines")


@query(
    "K13 G2 I1 B6 C22",
    "subgroup_var:s, subgroup_value:s, mean:d, sd:d, n:i, z_sd:d, z_se:d, p_value:d, significant:b",
    f"""WITH {SCORED}, u AS (
      SELECT 'segment' AS subgroup_var, segment AS subgroup_value, cate FROM scored
      UNION ALL SELECT 'region', region, cate FROM scored
      UNION ALL SELECT 'returned', coalesce(CAST(returned AS VARCHAR), 'nan'), cate FROM scored
      UNION ALL SELECT 'n_lines', coalesce(CAST(n_lines AS VARCHAR), 'nan'), cate FROM scored),
    g AS (SELECT subgroup_var, subgroup_value, avg(cate) AS mean, stddev_samp(cate) AS sd, count(cate) AS n FROM u GROUP BY ALL HAVING count(cate) >= 10),
    z AS (SELECT *, mean / sd AS z_sd, mean / (sd / sqrt(n)) AS z_se FROM g),
    p AS (SELECT *, greatest(2 * {tail_sql("z_sd")}, 1e-16) AS p_value FROM z)
    SELECT *, p_value < 0.05 AS significant FROM p""",
)
def subgroup_effects(spark, sf):
    return subgroup_table(scored(spark, sf), SUBGROUPS)


@query(
    "K30 I1 H6",
    "label:s, mean:d, lower:d, upper:d",
    f"""WITH {SCORED}, u AS (
      SELECT 'segment: ' || segment AS label, cate FROM scored UNION ALL SELECT 'region: ' || region, cate FROM scored)
    SELECT label, avg(cate) AS mean, avg(cate) - 2 * stddev_samp(cate) AS lower, avg(cate) + 2 * stddev_samp(cate) AS upper
    FROM u GROUP BY label HAVING count(cate) >= 10""",
)
def subgroup_bars(spark, sf):
    return subgroup_error_bars(subgroup_table(scored(spark, sf), ["segment", "region"]))


@query(
    "S19",
    "key:i, tail:d, digits:d",
    f"""WITH z AS (SELECT c_custkey AS key, c_acctbal / 1000 AS z FROM customer)
    SELECT key, {tail_sql("z")} AS tail, -log10({tail_sql("z")}) AS digits FROM z""",
)
def normal_tails(spark, sf):
    tail = normal_tail(F.col("c_acctbal") / 1000)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), tail.alias("tail"), (-F.log10(tail)).alias("digits"))


@query(
    "K16",
    "arm:i, n:i, est:d, se:d",
    f"""WITH {ONE_ARM} SELECT arm, regr_count(dr, cate) AS n, regr_slope(dr, cate) AS est,
      sqrt((regr_syy(dr, cate) - regr_slope(dr, cate) * regr_sxy(dr, cate)) / (regr_count(dr, cate) - 2) / regr_sxx(dr, cate)) AS se
    FROM long GROUP BY arm""",
)
def blp_one_arm(spark, sf):
    return O.effect_slopes(one_arm(spark, sf), robust=False)


BLP_TWO = """s AS (SELECT arm, regr_count(dr, cate) AS n, regr_avgx(dr, cate) AS mx, regr_avgy(dr, cate) AS my,
      regr_sxx(dr, cate) AS sxx, regr_slope(dr, cate) AS est FROM val GROUP BY arm),
    meat AS (SELECT arm, sum(pow(cate - mx, 2) * pow(dr - my - est * (cate - mx), 2)) AS m FROM val JOIN s USING (arm) GROUP BY arm),
    blp AS (SELECT arm AS treatment, est AS blp_est, sqrt(n * m / (n - 2)) / sxx AS blp_se FROM s JOIN meat USING (arm)),
    blp_p AS (SELECT *, 2 * {tail} AS blp_pval FROM blp)""".format(tail=tail_sql("blp_est / blp_se"))


@query(
    "K16",
    "treatment:i, blp_est:d, blp_se:d, blp_pval:d",
    f"WITH {TWO_ARMS}, val AS (SELECT * FROM long), {BLP_TWO} SELECT * FROM blp_p",
)
def blp_two_arms(spark, sf):
    return O.blp_test(two_arms(spark, sf), n_arms=2)


CAL_BINS = f"""WITH {SCORED}, q AS (SELECT list_sort(list_distinct(quantile_cont(cate, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS c FROM scored),
    b AS (SELECT greatest(len(list_filter(c, lambda x : x < cate)) - 1, 0) AS bin, cate, outcome, treatment FROM scored, q),
    g AS (SELECT bin, avg(cate) AS g_cate, avg(outcome) FILTER (treatment = 1) - avg(outcome) FILTER (treatment = 0) AS gate,
        stddev_samp(outcome) FILTER (treatment = 1) / sqrt(count(*) FILTER (treatment = 1)) AS se1,
        stddev_samp(outcome) FILTER (treatment = 0) / sqrt(count(*) FILTER (treatment = 0)) AS se0 FROM b GROUP BY bin),
    bins AS (SELECT bin, g_cate, gate, se1 + se0 AS se_gate, sqrt(se1 * se1 + se0 * se0) AS se_diff FROM g WHERE se1 + se0 > 0)"""


@query("K18 E2", "bin:i, g_cate:d, gate:d, se_gate:d, se_diff:d", f"{CAL_BINS} SELECT * FROM bins")
def calibration_by_bin(spark, sf):
    df = stage(scored(spark, sf).select("cate", "treatment", "outcome"), "calibration")
    return C.calibration_bins(df, "cate", "treatment", "outcome", 5)


@query(
    "K18 C21",
    "coefficient:s, estimate:d, std_error:d, z_value:d, p_value:d, stars:s, degenerate:b, r_squared:d",
    f"""{CAL_BINS}, s AS (SELECT count(*) AS n, avg(g_cate) AS mx, avg(gate) AS my, regr_sxx(gate, g_cate) AS sxx,
        regr_slope(gate, g_cate) AS b, regr_r2(gate, g_cate) AS r_squared FROM bins),
    f AS (SELECT *, my - b * mx AS a FROM s),
    w AS (SELECT f.*, (g_cate - mx) / sxx AS d, pow((gate - a - b * g_cate) / (1 - 1.0 / n - pow(g_cate - mx, 2) / sxx), 2) AS w FROM bins, f),
    e AS (SELECT any_value(a) AS a, any_value(b) AS b, any_value(r_squared) AS r_squared,
        sqrt(sum(pow(1.0 / n - mx * d, 2) * w)) AS sa, sqrt(sum(d * d * w)) AS sb FROM w),
    t AS (SELECT 'Intercept' AS coefficient, a AS estimate, sa AS std_error, FALSE AS degenerate, r_squared FROM e
      UNION ALL SELECT 'mean.forest.prediction', b, sb, FALSE, r_squared FROM e
      UNION ALL SELECT 'differential.forest.prediction', NULL, NULL, TRUE, r_squared FROM e),
    p AS (SELECT *, estimate / std_error AS z_value, 2 * {tail_sql("estimate / std_error")} AS p_value FROM t)
    SELECT *, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' WHEN p_value < 0.1 THEN '.'
      WHEN p_value IS NOT NULL THEN '' END AS stars FROM p""",
)
def calibration_line(spark, sf):
    return C.calibration_regression(calibration_by_bin(spark, sf))


CAL_TWO = """tr AS (SELECT arm, quantile_cont(cate, [0.0, 0.25, 0.5, 0.75, 1.0]) AS c FROM long WHERE fold <> 0 GROUP BY arm),
    o AS (SELECT arm, count(*) AS total, avg(dr) AS ate FROM val GROUP BY arm),
    k AS (SELECT arm, c, unnest([0, 1, 2, 3]) AS ind FROM tr),
    groups AS (SELECT k.arm, k.ind, count(*) / any_value(total) AS prob, avg(dr) AS gate, stddev_pop(dr) / sqrt(count(*)) AS se_gate,
        avg(cate) AS g_cate, stddev_pop(cate) / sqrt(count(*)) AS se_g_cate, any_value(ate) AS ate
      FROM k JOIN val v ON v.arm = k.arm AND v.cate BETWEEN c[ind + 1] AND c[ind + 2] JOIN o ON o.arm = k.arm GROUP BY k.arm, k.ind),
    cal AS (SELECT arm AS treatment, sum(prob * abs(gate - g_cate)) AS cal_g, sum(prob * abs(gate - ate)) AS cal_o,
        1 - sum(prob * abs(gate - g_cate)) / sum(prob * abs(gate - ate)) AS cal_r_squared FROM groups GROUP BY arm)"""
VAL = "val AS (SELECT * FROM long WHERE fold = 0)"


@query(
    "K19 E3 K30",
    "arm:i, ind:i, prob:d, gate:d, se_gate:d, g_cate:d, se_g_cate:d, ate:d, lower:d, upper:d",
    f"WITH {TWO_ARMS}, {VAL}, {CAL_TWO} SELECT *, gate - 1.96 * se_gate AS lower, gate + 1.96 * se_gate AS upper FROM groups",
)
def calibration_group_table(spark, sf):
    train, val = train_val(stage(two_arms(spark, sf).drop("unit_id"), "dr"))
    return C.gate_error_bars(C.calibration_groups(val, C.group_cuts(train)))


@query(
    "K19",
    "treatment:i, cal_g:d, cal_o:d, cal_r_squared:d",
    f"WITH {TWO_ARMS}, {VAL}, {CAL_TWO} SELECT * FROM cal",
)
def calibration_scores(spark, sf):
    return C.calibration_score(calibration_group_table(spark, sf))


def _uplift_sql(metric: str) -> str:
    """Curve and coefficient straight from the unit-level influence values."""
    if metric == "qini":
        value, weight = "p * (m - ate)", "(CASE WHEN v.cate >= q THEN 1.0 ELSE 0.0 END) - p"
    else:
        value, weight = "m - ate", "(CASE WHEN v.cate >= q THEN 1.0 ELSE 0.0 END) / p - 1.0"
    pct = "(5.0::DOUBLE + 90.0::DOUBLE * i / 49.0::DOUBLE)"
    return f"""{metric}_th AS (SELECT arm, i, {pct} AS pct, c[i + 1] AS q FROM (
        SELECT arm, quantile_cont(cate, list_transform(range(50), lambda i : {pct} / 100.0::DOUBLE)) AS c FROM long WHERE fold <> 0 GROUP BY arm) t,
        range(50) r(i)),
    {metric}_all AS (SELECT arm, count(*) AS n, avg(dr) AS ate FROM val GROUP BY arm),
    {metric}_m AS (SELECT h.arm, h.i, h.pct, h.q, n, ate, avg(dr) FILTER (cate >= q) AS m, count(*) FILTER (cate >= q) / n AS p
      FROM {metric}_th h JOIN {metric}_all a USING (arm) JOIN val v USING (arm) GROUP BY h.arm, h.i, h.pct, h.q, n, ate),
    {metric}_v AS (SELECT *, {value} AS value, (lead(pct) OVER (PARTITION BY arm ORDER BY i) - pct) / 100 AS step FROM {metric}_m),
    {metric}_psi AS (SELECT v.unit_id, c.arm, c.i, c.pct, c.value, c.n, c.step, (v.dr - ate) * ({weight}) - value AS psi
      FROM {metric}_v c JOIN val v USING (arm)),
    {metric}_curve AS (SELECT arm, 100 - pct AS pct_treated, any_value(value) AS value, sqrt(avg(psi * psi) / any_value(n)) AS err
      FROM {metric}_psi GROUP BY arm, i, pct),
    {metric}_u AS (SELECT arm, unit_id, any_value(n) AS n, sum(psi * step) AS s FROM {metric}_psi GROUP BY arm, unit_id),
    {metric}_area AS (SELECT arm, sum(value * step) AS est FROM {metric}_v GROUP BY arm),
    {metric}_coef AS (SELECT arm AS treatment, est, se, {tail_sql("est / se")} AS pval FROM (
      SELECT arm, any_value(est) AS est, sqrt(avg(s * s) / any_value(n)) AS se FROM {metric}_u JOIN {metric}_area USING (arm) GROUP BY arm) x)"""


def _moments(spark, sf):
    train, val = train_val(stage(two_arms(spark, sf).drop("unit_id"), "dr"))
    return U.bucket_moments(val, U.thresholds(train))


@query(
    "K20 K30",
    "arm:i, pct_treated:d, value:d, err:d, lower:d, upper:d",
    f"""WITH {TWO_ARMS}, {VAL}, {_uplift_sql("qini")}
    SELECT *, value - 1.96 * err AS lower, value + 1.96 * err AS upper FROM qini_curve""",
)
def qini_curve(spark, sf):
    return U.with_error_bars(U.uplift_curve(_moments(spark, sf), metric="qini"))


@query(
    "K21 K30",
    "arm:i, pct_treated:d, value:d, err:d, lower:d, upper:d",
    f"""WITH {TWO_ARMS}, {VAL}, {_uplift_sql("toc")}
    SELECT *, value - 1.96 * err AS lower, value + 1.96 * err AS upper FROM toc_curve""",
)
def toc_curve(spark, sf):
    return U.with_error_bars(U.uplift_curve(_moments(spark, sf), metric="toc"))


@query(
    "K22 H4 K20 K21",
    "metric:s, treatment:i, est:d, se:d, pval:d",
    f"""WITH {TWO_ARMS}, {VAL}, {_uplift_sql("qini")}, {_uplift_sql("toc")}
    SELECT 'qini' AS metric, * FROM qini_coef UNION ALL SELECT 'toc', * FROM toc_coef""",
)
def uplift_coefficients(spark, sf):
    moments = stage(_moments(spark, sf), "moments")
    parts = [U.uplift_coefficient(moments, metric=m).withColumn("metric", F.lit(m)) for m in U.METRICS]
    return parts[0].unionByName(parts[1])


def _uniform(key: str) -> str:
    return uniform_sql(0, f"arm || ':' || r || ':' || b || ':{key}'")


@query(
    "K23 K30",
    "arm:i, pct_treated:d, value:d, err:d, crit_two_sided:d, crit_one_sided:d, lower:d, upper:d",
    f"""WITH {TWO_ARMS}, {VAL}, {_uplift_sql("qini")},
    lists AS (SELECT arm, list(q ORDER BY i) AS c FROM qini_th GROUP BY arm),
    d AS (SELECT v.arm, len(list_filter(c, lambda x : x <= v.cate)) AS b, v.dr - a.ate AS d FROM val v JOIN lists USING (arm) JOIN qini_all a USING (arm)),
    mo AS (SELECT arm, b, count(*)::DOUBLE AS nb, sum(d) AS c1, sum(d * d) AS c2 FROM d GROUP BY arm, b),
    z AS (SELECT *, sqrt(-2.0 * ln({_uniform("1:r")})) * cos(2.0 * pi() * {_uniform("1:t")}) AS z1,
        sqrt(-2.0 * ln({_uniform("2:r")})) * cos(2.0 * pi() * {_uniform("2:t")}) AS z2 FROM mo, range(1000) t(r)),
    w AS (SELECT arm, r, b, sqrt(nb) * z1 AS w0, c1 / sqrt(nb) * z1 + sqrt(greatest(c2 - c1 * c1 / nb, 0)) * z2 AS w1 FROM z),
    e AS (SELECT v.arm, v.i, v.p, v.value, v.n, c.err, c.pct_treated FROM qini_v v JOIN qini_curve c ON c.arm = v.arm AND c.pct_treated = 100 - v.pct),
    st AS (SELECT arm, r, i, (sum(((CASE WHEN b >= i + 1 THEN 1.0 ELSE 0.0 END) - p) * w1) - any_value(value) * sum(w0))
        / (any_value(n) * any_value(err)) AS stat FROM w JOIN e USING (arm) GROUP BY arm, r, i),
    x AS (SELECT arm, r, max(abs(stat)) AS big, min(stat) AS small FROM st GROUP BY arm, r),
    k AS (SELECT arm, quantile_cont(big, 0.95) AS crit_two_sided, abs(quantile_cont(small, 0.05)) AS crit_one_sided FROM x GROUP BY arm)
    SELECT *, value - crit_two_sided * err AS lower, value + crit_two_sided * err AS upper FROM e JOIN k USING (arm)""",
)
def uniform_bands(spark, sf):
    moments = stage(_moments(spark, sf), "moments")
    curve = U.curve_with_bands(U.uplift_curve(moments), U.uniform_bands(moments))
    return U.with_error_bars(curve, "ucb2")


@query(
    "K24 F3 C23",
    "treatment:i, blp_est:d, blp_se:d, blp_pval:d, qini_est:d, qini_se:d, qini_pval:d, autoc_est:d, autoc_se:d, autoc_pval:d, cal_r_squared:d",
    f"""WITH {TWO_ARMS}, {VAL}, {BLP_TWO}, {CAL_TWO}, {_uplift_sql("qini")}, {_uplift_sql("toc")}
    SELECT treatment, round_even(blp_est, 3) AS blp_est, round_even(blp_se, 3) AS blp_se, round_even(blp_pval, 3) AS blp_pval,
      round_even(q.est, 3) AS qini_est, round_even(q.se, 3) AS qini_se, round_even(q.pval, 3) AS qini_pval, round_even(t.est, 3) AS autoc_est,
      round_even(t.se, 3) AS autoc_se, round_even(t.pval, 3) AS autoc_pval, round_even(cal_r_squared, 3) AS cal_r_squared
    FROM blp_p JOIN qini_coef q USING (treatment) JOIN toc_coef t USING (treatment) JOIN cal USING (treatment)""",
)
def combined_tests(spark, sf):
    train, val = train_val(stage(two_arms(spark, sf).drop("unit_id"), "dr"))
    moments = stage(U.bucket_moments(val, U.thresholds(train)), "moments")
    cal = C.calibration_score(C.calibration_groups(val, C.group_cuts(train)))
    return combined_summary(
        O.blp_test(val, 2), U.uplift_coefficient(moments, metric="qini"), U.uplift_coefficient(moments, metric="toc"), cal
    )


# Least squares on a constant and two covariates, solved by cofactors of the centred products.
@query(
    "K15 C21",
    "term:s, estimate:d, std_error:d",
    f"""WITH {SCORED}, x AS (SELECT dr AS y, price / 100000 AS a, bal / 1000 AS b FROM scored),
    c AS (SELECT count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, regr_sxx(a, a) AS aa, regr_sxx(b, b) AS bb,
      regr_sxy(a, b) AS ab, regr_sxy(y, a) AS ay, regr_sxy(y, b) AS yb FROM x),
    f AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * yb) / (aa * bb - ab * ab) AS ba, (aa * yb - ab * ay) / (aa * bb - ab * ab) AS bb_ FROM c),
    r AS (SELECT f.*, (bb * (a - ma) - ab * (b - mb)) / det AS ua, (aa * (b - mb) - ab * (a - ma)) / det AS ub, a, b,
        y - my - ba * (a - ma) - bb_ * (b - mb) AS e FROM x, f),
    h AS (SELECT *, 1 / n - ma * ua - mb * ub AS uc, e / (1 - 1 / n - ua * (a - ma) - ub * (b - mb)) AS s FROM r)
    SELECT 'const' AS term, any_value(my - ba * ma - bb_ * mb) AS estimate, sqrt(sum(uc * uc * s * s)) AS std_error FROM h
    UNION ALL SELECT 'price', any_value(ba), sqrt(sum(ua * ua * s * s)) FROM h
    UNION ALL SELECT 'bal', any_value(bb_), sqrt(sum(ub * ub * s * s)) FROM h""",
)
def linear_projection(spark, sf):
    from taufold.operators.dr import dr_score

    df = scored(spark, sf)
    mu, e = [F.col("mu0"), F.col("mu1")], [F.col("e0"), F.col("e")]
    dr = dr_score(F.col("outcome").cast("double"), F.col("treatment"), [0, 1], 1, mu, e)
    data = df.select(dr.alias("dr"), (F.col("price") / 100000).alias("price"), (F.col("bal") / 1000).alias("bal"))
    return O.fit_ols(stage(data, "projection"), "dr", ["price", "bal"]).table(df)


@query("K15 K17 E10 G18 B6", "covariate:s, estimate:d, std_error:d, min_p:d, stars:s")
def projection_summary(spark, sf):
    from taufold.operators.encode import Preprocessor

    df = stage(scored(spark, sf).select("unit_id", "cate", "price", "qty", "segment", "region"), "projection")
    pre = Preprocessor.fit(df, ["price", "qty"], ["segment", "region"])
    # All levels and a constant: the cross products are singular by design.
    wide = pre.transform(df, keep=["cate"])
    fit = O.fit_ols(wide, "cate", pre.features)
    return O.projection_by_covariate(fit.table(df, digits=5), pre.bases)


# A constant, all flags of the segments and all flags of their cells: six dependent columns.  Cells of one segment can be
# compared, as their segment's flag cancels; cells of different segments cannot.
@query(
    "K15 K17 C21",
    "contrast:s, estimate:d, std_error:d, stars:s",
    f"""WITH {SCORED}, x AS (SELECT cate, segment, CASE WHEN bal < 2000 THEN 'a' WHEN bal < 5000 THEN 'b' ELSE 'c' END AS balance FROM scored),
    g AS (SELECT segment, balance, count(*)::DOUBLE AS n, avg(cate) AS m FROM x GROUP BY 1, 2),
    v AS (SELECT segment, balance, any_value(m) AS m, sum(pow((cate - m) / (1 - 1 / n), 2)) / (any_value(n) * any_value(n)) AS v
      FROM x JOIN g USING (segment, balance) GROUP BY 1, 2),
    own AS (SELECT 'cell_' || l.segment || '/' || l.balance || ' - cell_' || f.segment || '/' || f.balance AS contrast, l.m - f.m AS estimate,
      sqrt(l.v + f.v) AS std_error FROM v l JOIN v f ON f.segment = l.segment AND f.balance = 'a' WHERE l.balance <> 'a'),
    p AS (SELECT *, 2 * {tail_sql("(estimate / std_error)")} AS p FROM own)
    SELECT contrast, estimate, std_error, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p < 0.1 THEN '.' ELSE '' END AS stars FROM p
    UNION ALL SELECT 'segment_' || segment || ' - segment_AUTOMOBILE', NULL, NULL, NULL FROM g WHERE segment <> 'AUTOMOBILE' GROUP BY segment""",
)
def projection_contrasts(spark, sf):
    from taufold.operators.encode import levels, one_hot_columns, one_hot_names

    balance = F.when(F.col("bal") < 2000, "a").when(F.col("bal") < 5000, "b").otherwise("c")
    data = scored(spark, sf).select("cate", "segment", F.concat_ws("/", "segment", balance).alias("cell"))
    data = stage(data, "contrasts")
    known = levels(data, ["segment", "cell"])
    flags = one_hot_names(known)
    wide = data.select("cate", *one_hot_columns(known))
    # Cells are compared within their own segment, segments with each other.
    bases = {flag: flag.split("/")[0] for flag in flags}
    bases |= {flag: "segment" for flag in flags if flag.startswith("segment_")}
    return O.fit_ols(wide, "cate", list(flags)).contrasts(data, O.level_contrasts(bases))


def _level_fit_sql(name: str, first: str) -> str:
    """Terms of a regression on one covariate's flags without the first: differences of group means, with HC3 errors."""
    return f"""{name}_g AS (SELECT {name} AS level, count(*)::DOUBLE AS n, avg(cate) AS m FROM x GROUP BY 1),
    {name}_v AS (SELECT level, any_value(m) AS m, sum(pow((cate - m) / (1 - 1 / n), 2)) / (any_value(n) * any_value(n)) AS v
      FROM x JOIN {name}_g ON {name} = level GROUP BY level),
    {name}_t AS (SELECT '{name}' AS covariate, l.m - f.m AS estimate, sqrt(l.v + f.v) AS std_error
      FROM {name}_v l, {name}_v f WHERE l.level <> '{first}' AND f.level = '{first}')"""


# Each covariate's own projection, so that every term has a closed form.
@query(
    "G18 K17 E10 C21",
    "covariate:s, estimate:d, std_error:d, min_p:d, stars:s",
    f"""WITH {SCORED}, x AS (SELECT cate, segment, CASE WHEN bal < 2000 THEN 'a' WHEN bal < 5000 THEN 'b' ELSE 'c' END AS balance FROM scored),
    {_level_fit_sql("segment", "AUTOMOBILE")}, {_level_fit_sql("balance", "a")},
    t AS (SELECT *, 2 * {tail_sql("(estimate / std_error)")} AS p FROM (SELECT * FROM segment_t UNION ALL SELECT * FROM balance_t) u),
    g AS (SELECT covariate, avg(estimate) AS estimate, avg(std_error) AS std_error, min(p) AS min_p FROM t GROUP BY covariate)
    SELECT *, CASE WHEN min_p < 0.001 THEN '***' WHEN min_p < 0.01 THEN '**' WHEN min_p < 0.05 THEN '*' WHEN min_p < 0.1 THEN '.' ELSE '' END AS stars
    FROM g WHERE min_p < 0.05""",
)
def significant_covariates(spark, sf):
    from taufold.operators.encode import base_of, levels, one_hot_columns, one_hot_names

    balance = F.when(F.col("bal") < 2000, "a").when(F.col("bal") < 5000, "b").otherwise("c").alias("balance")
    data = stage(scored(spark, sf).select("cate", "segment", balance), "significant")
    known = levels(data, ["segment", "balance"])
    tables = []
    for base in known:
        flags = one_hot_names({base: known[base]}, drop_first=True)
        wide = data.select("cate", *one_hot_columns({base: known[base]}, drop_first=True))
        tables.append(O.fit_ols(wide, "cate", list(flags)).table(data))
    terms = one_hot_names(known, drop_first=True)
    return O.significant_only(O.projection_by_covariate(tables[0].unionByName(tables[1]), {t: base_of(t, list(known)) for t in terms}))


@query(
    "K27",
    "score:d",
    f"""WITH {SCORED}, f AS (SELECT fold, avg(pow(outcome - cate * treatment, 2)) AS mse FROM scored GROUP BY fold)
    SELECT avg(mse) AS score FROM f""",
)
def proxy_tuning_score(spark, sf):
    return proxy_score(scored(spark, sf), "cate", "treatment", "outcome", "fold")


AUC = """auc AS (SELECT (sum(r) FILTER (outcome = 1) - count(*) FILTER (outcome = 1) * (count(*) FILTER (outcome = 1) + 1) / 2.0)
      / (count(*) FILTER (outcome = 1) * 1.0 * count(*) FILTER (outcome = 0)) AS roc_auc
    FROM (SELECT outcome, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s) x)"""


@query(
    "K29",
    "accuracy:d, precision:d, recall:d, f1:d, roc_auc:d",
    f"""WITH {SCORED}, s AS (SELECT outcome, round(mu0 + treatment * cate, 2) AS score FROM scored), {AUC},
    c AS (SELECT count(*) FILTER (outcome = 1 AND score >= 0.3)::DOUBLE AS tp, count(*) FILTER (outcome = 0 AND score >= 0.3) AS fp,
      count(*) FILTER (outcome = 1 AND score < 0.3) AS fn, count(*) FILTER (outcome = 0 AND score < 0.3) AS tn FROM s)
    SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
      2 * tp / (2 * tp + fp + fn) AS f1, roc_auc FROM c, auc""",
)
def classification_metrics(spark, sf):
    score = F.round(F.col("mu0") + F.col("treatment") * F.col("cate"), 2)
    df = stage(scored(spark, sf).select("outcome", score.alias("score")), "metrics")
    return classification_report(df, "outcome", "score", cut=0.3)


@query(
    "K29",
    "accuracy:d, precision:d, recall:d, f1:d",
    """WITH s AS (SELECT quality, n_chars >= 1000 AS long_text FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT count(*) FILTER (quality = 1 AND long_text)::DOUBLE AS tp, count(*) FILTER (quality = 0 AND long_text) AS fp,
      count(*) FILTER (quality = 1 AND NOT long_text) AS fn, count(*) FILTER (quality = 0 AND NOT long_text) AS tn FROM s)
    SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
      2 * tp / (2 * tp + fp + fn) AS f1 FROM c""",
)
def label_metrics(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return threshold_metrics(joined, "quality", "n_chars", cut=1000)


@query(
    "K29",
    "roc_auc:d",
    f"""WITH {SCORED}, s AS (SELECT outcome, mu0 + treatment * cate AS score FROM scored), {AUC} SELECT * FROM auc""",
)
def ranking_area(spark, sf):
    return roc_auc(scored(spark, sf).withColumn("score", F.col("mu0") + F.col("treatment") * F.col("cate")), "outcome", "score")


@query(
    "K26 F4",
    "round:i, error:d",
    f"""WITH {SCORED}, r AS (SELECT unit_id, outcome, unnest(range(1, 9)) AS round, mu0 FROM scored),
    v AS (SELECT unit_id, outcome, round, CASE WHEN mu0 + 0.02 * round > 0.33 THEN 1 ELSE 0 END AS prediction FROM r
      WHERE {uniform_sql(11, "unit_id || ':' || round")} < 0.37),
    c AS (SELECT *, sum(prediction) OVER w AS ones, count(*) OVER w AS votes FROM v WINDOW w AS (PARTITION BY unit_id ORDER BY round))
    SELECT round, avg(CASE WHEN (CASE WHEN 2 * ones > votes THEN 1 ELSE 0 END) <> outcome THEN 1.0 ELSE 0.0 END) AS error FROM c GROUP BY round""",
)
def out_of_bag_votes(spark, sf):
    from taufold.functions.numeric import uniform

    rounds = scored(spark, sf).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(8))))
    left_out = uniform(11, F.col("unit_id"), F.col("round")) < 0.37
    prediction = F.when(F.col("mu0") + 0.02 * F.col("round") > 0.33, 1).otherwise(0)
    votes = rounds.filter(left_out).select("unit_id", "round", prediction.alias("prediction"), F.col("outcome").alias("label"))
    return vote_errors(votes, [0, 1])
