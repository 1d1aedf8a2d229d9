"""Uplift curves (QINI, TOC), their coefficients and uniform bands.

Thresholds come from the training predictions.  Every validation unit falls in
bucket b = number of thresholds at or below its prediction, and the whole
analysis needs only count, sum and the squares about the bucket's own mean: one
aggregation, whatever the number of units, whose partial moments are merged
pairwise, so a large mean costs no digits.  Everything after it works on
(number of thresholds + 1) rows per arm.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taufold.functions.labels import at_least, first_match
from taufold.functions.numeric import cuts_at_or_below, normal_tail, standard_normal
from taufold.functions.values import Z95
from taufold.operators.quantiles import exact_quantiles

METRICS = ("qini", "toc")
PERCENTILES = tuple(5 + 90 * i / 49 for i in range(50))


def thresholds(train: DataFrame, percentiles: Sequence[float] = PERCENTILES, cate: str = "cate") -> dict[int, list[float]]:
    """Percentiles of the training predictions, per arm."""
    found = exact_quantiles(train, cate, [p / 100 for p in percentiles], by=["arm"])
    return {key[0]: cuts for key, cuts in found.items()}


def _check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unsupported metric {metric!r}; must be one of {METRICS}")


def bucket_moments(val: DataFrame, cuts: Mapping[int, Sequence[float]], score: str = "dr", cate: str = "cate") -> DataFrame:
    """(arm, b, n, s1, m2) for every arm and bucket, empty buckets included; ``m2`` sums squares about the bucket's mean."""
    bucket = first_match((F.col("arm") == arm, cuts_at_or_below(cate, arm_cuts)) for arm, arm_cuts in cuts.items())
    s = F.col(score)
    lost = F.col(score).isNotNull() & (F.col(cate).isNull() | ~F.col("arm").isin(*cuts))
    if stray := val.filter(lost).select("arm", cate).limit(1).collect():
        raise ValueError(f"a unit of arm {stray[0]['arm']!r} has no effect estimate or its arm no thresholds")
    found = val.groupBy("arm", bucket.alias("b")).agg(
        F.count(s).alias("n"), F.sum(s).alias("s1"), (F.var_pop(s) * F.count(s)).alias("m2")
    )
    zeros = [(arm, b, 0, 0.0, 0.0) for arm, arm_cuts in cuts.items() for b in range(len(arm_cuts) + 1)]
    fields = [T.StructField("arm", val.schema["arm"].dataType), T.StructField("b", T.IntegerType()), T.StructField("n", T.LongType())]
    fields += [T.StructField(s, T.DoubleType()) for s in ("s1", "m2")]
    empty = val.sparkSession.createDataFrame(zeros, T.StructType(fields))
    return (
        found.select("arm", "b", "n", "s1", "m2")
        .unionByName(empty)
        .filter("b is not null")
        .groupBy("arm", "b")
        .agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("m2").alias("m2"))
    )


def _analysis(moments: DataFrame, percentiles: Sequence[float], metric: str) -> DataFrame:
    """One row per arm and bucket with centred moments, curve point, weights and errors.

    Row b >= 1 carries the point of threshold b.  With d = score - mean score, a
    unit at or above the threshold has weight ``hi`` in the point's influence
    value, any other unit ``lo``.
    """
    _check_metric(metric)
    pct = F.array(*[F.lit(float(p)) for p in percentiles])
    arm = Window.partitionBy("arm")
    upward = arm.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    downward = arm.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    n_all = F.sum("n").over(arm).cast("double")
    centred = (
        moments.withColumn("total", n_all)
        .withColumn("ate", F.try_divide(F.sum("s1").over(arm), F.col("total")))
        .withColumn("c1", F.col("s1") - F.col("n") * F.col("ate"))
        .withColumn("c2", F.col("m2") + F.coalesce(F.try_divide(F.col("c1") * F.col("c1"), F.col("n")), F.lit(0.0)))
    )
    above = centred.withColumns(
        {
            "n_ge": F.sum("n").over(downward),
            "c1_ge": F.sum("c1").over(downward),
            "c2_ge": F.sum("c2").over(downward),
            "c2_all": F.sum("c2").over(arm),
        }
    )
    p = F.try_divide(F.col("n_ge"), F.col("total"))
    gain = F.try_divide(F.col("c1_ge"), F.col("n_ge"))
    if metric == "qini":
        value, hi, lo = p * gain, 1.0 - p, -p
    else:
        value, hi, lo = gain, F.try_divide(F.lit(1.0), p) - 1.0, F.lit(-1.0)
    is_point = F.col("b") >= 1
    points = above.withColumns(
        {
            "pct": F.when(is_point, F.get(pct, F.col("b") - 1)),
            "value": F.when(is_point, value),
            "hi": F.when(is_point, hi),
            "lo": F.when(is_point, lo),
            # Width of the step to the next percentile; the last point has none.
            "step": F.when(is_point & (F.col("b") < len(percentiles)), (F.get(pct, F.col("b")) - F.get(pct, F.col("b") - 1)) / 100),
        }
    )
    t = F.col("value")
    square = (
        F.pow("hi", F.lit(2)) * F.col("c2_ge")
        + F.pow("lo", F.lit(2)) * (F.col("c2_all") - F.col("c2_ge"))
        - 2 * t * (F.col("hi") - F.col("lo")) * F.col("c1_ge")
        + F.col("total") * t * t
    )
    errors = points.withColumn("err", F.sqrt(at_least(square, 0.0)) / F.col("total"))
    step_hi, step_lo = F.col("hi") * F.col("step"), F.col("lo") * F.col("step")
    return errors.withColumns(
        {
            # Without a value at one of the points there is no area.
            "area": F.when(F.count(t * F.col("step")).over(arm) == F.count("step").over(arm), F.sum(t * F.col("step")).over(arm)),
            "a": F.coalesce(F.sum(step_hi).over(upward), F.lit(0.0))
            + F.coalesce(F.sum(step_lo).over(arm), F.lit(0.0))
            - F.coalesce(F.sum(step_lo).over(upward), F.lit(0.0)),
        }
    )


def uplift_curve(moments: DataFrame, percentiles: Sequence[float] = PERCENTILES, metric: str = "qini") -> DataFrame:
    """(arm, pct_treated, value, err), one row per threshold; empty groups have NULL values."""
    rows = _analysis(moments, percentiles, metric).filter("b >= 1")
    return rows.select("arm", (100.0 - F.col("pct")).alias("pct_treated"), "value", "err")


def uplift_coefficient(moments: DataFrame, percentiles: Sequence[float] = PERCENTILES, metric: str = "qini") -> DataFrame:
    """(treatment, est, se, pval): area under the curve and its one-sided test, one row per arm."""
    rows = _analysis(moments, percentiles, metric)
    c, a = F.col("area"), F.col("a")
    square = F.col("c2") * a * a - 2 * F.col("c1") * a * c + F.col("n") * c * c
    per_arm = rows.groupBy("arm", "area", "total").agg(F.sum(square).alias("square"))
    se = F.sqrt(at_least(F.col("square"), 0.0)) / F.col("total")
    out = per_arm.select(F.col("arm").alias("treatment"), c.alias("est"), se.alias("se"))
    return out.withColumn("pval", normal_tail(F.try_divide(F.col("est"), F.col("se"))))


def uniform_bands(
    moments: DataFrame,
    percentiles: Sequence[float] = PERCENTILES,
    metric: str = "qini",
    replicates: int = 1000,
    seed: int = 0,
) -> DataFrame:
    """(arm, crit_two_sided, crit_one_sided): multipliers of the uniform confidence bands.

    Drawing a normal per unit and summing inside a bucket gives two jointly
    Gaussian sums with known covariance, so two normals per bucket and replicate
    have the same law: replicates * (thresholds + 1) rows, whatever the number of
    units.  Draws are hashes of (seed, arm, replicate, bucket).
    """
    rows = _analysis(moments, percentiles, metric).select("arm", "b", "n", "c1", "m2", "value", "err", "hi", "lo", "total")
    drawn = rows.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    root = F.sqrt(F.col("n").cast("double"))
    keys = (F.col("arm"), F.col("r"), F.col("b"))
    z1, z2 = standard_normal(seed, *keys, F.lit("1")), standard_normal(seed, *keys, F.lit("2"))
    spare = F.sqrt(F.greatest("m2", F.lit(0.0)))
    sums = drawn.withColumns({"_z1": z1, "_z2": z2}).withColumns(
        {"w0": root * F.col("_z1"), "w1": F.coalesce(F.try_divide(F.col("c1"), root), F.lit(0.0)) * F.col("_z1") + spare * F.col("_z2")}
    )
    one = Window.partitionBy("arm", "r")
    downward = one.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    w1_ge = F.sum("w1").over(downward)
    influence = F.col("hi") * w1_ge + F.col("lo") * (F.sum("w1").over(one) - w1_ge) - F.col("value") * F.sum("w0").over(one)
    stat = sums.withColumn("stat", F.try_divide(influence, F.col("total") * F.col("err"))).filter("b >= 1")
    extremes = stat.groupBy("arm", "r").agg(F.max(F.abs("stat")).alias("largest"), F.min("stat").alias("least"))
    # As many values per arm as replicates, so the exact percentile is small.
    return extremes.groupBy("arm").agg(
        F.percentile("largest", F.lit(0.95)).alias("crit_two_sided"),
        F.abs(F.percentile("least", F.lit(0.05))).alias("crit_one_sided"),
    )


def curve_with_bands(curve: DataFrame, bands: DataFrame) -> DataFrame:
    """Curve rows with both multipliers; ``bands`` has one row per arm."""
    return curve.join(F.broadcast(bands), "arm")


def with_error_bars(curve: DataFrame, kind: str | None = None) -> DataFrame:
    """Lower and upper limit of each point: pointwise, or uniform two-sided ('ucb2') or one-sided ('ucb1')."""
    factors: dict[str | None, Column] = {
        None: F.lit(Z95),
        "ucb2": F.col("crit_two_sided") if kind == "ucb2" else F.lit(None),
        "ucb1": F.col("crit_one_sided") if kind == "ucb1" else F.lit(None),
    }
    if kind not in factors:
        raise ValueError(f"invalid error type {kind!r}; must be one of [None, 'ucb2', 'ucb1']")
    reach = factors[kind] * F.col("err")
    upper = F.col("value") if kind == "ucb1" else F.col("value") + reach
    return curve.withColumns({"reach": reach, "lower": F.col("value") - reach, "upper": upper})

