"""Calibration of predicted effects against estimated group effects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taufold.functions.labels import first_match, is_finite, stars
from taufold.functions.numeric import two_sided_p
from taufold.functions.values import CONSTANT, DIFFERENCE, MEAN_PREDICTION, Z95
from taufold.operators.encode import closed_groups, quantile_bins
from taufold.operators.quantiles import exact_quantiles


def calibration_bins(
    df: DataFrame, cate: str, treatment: str, outcome: str, bins: int = 5, cuts: Sequence[float] | None = None
) -> DataFrame:
    """Group effect, its error and the mean prediction per quantile bin: one aggregation.

    ``se`` is the sum of the two arms' standard errors; ``se_diff`` is the usual
    error of a difference.  Bins with an empty arm, a missing value or no spread
    are left out.
    """
    binned = quantile_bins(df, cate, bins, cuts=cuts).filter("bin is not null")
    y, d = F.col(outcome).cast("double"), F.col(treatment)
    treated, control = F.when(d == 1, y), F.when(d == 0, y)
    per_bin = binned.groupBy("bin").agg(
        F.avg(F.col(cate)).alias("g_cate"),
        (F.avg(treated) - F.avg(control)).alias("gate"),
        _mean_error(treated).alias("se1"),
        _mean_error(control).alias("se0"),
        F.count_if(y.isNull() | d.isNull()).alias("missing"),
    )
    se = F.col("se1") + F.col("se0")
    kept = per_bin.withColumn("se_gate", se).filter((F.col("missing") == 0) & is_finite(F.col("se_gate")) & (F.col("se_gate") != 0))
    return kept.select("bin", "g_cate", "gate", "se_gate", F.hypot("se1", "se0").alias("se_diff"))


def _mean_error(c: Column) -> Column:
    return F.try_divide(F.stddev_samp(c), F.sqrt(F.count(c).cast("double")))


def calibration_regression(per_bin: DataFrame) -> DataFrame:
    """Regression of group effect on mean prediction with HC3 errors, one row per coefficient.

    ``per_bin`` has at most one row per bin.  The within-bin difference is zero
    by construction, so its coefficient is NULL and marked degenerate.
    """
    rows = per_bin.select("g_cate", "gate").collect()
    if len(rows) < 2:
        raise ValueError("fewer than two usable bins for the calibration regression")
    local = per_bin.sparkSession.createDataFrame(rows, "x double, y double").coalesce(1)
    y, x = F.col("y"), F.col("x")
    fit = local.agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mx"),
        F.avg(y).alias("my"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
        F.collect_list(F.struct(x, y)).alias("points"),
    )
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    lines = fit.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    point = lines.select("*", F.inline("points"))
    dx = x - F.col("mx")
    leverage = 1.0 / F.col("n") + F.try_divide(dx * dx, F.col("sxx"))
    residual = y - F.col("intercept") - F.col("slope") * x
    # A bin with leverage 1 is fitted exactly; the HC3 weight is then undefined.
    weight = F.pow(F.try_divide(residual, F.when(leverage < 1 - 1e-12, 1.0 - leverage)), F.lit(2))
    on_slope = F.try_divide(dx, F.col("sxx"))
    on_constant = 1.0 / F.col("n") - F.col("mx") * on_slope
    summed = point.groupBy("n", "intercept", "slope", "sxx", "sxy", "syy").agg(
        F.sqrt(F.sum(F.pow(on_constant, F.lit(2)) * weight)).alias("se_constant"),
        F.sqrt(F.sum(F.pow(on_slope, F.lit(2)) * weight)).alias("se_slope"),
    )
    r_squared = F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")).alias("r_squared")
    none = F.lit(None).cast("double")
    cells = F.array(
        _term(CONSTANT, F.col("intercept"), F.col("se_constant"), False),
        _term(MEAN_PREDICTION, F.col("slope"), F.col("se_slope"), False),
        _term(DIFFERENCE, none, none, True),
    )
    table = summed.select(F.inline(cells), r_squared).select("*")
    z = F.try_divide(F.col("estimate"), F.col("std_error"))
    return table.withColumn("z_value", z).withColumn("p_value", two_sided_p(z)).withColumn(
        "stars", F.when(F.col("p_value").isNotNull(), stars(F.col("p_value")))
    )


def _term(name: str, estimate: Column, error: Column, degenerate: bool) -> Column:
    return F.struct(
        F.lit(name).alias("coefficient"),
        estimate.alias("estimate"),
        error.alias("std_error"),
        F.lit(degenerate).alias("degenerate"),
    )


def group_cuts(train: DataFrame, groups: int = 4, cate: str = "cate") -> dict[int, list[float]]:
    """Quantiles 0..1 of the training predictions, per arm."""
    found = exact_quantiles(train, cate, [i / groups for i in range(groups + 1)], by=["arm"])
    return {key[0]: cuts for key, cuts in found.items()}


def calibration_groups(val: DataFrame, cuts: Mapping[int, Sequence[float]], score: str = "dr", cate: str = "cate") -> DataFrame:
    """(arm, ind, prob, gate, se_gate, g_cate, se_g_cate, ate) for each closed prediction group.

    A unit on an inner cut counts in both neighbours, a unit outside the training
    range in none; both shares and the overall effect refer to all units.
    """
    groups = first_match((F.col("arm") == arm, closed_groups(cate, arm_cuts)) for arm, arm_cuts in cuts.items())
    s, c = F.col(score), F.col(cate)
    overall = val.groupBy("arm").agg(F.count(F.lit(1)).alias("total"), F.avg(s).alias("ate"))
    member = val.select("arm", score, cate, F.explode(groups).alias("ind"))
    found = member.groupBy("arm", "ind").agg(
        F.count(F.lit(1)).alias("size"),
        F.avg(s).alias("gate"),
        F.stddev_pop(s).alias("sd_gate"),
        F.avg(c).alias("g_cate"),
        F.stddev_pop(c).alias("sd_cate"),
    )
    arm_type = val.schema["arm"].dataType
    known = T.StructType([T.StructField("arm", arm_type), T.StructField("ind", T.IntegerType())])
    grid = val.sparkSession.createDataFrame([(a, i) for a, v in cuts.items() for i in range(len(v) - 1)], known)
    # Arms times groups rows on each side.
    joined = grid.join(F.broadcast(found), ["arm", "ind"], "left").join(F.broadcast(overall), "arm")
    root = F.sqrt(F.col("size").cast("double"))
    return joined.select(
        "arm",
        "ind",
        (F.coalesce("size", F.lit(0)) / F.col("total")).alias("prob"),
        "gate",
        (F.col("sd_gate") / root).alias("se_gate"),
        "g_cate",
        (F.col("sd_cate") / root).alias("se_g_cate"),
        "ate",
    )


def gate_error_bars(groups: DataFrame) -> DataFrame:
    """Group effects with their 95 % limits, ready to plot against the mean prediction."""
    reach = Z95 * F.col("se_gate")
    return groups.withColumns({"reach": reach, "lower": F.col("gate") - reach, "upper": F.col("gate") + reach})


def calibration_score(groups: DataFrame) -> DataFrame:
    """(treatment, cal_g, cal_o, cal_r_squared), one row per arm; NULL if a group is empty."""
    def weighted(other: str) -> Column:
        total = F.sum(F.col("prob") * F.abs(F.col("gate") - F.col(other)))
        return F.when(F.count("gate") == F.count(F.lit(1)), total)

    scores = groups.groupBy(F.col("arm").alias("treatment")).agg(weighted("g_cate").alias("cal_g"), weighted("ate").alias("cal_o"))
    return scores.withColumn("cal_r_squared", 1.0 - F.try_divide(F.col("cal_g"), F.col("cal_o")))
