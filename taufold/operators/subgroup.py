"""Effects by subgroup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taufold.functions.labels import floor_p, p_text
from taufold.functions.numeric import two_sided_p
from taufold.functions.values import MIN_SUBGROUP, SIGNIFICANCE

# Label of units without a value, as text conversion of a missing number gives it.
NULL_LABEL = "nan"


def subgroup_means(df: DataFrame, subgroups: Sequence[str], score: str, null_label: str | None = None) -> DataFrame:
    """(subgroup_var, subgroup_value, mean, sd, n) for all variables in one job.

    The unpivoted rows are combined map-side, so only one row per task and
    subgroup value is shuffled.
    """
    text = df.select(F.col(score).alias("_s"), *[F.col(f"`{c}`").cast("string").alias(c) for c in subgroups])
    long = text.unpivot(["_s"], list(subgroups), "subgroup_var", "subgroup_value")
    if null_label is None:
        long = long.filter("subgroup_value is not null")
    else:
        long = long.fillna({"subgroup_value": null_label})
    return long.groupBy("subgroup_var", "subgroup_value").agg(
        F.avg("_s").alias("mean"), F.stddev_samp("_s").alias("sd"), F.count("_s").alias("n")
    )


def ratio_z(mean: Column, spread: Column) -> Column:
    """mean / spread; a spread of 0 gives the infinite limit."""
    infinite = F.when(mean > 0, float("inf")).when(mean < 0, float("-inf"))
    return F.when(spread != 0, F.try_divide(mean, spread)).otherwise(infinite)


def subgroup_error_bars(table: DataFrame) -> DataFrame:
    """Subgroup means with two standard deviations to each side, lowest mean first."""
    label = F.concat(F.col("subgroup_var"), F.lit(": "), F.col("subgroup_value"))
    reach = 2.0 * F.col("sd")
    limits = {"label": label, "lower": F.col("mean") - reach, "upper": F.col("mean") + reach}
    return table.withColumns(limits).orderBy("mean", "label")


def subgroup_table(df: DataFrame, subgroups: Sequence[str], cate: str = "cate", min_size: int = MIN_SUBGROUP) -> DataFrame:
    """Subgroup effects with z = mean / sd, its two-sided p and the mark of significance.

    ``z_se`` is the usual ratio to the standard error, given as an extra column.
    """
    grouped = subgroup_means(df, subgroups, cate, NULL_LABEL).filter(F.col("n") >= min_size)
    with_z = grouped.withColumn("z_sd", ratio_z(F.col("mean"), F.col("sd"))).withColumn(
        "z_se", ratio_z(F.col("mean"), F.col("sd") / F.sqrt(F.col("n").cast("double")))
    )
    p = floor_p(two_sided_p(F.col("z_sd")))
    return with_z.withColumns({"p_value": p, "p_label": p_text(p), "significant": p < SIGNIFICANCE})
