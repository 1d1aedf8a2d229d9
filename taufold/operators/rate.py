"""Targeting curve: mean effect among the units ranked first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taufold.functions.values import Z95
from taufold.operators.rank import distributed_rank
from taufold.operators.subgroup import subgroup_means

POINTS = 10


def rank_by_score(df: DataFrame, unit_id: str, score: str, rank: str = "rank") -> DataFrame:
    """Rank 1..n by score, highest first, ties by unit key."""
    return distributed_rank(df, [F.col(score).desc_nulls_last(), F.col(unit_id)], rank=rank)


def targeting_curve(ranked: DataFrame, effect: str, rank: str = "rank", points: int = POINTS) -> DataFrame:
    """Mean effect of the top floor(i*n/points) units, i = 1..points.

    Each rank belongs to the first point that includes it; sums per point are
    combined map-side and only ``points`` rows reach the running sum.
    """
    n = ranked.count()
    if n == 0:
        raise ValueError("no units to rank")
    first_point = F.floor((F.col(rank) * points + (n - 1)) / n).cast("int")
    found = ranked.groupBy(first_point.alias("point")).agg(F.sum(effect).alias("s"), F.count(effect).alias("c"))
    grid = df_points(ranked, points)
    sums = grid.join(F.broadcast(found), "point", "left").na.fill(0, ["s", "c"])
    running = Window.partitionBy(F.lit(0)).orderBy("point").rowsBetween(Window.unboundedPreceding, 0)
    mean = F.try_divide(F.sum("s").over(running), F.sum("c").over(running))
    share = F.col("point") * (100.0 / points)
    return sums.select(share.cast("int").alias("top_percentile"), mean.alias("mean_effect"))


def df_points(ranked: DataFrame, points: int) -> DataFrame:
    return ranked.sparkSession.createDataFrame([(i,) for i in range(1, points + 1)], "point int")


def trapezoid(curve: DataFrame, x: str, y: str, out: str = "area") -> DataFrame:
    """Area under a curve of a few points."""
    before = Window.partitionBy(F.lit(0)).orderBy(x)
    step = (F.col(x) - F.lag(x).over(before)) * (F.col(y) + F.lag(y).over(before)) / 2.0
    return curve.select(step.alias("_step")).agg(F.sum("_step").alias(out))


def rate_summary(curve: DataFrame) -> DataFrame:
    """Area under the targeting curve with its error and 95 % limits, one row."""
    before = Window.partitionBy(F.lit(0)).orderBy("top_percentile")
    x, y = F.col("top_percentile") / 100.0, F.col("mean_effect")
    step = (x - F.lag(x).over(before)) * (y + F.lag(y).over(before)) / 2.0
    area = curve.select("mean_effect", step.alias("_step")).agg(
        F.sum("_step").alias("autoc"),
        (F.stddev_pop("mean_effect") / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("se"),
    )
    reach = Z95 * F.col("se")
    return area.select("autoc", "se", (F.col("autoc") - reach).alias("lower"), (F.col("autoc") + reach).alias("upper"))


def with_curve_band(curve: DataFrame, summary: DataFrame) -> DataFrame:
    """Curve points with the band of the area's error; ``summary`` is one row."""
    se = summary.first()["se"]
    reach = Z95 * se
    y = F.col("mean_effect")
    return curve.withColumns({"lower": y - reach, "upper": y + reach})


def top_share(ranked: DataFrame, share: float = 0.1, rank: str = "rank") -> DataFrame:
    """The first int(share * n) units."""
    return ranked.filter(F.col(rank) <= int(share * ranked.count()))


def top_share_subgroups(
    ranked: DataFrame, subgroups: Sequence[str], cate: str, share: float = 0.1, rank: str = "rank"
) -> DataFrame:
    top = top_share(ranked, share, rank)
    found = subgroup_means(top, subgroups, cate).select("subgroup_var", "subgroup_value", "mean", "n")
    return found.orderBy("subgroup_var", F.desc("mean"))
