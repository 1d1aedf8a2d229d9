"""Covariate balance, propensity scores and inverse-probability weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taufold.functions.labels import at_most
from taufold.functions.values import SMD_LIMIT, TRIM_PERCENTILE
from taufold.operators.impute import fill, means, modes
from taufold.operators.quantiles import exact_quantiles


def smd_table(df: DataFrame, treatment: str, numeric: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """Standardized mean difference of each covariate, largest first.

    Numeric: |mean1 - mean0| over the root of the mean sample variance, 0 where
    that is 0.  Flags: |share1 - share0|.  One scan and one aggregation by
    (covariate, arm), so the code is as short for a wide table as for a narrow one.
    """
    names = [*numeric, *flags]
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in names])
    long = df.filter(F.col(treatment).isin(0, 1)).select((F.col(treatment) == 1).alias("treated"), F.posexplode(values).alias("place", "x"))
    number = F.when(F.col("place") < len(numeric), F.col("x"))
    by_arm = long.groupBy("place", "treated").agg(F.avg("x").alias("mean"), F.var_samp(number).alias("var"))
    one = lambda c, arm: F.max(F.when(F.col("treated") == arm, F.col(c)))  # noqa: E731 - an arm has one row
    both = by_arm.groupBy("place").agg(
        F.abs(one("mean", True) - one("mean", False)).alias("gap"), F.sqrt((one("var", True) + one("var", False)) / 2.0).alias("pooled")
    )
    listed = df.sparkSession.createDataFrame([(k, c) for k, c in enumerate(names)], "place int, covariate string")
    scaled = F.when(F.col("pooled") > 0, F.try_divide("gap", "pooled")).otherwise(0.0)
    smd = F.when(F.col("place") < len(numeric), scaled).otherwise(F.col("gap"))
    return listed.join(both, "place", "left").select("covariate", smd.alias("smd")).orderBy(F.desc("smd"), "covariate")


def imbalanced(smd: DataFrame, limit: float = SMD_LIMIT) -> DataFrame:
    return smd.filter(F.col("smd") > limit)


def imbalanced_names(smd: DataFrame, limit: float = SMD_LIMIT) -> list[str]:
    """Names only: at most one per column of the table."""
    return [r["covariate"] for r in imbalanced(smd, limit).collect()]


def fit_propensity(
    df: DataFrame, treatment: str, numeric: Sequence[str], flags: Sequence[str] = (), c: float = 1.0, n: int | None = None
) -> tuple[LogisticRegressionModel, dict[str, object]]:
    """L2 logistic regression with penalty strength 1/c on the summed loss, after imputation."""
    values = {**means(df, numeric), **modes(df, flags)}
    rows = df.count() if n is None else n
    model = LogisticRegression(
        featuresCol="_x",
        labelCol=treatment,
        regParam=1.0 / (rows * c),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=1000,
        tol=1e-9,
    )
    return model.fit(_features(df, [*numeric, *flags], values, [treatment])), values


def _features(df: DataFrame, columns: Sequence[str], values: dict, keep: Sequence[str]) -> DataFrame:
    filled = fill(df, values).withColumns({f"_f{i}": F.col(f"`{c}`").cast("double") for i, c in enumerate(columns)})
    names = [f"_f{i}" for i in range(len(columns))]
    return VectorAssembler(inputCols=names, outputCol="_x").transform(filled).select(*keep, "_x")


def score_propensity(
    df: DataFrame, model: LogisticRegressionModel, values: dict, columns: Sequence[str], out: str = "e"
) -> DataFrame:
    keep = df.columns
    scored = model.transform(_features(df, columns, values, keep))
    return scored.select(*keep, vector_to_array("probability")[1].alias(out))


def iptw_weight(treatment: Column, e: Column) -> Column:
    """1/e for treated, 1/(1-e) for the others; NULL where the propensity rules the arm out."""
    return F.when(treatment == 1, F.try_divide(F.lit(1.0), e)).otherwise(F.try_divide(F.lit(1.0), 1.0 - e))


def trim_weights(df: DataFrame, weight: str, share: float = TRIM_PERCENTILE, cap: bool = False) -> DataFrame:
    """Drop units above the percentile, or cap their weight instead."""
    limit = exact_quantiles(df, weight, [share])[()][0]
    if cap:
        return df.withColumn(weight, at_most(F.col(weight), limit))
    return df.filter(F.col(weight) <= limit)


def effective_size(w: Column) -> Column:
    return F.pow(F.sum(w), 2) / F.sum(w * w)


def weight_summary(df: DataFrame, weight: str, sample_sd: bool = False) -> DataFrame:
    """Mean, sd, min, max and effective sample size in one pass."""
    w = F.col(weight)
    return df.agg(
        F.count(w).alias("n"),
        F.avg(w).alias("mean"),
        (F.stddev_samp(w) if sample_sd else F.stddev_pop(w)).alias("sd"),
        F.min(w).alias("min"),
        F.max(w).alias("max"),
        effective_size(w).alias("ess"),
    )
