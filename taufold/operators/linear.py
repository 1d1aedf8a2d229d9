"""Least squares on any number of units: one triangular factor is the only thing collected."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taufold.functions.labels import at_least, is_finite, round_even, stars
from taufold.functions.numeric import student_two_sided, two_sided_p
from taufold.functions.values import SIGNIFICANCE

#: Scaled singular values below this share of the largest count as zero.
RANK_LIMIT = 1e-9
#: Factors merged by one task of the last level.
LAST_FAN = 32


def _factor(width: int, rows_of: Callable[[np.ndarray], np.ndarray]):
    """A task's work: the triangular factor of all rows it sees, batch after batch, as rows of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            matrix = rows_of(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width))
            factor = np.linalg.qr(matrix if factor is None else np.vstack([factor, matrix]), mode="r")
        if factor is not None:
            offsets = pa.array(np.arange(len(factor) + 1) * factor.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(factor.ravel(), pa.float64()))], names=["row"])

    return run


def _triangular_factor(df: DataFrame, columns: Sequence[str], rows_of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """R of the QR factorisation of the matrix that ``rows_of`` makes of all rows of ``columns``.

    R has ``width`` columns, however many units there are.  Each task sends its
    own factor, at most ``width`` rows; factors are stacked and factored again
    along a tree, so a task holds one factor and one batch.  The driver gets one.
    """
    rows = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("row"))
    found = rows.mapInArrow(_factor(len(columns), rows_of), "row array<double>")
    merge = _factor(width, lambda stacked: stacked)
    part = F.spark_partition_id()
    for key in (part, part % LAST_FAN, F.lit(0)):
        dealt = found.withColumn("part", key)
        found = dealt.repartition("part").select("row").mapInArrow(merge, "row array<double>")
    factor = np.array([r["row"] for r in found.collect()])
    if not len(factor):
        raise ValueError("no units for the regression")
    return np.vstack([factor, np.zeros((width - len(factor), width))])


@dataclass(frozen=True)
class LinearFit:
    """``undetermined``: directions (columns) along which the terms may move without changing any fitted value."""

    terms: tuple[str, ...]
    estimate: np.ndarray
    std_error: np.ndarray
    n: int
    r_squared: float
    covariance: np.ndarray
    undetermined: np.ndarray

    def table(self, df: DataFrame, digits: int | None = None) -> DataFrame:
        """(term, estimate, std_error, z_value, p_value, stars): one row per term."""
        found = zip(self.terms, self.estimate, self.std_error)
        return self._rows(df, "term", ((name, float(b), float(s)) for name, b, s in found), digits)

    def contrasts(self, df: DataFrame, wanted: Mapping[str, Mapping[str, float]], digits: int | None = None) -> DataFrame:
        """(contrast, estimate, std_error, z_value, p_value, stars): weighted sums of terms, one row per name.

        All but the name is NULL where dependent columns leave the sum open.
        """
        place = {term: k for k, term in enumerate(self.terms)}
        rows = []
        for name, weights in wanted.items():
            w = np.zeros(len(self.terms))
            for term, weight in weights.items():
                w[place[term]] += weight
            if np.linalg.norm(w @ self.undetermined) > 1e-7 * np.linalg.norm(w):
                rows.append((name, None, None))
            else:
                rows.append((name, float(w @ self.estimate), float(math.sqrt(max(w @ self.covariance @ w, 0.0)))))
        return self._rows(df, "contrast", rows, digits)

    def _rows(self, df: DataFrame, label: str, found: Iterable[tuple], digits: int | None) -> DataFrame:
        rows = []
        for name, b, s in found:
            z = None if b is None else b / s if s > 0 else float("nan")
            rows.append((name, b, s, z, None if z is None else math.erfc(abs(z) / math.sqrt(2.0))))
        out = df.sparkSession.createDataFrame(rows, f"{label} string, estimate double, std_error double, z_value double, p_value double")
        if digits is not None:
            out = out.withColumns({c: round_even(F.col(c), digits) for c in ("estimate", "std_error", "z_value", "p_value")})
        return out.withColumn("stars", F.when(F.col("p_value").isNotNull(), stars(F.col("p_value"))))


def level_contrasts(bases: Mapping[str, str]) -> dict[str, dict[str, float]]:
    """Each flag of a covariate against the covariate's first flag; ``bases`` gives the covariate of a flag."""
    first: dict[str, str] = {}
    wanted = {}
    for term, covariate in bases.items():
        if first.setdefault(covariate, term) != term:
            wanted[f"{term} - {first[covariate]}"] = {term: 1.0, first[covariate]: -1.0}
    return wanted


def fit_ols(df: DataFrame, y: str, x: Sequence[str], robust: str = "HC3") -> LinearFit:
    """OLS of y on a constant and x with HC1, HC3 or plain standard errors.

    Two scans: the triangular factor of the design and the outcome, then that of
    the design weighted by the residuals.  No cross products are formed, so the
    rank is judged at full precision.  With dependent columns the estimates are
    the shortest solution; ``contrasts`` gives what the data do tell.  The driver
    holds a few matrices of terms x terms.
    """
    data = df.select(y, *x).dropna()
    # Sums are taken around the mean, or they would cancel where it is large against the spread.
    centre = data.agg(F.avg(y)).first()[0] or 0.0
    k = len(x) + 1

    def design(m: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(m)), m[:, 1:]])

    factor = _triangular_factor(data, [y, *x], lambda m: np.column_stack([design(m), m[:, 0] - centre]), k + 1)
    on_x, on_y = factor[:k, :k], factor[:k, k]
    n = int(round(on_x[0, 0] ** 2))
    # Rank is judged on columns of length 1, so that units of measurement do not matter.
    length = np.linalg.norm(on_x, axis=0)
    scaled = np.linalg.svd(on_x / np.where(length > 0, length, 1.0), compute_uv=False)
    rank = int(np.sum(scaled > RANK_LIMIT * scaled[0]))
    left, size, right = np.linalg.svd(on_x)
    root = right[:rank].T / size[:rank]
    # A singular design's shortest solution depends on the outcome's own level.
    shift = centre if rank == k else 0.0
    beta = root @ (left[:, :rank].T @ (on_y + (centre - shift) * on_x[:, 0]))

    def weighted(m: np.ndarray) -> np.ndarray:
        own = design(m)
        residual = m[:, 0] - shift - own @ beta
        leverage = ((own @ root) ** 2).sum(1) if robust == "HC3" else 0.0
        weight = residual / np.maximum(1.0 - leverage, 1e-12)
        return np.column_stack([own * weight[:, None], residual])

    spread = _triangular_factor(data, [y, *x], weighted, k + 1)
    if robust in ("HC1", "HC3"):
        scale = n / (n - rank) if robust == "HC1" else 1.0
        half = math.sqrt(scale) * spread[:, :k] @ root @ root.T
    else:
        half = math.sqrt(float(np.sum(spread[:, k] ** 2)) / (n - rank)) * root.T
    covariance = half.T @ half
    # The factor's first row belongs to the constant: the rest is the outcome about its mean.
    total, squared = float(np.sum(factor[1:, k] ** 2)), float(np.sum(spread[:, k] ** 2))
    beta[0] += shift
    error = np.sqrt(np.diag(covariance))
    fitted = float(1.0 - squared / total) if total > 0 else float("nan")
    return LinearFit(("const", *x), beta, error, n, fitted, covariance, right[rank:].T)


def projection_by_covariate(table: DataFrame, bases: Mapping[str, str]) -> DataFrame:
    """Mean estimate, mean error and least p of the terms of each covariate, without the constant.

    ``bases`` comes from the encoder: one row per term, so it is broadcast.
    """
    spark = table.sparkSession
    known = spark.createDataFrame(list(bases.items()), "term string, covariate string")
    named = table.filter("term <> 'const'").join(F.broadcast(known), "term", "left")
    grouped = (
        named.withColumn("covariate", F.coalesce("covariate", F.lit("Other")))
        .groupBy("covariate")
        .agg(F.avg("estimate").alias("estimate"), F.avg("std_error").alias("std_error"), F.min("p_value").alias("min_p"))
    )
    return grouped.withColumn("stars", stars(F.col("min_p")))


def significant_only(grouped: DataFrame, limit: float = SIGNIFICANCE) -> DataFrame:
    return grouped.filter(F.col("min_p") < limit)


def effect_slopes(long: DataFrame, score: str = "dr", cate: str = "cate", robust: bool = True) -> DataFrame:
    """Slope of the score on the predicted effect, one regression per arm, all in one plan.

    ``robust`` gives the HC1 error, from a second centred pass; otherwise the
    plain OLS error.  A constant prediction has no slope: estimate and error are NULL.
    """
    y, x = F.col(score), F.col(cate)
    per_arm = long.groupBy("arm").agg(
        F.regr_count(y, x).alias("n"),
        F.regr_avgx(y, x).alias("mean_x"),
        F.regr_avgy(y, x).alias("mean_y"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
    )
    sxx = F.when(F.col("sxx") > 0, F.col("sxx"))
    fitted = per_arm.withColumn("est", F.col("sxy") / sxx)
    n = F.col("n").cast("double")
    if not robust:
        rest = at_least(F.col("syy") - F.col("est") * F.col("sxy"), 0.0)
        return fitted.select("arm", "n", "est", F.sqrt(F.try_divide(rest, (n - 2.0) * sxx)).alias("se"))
    # One row per arm (see arm_positions), so the fitted side is broadcast.
    centred_x = x - F.col("mean_x")
    residual = y - F.col("mean_y") - F.col("est") * centred_x
    meat = (
        long.filter(y.isNotNull() & x.isNotNull())
        .join(F.broadcast(fitted), "arm")
        .groupBy("arm", "n", "est", "sxx")
        .agg(F.sum(F.pow(centred_x, 2) * F.pow(residual, 2)).alias("meat"))
    )
    se = F.sqrt(F.try_divide(n * F.col("meat"), (n - 2.0) * sxx * sxx))
    return meat.select("arm", "n", "est", se.alias("se"))


def blp_test(long: DataFrame, n_arms: int, score: str = "dr", cate: str = "cate") -> DataFrame:
    """Best-linear-predictor test: (treatment, blp_est, blp_se, blp_pval), one row per arm.

    A single arm is a plain OLS with Student p-values; several arms use HC1
    errors and normal p-values.
    """
    slopes = effect_slopes(long, score, cate, robust=n_arms > 1)
    if n_arms > 1:
        p = two_sided_p(F.try_divide(F.col("est"), F.col("se")))
        return slopes.select(
            F.col("arm").alias("treatment"), F.col("est").alias("blp_est"), F.col("se").alias("blp_se"), p.alias("blp_pval")
        )
    rows = []
    for r in slopes.collect():
        defined = r["est"] is not None and r["se"]
        p = student_two_sided(r["est"] / r["se"], r["n"] - 2) if defined else None
        rows.append((r["arm"], r["est"], r["se"], p))
    fields = [T.StructField("treatment", long.schema["arm"].dataType)]
    fields += [T.StructField(c, T.DoubleType()) for c in ("blp_est", "blp_se", "blp_pval")]
    return long.sparkSession.createDataFrame(rows, T.StructType(fields))


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose named columns are all present and finite."""
    kept = F.lit(True)
    for c in columns:
        kept = kept & is_finite(F.col(c).cast("double"))
    return df.filter(kept)
