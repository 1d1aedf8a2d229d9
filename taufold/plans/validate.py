"""Validation of effect predictions: nuisances, doubly-robust scores and the four tests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taufold.functions.labels import round_even
from taufold.operators.calibration import calibration_groups, calibration_score, group_cuts
from taufold.operators.cate import EffectEstimator, effect_names
from taufold.operators.dr import arm_positions, average_effect, dr_long
from taufold.operators.linear import blp_test
from taufold.operators.nuisance import cross_fit, e_names, fit_predict, mu_names
from taufold.operators.split import with_folds, with_stratified_folds
from taufold.operators.uplift import (
    PERCENTILES,
    bucket_moments,
    curve_with_bands,
    thresholds,
    uniform_bands,
    uplift_coefficient,
    uplift_curve,
)
from taufold.sources.stage import stage


@dataclass(frozen=True)
class Validation:
    """Long tables (unit, arm, dr, cate); ``train`` is None without training units."""

    arms: tuple
    val: DataFrame
    train: DataFrame | None = None

    @property
    def n_arms(self) -> int:
        return len(self.arms) - 1

    def average_effect(self) -> DataFrame:
        return average_effect(self.val)

    def blp(self) -> DataFrame:
        return blp_test(self.val, self.n_arms)

    def calibration(self, groups: int = 4) -> tuple[DataFrame, DataFrame]:
        """(scores per arm, group table)."""
        table = calibration_groups(self.val, group_cuts(self._train("calibration"), groups))
        return calibration_score(table), table

    def moments(self, percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
        cuts = thresholds(self._train("uplift"), percentiles)
        return stage(bucket_moments(self.val, cuts), "moments")

    def uplift(
        self, metric: str = "qini", percentiles: Sequence[float] = PERCENTILES, replicates: int = 1000, seed: int = 0
    ) -> tuple[DataFrame, DataFrame]:
        """(coefficients per arm, curve with band multipliers)."""
        m = self.moments(percentiles)
        bands = uniform_bands(m, percentiles, metric, replicates, seed)
        return uplift_coefficient(m, percentiles, metric), curve_with_bands(uplift_curve(m, percentiles, metric), bands)

    def evaluate_all(self, groups: int = 4, digits: int | None = 3) -> DataFrame:
        """One row per arm with all tests."""
        m = self.moments()
        return combined_summary(
            self.blp(),
            uplift_coefficient(m, metric="qini"),
            uplift_coefficient(m, metric="toc"),
            self.calibration(groups)[0],
            digits,
        )

    def _train(self, what: str) -> DataFrame:
        if self.train is None:
            raise ValueError(f"the {what} test needs scored training units")
        return self.train


def combined_summary(blp: DataFrame, qini: DataFrame, toc: DataFrame, cal: DataFrame, digits: int | None = 3) -> DataFrame:
    """Inner joins of the per-arm summaries; each has one row per arm, so they are broadcast."""
    qini = qini.select("treatment", *[F.col(c).alias(f"qini_{c}") for c in ("est", "se", "pval")])
    toc = toc.select("treatment", *[F.col(c).alias(f"autoc_{c}") for c in ("est", "se", "pval")])
    cal = cal.select("treatment", "cal_r_squared")
    out = reduce(lambda left, right: left.join(F.broadcast(right), "treatment"), [blp, qini, toc, cal])
    if digits is None:
        return out
    return out.withColumns({c: round_even(F.col(c), digits) for c in out.columns if c != "treatment"})


@dataclass(frozen=True)
class DRScorer:
    """Any pyspark.ml regressor and probabilistic classifier as nuisance models.

    ``cate`` names the prediction columns already in the tables, one per
    non-control arm, or is a fitted estimator whose ``effects(df, arms)`` adds
    them.  Folds are even within each arm, or plain hash folds without
    ``stratified``, or an own column ``fold`` with values 0..folds-1.
    """

    regression: Estimator
    propensity: Estimator
    cate: tuple[str, ...] | EffectEstimator
    folds: int = 5
    seed: int = 123
    stratified: bool = True
    fold: str | None = None

    def fit(
        self, val: DataFrame, unit_id: str, treatment: str, outcome: str, train: DataFrame | None = None
    ) -> Validation:
        """Cross-fit within ``val``, or fit on ``train`` and apply to ``val``."""
        arms = arm_positions(val, treatment)
        if isinstance(self.cate, tuple) and len(self.cate) != len(arms) - 1:
            raise ValueError("need one prediction column per non-control arm")
        if train is None:
            crossed = self._cross(val, unit_id, treatment, outcome, arms)
            return Validation(tuple(arms), self._scores(crossed, unit_id, treatment, outcome, arms))
        scored = fit_predict(train, val, treatment, outcome, arms, self.regression, self.propensity)
        crossed = self._cross(train, unit_id, treatment, outcome, arms)
        return Validation(
            tuple(arms),
            self._scores(scored, unit_id, treatment, outcome, arms),
            self._scores(crossed, unit_id, treatment, outcome, arms),
        )

    def _cross(self, df: DataFrame, unit_id: str, treatment: str, outcome: str, arms: Sequence) -> DataFrame:
        if self.fold:
            tagged = df.withColumn("_fold", F.col(self.fold))
        elif self.stratified:
            tagged = with_stratified_folds(df, unit_id, treatment, self.folds, self.seed, "_fold")
        else:
            tagged = with_folds(df, unit_id, self.folds, self.seed, "_fold")
        return cross_fit(tagged, "_fold", self.folds, treatment, outcome, arms, self.regression, self.propensity)

    def _scores(self, df: DataFrame, unit_id: str, treatment: str, outcome: str, arms: Sequence) -> DataFrame:
        cate = self.cate
        if not isinstance(cate, tuple):
            df, cate = cate.effects(df, arms), effect_names(arms)
        long = dr_long(df, outcome, treatment, arms, mu_names(arms), e_names(arms), cate, keep=[unit_id])
        return stage(long, "dr")
