"""Estimation: analysis table -> balance -> weights -> effect forest -> scored units."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taufold.operators.balance import (
    fit_propensity,
    imbalanced_names,
    iptw_weight,
    score_propensity,
    smd_table,
    trim_weights,
)
from taufold.operators.cate import EffectForest, ForestParams, residual_targets, tune_forest
from taufold.operators.encode import Preprocessor
from taufold.operators.split import train_test_split
from taufold.roles import Roles
from taufold.sources.stage import stage


def weigh_units(df: DataFrame, roles: Roles, smd_limit: float = 0.1) -> DataFrame:
    """(unit_id, weights): inverse-probability weights on the imbalanced covariates, trimmed."""
    known_flags = roles.flags or roles.categorical
    smd = smd_table(df, roles.treatment, roles.numeric, known_flags)
    wanted = imbalanced_names(smd, smd_limit)
    numeric = [c for c in wanted if c in roles.numeric]
    flags = [c for c in wanted if c in known_flags]
    if not wanted:
        raise ValueError(f"no covariate has a standardized difference above {smd_limit}")
    model, values = fit_propensity(df, roles.treatment, numeric, flags)
    scored = score_propensity(df, model, values, [*numeric, *flags])
    weighted = scored.select(roles.unit_id, iptw_weight(F.col(roles.treatment), F.col("e")).alias("weights"))
    return trim_weights(stage(weighted, "weights"), "weights")


def attach_weights(df: DataFrame, weights: DataFrame, roles: Roles) -> DataFrame:
    """Inner join: units trimmed from the weights leave the table too."""
    joined = df.join(weights, roles.unit_id, "inner")
    return joined.dropna(subset=[roles.treatment, roles.outcome, "weights"])


@dataclass(frozen=True)
class Estimate:
    preprocessor: Preprocessor
    forest: EffectForest
    scored_test: DataFrame


def estimate_effects(
    weighted: DataFrame,
    roles: Roles,
    params: ForestParams = ForestParams(),
    grid: Sequence[ForestParams] = (),
    interval_groups: int = 4,
    outcome_model: Estimator | None = None,
    treatment_model: Estimator | None = None,
) -> Estimate:
    """Split, fit the preprocessor and the effect forest on train, score test with limits."""
    train, test = train_test_split(stage(weighted, "weighted"), roles.unit_id)
    pre = Preprocessor.fit(train, roles.numeric, roles.categorical)
    passed = [roles.unit_id, roles.treatment, roles.outcome, "weights"]
    vectors = pre.vectors(train, keep=passed)
    targets = residual_targets(
        vectors,
        roles.unit_id,
        roles.treatment,
        roles.outcome,
        outcome_model or RandomForestRegressor(featuresCol="features", numTrees=100, maxDepth=10, seed=42),
        treatment_model or LogisticRegression(featuresCol="features", maxIter=1000),
        weight="weights",
    )
    # Tuning and the forest both read them; the nuisances should score the units once.
    targets = stage(targets, "targets")
    if grid:
        best = tune_forest(targets, roles.unit_id, roles.treatment, roles.outcome, grid).first()
        params = grid[best["point"]]
    forest = EffectForest.fit(targets, roles.unit_id, params, groups=interval_groups)
    test_vectors = pre.vectors(test, keep=test.columns)
    scored = forest.effect_interval(test_vectors) if interval_groups else forest.effect(test_vectors)
    return Estimate(pre, forest, scored.drop("features"))
