"""Conditional effect models on MLlib forests, their intervals and tuning."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taufold.functions.numeric import hash32
from taufold.functions.values import FOREST_GRID, Z95
from taufold.operators.dr import arm_positions
from taufold.operators.fitting import fit_all
from taufold.operators.split import fold_of
from taufold.sources.stage import stage


@dataclass(frozen=True)
class ForestParams:
    num_trees: int = 100
    min_leaf: int = 5
    max_depth: int = 5
    sample_share: float = 0.5
    seed: int = 42

    def estimator(self, features: str, label: str, weight: str, trees: int | None = None, seed: int | None = None) -> Estimator:
        return RandomForestRegressor(
            featuresCol=features,
            labelCol=label,
            weightCol=weight,
            numTrees=trees or self.num_trees,
            maxDepth=self.max_depth,
            minInstancesPerNode=self.min_leaf,
            subsamplingRate=self.sample_share,
            # Each tree sees a share of the units drawn without replacement.
            bootstrap=False,
            seed=self.seed if seed is None else seed,
        )


def residual_targets(
    df: DataFrame,
    unit_id: str,
    treatment: str,
    outcome: str,
    outcome_model: Estimator,
    treatment_model: Estimator,
    weight: str | None = None,
    folds: int = 3,
    seed: int = 42,
) -> DataFrame:
    """Target and weight of the effect forest from cross-fitted outcome and treatment models.

    (T-e)^2 ((Y-m)/(T-e) - tau)^2 equals (Y - m - tau (T-e))^2, so the orthogonal
    loss is a weighted squared loss that any weighted regression tree fits.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    tagged = df.withColumns({"_fold": fold_of(F.col(unit_id), folds, seed), "_w": w, "_t": F.col(treatment).cast("double")})
    staged = stage(tagged, "residual-folds", partition_by=("_fold",))
    kept = [F.col(c) for c in staged.columns]
    jobs = []
    for f in range(folds):
        train = staged.filter(F.col("_fold") != f)
        jobs.append((outcome_model.copy({outcome_model.labelCol: outcome, outcome_model.weightCol: "_w"}), train))
        jobs.append((treatment_model.copy({treatment_model.labelCol: "_t", treatment_model.weightCol: "_w"}), train))
    models = fit_all(jobs)
    parts = []
    for f in range(folds):
        m_fit, t_fit = models[2 * f : 2 * f + 2]
        with_m = m_fit.transform(staged.filter(F.col("_fold") == f)).select(*kept, F.col("prediction").alias("m"))
        parts.append(t_fit.transform(with_m).select(*kept, "m", vector_to_array("probability")[1].alias("e")))
    crossed = reduce(DataFrame.unionByName, parts)
    gap = F.col("_t") - F.col("e")
    return crossed.withColumns(
        {
            "_target": F.try_divide(F.col(outcome).cast("double") - F.col("m"), gap),
            "_weight": F.col("_w") * gap * gap,
        }
    ).filter("_target is not null and _weight > 0")


@dataclass(frozen=True)
class EffectForest:
    """A forest for the point estimate and forests on half-samples for its spread."""

    model: Model
    halves: tuple[Model, ...]

    @staticmethod
    def fit(targets: DataFrame, unit_id: str, params: ForestParams, features: str = "features", groups: int = 0) -> EffectForest:
        data = stage(targets.select(unit_id, features, "_target", "_weight"), "effect-train")
        jobs = [(params.estimator(features, "_target", "_weight"), data)]
        for g in range(groups):
            half = data.filter(hash32(params.seed + 1 + g, F.col(unit_id)) % 2 == 0)
            trees = max(1, params.num_trees // groups)
            jobs.append((params.estimator(features, "_target", "_weight", trees, params.seed + 1 + g), half))
        model, *halves = fit_all(jobs)
        return EffectForest(model, tuple(halves))

    def effect(self, df: DataFrame, out: str = "cate") -> DataFrame:
        kept = df.columns
        return self.model.transform(df).select(*kept, F.col("prediction").alias(out))

    def effects(self, df: DataFrame, arms: Sequence) -> DataFrame:
        if len(arms) != 2:
            raise ValueError("the forest has one effect; there must be one non-control arm")
        return self.effect(df, effect_names(arms)[0])

    def effect_interval(self, df: DataFrame, out: str = "cate") -> DataFrame:
        """Estimate with lower and upper 95 % limit from the spread between half-sample forests."""
        if len(self.halves) < 2:
            raise ValueError("fit with at least two half-sample groups for an interval")
        scored = self.effect(df, out)
        for g, model in enumerate(self.halves):
            kept = scored.columns
            scored = model.transform(scored).select(*kept, F.col("prediction").alias(f"_g{g}"))
        names = [F.col(f"_g{g}") for g in range(len(self.halves))]
        mean = sum(names[1:], names[0]) / len(names)
        squares = [(n - mean) * (n - mean) for n in names]
        # Halves are drawn without replacement, so their spread around the full sample is its own variance.
        sd = F.sqrt(sum(squares[1:], squares[0]) / (len(names) - 1))
        limits = {f"{out}_lower": F.col(out) - Z95 * sd, f"{out}_upper": F.col(out) + Z95 * sd}
        return scored.withColumns(limits).select(*df.columns, out, f"{out}_lower", f"{out}_upper")


class EffectEstimator(Protocol):
    """What the scorer needs of a fitted effect model."""

    def effects(self, df: DataFrame, arms: Sequence) -> DataFrame:
        """``df`` plus one column of ``effect_names`` per non-control arm; the first arm is control."""


def effect_names(arms: Sequence) -> list[str]:
    return [f"_effect{k}" for k in range(1, len(arms))]


@dataclass(frozen=True)
class ArmModels:
    """One outcome model per arm (see ``t_learner``); an arm's effect is its prediction less the control's."""

    models: Mapping[object, Model]

    def effects(self, df: DataFrame, arms: Sequence) -> DataFrame:
        scored = df
        for k, arm in enumerate(arms):
            kept = scored.columns
            scored = self.models[arm].transform(scored).select(*kept, F.col("prediction").alias(f"_outcome{k}"))
        gains = [(F.col(f"_outcome{k}") - F.col("_outcome0")).alias(name) for k, name in enumerate(effect_names(arms), 1)]
        return scored.select(*df.columns, *gains)


def arm_effect(df: DataFrame, mu: Mapping[int, str], t0: int, t1: int, out: str = "effect") -> DataFrame:
    """Effect of arm t1 against arm t0 from per-arm outcome predictions."""
    return df.withColumn(out, F.col(mu[t1]) - F.col(mu[t0]))


def t_learner(df: DataFrame, treatment: str, outcome: str, arms: Sequence[int], regression: Estimator) -> dict[int, Model]:
    """One outcome model per arm."""
    staged = stage(df, "t-learner")
    model = regression.copy({regression.labelCol: outcome})
    return dict(zip(arms, fit_all([(model, staged.filter(F.col(treatment) == a)) for a in arms])))


def dr_learner(long: DataFrame, regression: Estimator, score: str = "dr") -> dict[int, Model]:
    """One regression of the doubly-robust score on the features per non-control arm."""
    staged = stage(long, "dr-learner")
    arms = arm_positions(staged, "arm")
    model = regression.copy({regression.labelCol: score})
    return dict(zip(arms, fit_all([(model, staged.filter(F.col("arm") == a)) for a in arms])))


def predict_arms(df: DataFrame, models: Mapping[int, Model], prefix: str) -> DataFrame:
    """One prediction column <prefix><arm> per model."""
    out = df
    for arm, model in models.items():
        kept = out.columns
        out = model.transform(out).select(*kept, F.col("prediction").alias(f"{prefix}{arm}"))
    return out


def proxy_score(df: DataFrame, cate: str, treatment: str, outcome: str, fold: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared gap between outcome and cate * treatment, averaged over folds (of each group ``by``)."""
    gap = F.col(outcome).cast("double") - F.col(cate) * F.col(treatment)
    per_fold = df.groupBy(*by, fold).agg(F.avg(gap * gap).alias("mse"))
    return per_fold.groupBy(*by).agg(F.avg("mse").alias("score"))


def residual_score(df: DataFrame, cate: str, fold: str, by: Sequence[str] = ()) -> DataFrame:
    """Orthogonal loss of the effect, averaged over folds (of each group ``by``)."""
    gap = F.col("_target") - F.col(cate)
    per_fold = df.groupBy(*by, fold).agg((F.sum(F.col("_weight") * gap * gap) / F.count(F.lit(1))).alias("mse"))
    return per_fold.groupBy(*by).agg(F.avg("mse").alias("score"))


def grid_points(grid: Mapping[str, Sequence] = FOREST_GRID) -> list[ForestParams]:
    names = list(grid)
    return [ForestParams(**dict(zip(names, point))) for point in itertools.product(*grid.values())]


def tune_forest(
    targets: DataFrame,
    unit_id: str,
    treatment: str,
    outcome: str,
    points: Sequence[ForestParams],
    folds: int = 5,
    seed: int = 42,
    loss: str = "proxy",
) -> DataFrame:
    """Cross-validated score of every grid point, best first.

    ``loss`` is 'proxy' (outcome against cate * treatment) or 'residual'.  The
    targets are staged once, partitioned by fold; every fit is a distributed job,
    and one plan scores all points.
    """
    if loss not in ("proxy", "residual"):
        raise ValueError(f"unknown loss {loss!r}")
    tagged = targets.withColumn("_cv", fold_of(F.col(unit_id), folds, seed + 1))
    columns = [unit_id, "features", "_target", "_weight", treatment, outcome, "_cv"]
    staged = stage(tagged.select(*columns), "tuning", partition_by=("_cv",))
    jobs = [
        (point.estimator("features", "_target", "_weight"), staged.filter(F.col("_cv") != f))
        for point in points
        for f in range(folds)
    ]
    models = fit_all(jobs)
    parts = []
    for f in range(folds):
        scored = staged.filter(F.col("_cv") == f)
        for number in range(len(points)):
            scored = models[number * folds + f].setPredictionCol(f"_c{number}").transform(scored)
        cells = [F.struct(F.lit(number).alias("point"), F.col(f"_c{number}").alias("cate")) for number in range(len(points))]
        parts.append(scored.select("_cv", "_target", "_weight", treatment, outcome, F.inline(F.array(*cells))))
    scored = reduce(DataFrame.unionByName, parts)
    by = ("point",)
    scores = proxy_score(scored, "cate", treatment, outcome, "_cv", by) if loss == "proxy" else residual_score(scored, "cate", "_cv", by)
    # As many rows as grid points.
    found = {r["point"]: r["score"] for r in scores.collect()}
    rows = [(k, p.num_trees, p.min_leaf, p.max_depth, p.sample_share, found.get(k)) for k, p in enumerate(points)]
    schema = T.StructType(
        [
            T.StructField("point", T.IntegerType()),
            T.StructField("num_trees", T.IntegerType()),
            T.StructField("min_leaf", T.IntegerType()),
            T.StructField("max_depth", T.IntegerType()),
            T.StructField("sample_share", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return targets.sparkSession.createDataFrame(rows, schema).orderBy("score", "point")
