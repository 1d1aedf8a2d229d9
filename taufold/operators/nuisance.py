"""Cross-fitted and train-fitted nuisance models.

The staged table is partitioned by fold, so that fitting on "all but f" and
scoring "f" prune directories: scoring all folds reads the table once in total.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taufold.functions.labels import first_match
from taufold.operators.fitting import fit_all
from taufold.sources.stage import stage


def mu_names(arms: Sequence[int]) -> list[str]:
    return [f"mu{k}" for k in range(len(arms))]


def e_names(arms: Sequence[int]) -> list[str]:
    return [f"e{k}" for k in range(len(arms))]


def _with_position(df: DataFrame, treatment: str, arms: Sequence[int]) -> DataFrame:
    """Arm position 0..K as the class label, whatever the arm values are."""
    position = first_match((F.col(treatment) == arm, float(k)) for k, arm in enumerate(arms))
    return df.withColumn("_position", position)


def _jobs(
    train: DataFrame, outcome: str, arms: Sequence[int], regression: Estimator, propensity: Estimator
) -> list[tuple[Estimator, DataFrame]]:
    """The propensity fit, then one outcome fit per arm."""
    jobs = [(propensity.copy({propensity.labelCol: "_position"}), train)]
    for k in range(len(arms)):
        own = train.filter(F.col("_position") == float(k))
        jobs.append((regression.copy({regression.labelCol: outcome}), own))
    return jobs


def _score(df: DataFrame, models: Sequence[Model], arms: Sequence[int]) -> DataFrame:
    kept: list[Column] = [F.col(c) for c in df.columns]
    out = df
    probability = vector_to_array(F.col("probability"))
    out = models[0].transform(out).select(*kept, *[probability[k].alias(n) for k, n in enumerate(e_names(arms))])
    for k, name in enumerate(mu_names(arms)):
        kept = [F.col(c) for c in out.columns]
        out = models[k + 1].transform(out).select(*kept, F.col("prediction").alias(name))
    return out


def fit_predict(
    train: DataFrame,
    val: DataFrame,
    treatment: str,
    outcome: str,
    arms: Sequence[int],
    regression: Estimator,
    propensity: Estimator,
) -> DataFrame:
    """Models from the training units, predictions mu0.. and e0.. for the validation units."""
    labelled = stage(_with_position(train, treatment, arms), "nuisance-train")
    return _score(val, fit_all(_jobs(labelled, outcome, arms, regression, propensity)), arms)


def cross_fit(
    df: DataFrame,
    fold: str,
    folds: int,
    treatment: str,
    outcome: str,
    arms: Sequence[int],
    regression: Estimator,
    propensity: Estimator,
) -> DataFrame:
    """Each unit is scored by models that did not see its fold: adds mu0.. and e0.. columns."""
    # Rows of a fold meet before the write, so a fold is a few files and not one of every task.
    placed = _with_position(df, treatment, arms)
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c != fold and isinstance(df.schema[c].dataType, T.AtomicType)]), F.lit(16))
    staged = stage(placed.repartition(fold, spread), "folds", partition_by=(fold,))
    stray = staged.filter(F.col(fold).isNull() | ~F.col(fold).between(0, folds - 1)).limit(1).collect()
    if stray:
        raise ValueError(f"column {fold!r} has a value outside 0..{folds - 1}: {stray[0][fold]!r}")
    jobs = []
    for f in range(folds):
        jobs += _jobs(staged.filter(F.col(fold) != f), outcome, arms, regression, propensity)
    models = fit_all(jobs)
    per_fold = len(arms) + 1
    parts = [
        _score(staged.filter(F.col(fold) == f), models[f * per_fold : (f + 1) * per_fold], arms) for f in range(folds)
    ]
    return reduce(DataFrame.unionByName, parts).drop("_position")
