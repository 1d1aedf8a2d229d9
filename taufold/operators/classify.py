"""Per-arm outcome models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taufold.functions.labels import binarize, by_arm
from taufold.functions.numeric import poisson_steps
from taufold.operators.histogram_trees import MAX_BINS, TreeSpec, binned, entries, feature_cuts, grow
from taufold.operators.split import with_draws
from taufold.sources.stage import stage


def outcome_forest(
    trees: int = 100, depth: int = 10, seed: int = 42, features: str = "features", bootstrap: bool = True, per_split: str = "sqrt"
) -> Estimator:
    """Probability forest for a 0/1 outcome.

    Variance of a 0/1 label is half its Gini impurity, so the splits are those of
    a classification forest, and a leaf mean is the leaf's share of ones.
    MLlib's classification trees merge leaves that predict the same class, which
    would flatten the probabilities.
    """
    return RandomForestRegressor(
        featuresCol=features, numTrees=trees, maxDepth=depth, seed=seed, bootstrap=bootstrap, featureSubsetStrategy=per_split
    )


def score_by_arm(
    fit_on: DataFrame, score_on: DataFrame, treatment: str, outcome: str, model: Estimator, cut: float = 0.5
) -> DataFrame:
    """Outcome probability of every unit under each arm, and under its own arm.

    ``model`` is a probabilistic classifier, or a regressor of the 0/1 outcome.
    The in-sample report fits and scores the same units; pass a test table as
    ``score_on`` for an honest one.
    """
    staged = stage(fit_on.withColumn("_label", F.col(outcome).cast("double")), "classify")
    out = score_on
    for arm in (1, 0):
        fitted = model.copy({model.labelCol: "_label"}).fit(staged.filter(F.col(treatment) == arm))
        kept = out.columns
        scored = fitted.transform(out)
        p = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
        out = scored.select(*kept, p.alias(f"mu{arm}"))
    own = by_arm(F.col(treatment), F.col("mu1"), F.col("mu0"))
    return out.withColumn("score", own).withColumn("predicted", binarize(F.col("score"), cut))


def forest_scores_by_arm(
    fit_on: DataFrame,
    score_on: DataFrame,
    unit_id: str,
    treatment: str,
    outcome: str,
    trees: int = 100,
    depth: int = 10,
    min_leaf: int = 1,
    seed: int = 42,
    features: str = "features",
    cut: float = 0.5,
    max_bins: int = MAX_BINS,
) -> DataFrame:
    """``score_by_arm`` with bootstrapped forests of both arms that grow together, one job a level.

    Trees count units by hashed Poisson draws and choose among all features.
    Units without outcome or features are not fitted on; an arm without units
    gives NULL.
    """
    values = lambda df: F.col(features) if dict(df.dtypes)[features].startswith("array") else vector_to_array(F.col(features))
    spread = int(fit_on.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    y, arm = F.col(outcome).cast("double"), F.col(treatment).cast("int")
    chosen = fit_on.select(F.col(unit_id).alias("unit"), values(fit_on).alias("x"), y.alias("y"), F.array(arm).alias("folds"))
    base = stage(chosen.filter("y IS NOT NULL AND x IS NOT NULL AND folds[0] IS NOT NULL").repartition(spread, "unit"), "classify")
    cuts = feature_cuts(base, "x", max_bins)
    steps = np.array(poisson_steps())
    drawn = with_draws(base, "unit", seed, range(trees), lambda u: np.searchsorted(steps, u, "right"))
    drawn = drawn.withColumns({"den": F.array(F.lit(1.0)), "num": F.array("y")})
    table = stage(binned(drawn, "x", cuts, ["draws", "folds", "den", "num"]), "classify-bins")
    specs = [TreeSpec(j, 0, depth, min_leaf, only=(a,)) for a in (1, 0) for j in range(trees)]
    shared = fit_on.sparkSession.sparkContext.broadcast(grow(table, specs, cuts))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        step = max(16, (1 << 20) // (2 * trees))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                found = own.value[own.leaves(own.binned(entries(part.column(0), np.float64))), 0].reshape(part.num_rows, 2, trees).mean(axis=2)
                scores = [pa.array(found[:, k], mask=~np.isfinite(found[:, k])) for k in range(2)]
                yield pa.record_batch([*part.columns[1:], *scores], [*part.schema.names[1:], "mu1", "mu0"])

    source = score_on.select(values(score_on).alias("_x"), *[c for c in score_on.columns if c != features])
    scores = [T.StructField(name, T.DoubleType()) for name in ("mu1", "mu0")]
    out = source.mapInArrow(scan, T.StructType([*source.schema.fields[1:], *scores]))
    own = by_arm(F.col(treatment), F.col("mu1"), F.col("mu0"))
    return out.withColumn("score", own).withColumn("predicted", binarize(F.col("score"), cut))
