"""Effect forests on shared histograms: nested cross-fitting and tuning in a few passes.

All nuisance trees of the fold lattice (tuning fold x nuisance fold) grow side by
side on one binned table, then all effect trees of all grid points and tuning
folds.  No unit takes part in a nuisance model of its own fold, and no validation
unit in any model it is scored with.  Effect trees split on moments: the gain of a
split compares sum (Y - m)(T - e) / sum (T - e)^2 of the two sides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taufold.functions.numeric import poisson_steps
from taufold.functions.values import Z95
from taufold.operators.cate import ForestParams
from taufold.operators.histogram_trees import MAX_BINS, Trees, TreeSpec, binned, entries, feature_cuts, grow, row_slices
from taufold.operators.split import fold_of, with_draws
from taufold.sources.stage import stage


@dataclass(frozen=True)
class NuisanceTrees:
    """Forests of the outcome and the treatment; a single tree sees every unit once, several see bootstrap counts."""

    num_trees: int = 20
    max_depth: int = 5
    min_leaf: int = 5


def _forest_mean(trees: Trees, bins: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Mean prediction of some trees per row; trees without rows don't count, NaN where none counts."""
    values = trees.value[trees.leaves(bins, which), 0]
    known = np.isfinite(values)
    total = np.where(known, values, 0.0).sum(axis=1)
    return np.divide(total, known.sum(axis=1), out=np.full(len(bins), np.nan), where=known.any(axis=1))


def _prepared(
    df: DataFrame, unit_id: str, treatment: str, outcome: str, features: str, weight: str | None, folds: int, nuisance_folds: int, seed: int
) -> DataFrame:
    kind = dict(df.dtypes)[features]
    values = F.col(features) if kind.startswith("array") else vector_to_array(F.col(features))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y, t = F.col(outcome).cast("double"), F.col(treatment).cast("double")
    cv = fold_of(F.col(unit_id), folds, seed + 1) if folds > 1 else F.lit(-2)
    tagged = df.select(
        F.col(unit_id).alias("unit"),
        values.alias("features"),
        y.alias("y"),
        t.alias("t"),
        w.alias("w"),
        F.array(cv.cast("int"), fold_of(F.col(unit_id), nuisance_folds, seed + 2).cast("int")).alias("folds"),
    )
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tagged.filter("y IS NOT NULL AND t IS NOT NULL AND w > 0").repartition(spread, "unit")


def residual_moments(table: DataFrame, trees: Trees, folds: int, nuisance_folds: int, nuisances: int) -> DataFrame:
    """(bins, draws, folds, den, num, y, t): the moments of the residuals, one target per tuning fold.

    Tree numbers run over (tuning fold, nuisance fold, outcome or treatment, tree).
    Where a nuisance has no value, or no variation is left, the unit doesn't count.
    """
    shared = table.sparkSession.sparkContext.broadcast(trees)
    tree = np.arange(folds * nuisance_folds * 2 * nuisances).reshape(folds, nuisance_folds, 2, nuisances)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for bins, part in row_slices(batches, len(own.cuts), folds * 2 * nuisances):
            group = entries(part.column(2), np.int64)[:, 1]
            y, t, w = (part.column(c).to_numpy()[:, None] for c in (3, 4, 5))
            found = np.full((2, part.num_rows, folds), np.nan)
            for g in np.unique(group).tolist():
                rows = np.flatnonzero(group == g)
                for f in range(folds):
                    for kind in range(2):
                        found[kind, rows, f] = _forest_mean(own, bins[rows], tree[f, g, kind])
            gap, rest = t - found[1], y - found[0]
            den, num = w * gap * gap, w * gap * rest
            sound = np.isfinite(den) & np.isfinite(num) & (den > 0)
            cuts = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * folds)
            moments = [pa.ListArray.from_arrays(cuts, pa.array(np.where(sound, x, 0.0).reshape(-1))) for x in (den, num)]
            yield pa.record_batch([*part.columns[:3], *moments, *part.columns[3:5]], ["bins", "draws", "folds", "den", "num", "y", "t"])

    kinds = "bins binary, draws array<tinyint>, folds array<int>, den array<double>, num array<double>, y double, t double"
    return table.select("bins", "draws", "folds", "y", "t", "w").mapInArrow(scan, kinds)


def tune_nested(
    df: DataFrame,
    unit_id: str,
    treatment: str,
    outcome: str,
    points: Sequence[ForestParams],
    features: str = "features",
    weight: str | None = None,
    nuisance: NuisanceTrees = NuisanceTrees(),
    folds: int = 5,
    nuisance_folds: int = 3,
    seed: int = 42,
    max_bins: int = MAX_BINS,
) -> DataFrame:
    """(point, num_trees, min_leaf, max_depth, sample_share, score) of every grid point, best first.

    Within each tuning fold the nuisances are fitted anew on the other folds'
    units, cross-fitted over ``nuisance_folds``; each point's forest is fitted on
    those units' residuals; ``score`` is the mean squared gap between outcome
    and effect * treatment of the fold left out, averaged over the folds.  Units
    without outcome, treatment, features or a positive weight are left out.  The
    jobs are the depths of nuisance and effect trees and a few scans, however
    many points, folds and trees there are.
    """
    spark = df.sparkSession
    base = stage(_prepared(df, unit_id, treatment, outcome, features, weight, folds, nuisance_folds, seed).filter("features IS NOT NULL"), "tuning-units")
    cuts = feature_cuts(base, "features", max_bins)
    shares = sorted({p.sample_share for p in points})
    most = max(p.num_trees for p in points)
    steps, bootstrap = np.array(poisson_steps()), nuisance.num_trees > 1

    def decide(u: np.ndarray) -> np.ndarray:
        own, effect = u[:, : nuisance.num_trees], u[:, nuisance.num_trees :]
        counts = np.searchsorted(steps, own, "right") if bootstrap else np.ones(own.shape, np.int64)
        return np.concatenate([counts, *(effect < share for share in shares)], axis=1)

    keys = [*(f"n{j}" for j in range(nuisance.num_trees)), *(f"e{j}" for j in range(most))]
    drawn = with_draws(base, "unit", seed, keys, decide, width=nuisance.num_trees + len(shares) * most)
    w = F.col("w")
    drawn = drawn.withColumns({"den": F.array(w, w), "num": F.array(w * F.col("y"), w * F.col("t"))})
    table = stage(binned(drawn, "features", cuts, ["draws", "folds", "den", "num", "y", "t", "w"]), "tuning-bins")
    lattice = [
        TreeSpec(j, kind, nuisance.max_depth, nuisance.min_leaf, (f, g))
        for f in range(folds)
        for g in range(nuisance_folds)
        for kind in range(2)
        for j in range(nuisance.num_trees)
    ]
    trees = grow(table, lattice, cuts)
    residuals = stage(residual_moments(table, trees, folds, nuisance_folds, nuisance.num_trees), "tuning-residuals")
    specs, first = [], []
    for p in points:
        variant = nuisance.num_trees + shares.index(p.sample_share) * most
        first.append(len(specs))
        specs += [TreeSpec(variant + j, f, p.max_depth, p.min_leaf, (f, -1)) for f in range(folds) for j in range(p.num_trees)]
    grown = grow(residuals, specs, cuts)
    forests = spark.sparkContext.broadcast(grown)
    sizes = [p.num_trees for p in points]
    # Points whose trees came out alike are scored once.
    alike = grown.alike()
    forest_of = {(k, f): tuple(alike[first[k] + f * size + np.arange(size)].tolist()) for k, size in enumerate(sizes) for f in range(folds)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = forests.value
        squares, units = np.zeros((len(sizes), folds)), np.zeros((len(sizes), folds), np.int64)
        for bins, part in row_slices(batches, len(cuts), max(sizes)):
            fold, y, t = entries(part.column(1), np.int64)[:, 0], part.column(2).to_numpy(), part.column(3).to_numpy()
            for f in np.unique(fold).tolist():
                rows = np.flatnonzero(fold == f)
                sums: dict[tuple[int, ...], tuple[float, int]] = {}
                for k in range(len(sizes)):
                    forest = forest_of[k, f]
                    if forest not in sums:
                        gap = y[rows] - t[rows] * _forest_mean(own, bins[rows], np.array(forest))
                        known = np.isfinite(gap)
                        sums[forest] = (gap[known] ** 2).sum(), known.sum()
                    squares[k, f] += sums[forest][0]
                    units[k, f] += sums[forest][1]
        point, fold = np.indices(units.shape)
        columns = [x.reshape(-1) for x in (point, fold, squares, units)]
        yield pa.record_batch([pa.array(c) for c in columns], ["point", "fold", "squares", "units"])

    sums = residuals.select("bins", "folds", "y", "t").mapInArrow(score, "point long, fold long, squares double, units long")
    per_fold = sums.groupBy("point", "fold").agg(F.try_divide(F.sum("squares"), F.sum("units")).alias("mse"))
    scores = per_fold.groupBy("point").agg(F.avg("mse").alias("score"))
    rows = [(k, p.num_trees, p.min_leaf, p.max_depth, p.sample_share) for k, p in enumerate(points)]
    grid = spark.createDataFrame(rows, "point int, num_trees int, min_leaf int, max_depth int, sample_share double")
    return grid.join(scores, "point", "left").orderBy(F.asc_nulls_last("score"), "point")


def bag_spread(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sampling variance of predictions (rows, groups, trees of a group).

    The variance between groups, less what a group's few trees add to it, and at least 0.
    """
    means = values.mean(axis=2)
    spread = means.var(axis=1, ddof=1)
    if values.shape[2] > 1:
        spread = np.maximum(spread - values.var(axis=2, ddof=1).mean(axis=1) / values.shape[2], 0.0)
    return means.mean(axis=1), spread


@dataclass(frozen=True)
class EffectBags:
    """An effect forest in little bags: each group of trees shares a half-sample of the units.

    Halves are drawn without replacement, so the variance between the groups'
    means is that of the estimate plus the noise of a group's few trees; the
    latter is estimated within the groups and taken off, down to zero.
    """

    trees: Trees
    groups: int
    size: int

    def _scored(self, df: DataFrame, features: str, names: Sequence[str]) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.trees)
        groups, size = self.groups, self.size

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            step = max(16, (1 << 20) // (groups * size))
            for batch in batches:
                for low in range(0, batch.num_rows, step):
                    part = batch.slice(low, step)
                    bins = own.binned(entries(part.column(0), np.float64))
                    values = own.value[own.leaves(bins), 0].reshape(part.num_rows, groups, size)
                    effect, spread = bag_spread(values)
                    reach = Z95 * np.sqrt(spread)
                    found = (effect, effect - reach, effect + reach)
                    yield pa.record_batch([*part.columns[1:], *map(pa.array, found)], [*part.schema.names[1:], *names])

        kind = dict(df.dtypes)[features]
        values = F.col(features) if kind.startswith("array") else vector_to_array(F.col(features))
        source = df.select(values.alias("_values"), *[c for c in df.columns if c != features])
        return source.mapInArrow(scan, T.StructType([*source.schema.fields[1:], *(T.StructField(n, T.DoubleType()) for n in names)]))

    def effect_interval(self, df: DataFrame, features: str = "features", out: str = "cate") -> DataFrame:
        """The columns of ``df`` but ``features``, with the effect and its 95 % limits."""
        return self._scored(df, features, (out, f"{out}_lower", f"{out}_upper"))


def fit_effect_bags(
    df: DataFrame,
    unit_id: str,
    treatment: str,
    outcome: str,
    params: ForestParams,
    size: int = 4,
    features: str = "features",
    weight: str | None = None,
    nuisance: NuisanceTrees = NuisanceTrees(),
    nuisance_folds: int = 3,
    max_bins: int = MAX_BINS,
) -> EffectBags:
    """An effect forest of ``params.num_trees`` trees in groups of ``size``, from cross-fitted residuals.

    A tree draws ``params.sample_share`` of all units, at most half, from its
    group's half-sample.  Units without outcome, treatment, features or a
    positive weight are left out.
    """
    groups = params.num_trees // size
    if groups < 2 or params.sample_share > 0.5:
        raise ValueError("little bags need two groups of trees at least, and samples of half the units at most")
    base = _prepared(df, unit_id, treatment, outcome, features, weight, 1, nuisance_folds, params.seed).filter("features IS NOT NULL")
    base = stage(base, "effect-units")
    cuts = feature_cuts(base, "features", max_bins)
    steps, bootstrap = np.array(poisson_steps()), nuisance.num_trees > 1

    def decide(u: np.ndarray) -> np.ndarray:
        own, halves, trees = np.split(u, [nuisance.num_trees, nuisance.num_trees + groups], axis=1)
        counts = np.searchsorted(steps, own, "right") if bootstrap else np.ones(own.shape, np.int64)
        return np.concatenate([counts, np.repeat(halves < 0.5, size, axis=1) & (trees < 2 * params.sample_share)], axis=1)

    keys = [f"{kind}{j}" for kind, n in (("n", nuisance.num_trees), ("g", groups), ("e", groups * size)) for j in range(n)]
    drawn = with_draws(base, "unit", params.seed, keys, decide, width=nuisance.num_trees + groups * size)
    w = F.col("w")
    drawn = drawn.withColumns({"den": F.array(w, w), "num": F.array(w * F.col("y"), w * F.col("t"))})
    table = stage(binned(drawn, "features", cuts, ["draws", "folds", "den", "num", "y", "t", "w"]), "effect-bins")
    lattice = [
        TreeSpec(j, kind, nuisance.max_depth, nuisance.min_leaf, (-1, g))
        for g in range(nuisance_folds)
        for kind in range(2)
        for j in range(nuisance.num_trees)
    ]
    residuals = residual_moments(table, grow(table, lattice, cuts), 1, nuisance_folds, nuisance.num_trees)
    residuals = stage(residuals, "effect-residuals")
    specs = [TreeSpec(nuisance.num_trees + j, 0, params.max_depth, params.min_leaf) for j in range(groups * size)]
    return EffectBags(grow(residuals, specs, cuts), groups, size)
