"""Bagged trees: out-of-bag and test error by round."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taufold.functions.labels import first_match
from taufold.functions.numeric import poisson_steps
from taufold.operators.histogram_trees import MAX_BINS, TreeSpec, binned, entries, feature_cuts, grow, row_slices
from taufold.operators.split import with_draws
from taufold.sources.stage import stage

#: Class labels that a classifier takes.
MAX_CLASSES = 1_000


def out_of_bag(df: DataFrame, sampled: DataFrame, unit_id: str) -> DataFrame:
    """Units that a sample left out."""
    return df.join(sampled.select(unit_id).distinct(), unit_id, "left_anti")


def vote_errors(votes: DataFrame, classes: Sequence[int], unit_id: str = "unit_id") -> DataFrame:
    """(round, error): share of the round's out-of-bag units whose majority vote is wrong.

    ``votes`` has a row (unit, round, prediction, label) for each round that left
    the unit out.  The vote counts all such rounds so far; ties go to the
    smallest class.  A unit has at most one row per round, so no window group
    grows with the data.
    """
    so_far = Window.partitionBy(unit_id).orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    counts = {f"_v{i}": F.count_if(F.col("prediction") == c).over(so_far) for i, c in enumerate(classes)}
    counted = votes.withColumns(counts)
    names = [F.col(f"_v{i}") for i in range(len(classes))]
    most = F.greatest(*names) if len(names) > 1 else names[0]
    majority = first_match((name == most, c) for name, c in zip(names, classes))
    wrong = (majority != F.col("label")).cast("double")
    return counted.groupBy("round").agg(F.avg(wrong).alias("error"))


def running_majority(votes: np.ndarray, known: np.ndarray, n_classes: int) -> np.ndarray:
    """Majority class after each of a row's votes (rows, rounds); those not ``known`` don't count; ties go to the smallest class."""
    counts = np.stack([np.cumsum((votes == c) & known, axis=1) for c in range(n_classes)])
    return counts.argmax(axis=0)


def _classes(df: DataFrame, label: str) -> list[float]:
    """The labels, which must be few."""
    found = sorted(r[0] for r in df.select(label).distinct().limit(MAX_CLASSES + 1).collect())
    if len(found) > MAX_CLASSES:
        raise ValueError(f"column {label!r} has more than {MAX_CLASSES} values; it is no class label")
    return found


def bagged_tree_errors(
    train: DataFrame,
    test: DataFrame,
    unit_id: str,
    label: str,
    rounds: int = 200,
    seed: int = 42,
    max_depth: int = 10,
    features: str = "features",
    max_bins: int = MAX_BINS,
) -> DataFrame:
    """(round, oob_error, test_error) for rounds 1..B.

    The trees of all rounds grow together, one job a level.  One more scan each
    of the training and the test units lets every row vote in all rounds, folds
    its running majority, and adds up wrong and all votes per round in its task:
    no row per unit and round leaves a task.  A round whose test error or
    out-of-bag error has no units has none.
    """
    kind = dict(train.dtypes)[features]
    values = F.col(features) if kind.startswith("array") else vector_to_array(F.col(features))
    prepared = [df.select(unit_id, values.alias("_features"), F.col(label).cast("double").alias("label")).filter("label IS NOT NULL") for df in (train, test)]
    # Every unit is drawn, binned and sent down in each round: worth spreading its few columns first.
    spread = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = stage(prepared[0].repartition(spread, unit_id), "bag-train")
    classes = _classes(base, "label")
    cuts = feature_cuts(base, "_features", max_bins)
    place = first_match((F.col("label") == c, k) for k, c in enumerate(classes)).cast("int")
    one_hot = F.array(*[(F.col("label") == c).cast("double") for c in classes])
    # Poisson(1) is the large-sample law of a bootstrap count, and a hash of the key draws alike on every layout.
    steps = np.array(poisson_steps())
    drawn = with_draws(base, unit_id, seed, range(1, rounds + 1), lambda u: np.searchsorted(steps, u, "right"))
    trained = drawn.withColumns({"folds": F.array().cast("array<int>"), "den": F.array(F.lit(1.0)), "num": one_hot, "place": place})
    table = stage(binned(trained, "_features", cuts, ["draws", "folds", "den", "num", "place"]), "bag-bins")
    specs = [TreeSpec(draw=b, max_depth=max_depth) for b in range(rounds)]
    trees = grow(table, specs, cuts, len(classes))
    shared = train.sparkSession.sparkContext.broadcast(trees)

    def errors(df: DataFrame, name: str, out_of_bag: bool) -> DataFrame:
        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            best = own.value.argmax(axis=1)  # ties go to the smallest class
            wrong, units = np.zeros(rounds, np.int64), np.zeros(rounds, np.int64)
            for bins, part in row_slices(batches, len(cuts), rounds):
                votes, truth = best[own.leaves(bins)], part.column(1).to_numpy(zero_copy_only=False)[:, None]
                known = np.ones(votes.shape, bool)
                if out_of_bag:
                    known = entries(part.column(2), np.int64) == 0
                    votes = running_majority(votes, known, len(classes))
                wrong += ((votes != truth) & known).sum(axis=0)
                units += known.sum(axis=0)
            yield pa.record_batch([pa.array(np.arange(1, rounds + 1)), pa.array(wrong), pa.array(units)], ["round", "wrong", "units"])

        summed = df.mapInArrow(vote, "round long, wrong long, units long").groupBy("round").agg(F.sum("wrong").alias("wrong"), F.sum("units").alias("units"))
        return summed.select(F.col("round").cast("int").alias("round"), F.try_divide("wrong", "units").alias(name))

    # A class that was never trained is a class of its own, so every vote on it is wrong.
    held = prepared[1].repartition(spread, unit_id).withColumn("place", F.coalesce(place, F.lit(-1)))
    oob = errors(table.select("bins", "place", "draws"), "oob_error", True)
    tested = errors(binned(held, "_features", cuts, ["place"]), "test_error", False)
    return oob.join(tested, "round").orderBy("round")
