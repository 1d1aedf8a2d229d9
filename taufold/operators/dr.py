"""Doubly-robust scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taufold.functions.labels import at_least
from taufold.functions.values import PROPENSITY_FLOOR


def arm_positions(df: DataFrame, treatment: str, at_most: int = 1000) -> list:
    """Sorted arms of any sortable type; the lowest is control.

    Arms are few: the result is as short as the design.  A column with more than
    ``at_most`` values is refused, as it is no treatment.
    """
    rows = df.select(treatment).filter(F.col(treatment).isNotNull()).distinct().limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"column {treatment!r} has more than {at_most} values; it is not a treatment arm")
    return sorted(r[0] for r in rows)


def corrected_outcome(y: Column, in_arm: Column, mu: Column, e: Column) -> Column:
    """mu + 1[in arm] / max(e, floor) * (y - mu)."""
    weight = F.when(in_arm, 1.0).otherwise(0.0) / at_least(e, PROPENSITY_FLOOR)
    return mu + weight * (y - mu)


def dr_score(y: Column, treatment: Column, arms: Sequence[int], k: int, mu: Sequence[Column], e: Sequence[Column]) -> Column:
    """Score of the k-th arm against control (position 0)."""
    treated = corrected_outcome(y, treatment == arms[k], mu[k], e[k])
    control = corrected_outcome(y, treatment == arms[0], mu[0], e[0])
    return treated - control


def dr_long(
    df: DataFrame,
    outcome: str,
    treatment: str,
    arms: Sequence[int],
    mu: Sequence[str],
    e: Sequence[str],
    cate: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per unit and non-control arm: (keep..., arm, dr[, cate]).

    ``mu`` and ``e`` name one column per arm, control first; ``cate`` one per
    non-control arm.
    """
    y, d = F.col(outcome).cast("double"), F.col(treatment)
    mu_cols, e_cols = [F.col(c) for c in mu], [F.col(c) for c in e]
    cells = []
    for k in range(1, len(arms)):
        fields = [F.lit(arms[k]).alias("arm"), dr_score(y, d, arms, k, mu_cols, e_cols).alias("dr")]
        if cate:
            fields.append(F.col(cate[k - 1]).alias("cate"))
        cells.append(F.struct(*fields))
    return df.select(*keep, F.inline(F.array(*cells)))


def average_effect(long: DataFrame, score: str = "dr", by: Sequence[str] = ("arm",)) -> DataFrame:
    """Mean effect and its standard error, in the population and the sample form of the sd."""
    s = F.col(score)
    root = F.sqrt(F.count(s).cast("double"))
    return long.groupBy(*by).agg(
        F.count(s).alias("n"),
        F.avg(s).alias("ate"),
        (F.stddev_pop(s) / root).alias("se_pop"),
        (F.stddev_samp(s) / root).alias("se_samp"),
    )
