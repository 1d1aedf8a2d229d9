"""The most frequent rows of a count table, as many as fit a given number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counts are told apart by powers of 2 ** (1 / PARTS).
PARTS = 16


def most_frequent(counted: DataFrame, count: str, entries: int) -> DataFrame:
    """Rows whose count is in the highest bins that hold at most ``entries`` rows together.

    A histogram of the counts finds the bins, so no task and no driver ever holds
    more than its own rows; sorting for a limit would gather that many from every task.
    """
    place = F.floor(F.log2(F.col(count)) * PARTS)
    bins = {r["bin"]: r["rows"] for r in counted.groupBy(place.alias("bin")).agg(F.count("*").alias("rows")).collect()}
    least, held = None, 0
    for b in sorted(bins, reverse=True):
        held += bins[b]
        if held > entries:
            break
        least = b
    return counted.filter(place >= least) if least is not None else counted.limit(0)
