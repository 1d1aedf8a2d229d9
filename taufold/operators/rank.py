"""Distributed rank: a global order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taufold.sources.stage import stage

# Offset rows (partitions plus group starts) that are small enough to broadcast.
BROADCAST_ROWS = 100_000


def _placed(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows range-partitioned and sorted by ``keys``, with partition and position, as a stage table."""
    number = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_number", number)
    )
    return stage(placed, "rank")


def distributed_rank(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """Rank 1..n in ``order`` within each group of ``by``.

    Rows are range-partitioned on (by, order), numbered inside their partition,
    and written once, so that every later job sees the same numbers.  A second
    aggregate over the written table gives each partition its offset.  ``order``
    should end in a unique key: it settles ties, and it lets the range
    partitioner split a value or group that holds a large part of all rows.
    """
    by = list(by)
    written = _placed(df, [F.col(c) for c in by] + list(order))
    parts = written.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_number").alias("_first"))
    # One row per partition (and group start): as many rows as tasks, not as data.
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
        F.col("_part").alias("_offset_part"),
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
    )
    same = F.col("_part") == F.col("_offset_part")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    if not by or parts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    ranked = written.join(offsets, same)
    return ranked.select(*df.columns, (F.col("_offset") + F.col("_number") - F.col("_first") + 1).alias(rank))


def running_total(df: DataFrame, order: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """Adds <c>_before for each c of ``sums``: its total over all rows earlier in ``order``.

    Partition totals give the offsets; the window that remains covers one range
    partition at a time, so no task sees more than its own share of the rows.
    """
    written = _placed(df, list(order))
    parts = written.groupBy("_part").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        F.col("_part").alias("_offset_part"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums]
    )
    inside = Window.partitionBy("_part").orderBy("_number").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_b_{c}") for c in sums]
    joined = written.select("*", *before).join(F.broadcast(offsets), F.col("_part") == F.col("_offset_part"))
    return joined.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_b_{c}")).alias(f"{c}_before") for c in sums])
