"""A merge on a key that repeats on both sides: every left row meets every right row of its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key and side that meet in one cell; larger keys are dealt over several cells.
CELL_ROWS = 2000


def _counted(df: DataFrame, times: str, limit: int) -> DataFrame:
    """Equal rows as one row with their number, in portions of at most ``limit``."""
    classes = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_all"))
    portions = classes.withColumn("_portion", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_all - 1) div {limit}"))))
    size = F.least(F.lit(limit).cast("long"), F.col("_all") - F.col("_portion") * limit)
    return portions.withColumn(times, size).drop("_all")


def _dealt(df: DataFrame, columns: list[str], parts: str) -> Column:
    mixed = F.xxhash64(*[F.col(f"`{c}`") for c in columns], "_portion")
    return F.pmod(mixed, F.coalesce(parts, F.lit(1).cast("long")))


def _every(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(parts, F.lit(1).cast("long")) - 1))


def merge_fan_out(left: DataFrame, right: DataFrame, key: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Left merge; shared columns are taken from the right, a repeated key fans out.

    Equal rows travel once, with their number.  The rows of a frequent key are dealt
    by hash over a grid of cells, so that no task holds a whole key; a cell joins at
    most about ``cell_rows`` rows of either side.  NULL keys match nothing.  Left rows
    without a partner stay, with NULL for the right columns.  Maps can't be counted
    as equal rows and are refused by Spark.
    """
    own = left.drop(*[c for c in left.columns if c in right.columns and c != key])
    lefts = _counted(own, "_l", cell_rows)
    rights = _counted(right.filter(F.col(f"`{key}`").isNotNull()), "_r", cell_rows)
    sizes = [d.groupBy(key).agg(F.sum(n).alias(n)) for d, n in ((lefts, "_l"), (rights, "_r"))]
    parts = sizes[0].join(sizes[1], key).select(
        key, F.expr(f"(_l - 1) div {cell_rows} + 1").alias("_ls"), F.expr(f"(_r - 1) div {cell_rows} + 1").alias("_rs")
    )
    # Few keys are so frequent: at most one for every cell_rows rows.
    parts = parts.filter("_ls > 1 OR _rs > 1")
    left_cells = lefts.join(parts, key, "left").withColumn("_i", _dealt(lefts, own.columns, "_ls")).withColumn("_j", _every("_rs"))
    right_cells = rights.join(parts, key, "left").withColumn("_j", _dealt(rights, right.columns, "_rs")).withColumn("_i", _every("_ls"))
    met = left_cells.drop("_portion", "_ls", "_rs").join(right_cells.drop("_portion", "_ls", "_rs"), [key, "_i", "_j"])
    alone = lefts.join(rights.select(key).distinct(), key, "left_anti").withColumn("_r", F.lit(1).cast("long"))
    columns = [F.col(f"`{c}`") for c in [*own.columns, *[c for c in right.columns if c != key]]]
    every = met.select(*columns, "_l", "_r").unionByName(alone.select(*[F.col(f"`{c}`") for c in own.columns], "_l", "_r"), allowMissingColumns=True)
    for n in ("_l", "_r"):
        every = every.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), n)))
    return every.select(*columns)
