"""Descriptive operators: counts, shares, crosstabs, boxes, duplicates, terms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taufold.functions.text import bin_order_key, split_terms
from taufold.operators.quantiles import exact_quantiles, quantile_table

COPIES_PER_CHUNK = 100_000


def mean_by_bin(df: DataFrame, group: str, value: str, labels: Sequence[str]) -> DataFrame:
    """Mean per bin label; declared bins without units stay, with a NULL mean."""
    found = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.avg(value).alias("mean"))
    known = df.sparkSession.createDataFrame([(v,) for v in labels], f"`{group}` string")
    return known.join(found, group, "left")


def value_counts(df: DataFrame, column: str, by_value: bool = False) -> DataFrame:
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(column) if by_value else counted.orderBy(F.desc("count"), column)


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """Counts of row value by column value; the column values are declared, so no extra job."""
    seen = df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    return seen.groupBy(rows).pivot(columns, list(values)).count().na.fill(0)


def zero_one_counts(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """For several 0/1 columns: display name, units without, units with.

    One pass of conditional counts; the rows are made from the single result row.
    """
    cells = [
        F.struct(
            F.lit(label).alias("variable"),
            F.count_if(F.col(c) == 0).alias("zeros"),
            F.count_if(F.col(c) == 1).alias("ones"),
        )
        for c, label in columns.items()
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def share_table(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage of each value; the total is one number from a pass over the counts."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n")).first()[0]
    return counted.withColumn("pct", 100.0 * F.col("n") / F.lit(total))


def distinct_keys(df: DataFrame, key: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return df.agg(count.alias("n_keys"))


def has_unique_key(df: DataFrame, key: str) -> bool:
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return repeated.isEmpty()


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Every copy of every row that occurs more than once.

    Copies are equal in all columns, so they are counted (combined map-side) and
    written out again in chunks: no join, and a row with very many copies is
    neither collected in one task nor expanded by one.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    last = F.floor((F.col("_n") - 1) / COPIES_PER_CHUNK)
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    spread = chunks.repartition(*df.columns, "_chunk")
    size = F.least(F.lit(COPIES_PER_CHUNK), F.col("_n") - F.col("_chunk").cast("bigint") * COPIES_PER_CHUNK)
    copies = spread.withColumn("_copy", F.explode(F.sequence(F.lit(1), size.cast("int"))))
    return copies.select(*df.columns)


def min_max(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"))


def describe(df: DataFrame, column: str, shares: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """count, mean, sd, min, percentiles, max as rows (statistic, value)."""
    cuts = exact_quantiles(df, column, shares).get((), [None] * len(shares))
    c = F.col(column).cast("double")
    items: list[tuple[str, Column]] = [
        ("count", F.count(c).cast("double")),
        ("mean", F.avg(c)),
        ("std", F.stddev_samp(c)),
        ("min", F.min(c)),
        *[(f"{s * 100:g}%", F.lit(v).cast("double")) for s, v in zip(shares, cuts)],
        ("max", F.max(c)),
    ]
    cells = [F.struct(F.lit(name).alias("statistic"), value.alias("value")) for name, value in items]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def _box_limits(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles and fences, one row per group."""
    found = quantile_table(df.filter(F.col(group).isNotNull()), value, [0.25, 0.5, 0.75], by=[group])
    at = [F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for s, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return found.groupBy(group).agg(*at).withColumn("low_fence", F.col("q1") - reach).withColumn("high_fence", F.col("q3") + reach)


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Data behind a box plot: quartiles, whiskers, mean, count and outlier count per group."""
    x = F.col(value).cast("double")
    inside = x.between(F.col("low_fence"), F.col("high_fence"))
    out = (
        df.select(group, value)
        .join(_box_limits(df, group, value), group)
        .groupBy(group, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, x)).alias("whisker_low"),
            F.max(F.when(inside, x)).alias("whisker_high"),
            F.avg(x).alias("mean"),
            F.count(x).alias("n"),
            F.count_if(~inside).alias("outliers"),
        )
    )
    return out.withColumn("order_key", bin_order_key(F.col(group).cast("string")))


def box_outliers(df: DataFrame, group: str, value: str, keep: Sequence[str] = ()) -> DataFrame:
    """The units beyond the fences."""
    x = F.col(value).cast("double")
    joined = df.select(*keep, group, value).join(_box_limits(df, group, value), group)
    return joined.filter((x < F.col("low_fence")) | (x > F.col("high_fence"))).select(*keep, group, value)


def term_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Frequency of the terms in a '|' or ',' separated column."""
    exploded = df.select(F.explode(split_terms(F.col(column))).alias("term"))
    counted = exploded.groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))
    ordered = counted.orderBy(F.desc("frequency"), "term")
    return ordered.limit(top) if top else ordered


def distinct_sketches(df: DataFrame, column: str, by: Sequence[str], log_size: int = 12) -> DataFrame:
    """(by..., sketch): a mergeable sketch of each group's distinct values, of 2**log_size registers at most.

    Store it once and merge it with later ones; the rows are not read again.
    NULL is not counted.  The relative error is about 1.04 / sqrt(2**log_size).
    """
    return df.groupBy(*by).agg(F.hll_sketch_agg(column, log_size).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., estimate): distinct values of the union of stored sketches."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
