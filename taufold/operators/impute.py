"""Imputation with fitted fill values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taufold.functions.labels import round_even


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value of each column, the smallest one on ties.

    Values are counted by (column, value) first, so a column with many distinct
    values is spread over all tasks.  The built-in ``mode`` keeps them in one.
    """
    if not columns:
        return {}
    # One field per column keeps every type; a cell fills its own field only.
    fields = {c: f"_v{k}" for k, c in enumerate(columns)}
    cells = [
        F.struct(F.lit(k).alias("variable"), *[(F.col(f"`{c}`") if c == own else F.lit(None).cast(df.schema[c].dataType)).alias(f) for c, f in fields.items()])
        for k, own in enumerate(columns)
    ]
    counts = df.select(F.inline(F.array(*cells))).groupBy("variable", *fields.values()).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter(F.coalesce(*[F.col(f).isNotNull() if len(fields) == 1 else F.when(F.col(f).isNotNull(), True) for f in fields.values()]))
    # The most frequent value, the smallest of ties: fields before the column's own are NULL in all its rows.
    best = counts.groupBy("variable").agg(F.min(F.struct((-F.col("n")).alias("n"), *fields.values())).alias("best"))
    found = {r["variable"]: r["best"] for r in best.collect()}
    return {c: found[k][fields[c]] if k in found else None for k, c in enumerate(columns)}


def means(df: DataFrame, columns: Sequence[str], digits: int | None = None) -> dict[str, float]:
    """Column means in one pass; ``digits`` rounds them half to even."""
    if not columns:
        return {}
    aggs = [F.avg(f"`{c}`") for c in columns]
    if digits is not None:
        aggs = [round_even(a, digits) for a in aggs]
    row = df.agg(*[a.alias(c) for a, c in zip(aggs, columns)]).first()
    return {c: row[c] for c in columns}


def fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Fill NULLs, keeping each column's type."""
    types = {f.name: f.dataType for f in df.schema.fields}
    known = {c: v for c, v in values.items() if v is not None}
    filled = {c: F.coalesce(F.col(f"`{c}`"), F.lit(v).cast(types[c])) for c, v in known.items()}
    return df.withColumns(filled) if filled else df


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fill(df, modes(df, columns))


def fill_rounded_mean(df: DataFrame, columns: Sequence[str], digits: int = 0) -> DataFrame:
    return fill(df, means(df, columns, digits))


def null_audit(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL count of each column, as rows (variable, nulls): one pass, no row expansion."""
    names = list(columns or df.columns)
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in names])
    return counted.unpivot([], names, "variable", "nulls")
