"""Query registry: a Spark function, its oracle SQL and one output schema for both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taufold.session import reach_workers

# Output kinds: i integer, d number to 6 digits (by the same operations in both engines), s text, b boolean.
SPARK_CAST = {
    "i": lambda c: F.col(f"`{c}`").cast("bigint"),
    "d": lambda c: F.floor(F.col(f"`{c}`").cast("double") * 1e6 + 0.5) / 1e6 + 0.0,
    "s": lambda c: F.col(f"`{c}`").cast("string"),
    "b": lambda c: F.col(f"`{c}`").cast("boolean"),
}
SQL_CAST = {
    "i": 'CAST("{c}" AS BIGINT)',
    "d": 'floor(CAST("{c}" AS DOUBLE) * 1e6 + 0.5) / 1e6 + 0.0',
    "s": 'CAST("{c}" AS VARCHAR)',
    "b": 'CAST("{c}" AS BOOLEAN)',
}


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [(name.strip(), kind) for name, kind in (part.rsplit(":", 1) for part in spec.split(","))]


def query(operators: str, spec: str, sql: str | None = None):
    """Register a function under its own name.  ``operators`` lists the inventory IDs it covers."""
    columns = _columns(spec)

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            reach_workers(spark)
            found = fn(spark, sf_dir)
            return found.select(*[SPARK_CAST[kind](c).alias(c) for c, kind in columns])

        text = None
        if sql is not None:
            shaped = ", ".join(f'{SQL_CAST[kind].format(c=c)} AS "{c}"' for c, kind in columns)
            text = f"SELECT {shaped} FROM (\n{sql.strip()}\n) AS q"
        if fn.__name__ in REGISTRY:
            raise ValueError(f"query {fn.__name__!r} is registered twice")
        REGISTRY[fn.__name__] = Query(fn.__name__, operators, run, text)
        return fn

    return register
