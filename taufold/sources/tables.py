"""Table readers and writers, small artifacts, fitted models, text lines."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taufold.functions.text import split_lines, strip


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header.  A schema spares the extra pass that inference costs."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def read_parquet(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, nan_as_null: bool = False
) -> DataFrame:
    """Parquet keeps NULL, so NaN is only replaced on request: the replacement hides a column from filter pushdown."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return nan_to_null(df) if nan_as_null else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL is the only missing value downstream: Spark aggregates do not skip NaN."""

    def clean(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c), c).alias(field.name)
        return c

    return df.select(*[clean(f) for f in df.schema.fields])


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_names(spark: SparkSession, names: list[str], path: str) -> None:
    """A variable list as a one-column table; its order is kept."""
    rows = [(i, n) for i, n in enumerate(names)]
    spark.createDataFrame(rows, "position int, name string").coalesce(1).write.mode("overwrite").parquet(path)


def read_names(spark: SparkSession, path: str) -> list[str]:
    """Column names only, so the size is bounded by the width of a table."""
    return [r["name"] for r in spark.read.parquet(path).orderBy("position").collect()]


def save_model(model: Transformer, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> Transformer:
    """Load any saved pyspark.ml model; its class is read from the stored metadata."""
    return DefaultParamsReader.loadParamsInstance(path, _context())


def _context():
    return SparkSession.getActiveSession().sparkContext


def text_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per non-empty trimmed line, with its position in the page."""
    exploded = df.select(id_col, F.posexplode(split_lines(F.col(text_col))).alias("line_no", "raw_line"))
    return exploded.select(id_col, "line_no", strip(F.col("raw_line")).alias("line")).filter(F.col("line") != "")
