"""Preparation: raw records -> labelled records -> grouped and encoded analysis table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taufold.functions import labels as L
from taufold.functions import text as X
from taufold.functions.values import (
    AGE_EDGES,
    AGE_LABELS,
    INDEX_EDGES,
    INDEX_LABELS,
    SIZE_EDGES,
    SIZE_LABELS,
)
from taufold.operators.encode import fixed_bins, one_hot_columns
from taufold.operators.encode import levels as find_levels
from taufold.operators.impute import fill, means, modes
from taufold.operators.summary import has_unique_key
from taufold.sources.stage import stage

# Declared types of a record table; text that may hold a missing mark or a bad date stays text here.
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("unit_id", T.StringType()),
        T.StructField("birth_year", T.IntegerType()),
        T.StructField("gender", T.StringType()),
        T.StructField("first_contact", T.StringType()),
        T.StructField("diagnosis", T.StringType()),
        T.StructField("grade", T.StringType()),
        T.StructField("cci", T.DoubleType()),
        T.StructField("region_code", T.DoubleType()),
        T.StructField("tissue", T.StringType()),
        T.StructField("size_mm", T.StringType()),
        T.StructField("n_operations", T.DoubleType()),
        T.StructField("radio_indication", T.StringType()),
        T.StructField("chemo_first_indication", T.StringType()),
        T.StructField("line_start", T.StringType()),
        T.StructField("line_end", T.StringType()),
        T.StructField("n_metastasis", T.StringType()),
        T.StructField("metastasis_date", T.StringType()),
        T.StructField("last_follow_up", T.StringType()),
        T.StructField("death_date", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)
RECORD_COLUMNS = tuple(RECORD_SCHEMA.fieldNames())
GROUP_COLUMNS = (
    "unit_id",
    "survival_status",
    "chemo_status",
    "age",
    "gender",
    "cci",
    "grade",
    "tissue",
    "reoperation_label",
    "region_label",
    "metastasis_label",
    "radiation_status",
    "size_mm",
)
CATEGORIES = ("region_label", "gender", "grade", "tissue", "size_group", "age_group", "cci_group")
BIN_LEVELS = {"size_group": SIZE_LABELS, "age_group": AGE_LABELS, "cci_group": INDEX_LABELS}
RAW_NUMBERS = ("age", "cci", "size_mm")


@dataclass(frozen=True)
class FillValues:
    """Fitted fill values; a handful of scalars."""

    values: dict[str, object]


def clean_records(df: DataFrame, names: dict[str, str] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Rename source columns ({source: generic}) and drop outline numbers; ``keep`` names the columns to keep, all by default."""
    renamed = df.withColumnsRenamed(names or {})
    kept = renamed.columns if keep is None else [c for c in renamed.columns if c in set(keep)]
    return renamed.select(*[F.col(f"`{c}`") for c in kept]).withColumn("diagnosis", X.strip_outline_number(F.col("diagnosis")))


def derive_labels(df: DataFrame, as_of: str) -> DataFrame:
    """All derived columns that need no fitted value, as expressions of one scan."""
    c = F.col
    dates = ("first_contact", "line_start", "line_end", "metastasis_date", "last_follow_up", "death_date")
    parsed = df.withColumns({d: L.iso_date(c(d)) for d in dates})
    flags = parsed.withColumns(
        {
            "age": L.age_at(c("birth_year"), int(as_of[:4])),
            "reoperation_label": L.at_least_one(c("n_operations")),
            "metastasis_label": L.event_flag(c("n_metastasis")),
            "chemo_status": L.presence_flag(c("chemo_first_indication")),
            "chemo_duration": L.open_duration(c("line_start"), c("line_end"), as_of),
            "survival_status_label": X.code_in_parentheses(c("status")),
            "radio_code": X.leading_integer(c("radio_indication")),
            "size_mm": L.number_or_null(c("size_mm")),
        }
    )
    days = L.days_if(c("metastasis_label"), 1, c("metastasis_date"), c("last_follow_up"))
    return flags.withColumn("metastasis_days", days)


def fit_fill_values(derived: DataFrame) -> FillValues:
    """Modes and the rounded mean size."""
    found = modes(derived, ["region_code", "survival_status_label", "radio_code", "cci"])
    return FillValues({**found, **means(derived, ["size_mm"], digits=0)})


def label_records(df: DataFrame, as_of: str, fitted: FillValues | None = None) -> DataFrame:
    """Labelled records; ``as_of`` (yyyy-MM-dd) stands for the day of the run."""
    derived = derive_labels(df, as_of)
    if fitted is None:
        # The fill values take their own passes; the joins and the text parsing should not repeat for them.
        derived = stage(derived, "derived")
        fitted = fit_fill_values(derived)
    c = F.col
    filled = fill(derived, fitted.values).withColumns(
        {
            "region_label": L.code_label(c("region_code")),
            "survival_status": L.alive_flag(c("survival_status_label")),
            "radiation_status": L.nonzero_flag(c("radio_code")),
        }
    )
    survived = L.days_if(c("survival_status"), 0, c("first_contact"), c("death_date"))
    return filled.withColumn("overall_survival_days", survived)


def group_records(labelled: DataFrame) -> DataFrame:
    """The analysis columns with age, size and index bins."""
    return labelled.select(*GROUP_COLUMNS).withColumns(
        {
            "age_group": fixed_bins(F.col("age"), AGE_EDGES, AGE_LABELS),
            "size_group": fixed_bins(F.col("size_mm"), SIZE_EDGES, SIZE_LABELS),
            "cci_group": fixed_bins(F.col("cci"), INDEX_EDGES, INDEX_LABELS),
        }
    )


def encode_groups(groups: DataFrame) -> DataFrame:
    """Group columns and their one-hot flags side by side.

    The flags belong to the unit's own row, so joining the encoded table back on
    the unit key is the same as one wider projection, without a shuffle.
    """
    found = find_levels(groups, [c for c in CATEGORIES if c not in BIN_LEVELS])
    level_map = {c: BIN_LEVELS.get(c, found.get(c)) for c in CATEGORIES}
    return groups.select("*", *one_hot_columns(level_map))


def encoded_names(groups: DataFrame, merged: DataFrame) -> list[str]:
    """The flag columns that encoding added."""
    return [c for c in merged.columns if c not in groups.columns]


def merge_keep_right(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on a key of the right table; shared columns are taken from the right.

    The right key must be unique: with repeated keys on both sides a join would
    emit all pairs of a key.
    """
    if not has_unique_key(right, key):
        raise ValueError(f"column {key!r} repeats in the right table")
    own = left.drop(*[c for c in left.columns if c in right.columns and c != key])
    return own.join(right, key, "left")
