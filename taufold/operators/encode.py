"""Bins, one-hot flags, scaling and the fitted preprocessor."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taufold.functions.labels import first_match
from taufold.functions.numeric import cuts_at_or_below, cuts_below, distinct_cuts
from taufold.operators.impute import fill, means, modes
from taufold.operators.quantiles import exact_quantiles

MAX_LEVELS = 10_000


def fixed_bins(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-open bin [a, b); NULL below the first and from the last edge on."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    top = float(edges[-1])
    below_top = c.isNotNull() if top == float("inf") else c < top
    bins = [(c < float(upper), label) for upper, label in zip(edges[1:-1], labels)]
    return F.when((c >= float(edges[0])) & below_top, first_match(bins, labels[-1]))


def quantile_bins(
    df: DataFrame, value: str, bins: int, out: str = "bin", cuts: Sequence[float] | None = None
) -> DataFrame:
    """Right-closed quantile bins 0.., lowest value included, equal cuts dropped."""
    if cuts is None:
        cuts = exact_quantiles(df, value, [i / bins for i in range(bins + 1)])[()]
    kept = distinct_cuts(cuts)
    inside = F.col(value).between(kept[0], kept[-1])
    return df.withColumn(out, F.when(inside, F.greatest(cuts_below(value, kept) - 1, F.lit(0))))


def closed_groups(column: str, cuts: Sequence[float]) -> Column:
    """Array of the groups whose closed range [cut_i, cut_i+1] holds the value.

    A value on an inner cut is in both neighbours; a value outside all cuts is in none.
    """
    first = F.greatest(cuts_below(column, cuts) - 1, F.lit(0))
    last = F.least(cuts_at_or_below(column, cuts) - 1, F.lit(len(cuts) - 2))
    return F.when(F.col(column).between(cuts[0], cuts[-1]), F.sequence(first, last))


def levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Sorted distinct non-null values of each column, from one job.

    A column with more than MAX_LEVELS values is refused: it would become as
    many columns, and it is not a category.
    """
    if not columns:
        return {}
    spread = (
        df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
        .unpivot([], list(columns), "variable", "value")
        .filter("value is not null")
        .distinct()
    )
    rows = spread.limit(MAX_LEVELS * len(columns) + 1).collect()
    out: dict[str, list] = {c: [] for c in columns}
    for r in rows:
        out[r["variable"]].append(r["value"])
    for c, found in out.items():
        if len(found) > MAX_LEVELS or len(rows) > MAX_LEVELS * len(columns):
            raise ValueError(f"column {c!r} has too many levels for one-hot flags")
        found.sort(key=_level_order)
    return out


def _level_order(text: str):
    try:
        return (0, float(text), text)
    except ValueError:
        return (1, 0.0, text)


def level_name(base: str, level: str) -> str:
    return f"{base}_{level}"


def one_hot_columns(level_map: Mapping[str, Sequence], drop_first: bool = False) -> list[Column]:
    """0/1 flags for all known levels; NULL and unseen values give zeros everywhere."""
    out = []
    for base, known in level_map.items():
        for level in list(known)[1 if drop_first else 0 :]:
            flag = F.coalesce((F.col(f"`{base}`").cast("string") == str(level)).cast("int"), F.lit(0))
            out.append(flag.alias(level_name(base, str(level))))
    return out


def one_hot_names(level_map: Mapping[str, Sequence], drop_first: bool = False) -> dict[str, str]:
    """{flag column: base covariate}, kept from the encoding rather than guessed from names."""
    skip = 1 if drop_first else 0
    return {level_name(b, str(v)): b for b, known in level_map.items() for v in list(known)[skip:]}


def one_hot(
    df: DataFrame,
    columns: Sequence[str],
    drop_first: bool = False,
    known: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """Replace ``columns`` by their flags.  ``known`` adds declared levels, such as bin labels."""
    known = dict(known or {})
    found = levels(df, [c for c in columns if c not in known])
    level_map = {c: known.get(c, found.get(c)) for c in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, *one_hot_columns(level_map, drop_first))


def base_of(feature: str, bases: Sequence[str]) -> str:
    """First base name found in a feature name, else 'Other'."""
    return next((b for b in bases if b in feature), "Other")


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population sd, one fitted pass; a constant column is only centred."""
    row = df.agg(
        *[F.avg(f"`{c}`").alias(f"m_{c}") for c in columns], *[F.stddev_pop(f"`{c}`").alias(f"s_{c}") for c in columns]
    ).first()
    return df.withColumns({c: _scaled(F.col(f"`{c}`"), row[f"m_{c}"], row[f"s_{c}"]) for c in columns})


def _scaled(c: Column, mean: float | None, sd: float | None) -> Column:
    return (c.cast("double") - F.lit(mean)) / F.lit(sd if sd else 1.0)


@dataclass(frozen=True)
class Preprocessor:
    """Fitted on training units, applied to any units: impute, scale, encode."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    mean: dict[str, float]
    sd: dict[str, float]
    mode: dict[str, object]
    level_map: dict[str, list]

    @staticmethod
    def fit(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Preprocessor:
        text = train.select(*numeric, *[F.col(c).cast("string").alias(c) for c in categorical])
        mean = means(text, numeric)
        mode = modes(text, categorical)
        sd: dict[str, float] = {}
        if numeric:
            filled = fill(text, mean)
            row = filled.agg(*[F.stddev_pop(c).alias(c) for c in numeric]).first()
            sd = {c: row[c] for c in numeric}
        return Preprocessor(tuple(numeric), tuple(categorical), mean, sd, mode, levels(text, categorical))

    @property
    def bases(self) -> dict[str, str]:
        """{feature: base covariate} in feature order."""
        flags = {f"cat__{level_name(b, str(v))}": b for b in self.categorical for v in self.level_map[b]}
        return {**{f"num__{c}": c for c in self.numeric}, **flags}

    @property
    def features(self) -> list[str]:
        return list(self.bases)

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Kept columns as they are plus one double column per feature: a single projection."""
        out = []
        for c in self.numeric:
            filled = F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(self.mean[c]))
            out.append(_scaled(filled, self.mean[c], self.sd[c]).alias(f"num__{c}"))
        for c in self.categorical:
            filled = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(self.mode[c]).cast("string"))
            for level in self.level_map[c]:
                flag = F.coalesce((filled == str(level)).cast("double"), F.lit(0.0))
                out.append(flag.alias(f"cat__{level_name(c, str(level))}"))
        return df.select(*keep, *out)

    def assemble(self, wide: DataFrame, keep: Sequence[str] = (), out: str = "features") -> DataFrame:
        """Feature columns of an already transformed table as one vector."""
        assembled = VectorAssembler(inputCols=self.features, outputCol=out).transform(wide)
        return assembled.select(*keep, out)

    def vectors(self, df: DataFrame, keep: Sequence[str] = (), out: str = "features") -> DataFrame:
        return self.assemble(self.transform(df, keep), keep, out)

    def save(self, spark: SparkSession, path: str) -> None:
        """One small row per covariate, as a Parquet table."""
        rows = [(c, True, self.mean[c], self.sd[c], None, None) for c in self.numeric]
        rows += [
            (c, False, None, None, None if self.mode[c] is None else str(self.mode[c]), [str(v) for v in self.level_map[c]])
            for c in self.categorical
        ]
        fields = [
            T.StructField("position", T.IntegerType()),
            T.StructField("covariate", T.StringType()),
            T.StructField("is_numeric", T.BooleanType()),
            T.StructField("mean", T.DoubleType()),
            T.StructField("sd", T.DoubleType()),
            T.StructField("mode", T.StringType()),
            T.StructField("levels", T.ArrayType(T.StringType())),
        ]
        numbered = [(i, *r) for i, r in enumerate(rows)]
        spark.createDataFrame(numbered, T.StructType(fields)).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Preprocessor:
        rows = spark.read.parquet(path).orderBy("position").collect()
        num = [r for r in rows if r["is_numeric"]]
        cat = [r for r in rows if not r["is_numeric"]]
        return Preprocessor(
            tuple(r["covariate"] for r in num),
            tuple(r["covariate"] for r in cat),
            {r["covariate"]: r["mean"] for r in num},
            {r["covariate"]: r["sd"] for r in num},
            {r["covariate"]: r["mode"] for r in cat},
            {r["covariate"]: list(r["levels"]) for r in cat},
        )
