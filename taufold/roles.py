"""Column roles: the only configuration the operators need."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Roles:
    unit_id: str = "unit_id"
    treatment: str = "treatment"
    outcome: str = "outcome"
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    subgroups: tuple[str, ...] = ()
    weight: str | None = None
    # 0/1 columns of the categories, for balance and propensity; the effect model encodes the categories itself.
    flags: tuple[str, ...] = ()

    @property
    def covariates(self) -> tuple[str, ...]:
        return (*self.numeric, *self.categorical)

    def check(self, df: DataFrame) -> Roles:
        """Raise if a named column is missing from ``df``."""
        named = [self.unit_id, self.treatment, self.outcome, *self.covariates, *self.subgroups, *self.flags]
        if self.weight:
            named.append(self.weight)
        missing = [c for c in named if c not in df.columns]
        if missing:
            raise ValueError(f"columns not in the table: {missing}")
        return self

    def infer_covariates(self, df: DataFrame, exclude: tuple[str, ...] = ()) -> Roles:
        """Every column that has no other role becomes a covariate.

        Columns already named numeric stay numeric; the rest are categorical, as
        they are one-hot flags or codes.  Only the schema is read, no data.
        """
        taken = {self.unit_id, self.treatment, self.outcome, self.weight, *exclude, *self.subgroups, *self.numeric, *self.flags}
        rest = tuple(c for c in df.columns if c not in taken)
        return replace(self, categorical=rest)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)
