"""Conditional, date and number expressions.  No Python UDF is needed for any of them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from taufold.functions.values import ALIVE_CODES, MISSING_MARK, P_FLOOR, REGION_LABELS, REGION_OTHER, STARS


def first_match(cases: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first case whose condition holds, else ``default``."""
    chain = reduce(lambda out, case: out.when(*case), cases, F)
    return chain.otherwise(default)


def age_at(birth_year: Column, as_of_year: int) -> Column:
    return F.lit(as_of_year) - birth_year


def at_least_one(c: Column) -> Column:
    """1 where the count is 1 or more, else 0 (also for NULL)."""
    return F.coalesce((c >= 1).cast("int"), F.lit(0))


def code_label(c: Column, labels: Mapping[int, str] = REGION_LABELS, other: str = REGION_OTHER) -> Column:
    return first_match(((c == code, label) for code, label in labels.items()), other)


def event_flag(c: Column) -> Column:
    """0 for NULL, the missing mark and zero; 1 for everything else, text included."""
    number = c.try_cast("double")
    absent = c.isNull() | (c.cast("string") == MISSING_MARK) | F.coalesce(number == 0, F.lit(False))
    return F.when(absent, 0).otherwise(1)


def presence_flag(c: Column) -> Column:
    return F.when(c.isNull() | (c.cast("string") == MISSING_MARK), 0).otherwise(1)


def iso_date(c: Column) -> Column:
    """Strict yyyy-MM-dd; anything else is NULL."""
    return F.try_to_date(c, "yyyy-MM-dd")


def days_if(flag: Column, value: int, start: Column, end: Column) -> Column:
    """Days from start to end where ``flag`` equals ``value``."""
    return F.when(flag == value, F.datediff(end, start))


def open_duration(start: Column, end: Column, as_of: str) -> Column:
    """Days to the end, or to ``as_of`` while the end is open; NULL without a start."""
    return F.datediff(F.coalesce(end, F.lit(as_of).cast("date")), start)


def alive_flag(code: Column) -> Column:
    return member_flag(code, ALIVE_CODES)


def member_flag(c: Column, members: Sequence[str]) -> Column:
    return F.coalesce(c.isin(*members).cast("int"), F.lit(0))


def nonzero_flag(c: Column) -> Column:
    return F.when(c == 0, 0).otherwise(1)


def number_or_null(c: Column) -> Column:
    """Parsed number; text, NaN and infinite text become NULL as a missing measurement."""
    parsed = c.try_cast("double")
    return F.when(~F.isnan(parsed) & (F.abs(parsed) < float("inf")), parsed)


def display_label(c: Column, labels: Mapping[object, str]) -> Column:
    return first_match((c == value, label) for value, label in labels.items())


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def stars(p: Column) -> Column:
    return first_match(((p < limit, mark) for limit, mark in STARS), "")


def at_least(c: Column, low: float) -> Column:
    """max(c, low) that keeps NULL; ``greatest`` would turn it into the bound."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def at_most(c: Column, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(c, F.lit(high)))


def p_text(p: Column) -> Column:
    return F.when(p.isNotNull(), F.format_string("%.2e", floor_p(p)))


def floor_p(p: Column) -> Column:
    return at_least(p, P_FLOOR)


def round_even(c: Column, digits: int) -> Column:
    """Half-even rounding of the scaled double, as array libraries round."""
    scale = float(10**digits)
    return F.rint(c.cast("double") * scale) / scale


def by_arm(treatment: Column, treated: Column, control: Column) -> Column:
    """The value that belongs to the unit's own arm."""
    return F.when(treatment == 1, treated).otherwise(control)


def binarize(score: Column, cut: float = 0.5) -> Column:
    return F.when(score >= cut, 1).otherwise(0)
