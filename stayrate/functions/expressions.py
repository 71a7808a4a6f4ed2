"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.config import DEFAULT


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def n_rows() -> Column:
    return F.count(F.lit(1))


def as_double(column: Column | str) -> Column:
    return _col(column).cast("double")


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient in double precision; NULL where the denominator is zero."""
    return F.try_divide(as_double(numerator), as_double(denominator))


def round_even(column: Column | str, digits: int | None) -> Column:
    """Round halves to even after scaling, as numpy and pandas do; None keeps the value."""
    if digits is None:
        return _col(column)
    scale = float(10**digits)
    return F.rint(as_double(column) * scale) / scale


def share_pct(part: Column | str, whole: Column | str, digits: int | None = None) -> Column:
    return round_even(ratio(part, whole) * 100.0, digits)


def week_start(date: Column | str) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", _col(date)).cast("date")


def month_start(date: Column | str) -> Column:
    return F.trunc(_col(date), "month")


def months_after(later: Column | str, earlier: Column | str) -> Column:
    """Calendar months from one date to another, counting month boundaries."""
    later, earlier = _col(later), _col(earlier)
    years = F.year(later) - F.year(earlier)
    return (years * 12 + F.month(later) - F.month(earlier)).cast("bigint")


def clean_age(
    age: Column | str, low: int = DEFAULT.min_age, high: int = DEFAULT.max_age
) -> Column:
    """The age, or NULL where it is implausible."""
    age = _col(age)
    return F.when(age.between(low, high), age)


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One row from frames of one row each, whose columns have different names."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*(F.max(column).alias(column) for column in stacked.columns))
