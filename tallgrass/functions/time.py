"""Time as integers: microseconds since 1970 for both kinds of timestamp, and bins over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast({column} as timestamp_ntz))")


def bin_start(us: Column, days: int, origin_days: int = 0) -> Column:
    """Start, in micros, of the bin of ``days`` days that holds the instant; bins are aligned to day ``origin_days``."""
    width, shift = days * DAY_US, origin_days * DAY_US
    return us - F.pmod(us - F.lit(shift), F.lit(width))


def week_start(us: Column) -> Column:
    """Start of the Monday week (1970-01-05 was a Monday)."""
    return bin_start(us, 7, 4)


def whole_days(us: Column) -> Column:
    """Elapsed micros as whole days, cut towards zero."""
    return (us / F.lit(DAY_US)).cast("bigint")


def fractional_years(us: Column) -> Column:
    """Years of 365.25 days since 2020-01-01."""
    return (us - F.lit(1_577_836_800_000_000)) / F.lit(DAY_US * 365.25)


def day_text(us: Column) -> Column:
    """``yyyy-MM-dd`` of the instant."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / F.lit(DAY_US)).cast("int")).cast("string")


def whole_hours(us: Column) -> Column:
    """Elapsed micros as whole hours, cut towards zero."""
    return (us / F.lit(HOUR_US)).cast("bigint")


def iso_year(date: Column) -> Column:
    """The year that a date's Monday week belongs to (2024-12-30 is in the first week of 2025)."""
    return F.extract(F.lit("YEAROFWEEK"), date)


def week_label(date: Column) -> Column:
    """``<iso year>_<week>`` without padding."""
    return F.concat_ws("_", iso_year(date), F.weekofyear(date))


def centred_years(at: Column, first: int, last: int, reach: int = 365) -> Column:
    """Years whose 1 July lies within ``reach`` days of a date, as an array: one date may belong to two of them."""
    years = F.sequence(F.greatest(F.year(at) - 1, F.lit(first)), F.least(F.year(at) + 1, F.lit(last)))
    inside = F.greatest(F.year(at) - 1, F.lit(first)) <= F.least(F.year(at) + 1, F.lit(last))
    near = lambda y: F.abs(F.datediff(at, F.make_date(y, F.lit(7), F.lit(1)))) <= reach
    return F.when(inside, F.filter(years, near)).otherwise(F.array().cast("array<int>"))
