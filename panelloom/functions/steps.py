"""Time as whole-numbered steps of a grain (hour, day or month).

A step number makes positions, calendar lengths and gap lengths plain integer
arithmetic, so no operator needs a global or per-entity row number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAINS = ("hour", "day", "month")

# Years outside this range cannot be held by nanosecond timestamps and count as missing.
YEAR_MIN, YEAR_MAX = 1678, 2261


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def step_number(t: Column | str, grain: str) -> Column:
    """Steps since 1970-01-01 (months: since year 0) as a 64-bit integer."""
    t = _column(t)
    if grain == "month":
        return (F.year(t) * 12 + F.month(t) - 1).cast("long")
    if grain == "day":
        return F.unix_date(t.cast("date")).cast("long")
    if grain == "hour":
        return F.unix_date(t.cast("date")).cast("long") * 24 + F.hour(t)
    raise ValueError(f"unknown grain {grain!r}, expected one of {GRAINS}")


def step_start(step: Column | str, grain: str) -> Column:
    """The start of a step: a date, or for hours a timestamp without zone."""
    step = _column(step)
    if grain == "month":
        year = F.floor(step / 12).cast("int")
        return F.make_date(year, (F.pmod(step, F.lit(12)) + 1).cast("int"), F.lit(1))
    if grain == "day":
        return F.date_from_unix_date(step.cast("int"))
    if grain == "hour":
        midnight = F.date_from_unix_date(F.floor(step / 24).cast("int")).cast("timestamp_ntz")
        hours = F.pmod(step, F.lit(24)).cast("int")
        return midnight + F.make_dt_interval(hours=hours)
    raise ValueError(f"unknown grain {grain!r}, expected one of {GRAINS}")


def month_start(t: Column | str) -> Column:
    """First day of the month as a date."""
    return F.trunc(_column(t), "MM")


def truncate_to(t: Column | str, grain: str) -> Column:
    """Start of the hour, day or month that holds ``t``."""
    t = _column(t)
    if grain == "month":
        return F.trunc(t, "MM")
    if grain == "day":
        return t.cast("date")
    return step_start(step_number(t, grain), grain)


def month_date(year: Column | str, month: Column | str) -> Column:
    """Month start from numeric year and month; NULL when they name no month.

    Both are truncated to whole numbers.
    """
    y = _column(year).try_cast("int")
    m = _column(month).try_cast("int")
    return F.when(y.between(YEAR_MIN, YEAR_MAX) & m.between(1, 12), F.make_date(y, m, F.lit(1)))


def monthly_date(df: DataFrame, year: str, month: str, out: str = "date") -> DataFrame:
    """Add ``year``, ``month`` (whole numbers) and the month start; drop undated rows."""
    return (
        df.withColumn(out, month_date(year, month))
        .where(F.col(out).isNotNull())
        .withColumns({"year": F.year(out), "month": F.month(out)})
    )
