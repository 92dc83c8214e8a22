"""Numeric coercion, unit conversion, distance."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip_space

# A number is digits with an optional point and exponent.  The guard keeps out
# what a cast alone would accept (type suffixes such as 1.5d).
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_INFINITY = r"^[+-]?(inf|infinity)$"


def to_number(value: Column | str) -> Column:
    """Text to double; anything that is no number gives NULL, as does NaN."""
    text = strip_space(value)
    infinite = F.lower(text).rlike(_INFINITY)
    return F.when(text.rlike(_NUMBER) | infinite, text.try_cast("double"))


def nan_to_null(value: Column | str) -> Column:
    """NaN means missing; Spark aggregates skip NULL but not NaN."""
    number = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(number), number)


def convert_units(df: DataFrame, rules: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Apply ``value * factor + offset`` to each named column that exists."""
    present = {c: r for c, r in rules.items() if c in df.columns}
    return df.withColumns(
        {c: F.col(c) * F.lit(mul) + F.lit(add) for c, (mul, add) in present.items()}
    )


def scale_round(value: Column | str, factor: float, digits: int = 6) -> Column:
    """Scaled and rounded; NULL stays NULL."""
    number = F.col(value) if isinstance(value, str) else value
    return F.round(number * F.lit(factor), digits)


def planar_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Straight-line distance in degrees (not along the sphere).

    Written out rather than ``hypot`` so that equal distances come out equal to
    the last bit wherever they are computed; degrees cannot overflow a square.
    """
    dlat, dlon = lat1 - lat2, lon1 - lon2
    return F.sqrt(dlat * dlat + dlon * dlon)


def rounded(value: Column, digits: int) -> Column:
    """What ``round`` gives, which goes through big decimals for every row; here only values near a half or beyond 1 do.

    Up to nine digits the product below is off by far less than what counts as near, and a whole number divided by a
    power of ten is the double closest to that decimal.
    """
    scaled = value * F.lit(10.0**digits)
    near = (F.abs(scaled - F.floor(scaled) - 0.5) < 1e-3) | (F.abs(value) > 1)
    return F.when(near, F.round(value, digits)).otherwise(F.rint(scaled) / F.lit(10.0**digits) + F.lit(0.0))
