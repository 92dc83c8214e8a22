"""Reductions of classified or index samples to one row per entity and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import scale_round
from ..functions.steps import month_start
from .calendar import densify, with_year_month

# Class codes of a sample.
NO_DATA, DRY, WET = 0, 1, 2


def latest_per_cell(df: DataFrame, key: str, cell: str, t: str, cls: str, tie: str) -> DataFrame:
    """The last image's class for each cell and month (``tie`` orders images of equal time)."""
    rest = [c for c in df.columns if c not in (key, cell)]
    return (
        df.withColumn("_month", month_start(t))
        .groupBy(key, cell, "_month")
        .agg(F.max_by(F.struct(*rest), F.struct(t, tie)).alias("_last"))
        .select(key, cell, "_last.*")
        .select(*df.columns)
    )


def _all_months(
    monthly: DataFrame, key: str, bounds: tuple[str, str] | None, entities: DataFrame | None
) -> DataFrame:
    """Every month of the range for every entity that has samples or is listed."""
    if entities is None:
        return densify(monthly, [key], "date", "month", bounds, rolled_up=True)
    if bounds is None:
        raise ValueError("entities need bounds")
    listed = entities.select(key).where(F.col(key).isNotNull()).distinct()
    absent = listed.join(monthly.select(key), key, "left_anti").withColumn("date", F.to_date(F.lit(bounds[0])))
    both = monthly.unionByName(absent, allowMissingColumns=True)
    return densify(both, [key], "date", "month", bounds)


def class_fraction(
    df: DataFrame,
    key: str,
    t: str,
    cls: str,
    weight: str,
    bounds: tuple[str, str] | None = None,
    entities: DataFrame | None = None,
) -> DataFrame:
    """Wet share of the valid weight per month of a fixed range.

    ``entities`` lists all that get their months of the range, also without any
    sample (``bounds`` must then be given).

    The share is taken from the weighted sums; the two counts are cut to whole
    numbers only afterwards, so a share may stand beside a count of 0.
    """
    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0))

    sums = df.groupBy(key, month_start(t).alias("date")).agg(
        total(F.col(cls) == WET).alias("_wet"), total(F.col(cls) >= DRY).alias("_valid")
    )
    dense = _all_months(sums, key, bounds, entities)
    share = F.when(
        F.col("_valid") > 0,
        F.round(F.try_divide(F.col("_wet").cast("double"), F.col("_valid").cast("double")), 6),
    )
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    return with_year_month(dense, "date").select(
        key,
        "year",
        "month",
        share.alias("water_fraction"),
        whole("_wet").alias("water_pixels"),
        whole("_valid").alias("total_pixels"),
    )


def monthly_index(
    df: DataFrame,
    key: str,
    t: str,
    raw: str,
    bounds: tuple[str, str] | None = None,
    scale: float = 0.0001,
    out: str = "ndvi",
    entities: DataFrame | None = None,
) -> DataFrame:
    """Scaled monthly mean of composites over a fixed range; NULL where there is none.

    ``entities`` as for :func:`class_fraction`.
    """
    means = df.groupBy(key, month_start(t).alias("date")).agg(F.avg(raw).alias("_raw"))
    dense = _all_months(means, key, bounds, entities)
    return with_year_month(dense, "date").select(
        key, "year", "month", scale_round("_raw", scale).alias(out)
    )
