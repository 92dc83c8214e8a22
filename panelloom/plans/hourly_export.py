"""Hourly readings of many locations to one monthly export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.aggregates import rollup_dense
from ..operators.shape import upsert_columns
from ..sources.files import normalise_hourly, read_series
from . import fixed_values as fv

HOURLY_SCHEMA = (
    "timestamp timestamp_ntz, latitude double, longitude double, "
    "u10 double, v10 double, t2m double, tp double, d2m double, msl double"
)
LOCATION_REGEX = r"^era5_(.+)_1940_.*$"


def read_hourly(
    spark: SparkSession, paths: str, schema: str = HOURLY_SCHEMA, key: str = "location"
) -> DataFrame:
    """All locations in one scan, tagged by file name.  Unreadable files can be skipped with
    ``spark.sql.files.ignoreCorruptFiles``."""
    return normalise_hourly(
        read_series(spark, paths, key_regex=LOCATION_REGEX, key=key, schema=schema)
    )


def add_variables(hourly: DataFrame, extra: DataFrame, key: str = "location") -> DataFrame:
    """Bring in (or replace) the extra variables by location and hour."""
    cleaned = normalise_hourly(extra, drop=("latitude", "longitude", "number"))
    return upsert_columns(hourly, cleaned, [key, "timestamp"])


def export_months(hourly: DataFrame, key: str = "location") -> DataFrame:
    """Every month from a location's first to its last reading, in export units."""
    return rollup_dense(
        hourly, [key], "timestamp", fv.HOURLY_TO_EXPORT, out_t="month_start", units=fv.EXPORT_UNITS
    )
