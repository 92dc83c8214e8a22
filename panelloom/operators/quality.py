"""Checks to run before publishing.  Each returns the offending rows: none is good."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.steps import step_number


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys met more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def check_complete(
    df: DataFrame, key: str, t: str, grain: str = "month", only_bad: bool = True
) -> DataFrame:
    """Entities whose periods from first to last are not all there exactly once."""
    step = step_number(t, grain)
    counted = (
        df.groupBy(key, step.alias("_step"))
        .agg(F.count("*").alias("_rows"))
        .groupBy(key)
        .agg(
            F.count("*").alias("n_periods"),
            F.sum("_rows").alias("n_rows"),
            (F.max("_step") - F.min("_step") + 1).alias("n_expected"),
        )
        .withColumn(
            "complete",
            (F.col("n_periods") == F.col("n_expected")) & (F.col("n_rows") == F.col("n_expected")),
        )
    )
    return counted.where(~F.col("complete")) if only_bad else counted


def check_subset(part: DataFrame, full: DataFrame) -> DataFrame:
    """Rows the two tables do not share equally often, with ``surplus`` in ``part``.

    One pass over both: counts of equal rows are subtracted, and partial sums
    combine before the shuffle.  NULLs compare as equal.
    """
    columns = part.columns
    signed = part.withColumn("_n", F.lit(1).cast("long")).unionByName(
        full.select(*columns).withColumn("_n", F.lit(-1).cast("long"))
    )
    return signed.groupBy(*columns).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")


def require_empty(*checks: DataFrame) -> None:
    """Raise when a check found something.  Fetches one row per check, at most."""
    for check in checks:
        bad = check.take(1)
        if bad:
            raise ValueError(f"check failed, for example: {bad[0].asDict()}")
