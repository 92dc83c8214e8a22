"""Nearest known neighbours of every row of a series, and linear interpolation.

A window over a whole series would put one long series in one task.  Instead a
series is cut into blocks of steps: each block finds its neighbours on its own,
and what a block cannot see comes from a small per-block summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_STEPS = 4096


def with_neighbours(
    df: DataFrame, key: str, step: str, value: str, block_steps: int = BLOCK_STEPS
) -> DataFrame:
    """Add ``prev_step, prev_value, next_step, next_value`` and the series' ``lo, hi``.

    A row with a value is its own neighbour on both sides; a side without any
    known value is NULL.
    """
    blocked = df.withColumn("_block", F.floor(F.col(step) / F.lit(block_steps)))
    known = F.when(
        F.col(value).isNotNull(), F.struct(F.col(step).alias("s"), F.col(value).alias("v"))
    )

    # What each block knows: two rows' worth of data for thousands of steps.
    has = F.col(value).isNotNull()
    summary = blocked.groupBy(key, "_block").agg(
        F.min(F.when(has, F.col(step))).alias("s0"),
        F.min_by(value, F.when(has, F.col(step))).alias("v0"),
        F.max(F.when(has, F.col(step))).alias("s1"),
        F.max_by(value, F.when(has, F.col(step))).alias("v1"),
        F.min(step).alias("lo"),
        F.max(step).alias("hi"),
    )
    series = Window.partitionBy(key)
    # Looking ahead is looking back in descending order: a frame that reaches
    # to the end of the partition would be evaluated anew for every row.
    before = series.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    after = series.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    first = F.when(F.col("s0").isNotNull(), F.struct(F.col("s0").alias("s"), F.col("v0").alias("v")))
    last = F.when(F.col("s1").isNotNull(), F.struct(F.col("s1").alias("s"), F.col("v1").alias("v")))
    carried = summary.select(
        key,
        "_block",
        F.last(last, True).over(before).alias("_from_before"),
        F.last(first, True).over(after).alias("_from_after"),
        F.min("lo").over(series).alias("lo"),
        F.max("hi").over(series).alias("hi"),
    )

    block = Window.partitionBy(key, "_block")
    upto = block.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    onward = block.orderBy(F.desc(step)).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumns(
        {"_prev": F.last(known, True).over(upto), "_next": F.last(known, True).over(onward)}
    )
    previous = F.coalesce("_prev", "_from_before")
    following = F.coalesce("_next", "_from_after")
    return local.join(carried, [key, "_block"], "left").select(
        *df.columns,
        previous["s"].alias("prev_step"),
        previous["v"].alias("prev_value"),
        following["s"].alias("next_step"),
        following["v"].alias("next_value"),
        "lo",
        "hi",
    )


def on_the_line(value: str, step: str) -> Column:
    """Value by equal steps between the neighbours: leading gaps stay NULL, trailing
    gaps carry the last value."""
    share = F.try_divide(
        (F.col(step) - F.col("prev_step")).cast("double"),
        (F.col("next_step") - F.col("prev_step")).cast("double"),
    )
    between = F.col("prev_value") + (F.col("next_value") - F.col("prev_value")) * share
    return F.coalesce(
        F.col(value), F.when(F.col("next_step").isNull(), F.col("prev_value")), between
    )


def interpolate_linear(
    df: DataFrame,
    key: str,
    step: Column,
    value: str,
    out: str = "interpolated",
    block_steps: int = BLOCK_STEPS,
) -> DataFrame:
    """Linear interpolation by position on a dense series; ``value`` is kept."""
    stepped = df.withColumn("_step", step)
    found = with_neighbours(stepped, key, "_step", value, block_steps)
    return found.withColumn(out, on_the_line(value, "_step")).select(*df.columns, out)
