"""Dense calendars, static columns on new rows, lists of missing periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.steps import step_number, step_start

# A calendar is laid out in blocks, so no single array grows with its length.
CALENDAR_BLOCK = 4096


def calendar(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    grain: str = "month",
    bounds: tuple[str, str] | None = None,
    rolled_up: bool = False,
) -> DataFrame:
    """``(keys, t)``: every period from each entity's first to its last.

    With ``bounds`` (two dates, both included) all entities get that range.

    ``rolled_up`` says that ``df`` is the result of an aggregate.  The spans then
    mention its measures too: with the same columns asked for, Spark takes them
    from the shuffle of that aggregate instead of reading its source once more.
    """
    blocks = _blocks(df, keys, t, grain, bounds, rolled_up)
    steps = blocks.select(*keys, F.explode(F.sequence("first", "last")).alias("step"))
    return steps.select(*keys, step_start("step", grain).alias(t))


def _blocks(
    df: DataFrame, keys: Sequence[str], t: str, grain: str, bounds: tuple[str, str] | None, rolled_up: bool
) -> DataFrame:
    """``(keys, block, first, last)``: the blocks of steps of each entity's calendar."""
    # The same rows the later join can match, so that both ask for the same table.
    dated = _dated(df, keys, t)
    if bounds is None:
        step = step_number(t, grain)
        lo, hi = F.min(step), F.max(step)
    else:
        lo, hi = (F.max(step_number(F.lit(b).cast("date"), grain)) for b in bounds)
        if grain == "hour":
            hi = hi + 23
    measures = [c for c in df.columns if c not in (*keys, t)]
    if rolled_up and measures:
        # A checksum stands for "all columns are needed"; its test always holds.
        sums = F.bit_xor(F.xxhash64(*measures)).alias("_sum")
        spans = dated.groupBy(*keys).agg(lo.alias("lo"), hi.alias("hi"), sums)
        spans = spans.where(F.pmod("_sum", F.lit(2)) < 2)
    else:
        spans = dated.groupBy(*keys).agg(lo.alias("lo"), hi.alias("hi"))
    size = F.lit(CALENDAR_BLOCK).cast("long")
    blocks = spans.select(
        *keys,
        "lo",
        "hi",
        F.explode(
            F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))
        ).alias("block"),
    )
    first = F.greatest(F.col("lo"), F.col("block") * size)
    last = F.least(F.col("hi"), F.col("block") * size + size - 1)
    return blocks.select(*keys, "block", first.alias("first"), last.alias("last"))


def _dated(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    for column in (*keys, t):
        df = df.where(F.col(column).isNotNull())
    return df


def densify(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    grain: str = "month",
    bounds: tuple[str, str] | None = None,
    rolled_up: bool = False,
) -> DataFrame:
    """One row per entity and period; periods without a row get NULL measures.

    ``t`` must already be truncated to the grain.  What is shuffled are the rows
    and one row per block of the calendar: each row brings the empty periods
    behind it, up to the next row of its block, and the first one those before
    it.  A long series spreads over tasks by its blocks.  Pass ``rolled_up=True``
    when ``df`` comes straight from an aggregate (see :func:`calendar`).
    """
    measures = [c for c in df.columns if c not in (*keys, t)]
    blocks = _blocks(df, keys, t, grain, bounds, rolled_up)
    step = step_number(t, grain)
    # Never NULL here; said so, no filter on it keeps the rows and the spans from sharing a shuffle.
    block = F.coalesce(F.floor(step / F.lit(CALENDAR_BLOCK).cast("long")), F.lit(0).cast("long"))
    # What lies off the grain or outside the bounds matches no period.
    on_grain = step_start(step, grain).cast(df.schema[t].dataType) == F.col(t)
    rows = _dated(df, keys, t).withColumns({"block": block, "_step": F.when(on_grain, step)})
    placed = blocks.join(rows.select(*keys, "block", "_step", *measures), [*keys, "block"], "left")
    known = F.col("_step").between(F.col("first"), F.col("last"))
    placed = placed.withColumn("_step", F.when(known, F.col("_step")))
    series = Window.partitionBy(*keys, "block").orderBy(F.asc_nulls_last("_step"))
    placed = placed.withColumns({"_next": F.lead("_step").over(series), "_nth": F.row_number().over(series)})
    # A block without a row of its own has one with NULLs; others outside the bounds add nothing.
    placed = placed.where(F.col("_step").isNotNull() | (F.col("_nth") == 1))
    start = F.when(F.col("_nth") == 1, F.col("first")).otherwise(F.col("_step"))
    end = F.greatest(F.coalesce(F.col("_next") - 1, F.col("last")), F.col("_step"), F.col("first"))
    steps = placed.select(*keys, "_step", *measures, F.explode(F.sequence(start, end)).alias("_at"))
    own = F.col("_at").eqNullSafe(F.col("_step"))
    filled = {t: step_start("_at", grain), **{m: F.when(own, F.col(m)) for m in measures}}
    return steps.withColumns(filled).select(*df.columns)


def fill_static(
    dense: DataFrame,
    key: str,
    t: str,
    columns: Sequence[str],
) -> DataFrame:
    """Give every row of an entity its first known value of each static column."""
    known = dense.groupBy(key).agg(
        *[
            F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(t))).alias(f"_{c}")
            for c in columns
        ]
    )
    filled = dense.join(known, key, "left")
    return filled.withColumns({c: F.col(f"_{c}") for c in columns}).select(*dense.columns)


def missing_periods(df: DataFrame, key: str, t: str, value: str, fmt: str = "yyyy-MM") -> DataFrame:
    """One row per missing period.  A long list stays distributed."""
    return df.where(F.col(value).isNull()).select(key, F.date_format(t, fmt).alias("missing"))


def missing_by_year(df: DataFrame, key: str, t: str, value: str, fmt: str = "yyyy-MM") -> DataFrame:
    """Missing periods as one sorted list per entity and year: bounded by the grain."""
    return (
        df.where(F.col(value).isNull())
        .groupBy(key, F.year(t).alias("year"))
        .agg(F.sort_array(F.collect_list(F.date_format(t, fmt))).alias("missing"))
    )


def with_year_month(df: DataFrame, t: Column | str) -> DataFrame:
    """Calendar year and month of ``t``."""
    return df.withColumns({"year": F.year(t), "month": F.month(t)})
