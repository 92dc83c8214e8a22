"""Group aggregates.  All combine on the map side, so a hot entity shuffles one
partial row per task, not its readings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import convert_units
from ..functions.steps import truncate_to
from .calendar import densify

Rules = Mapping[str, tuple[str, str]]


def first_non_null(value: Column | str, order: Sequence[Column | str]) -> Column:
    """Aggregate: the first value that is not missing, in the given order.

    The order must be total for the answer to be fixed: Spark rows have none of
    their own.
    """
    value = F.col(value) if isinstance(value, str) else value
    # Ranking only the rows with a value leaves the others out of min_by.
    present = F.when(value.isNotNull(), _order(order))
    return F.min_by(value, present)


def _order(order: Sequence[Column | str]) -> Column:
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    return columns[0] if len(columns) == 1 else F.struct(*columns)


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep the first row of each key, whatever it holds (a NULL value stays)."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), _order(order)).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)


_AGGREGATES = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}


def _aggregate(rules: Rules, columns: Sequence[str]) -> list[Column]:
    return [
        _AGGREGATES[how](column).alias(out)
        for out, (column, how) in rules.items()
        if column in columns
    ]


def rollup_sparse(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    rules: Rules,
    *,
    grain: str = "month",
    out_t: str = "date",
    units: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Fine readings to one row per entity and period that has readings.

    ``rules`` maps output to (input, mean/min/max/sum).  Units are converted
    after aggregating.  A sum over no valid reading is NULL.
    """
    rolled = df.groupBy(*keys, truncate_to(t, grain).alias(out_t)).agg(
        *_aggregate(rules, df.columns)
    )
    return convert_units(rolled, units or {})


def rollup_dense(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    rules: Rules,
    *,
    grain: str = "month",
    out_t: str = "month_start",
    units: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """As :func:`rollup_sparse`, but every period from an entity's first to its last.

    Units are converted before aggregating, inputs that do not exist are left
    out, and sums of periods without a valid reading are 0, not NULL.
    """
    dated = df
    for column in (*keys, t):
        dated = dated.where(F.col(column).isNotNull())
    converted = convert_units(dated, units or {})
    rolled = rollup_sparse(converted, keys, t, rules, grain=grain, out_t=out_t)
    dense = densify(rolled, keys, out_t, grain=grain, rolled_up=True)
    sums = [out for out, (column, how) in rules.items() if how == "sum" and out in rolled.columns]
    return dense.withColumns({c: F.coalesce(c, F.lit(0)) for c in sums})


def climatology(
    df: DataFrame, key: str, t: str, value: str, out: str = "climatology"
) -> DataFrame:
    """Mean per entity and calendar month over all years."""
    return df.groupBy(key, F.month(t).alias("calendar_month")).agg(F.avg(value).alias(out))


def bias_factor(
    df: DataFrame,
    key: str,
    observed: str,
    model: str,
    min_overlap: int = 12,
    out: str = "bias_factor",
) -> DataFrame:
    """Ratio of means over the rows that have both; NULL on short overlap or zero model mean."""
    both = F.col(observed).isNotNull() & F.col(model).isNotNull()
    ratio = F.try_divide(
        F.avg(F.when(both, F.col(observed))), F.avg(F.when(both, F.col(model)))
    )
    return df.groupBy(key).agg(F.when(F.count_if(both) >= min_overlap, ratio).alias(out))


def coverage(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Rows, missing values and time range per entity."""
    total, missing = F.count("*"), F.count_if(F.col(value).isNull())
    return df.groupBy(key).agg(
        total.alias("n_total"),
        missing.alias("n_missing"),
        percent_missing(missing, total).alias("pct_missing"),
        F.min(t).alias("first_date"),
        F.max(t).alias("last_date"),
    )


def percent_missing(missing: Column, total: Column) -> Column:
    return F.try_divide(missing * F.lit(100.0), total)


def percent_filled(before: Column, after: Column) -> Column:
    """Share of the missing values that got one; 0 when nothing was missing."""
    return (before - after) * F.lit(100.0) / F.greatest(before, F.lit(1))


def entity_location(
    df: DataFrame, key: str, lat: str, lon: str, order: Sequence[Column | str]
) -> DataFrame:
    """First valid latitude and longitude of each entity, each on its own."""
    return df.groupBy(key).agg(
        first_non_null(lat, order).alias("lat"), first_non_null(lon, order).alias("lon")
    )
