"""Fill missing values from models or from the series' own seasons.

Observed columns are never overwritten: filled values go to new columns.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.steps import step_number
from .aggregates import bias_factor, percent_filled
from .interpolate import BLOCK_STEPS, interpolate_linear
from .shape import fill_flag, fill_from


def impute_from_model(
    df: DataFrame, models: Mapping[str, str], flag_rule: str = "reference"
) -> DataFrame:
    """For each observed column fill gaps from its model column.

    Adds ``<observed>_filled`` and ``<observed>_imputed``.  A model column that
    does not exist fills nothing and flags nothing.
    """
    for observed, model in models.items():
        if model in df.columns:
            df = fill_from(
                df, observed, model, f"{observed}_filled", f"{observed}_imputed", flag_rule
            )
        else:
            df = df.withColumns(
                {f"{observed}_filled": F.col(observed), f"{observed}_imputed": F.lit(False)}
            )
    return df


def impute_bias_corrected(
    df: DataFrame,
    key: str,
    observed: str,
    model: str,
    *,
    min_overlap: int = 12,
    flag_rule: str = "reference",
) -> DataFrame:
    """Fill gaps with the model times the entity's ratio of means (1 when it has none).

    Adds ``bias_factor``, ``<observed>_filled`` and ``<observed>_imputed``.  A model column that does not exist fills nothing and
    flags nothing, and there is no factor.
    """
    if model not in df.columns:
        nothing = {f"{observed}_filled": F.col(observed), f"{observed}_imputed": F.lit(False)}
        return df.withColumns({"bias_factor": F.lit(None).cast("double"), **nothing})
    factors = bias_factor(df, key, observed, model, min_overlap)
    corrected = F.col(model) * F.coalesce("bias_factor", F.lit(1.0))
    return df.join(factors, key, "left").withColumns(
        {
            f"{observed}_filled": F.coalesce(F.col(observed), corrected),
            f"{observed}_imputed": fill_flag(F.col(observed), corrected, flag_rule),
        }
    )


def impute_climatology(
    dense: DataFrame,
    key: str,
    t: str,
    value: str,
    *,
    on_complete: str = "skip",
    block_steps: int = BLOCK_STEPS,
    grain: str = "month",
    season: Column | None = None,
) -> DataFrame:
    """Mean of the season, then linear interpolation for what remains.

    ``grain`` is that of ``t``: neighbours are a month, a day or an hour apart.
    The season is the calendar month unless given as an expression of ``t``.

    Adds ``<value>_imputed``.  Entities with nothing missing are left out
    (``skip``) or passed through (``keep``).
    """
    if on_complete not in ("skip", "keep"):
        raise ValueError(f"unknown on_complete {on_complete!r}")
    missing = F.count_if(F.col(value).isNull())
    season = F.month(t) if season is None else season
    seasons = dense.groupBy(key, season.alias("_season")).agg(
        F.avg(value).alias("_mean"), missing.alias("_missing")
    )
    # A few rows per entity: summing them here spares a second pass.
    seasons = seasons.withColumn("_gaps", F.sum("_missing").over(Window.partitionBy(key)))
    filled = dense.withColumn("_season", season).join(
        seasons.drop("_missing"), [key, "_season"], "left"
    )
    if on_complete == "skip":
        filled = filled.where(F.col("_gaps") > 0)
    filled = filled.select(*dense.columns, F.coalesce(value, "_mean").alias("_filled"))
    out = f"{value}_imputed"
    result = interpolate_linear(filled, key, step_number(t, grain), "_filled", out, block_steps)
    return result.select(*dense.columns, out)


def imputation_summary(
    df: DataFrame, key: str, t: str, original: str, imputed: str, fmt: str = "yyyy-MM"
) -> DataFrame:
    """Period, length, missing before and after, percent filled, per entity."""
    before = F.count_if(F.col(original).isNull())
    after = F.count_if(F.col(imputed).isNull())
    return df.groupBy(key).agg(
        F.date_format(F.min(t), fmt).alias("period_start"),
        F.date_format(F.max(t), fmt).alias("period_end"),
        F.count("*").alias("n_total"),
        before.alias("missing_before"),
        after.alias("missing_after"),
        percent_filled(before, after).alias("pct_filled"),
    )


def fill_counts(df: DataFrame, key: str, flags: Mapping[str, str], factor: str) -> DataFrame:
    """Rows, flagged rows per flag column, and the bias factor, per entity."""
    return df.groupBy(key).agg(
        F.count("*").alias("n_total"),
        *[F.count_if(F.col(flag)).alias(out) for out, flag in flags.items()],
        F.max(factor).alias(factor),
    )
