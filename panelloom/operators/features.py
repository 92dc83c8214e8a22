"""Basin and static features per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def area_weighted(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str = "mean"
) -> DataFrame:
    """Weighted mean over the cells with a value, and the share of weight they hold."""
    valid = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(valid)).alias(out),
        F.try_divide(F.coalesce(F.sum(valid), F.lit(0)), F.sum(weight)).alias("valid_area_fraction"),
    )


def volume_proxy(depth_mm: Column | str, area_km2: Column | str) -> Column:
    """Cubic metres from a mean depth in millimetres over an area."""
    depth = F.col(depth_mm) if isinstance(depth_mm, str) else depth_mm
    area = F.col(area_km2) if isinstance(area_km2, str) else area_km2
    return depth / F.lit(1000.0) * area * F.lit(1_000_000.0)


def pivot_features(
    df: DataFrame,
    key: str,
    prop: str,
    depth: str,
    value: str,
    props: Sequence[str],
    depths: Sequence[str],
) -> DataFrame:
    """One column per property and depth, for fixed short lists of both."""
    names = [f"{p}_{d}" for p in props for d in depths]
    named = df.withColumn("_name", F.concat_ws("_", prop, depth))
    return named.groupBy(key).pivot("_name", names).agg(F.first(value, ignorenulls=True))


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many of the feature columns are missing, and whether all are."""
    count = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.withColumns(
        {"missing_feature_count": count, "all_missing_flag": count == len(columns)}
    )


def category_share(df: DataFrame, key: str, category: str, weight: str) -> DataFrame:
    """Share of each category, and the dominant one (ties: the smallest name) beside it."""
    parts = df.groupBy(key, category).agg(F.sum(weight).alias("_w"))
    totals = parts.groupBy(key).agg(
        F.sum("_w").alias("_total"),
        F.min_by(category, F.struct((-F.col("_w")).alias("w"), F.col(category).alias("c"))).alias(
            "dominant"
        ),
    )
    return parts.join(totals, key).select(
        key,
        category,
        F.try_divide("_w", "_total").alias("share"),
        "dominant",
        (F.col(category) == F.col("dominant")).alias("is_dominant"),
    )


def attach_static(base: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Repeat the static attributes of an entity over its rows."""
    return base.join(static, key, "left")
