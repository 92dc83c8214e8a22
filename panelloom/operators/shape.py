"""Projections, filters, reshaping, plain attachments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_empty(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Drop wholly empty rows, then rows with a missing key."""
    df = df.dropna(how="all")
    return df.dropna(how="any", subset=list(keys)) if keys else df


def unpivot(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str] | None = None,
    name: str = "source_name",
    value: str = "value",
) -> DataFrame:
    """Wide to long, one row per value column, with the column's position in ``ord``."""
    values = list(values) if values is not None else [c for c in df.columns if c not in ids]
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(c).alias(name),
                F.col(c).cast("double").alias(value),
            )
            for i, c in enumerate(values)
        ]
    )
    return df.select(*ids, F.inline(cells))


def pivot_series(df: DataFrame, key: str, t: str, value: str, keys: Sequence) -> DataFrame:
    """Long to wide: one column per entity in ``keys``, a row per time any of them has.

    Meant for a short list of entities; operators on many series stay long.
    """
    return df.groupBy(t).pivot(key, list(keys)).agg(F.first(value, ignorenulls=True))


def fill_from(
    df: DataFrame,
    value: str,
    other: str,
    out: str,
    flag: str | None = None,
    flag_rule: str = "reference",
) -> DataFrame:
    """``out`` is ``value`` or, where that is missing, ``other``; ``value`` is kept.

    The flag marks every missing observation (``reference``) or only those that
    really got a value (``strict``).
    """
    columns = {out: F.coalesce(value, other)}
    if flag is not None:
        columns[flag] = fill_flag(F.col(value), F.col(other), flag_rule)
    return df.withColumns(columns)


def fill_flag(value: Column, other: Column, rule: str) -> Column:
    if rule == "reference":
        return value.isNull()
    if rule == "strict":
        return value.isNull() & other.isNotNull()
    raise ValueError(f"unknown flag rule {rule!r}")


def map_values(df: DataFrame, column: str, mapping: Mapping[str, str], out: str) -> DataFrame:
    """Look each value up in a small fixed dictionary; unmapped gives NULL."""
    if not mapping:
        return df.withColumn(out, F.lit(None).cast("string"))
    pairs = F.create_map(*[F.lit(x) for item in mapping.items() for x in item])
    return df.withColumn(out, F.try_element_at(pairs, F.col(column)))


def attach(base: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left equi-join of measures; the base keeps every row."""
    return base.join(other, list(on), "left")


def attach_via(
    base: DataFrame,
    key: str,
    link: DataFrame,
    other: DataFrame,
    on: Sequence[str],
) -> DataFrame:
    """Left join through a mapped key: ``link`` maps ``key`` to a column of ``on``.

    ``link`` has one row per entity; whether it is sent to all tasks is decided
    from its measured size at run time.
    """
    return base.join(link, key, "left").join(other, list(on), "left")


def upsert_columns(base: DataFrame, extra: DataFrame, on: Sequence[str]) -> DataFrame:
    """Replace or add the columns of ``extra`` by key; running it twice changes nothing.

    A key met twice in ``extra`` stops the job instead of multiplying rows.  The
    check groups on the join key, so the join needs no further shuffle of ``extra``.
    """
    new = [c for c in extra.columns if c not in on]
    unique = extra.groupBy(*on).agg(
        F.count("*").alias("_copies"), F.first(F.struct(*new)).alias("_new")
    )
    checked = unique.select(
        *on,
        F.when(F.col("_copies") == 1, F.col("_new"))
        .otherwise(F.raise_error(F.lit("upsert_columns: key is not unique")).cast(
            unique.schema["_new"].dataType
        ))
        .alias("_new"),
    )
    return (
        base.drop(*new)
        .join(checked, list(on), "left")
        .select(*[c for c in base.columns if c not in new], "_new.*")
    )
