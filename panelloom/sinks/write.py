"""Publish a panel: one sorted table, one folder per entity, a manifest."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_name


def sorted_for_output(df: DataFrame, key: str, t: str, columns: Sequence[str]) -> DataFrame:
    """Fixed column order, globally ordered by (entity, time).

    Range partitioning on both columns splits an entity that holds much of the
    table over many tasks.
    """
    return df.select(*columns).repartitionByRange(key, t).sortWithinPartitions(key, t)


def write_panel(
    df: DataFrame, path: str, key: str, t: str, columns: Sequence[str], fmt: str = "csv"
) -> None:
    """The combined panel; CSV with a header by default."""
    writer = sorted_for_output(df, key, t, columns).write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", "true").option("dateFormat", "yyyy-MM-dd")
    writer.format(fmt).save(path)


def write_per_entity(
    df: DataFrame, path: str, key: str, t: str, columns: Sequence[str], fmt: str = "csv"
) -> None:
    """One folder ``slug=<entity>`` each, written in a single job.

    Only the entities in ``df`` are replaced, so a re-run of some of them
    leaves the others alone.  Names that share a slug would share a folder:
    check :func:`slugs` first.
    """
    slugged = sorted_for_output(df, key, t, columns).withColumn("slug", normalize_name(key))
    writer = slugged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer = writer.option("header", "true").option("dateFormat", "yyyy-MM-dd")
    writer.partitionBy("slug").format(fmt).save(path)


def slugs(df: DataFrame, key: str | Column) -> DataFrame:
    """``(slug, names, n)`` of slugs that are empty or stand for more than one entity: none is good."""
    key = F.col(key) if isinstance(key, str) else key
    names = df.select(key.alias("entity")).distinct()
    found = names.groupBy(normalize_name(F.col("entity")).alias("slug")).agg(
        F.min("entity").alias("example"), F.count("*").alias("n")
    )
    return found.where((F.col("n") > 1) | (F.coalesce("slug", F.lit("")) == ""))


def written_files(df: DataFrame, root: str) -> DataFrame:
    """``(file, row_count)`` of a table that was read back: paths below ``root``."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    below = F.regexp_replace(path, "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    return df.groupBy(below.alias("file")).agg(F.count("*").alias("row_count"))


def manifest(
    df: DataFrame,
    key: str | Column,
    combined: str,
    per_entity: str,
    other_files: Sequence[str] = (),
) -> DataFrame:
    """``(file, row_count)``: the combined table, each entity, then files without rows.

    The total is the sum of the entity counts, so the panel is counted once.
    ``per_entity`` is a template with ``{slug}``.
    """
    key = F.col(key) if isinstance(key, str) else key
    counts = df.groupBy(key.alias("entity")).agg(F.count("*").alias("row_count"))
    before, after = per_entity.split("{slug}")
    # Two entities under one name, or one without a name, would be two equal rows.
    by_slug = counts.groupBy(normalize_name(F.col("entity")).alias("slug")).agg(
        F.sum("row_count").alias("row_count"), F.count("*").alias("n"), F.min("entity").cast("string").alias("example")
    )
    message = F.concat(F.lit("no file name of its own for "), F.coalesce("example", F.lit("NULL")))
    good = (F.col("n") == 1) & (F.coalesce("slug", F.lit("")) != "")
    slug = F.when(good, F.col("slug")).otherwise(F.raise_error(message))
    parts = by_slug.select(F.concat(F.lit(before), slug, F.lit(after)).alias("file"), "row_count")
    total = counts.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count")).select(
        F.lit(combined).alias("file"), "row_count"
    )
    result = total.unionByName(parts)
    if other_files:
        rest = df.sparkSession.createDataFrame(
            [(name, None) for name in other_files], "file string, row_count long"
        )
        result = result.unionByName(rest)
    return result
