"""Months of hourly files that are kept up to date: only files that are new or changed are read again.

A folder that all executors share holds, by run, what each file adds to its months (sums, counts, least and greatest values,
which can be merged), and a ledger of files (path, size, time of change, the run that read them).  A run reads the files that the
latest ledger doesn't list as they are, writes their partial months, then the next ledger: it is complete or not there, so a
run that dies changes nothing.  Months are merged from the partials of the files that the ledger lists, so a file that changed
or went away takes its old readings with it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import convert_units
from ..functions.steps import truncate_to
from ..sources.files import normalise_hourly, read_series
from . import fixed_values as fv
from .hourly_export import HOURLY_SCHEMA, LOCATION_REGEX
from .settle import remove

_LEDGER = "file string, size long, changed timestamp, run long"
#: What is kept of a column, and how it is merged.
_KEPT = {"mean": ("sum", "n"), "sum": ("sum",), "min": ("min",), "max": ("max",)}
_FIRST = {"sum": F.sum, "n": F.count, "min": F.min, "max": F.max}
_MERGED = {"sum": F.sum, "n": F.sum, "min": F.min, "max": F.max}


def _runs(spark: SparkSession, folder: str) -> list[int]:
    """Runs whose ledger is complete."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName()) for p in found if p.getName().isdigit() and fs.exists(done(p, "_SUCCESS")))


def _partials(rules: Mapping[str, tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted({(column, part) for column, how in rules.values() for part in _KEPT[how]})


def _value(column: str, how: str) -> Column:
    """A merged month's value."""
    if how == "mean":
        return F.try_divide(F.sum(f"{column}_sum"), F.sum(f"{column}_n"))
    return _MERGED[how](f"{column}_{how}")


def refresh_months(
    spark: SparkSession,
    paths: str | list[str],
    folder: str,
    *,
    rules: Mapping[str, tuple[str, str]] = fv.HOURLY_TO_PANEL,
    units: Mapping[str, tuple[float, float]] | None = fv.PANEL_UNITS,
    schema: str = HOURLY_SCHEMA,
    key_regex: str = LOCATION_REGEX,
    key: str = "era5_grid",
    t: str = "timestamp",
    out_t: str = "date",
    report: dict | None = None,
) -> DataFrame:
    """As rolling up all files at once with :func:`~panelloom.operators.aggregates.rollup_sparse`; ``report`` gets the files read.

    ``rules`` and ``schema`` belong to the folder: with others, take another folder.  Files are told apart by path, size and time
    of change.
    """
    runs = _runs(spark, folder)
    # names, sizes and times only: contents are not looked at
    listing = spark.read.format("binaryFile").load(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed")
    )
    ledger = spark.read.schema(_LEDGER).parquet(f"{folder}/ledger/{runs[-1]}") if runs else spark.createDataFrame([], _LEDGER)
    now = listing.join(ledger, ["file", "size", "changed"], "left").select("file", "size", "changed", "run")
    new = [r.file for r in now.where("run IS NULL").select("file").collect()]  # file names
    gone = ledger.join(listing, ["file", "size", "changed"], "left_anti").count()
    if report is not None:
        report.update(read=new, gone=gone)
    run = runs[-1] if runs else 0
    if new or gone or not runs:
        run += 1
        if new:
            rows = normalise_hourly(read_series(spark, new, key_regex=key_regex, key=key, schema=schema, path="_file"))
            parts = [_FIRST[part](column).alias(f"{column}_{part}") for column, part in _partials(rules) if column in rows.columns]
            months = rows.groupBy(F.col("_file").alias("file"), key, truncate_to(t, "month").alias(out_t)).agg(*parts)
            months.write.mode("overwrite").parquet(f"{folder}/partials/run={run}")
        # one row for each file; written whole or not at all
        now.withColumn("run", F.coalesce("run", F.lit(run))).write.mode("overwrite").parquet(f"{folder}/ledger/{run}")
        _vacuum(spark, folder, runs[-1:] + [run])
    ledger = spark.read.schema(_LEDGER).parquet(f"{folder}/ledger/{run}")
    used = [r.run for r in ledger.select("run").distinct().collect()]
    if not used:
        raise FileNotFoundError(f"no files at {paths}")
    found = spark.read.option("basePath", f"{folder}/partials").parquet(*(f"{folder}/partials/run={r}" for r in sorted(used)))
    # of each file, what the listed run read
    found = found.withColumn("run", F.col("run").cast("long")).join(ledger.select("file", "run"), ["file", "run"], "left_semi")
    values = [_value(column, how).alias(out) for out, (column, how) in rules.items() if f"{column}_{_KEPT[how][0]}" in found.columns]
    return convert_units(found.groupBy(key, out_t).agg(*values), units or {})


def _vacuum(spark: SparkSession, folder: str, keep: list[int]) -> None:
    """Ledgers but those of ``keep``, and partials that none of these lists."""
    used = set()
    for run in keep:
        used |= {r.run for r in spark.read.schema(_LEDGER).parquet(f"{folder}/ledger/{run}").select("run").distinct().collect()}
    for run in _runs(spark, folder):
        if run not in keep:
            remove(spark, f"{folder}/ledger/{run}")
        if run not in keep and run not in used:
            remove(spark, f"{folder}/partials/run={run}")
