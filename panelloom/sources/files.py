"""Scans over many same-shaped files."""

from __future__ import annotations

import csv
import os
import re
from collections.abc import Sequence
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import nan_to_null


def file_name() -> Column:
    """Name of the file a row was read from, as it is on disk.

    Spark reports names as URL parts, but with a plus sign left as it is.
    """
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def _literal(path: str) -> str:
    """A listed file as a path that is taken as it is."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(path))


def path_below(folder: str) -> Column:
    """Path of the file a row was read from, below a folder."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, "^.*?" + re.escape(folder.rstrip("/")) + "/", "")


def common_folder(files: Sequence[str]) -> str:
    """The innermost folder that holds all listed files, without a scheme."""
    folders = [urlsplit(f).path if "://" in f or f.startswith("file:") else f for f in files]
    folders = [unquote(f).rsplit("/", 1)[0] for f in folders]
    return os.path.commonpath(folders) if folders else ""


def header_lines(spark: SparkSession, files: Sequence[str]) -> list[tuple[str, str]]:
    """(listed file, first line) of text files, by one job.

    Every split of a file is a task of its own, which reads one batch of lines and stops; only first splits give a row.
    """
    import pyarrow as pa

    def first(batches):
        for batch in batches:
            if batch.num_rows:
                if batch.column(1)[0].as_py() == 0:
                    line = (batch.column(2)[0].as_py() or "").lstrip("\ufeff")
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), pa.array([line])], names=["file", "line"])
                return

    batch, cost = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.openCostInBytes"
    before = {k: spark.conf.get(k) for k in (batch, cost)}
    spark.conf.set(batch, "1")
    spark.conf.set(cost, str(1 << 40))  # no two splits share a task
    try:
        lines = spark.read.text([_literal(f) for f in files])
        found = lines.select("_metadata.file_path", "_metadata.file_block_start", "value").mapInArrow(first, "file string, line string").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return [(r.file, r.line) for r in found]


def _by_layout(spark: SparkSession, reader, files: Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV files by column *name*: one scan for each order of columns found in their header lines.

    Only header lines are looked at beforehand, by one job for all files.  Each scan also checks the
    headers of its files (``enforceSchema`` is off), so nothing is taken by position.
    """
    kinds = {f.name.lower(): f for f in schema.fields}
    layouts: dict[tuple[str, ...], list[str]] = {}
    for file, line in sorted(header_lines(spark, files)):
        names = tuple(next(csv.reader([line]), []))
        layouts.setdefault(names, []).append(_literal(file))
    frames = []
    for names, paths in layouts.items():
        absent = [f.name for f in schema.fields if f.name.lower() not in {n.lower() for n in names}]
        if absent:
            raise ValueError(f"column(s) {absent} missing in {paths[0]}; found {list(names)}")
        layout = T.StructType([T.StructField(n, kinds[n.lower()].dataType if n.lower() in kinds else T.StringType()) for n in names])
        frames.append(reader.schema(layout).option("enforceSchema", "false").load(paths).select(*schema.names, "_metadata"))
    # files without any line have no header and no rows
    return union_series(frames) if frames else reader.schema(schema).load([_literal(f) for f in files]).select(*schema.names, "_metadata")


def read_series(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    key_regex: str | None = None,
    key: str = "series",
    schema: T.StructType | str | None = None,
    columns: Sequence[str] | None = None,
    exclude_regex: str | None = None,
    expect_files: int | None = None,
    fmt: str = "csv",
    path: str | None = None,
) -> DataFrame:
    """Read every matching file in one scan and tag rows with their series id.

    ``key_regex`` has one group, matched on the file name; a file that does not
    match stops the job.  ``exclude_regex`` leaves out files by name, for
    instance results of an earlier run.  ``expect_files`` guards a source that
    must be found exactly that often (without the excluded ones).  ``path`` names a column for each row's file.

    CSV columns are found by name: files may order them differently and have
    others besides; a missing one raises.  NaN becomes NULL.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("nanValue", "NaN")
    given = list(paths) if not isinstance(paths, str) else paths
    if schema is not None and fmt == "csv":
        if isinstance(schema, str):
            schema = spark.createDataFrame([], schema).schema
        listed = spark.read.format("text").load(given).inputFiles()
        if exclude_regex is not None:
            listed = [f for f in listed if not re.search(exclude_regex, unquote(f).rsplit("/", 1)[-1])]
        df = _by_layout(spark, reader, sorted(listed), schema) if listed else spark.createDataFrame([], schema)
        names = schema.names
    else:
        df = (reader.schema(schema) if schema is not None else reader).load(given)
        names = df.columns
    if expect_files is not None:
        # A listing of names, not a job over the data.
        found = [unquote(f).rsplit("/", 1)[-1] for f in df.inputFiles()]
        found = len([f for f in found if exclude_regex is None or not re.search(exclude_regex, f)])
        if found != expect_files:
            raise FileNotFoundError(f"expected {expect_files} file(s) for {paths}, found {found}")
    if exclude_regex is not None and df.inputFiles():
        df = df.where(~file_name().rlike(exclude_regex))
    kinds = dict(df.dtypes)
    wanted = [nan_to_null(c).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in (columns or names)]
    if key_regex is not None:
        found = F.regexp_extract(file_name(), key_regex, 1)
        message = F.concat(F.lit("no series id in file name "), file_name())
        found = F.when(file_name().rlike(key_regex), found).otherwise(F.raise_error(message))
        wanted.insert(0, found.alias(key))
    if path is not None:
        wanted.append(F.col("_metadata.file_path").alias(path))
    return df.select(*wanted)


def union_series(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; columns a frame lacks become NULL."""
    first, *rest = frames
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def normalise_hourly(df: DataFrame, drop: Sequence[str] = ("number",)) -> DataFrame:
    """One ``timestamp`` column from ``valid_time`` or ``time``; drop leftovers."""
    source = "valid_time" if "valid_time" in df.columns else "time"
    if source in df.columns:
        df = df.withColumnRenamed(source, "timestamp")
    return df.drop("time", *drop)
