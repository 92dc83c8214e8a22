"""Tables hidden in sheets: find the header row, name the columns, pick cells.

Input is a table of raw rows ``(file, row_idx, cells array<string>)``.  The
header is found by one small aggregate per file; data rows are then read by
column *position*, so no row is turned into a map.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binding import once
from ..functions.text import normalize_name, plain_words
from .files import common_folder, path_below

# What marks a header row, one group per expected column.
HEADER_GROUPS = (
    ("year", "yy", "annee"),
    ("month", "mm", "mois"),
    ("station", "station name", "name"),
    ("haut", "temp", "precip", "total"),
)
HEADER_ROWS_SCORED = 8
HEADER_NAMES_EXACT = ("year", "yy")
HEADER_ROWS_EXACT = 10

_CELL_MARK = "\x1e"

# Column names that mean the same.
COLUMN_SYNONYMS = {
    "Station_Name": ("station_name", "name"),
    "StationID": ("stationid",),
    "Lat": ("lat",),
    "Lon": ("lon",),
    "Elev": ("elev", "alt"),
    "Year": ("year", "yy"),
    "Month": ("month", "mm"),
}
LEVEL_COLUMN, LEVEL_TOKENS = "haut_moy", ("haut", "moy")
REQUIRED_COLUMNS = ("Station_Name", "Lat", "Lon", "Elev", "Year", "Month", "haut_moy")


def read_sheet_rows(spark: SparkSession, paths: str | Sequence[str], width: int) -> DataFrame:
    """Headerless CSV exports of sheets as ``(file, row_idx, cells)``.

    Quoted cells may hold line breaks, so a file is read as a whole.  ``width``
    is the most cells a row may have: one with more stops the job, nothing is
    cut off.  ``file`` is a file's path below the folder that holds all of them: its name, if they lie in one folder.
    """
    names = [f"c{i}" for i in range(width)]
    raw = (
        spark.read.option("header", "false")
        .option("multiLine", "true")
        .option("escape", '"')
        .option("columnNameOfCorruptRecord", "_raw")
        .schema(", ".join(f"{n} string" for n in [*names, "_beyond"]) + ", _raw string")
        .csv(list(paths) if not isinstance(paths, str) else paths)
    )
    file = path_below(common_folder(raw.inputFiles()))
    # Rows of another length than the schema come with their text: shorter ones are usual.  Commas in quoted cells don't count.
    bare = F.regexp_replace("_raw", r'(^|,)"(?:[^"]|"")*"', "$1")
    many = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) > width
    too_wide = F.col("_beyond").isNotNull() | F.coalesce(many, F.lit(False))
    message = F.concat(F.lit(f"more than {width} cells in a row of "), file)
    cells = F.when(too_wide, F.raise_error(message).cast("array<string>")).otherwise(F.array(*names))
    seen = F.monotonically_increasing_id()
    rows = raw.select(file.alias("file"), seen.alias("seen"), cells.alias("cells"))
    first = F.min("seen").over(Window.partitionBy("file"))
    return rows.select("file", (F.col("seen") - first).cast("int").alias("row_idx"), "cells")


def header_score(cells: Column | str, groups: Sequence[Sequence[str]] = HEADER_GROUPS) -> Column:
    """How many keyword groups have a keyword inside any cell."""
    cells = F.col(cells) if isinstance(cells, str) else cells
    # The row is normalised as one text in which the mark between cells survives, so
    # no keyword can match across two of them.
    joined = plain_words(F.array_join(cells, _CELL_MARK), _CELL_MARK)

    def score(text: Column) -> Column:
        total = F.lit(0)
        for group in groups:
            hit = F.lit(False)
            for word in group:
                hit = hit | F.contains(text, F.lit(word))
            total = total + hit.cast("int")
        return total

    return once(joined, score)


def detect_header(
    rows: DataFrame,
    groups: Sequence[Sequence[str]] = HEADER_GROUPS,
    max_rows: int = HEADER_ROWS_SCORED,
) -> DataFrame:
    """``(file, header_row, header_score)``: best score among the first rows, earliest on ties."""
    scored = rows.where(F.col("row_idx") < max_rows).select(
        "file", "row_idx", header_score("cells", groups).alias("score")
    )
    # One integer holds score and earliness, so the aggregate keeps to fixed-width buffers.
    rank = F.col("score") * F.lit(max_rows) + (F.lit(max_rows - 1) - F.col("row_idx"))
    best = scored.groupBy("file").agg(F.max(rank).alias("best"))
    return best.select(
        "file",
        (F.lit(max_rows - 1) - F.pmod("best", F.lit(max_rows))).cast("int").alias("header_row"),
        F.floor(F.col("best") / max_rows).cast("int").alias("header_score"),
    )


def detect_header_exact(
    rows: DataFrame,
    names: Sequence[str] = HEADER_NAMES_EXACT,
    max_rows: int = HEADER_ROWS_EXACT,
) -> DataFrame:
    """``(file, header_row)``: first row with a cell equal to one of ``names``, else 0."""
    lowered = F.transform("cells", lambda c: F.lower(F.trim(c)))
    is_header = F.arrays_overlap(lowered, F.array(*[F.lit(n) for n in names]))
    head = rows.where(F.col("row_idx") < max_rows)
    return head.groupBy("file").agg(
        F.coalesce(F.min(F.when(is_header, F.col("row_idx"))), F.lit(0)).cast("int").alias("header_row")
    )


def _column_names(cells: Column) -> Column:
    """Normalised header cells: blanks become ``unnamed_<i>``, repeats get ``_1``, ``_2``…"""
    filled = F.transform(
        cells,
        lambda c, i: F.when(
            c.isNull() | (F.trim(c) == ""), F.concat(F.lit("Unnamed: "), i.cast("string"))
        ).otherwise(c),
    )

    def numbered(raw: Column) -> Column:
        def name(c: Column, i: Column) -> Column:
            earlier = F.size(F.filter(F.slice(raw, F.lit(1), i), lambda x: x == c))
            return F.when(earlier > 0, F.concat(c, F.lit("."), earlier.cast("string"))).otherwise(c)

        return F.transform(raw, name)

    return F.transform(once(filled, numbered), normalize_name)


def headers(rows: DataFrame, header_rows: DataFrame) -> DataFrame:
    """``(file, header_row, columns array<string>)`` from the detected header rows."""
    return rows.join(header_rows.select("file", "header_row"), "file").where(
        F.col("row_idx") == F.col("header_row")
    ).select("file", "header_row", _column_names(F.col("cells")).alias("columns"))


def data_rows(rows: DataFrame, header: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Rows below the header that are not wholly empty, with ``extra`` header columns."""
    blank = F.forall("cells", lambda c: c.isNull() | (F.trim(c) == ""))
    return (
        rows.where(~blank)
        .join(header.select("file", "header_row", *extra), "file")
        .where(F.col("row_idx") > F.col("header_row"))
    )


def promote_header(rows: DataFrame, header: DataFrame) -> DataFrame:
    """``(file, row_idx, values map<name, cell>)`` for files of unlike layout."""
    data = data_rows(rows, header, ["columns"])
    width = F.size("columns")
    padded = F.slice(
        F.concat("cells", F.array_repeat(F.lit(None).cast("string"), width)), F.lit(1), width
    )
    return data.select("file", "row_idx", F.map_from_arrays("columns", padded).alias("values"))


def locate(
    columns: Column | str,
    exact: Sequence[str] = (),
    contains: Sequence[str] = (),
) -> Column:
    """Position (from 1) of the first column named in ``exact``, else of the first
    holding every token of ``contains``; NULL when there is none.

    Without tokens there is no second try: an absent exact name is NULL rather
    than whatever column comes first.
    """
    columns = F.col(columns) if isinstance(columns, str) else columns
    wanted = F.array(*[F.lit(n) for n in exact]) if exact else None
    position = F.lit(None).cast("int")
    if contains:
        def has_all(name: Column) -> Column:
            test = F.lit(True)
            for token in contains:
                test = test & F.contains(name, F.lit(token))
            return test

        position = _first_position(columns, has_all)
    if wanted is not None:
        position = F.coalesce(
            _first_position(columns, lambda n: F.array_contains(wanted, n)), position
        )
    return position


def _first_position(columns: Column, test) -> Column:
    at = F.array_position(F.transform(columns, test), F.lit(True)).cast("int")
    return F.when(at > 0, at)


def cell(cells: Column | str, position: Column | str) -> Column:
    """The cell at a position from :func:`locate`; blank or absent gives NULL."""
    cells = F.col(cells) if isinstance(cells, str) else cells
    position = F.col(position) if isinstance(position, str) else position
    text = F.try_element_at(cells, position)
    return F.when(F.trim(text) != "", text)


def harmonise(
    df: DataFrame,
    synonyms: Mapping[str, Sequence[str]] = COLUMN_SYNONYMS,
    level: tuple[str, Sequence[str]] = (LEVEL_COLUMN, LEVEL_TOKENS),
    drop: Sequence[str] = ("StationID",),
    required: Sequence[str] = REQUIRED_COLUMNS,
) -> DataFrame:
    """Rename columns to one vocabulary, drop ids, keep the required columns."""
    canonical = {alias: name for name, aliases in synonyms.items() for alias in aliases}
    renames: dict[str, str] = {}
    for column in df.columns:
        lowered = column.strip().lower()
        if lowered in canonical:
            renames[column] = canonical[lowered]
        elif all(token in lowered for token in level[1]):
            renames[column] = level[0]
    renamed = df.withColumnsRenamed(renames).drop(*drop)
    missing = [c for c in required if c not in renamed.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; found {renamed.columns}")
    return renamed.select(*required)
