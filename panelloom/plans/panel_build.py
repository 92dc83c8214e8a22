"""From raw sheets and readings to the published monthly panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import to_number
from ..functions.steps import monthly_date
from ..functions.text import normalize_name, normalize_text
from ..operators.aggregates import first_non_null, rollup_sparse
from ..operators.calendar import densify, with_year_month
from ..operators.names import canonical_name, unmatched_entities
from ..operators.nearest import nearest_join, source_coverage
from ..operators.quality import check_complete, check_subset, check_unique, require_empty
from ..operators.shape import attach, map_values, unpivot
from ..sinks.commit import MANIFEST, beside, commit, decided, exists, recover
from ..sinks.write import slugs, write_panel, write_per_entity, written_files
from ..sources import sheets
from . import fixed_values as fv
from .settle import remove, settle

#: Folders of a published panel.
COMBINED, PER_RIVER = "master_dataset_monthly", "per_river"
YEAR, MONTH, NAME = ("year", "yy"), ("month", "mm"), ("station_name", "name")


def read_sheets(
    rows: DataFrame,
    measures: Mapping[str, Sequence[str]],
    optional: Sequence[str] = (),
    folder: str | None = None,
) -> DataFrame:
    """Dated rows of all sheets: ``file, row_idx, station_name_raw, lat, lon, date`` and measures.

    ``measures`` maps each output to the tokens its column name must hold.  A
    sheet that lacks a column stops the job, unless the column is ``optional``.
    With a shared ``folder`` the rows are written there once and read back;
    whoever names it clears it.
    """
    header = sheets.headers(rows, sheets.detect_header(rows))
    at = {
        "yy": sheets.locate("columns", exact=YEAR),
        "mm": sheets.locate("columns", exact=MONTH),
        "name": sheets.locate("columns", exact=NAME),
        "lat": sheets.locate("columns", exact=["lat"]),
        "lon": sheets.locate("columns", exact=["lon"]),
        **{m: sheets.locate("columns", contains=tokens) for m, tokens in measures.items()},
    }

    def demand(name: str, position: Column) -> Column:
        if name in optional:
            return position
        message = F.concat(F.lit(f"no column for {name!r} in "), F.col("file").cast("string"))
        return F.coalesce(position, F.raise_error(message).cast("int"))

    places = header.withColumns({f"_{n}": demand(n, p) for n, p in at.items()})
    cells = sheets.data_rows(rows, places, [f"_{n}" for n in at])
    numbers = {n: to_number(sheets.cell("cells", f"_{n}")) for n in at if n != "name"}
    read = cells.select(
        "file",
        "row_idx",
        F.trim(sheets.cell("cells", "_name")).alias("station_name_raw"),
        *[c.alias(n) for n, c in numbers.items()],
    )
    dated = monthly_date(read, "yy", "mm").drop("yy", "mm", "year", "month")
    # Everything later reads these rows several times: keep them, not the sheets.
    return settle(dated, folder, "sheets") if folder else dated


def river_levels(
    rows: DataFrame, aliases: Sequence[tuple[str, str]] = fv.RIVER_ALIASES, folder: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Levels ``(river, date, water_level)``, locations ``(river, lat, lon)``, suspect names.

    The river comes from the file's name; two files of one river, in one folder or in two, stop the job.
    Station names that map to no river, or to another than their file's
    (``maps_to``), are reported.
    """
    dated = read_sheets(rows, {"water_level": ["haut"]}, folder=folder).withColumn(
        "river", canonical_name(F.substring_index("file", "/", -1), aliases)
    )
    dated = one_file_each(dated, "river")
    levels = (
        dated.where(F.col("river").isNotNull())
        .groupBy("river", "date")
        .agg(first_non_null("water_level", ["station_name_raw", "row_idx", "file"]).alias("water_level"))
    )
    located = dated.groupBy("river").agg(
        first_non_null("lat", ["file", "row_idx"]).alias("lat"),
        first_non_null("lon", ["file", "row_idx"]).alias("lon"),
    )
    named = dated.select("river", "station_name_raw").distinct()
    named = named.withColumn("maps_to", canonical_name("station_name_raw", aliases))
    suspect = named.where(F.col("maps_to").isNull() | (F.col("maps_to") != F.col("river")))
    return levels, located, suspect


def one_file_each(df: DataFrame, key: str) -> DataFrame:
    """The rows as they are; an entity that comes from more than one file stops the job."""
    files = df.groupBy(F.col(key).alias("_key")).agg(F.min("file").alias("_one"), F.max("file").alias("_other"))
    message = F.concat(F.lit("more than one file for "), F.col(key), F.lit(": "), F.col("_one"), F.lit(", "), F.col("_other"))
    checked = F.when(F.col("_one") == F.col("_other"), F.col(key)).otherwise(F.raise_error(message))
    joined = df.join(files, df[key] == F.col("_key"), "left").withColumn(
        key, F.when(F.col(key).isNotNull(), checked)
    )
    return joined.select(*df.columns)


def without_runoff(rivers: DataFrame, runoff: DataFrame) -> DataFrame:
    """Target rivers that no runoff column maps to."""
    return unmatched_entities(rivers, runoff, "river")


def river_runoff(
    wide: DataFrame, order: str, aliases: Sequence[tuple[str, str]] = fv.RIVER_ALIASES
) -> tuple[DataFrame, DataFrame]:
    """Runoff ``(river, date, runoff)`` from a matrix with a column per river, and unmapped columns.

    ``order`` names a column that orders the rows of the source.
    """
    spark = wide.sparkSession
    names = [r[0] for r in _normalised(spark, wide.columns)]
    named = wide.toDF(*names)
    order = names[wide.columns.index(order)]
    year = next(c for c in names if c in ("annee", "year"))
    month = next(c for c in names if c in ("mois", "month"))
    rivers = [c for c in names if c not in (year, month, order)]
    numbers = named.select(
        order,
        to_number(F.col(year).cast("string")).alias("_yy"),
        to_number(F.col(month).cast("string")).alias("_mm"),
        *[to_number(F.col(c).cast("string")).alias(c) for c in rivers],
    )
    dated = monthly_date(numbers, "_yy", "_mm").select(order, "date", *rivers)
    long = unpivot(dated, [order, "date"], rivers, "source_name", "runoff").withColumn(
        "river", canonical_name("source_name", aliases)
    )
    runoff = (
        long.where(F.col("river").isNotNull())
        .groupBy("river", "date")
        .agg(first_non_null("runoff", ["ord", order]).alias("runoff"))
    )
    unmapped = long.where(F.col("river").isNull()).select("source_name").distinct()
    return runoff, unmapped


def _normalised(spark, columns: Sequence[str]) -> list:
    """Column names are plan metadata; a one-row projection normalises them all."""
    names = F.array(*[normalize_name(F.lit(c)) for c in columns])
    return spark.range(1).select(F.explode(names)).collect()


def station_months(
    rows: DataFrame,
    measures: Mapping[str, Sequence[str]],
    grids: Mapping[str, str] = fv.STATION_GRID,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Observations per (station_key, date) and the station dimension.

    A station found in several files is merged once over all of them, so the
    keys of both results are unique.
    """
    dated = read_sheets(rows, measures, folder=folder).withColumn("station_key", normalize_text("station_name_raw"))
    seen = ["file", "row_idx"]
    observations = dated.groupBy("station_key", "date").agg(
        *[first_non_null(m, seen).alias(m) for m in measures]
    )
    by_date = ["file", "date", "row_idx"]
    stations = dated.groupBy("station_key").agg(
        *[first_non_null(c, by_date).alias(c) for c in ("station_name_raw", "lat", "lon")]
    )
    return observations, map_values(stations, "station_key", grids, "cell")


def hourly_months(hourly: DataFrame, grid: str = "era5_grid") -> DataFrame:
    """Hourly readings to months: only months with readings, units converted after."""
    return rollup_sparse(
        hourly, [grid], "timestamp", fv.HOURLY_TO_PANEL, out_t="date", units=fv.PANEL_UNITS
    )


def assemble(
    levels: DataFrame,
    runoff: DataFrame,
    rivers: DataFrame,
    temperature: tuple[DataFrame, DataFrame],
    precipitation: tuple[DataFrame, DataFrame],
    monthly: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """The panel, and the chosen sources per river.

    ``rivers`` has ``river, lat, lon, cell``; ``temperature`` and
    ``precipitation`` are (observations, stations); ``monthly`` is
    :func:`hourly_months`.  Fine readings are rolled up before any join.  What
    belongs to a river as a whole (its stations, its grid) is gathered in one
    row each and joined once; the readings then meet on keys unique on the right.
    """
    sources = rivers.select("river", F.col("cell").alias("era5_grid"))
    # stations that serve both are searched once
    searches = [(temperature[1], ["temp"]), (precipitation[1], ["precip"])]
    if temperature[1] is precipitation[1]:
        searches = [(temperature[1], ["temp", "precip"])]
    for stations, labels in searches:
        choices = nearest_join(rivers, stations, "river", "station_key", name="station_name_raw")
        named = choices.join(stations.select("station_key", "station_name_raw"), "station_key")
        kinds = {"station": "station_key", "source": "station_name_raw", "distance_deg": "distance_deg", "mode": "selection_mode"}
        columns = [F.col(c).alias(f"_{label}_station" if k == "station" else f"{label}_{k}") for label in labels for k, c in kinds.items()]
        sources = sources.join(named.select("river", *columns), "river", "left")

    panel = with_year_month(densify(levels, ["river"], "date", rolled_up=True), "date")
    panel = attach(panel, runoff.select("river", "date", "runoff"), ["river", "date"])
    links = ["_temp_station", "temp_source", "_precip_station", "precip_source", "era5_grid"]
    panel = panel.join(sources.select("river", *links), "river", "left")
    for label, (observed, _), measures in (
        ("temp", temperature, ["temp_max_observed", "temp_min_observed"]),
        ("precip", precipitation, ["precip_observed"]),
    ):
        station = F.col("station_key").alias(f"_{label}_station")
        readings = observed.select(station, "date", *measures)
        panel = attach(panel, readings, [f"_{label}_station", "date"])
    panel = attach(panel, monthly, ["era5_grid", "date"])
    return panel.select(*fv.PANEL_COLUMNS), sources.drop("_temp_station", "_precip_station")


def coverage_report(panel: DataFrame, sources: DataFrame, dated: DataFrame | None = None) -> DataFrame:
    """Range, rows, chosen sources and missing months per river.

    ``dated`` is the level table before its calendar was filled in; with it the
    report also has the number of dated rows.
    """
    columns = [c for c in sources.columns if c != "river"]
    report = source_coverage(panel, "river", "date", "water_level", sources, columns)
    if dated is None:
        return report
    counts = dated.groupBy("river").agg(F.count("*").alias("n_dated"))
    return report.join(counts, "river", "left")


def publish(
    panel: DataFrame, out: str, fmt: str = "csv", levels: DataFrame | None = None
) -> DataFrame:
    """Check, then publish the panel, its per-river folders and the manifest; returns the manifest.

    The panel is evaluated once, into a table beside ``out`` that is checked and written from.  A panel that fails a check (keys
    unique, calendars complete, folder names distinct, exactly the observed ``levels`` if given, as many rows written as there
    are) is not published.  Everything is written beside ``out``, the manifest last: it is the commit record.  Only then are
    the old files switched for the new ones.  A job that dies before leaves the old panel whole; one that dies while
    switching is finished by :func:`panelloom.sinks.commit.recover`, which the next call begins with.  The manifest lists the files written;
    rivers that are not in the panel stay.
    """
    spark = panel.sparkSession
    recover(spark, out)
    work = beside(out)
    new = f"{work}/new"
    try:
        stored = settle(panel, work, "panel")
        checks = [
            check_unique(stored, ["river", "date"]),
            check_complete(stored, "river", "date"),
            slugs(stored, "river"),
        ]
        if levels is not None:
            keys = ["river", "date", "water_level"]
            known = lambda df: df.where(F.col("water_level").isNotNull()).select(*keys)
            checks.append(check_subset(known(stored), known(levels)))
        require_empty(*checks)
        write_panel(stored, f"{new}/{COMBINED}", "river", "date", stored.columns, fmt)
        write_per_entity(stored, f"{new}/{PER_RIVER}", "river", "date", stored.columns, fmt)
        reader = spark.read.format(fmt).option("header", "true").schema(stored.schema)
        written = [written_files(reader.load(f"{new}/{part}"), new) for part in (COMBINED, PER_RIVER)]
        listed = settle(written[0].unionByName(written[1]), work, "listed")
        n = stored.count()
        sums = listed.groupBy(F.substring_index("file", "/", 1).alias("part")).agg(F.sum("row_count").alias("row_count")).collect()
        if any(r.row_count != n for r in sums) or (n and len(sums) < 2):
            raise ValueError(f"{n} rows in the panel, written: {sums}")
        if exists(spark, f"{out}/{PER_RIVER}"):  # what stays there
            folder = F.regexp_extract("file", f"^{PER_RIVER}/([^/]+)/", 1)
            old = written_files(spark.read.format(fmt).option("header", "true").load(f"{out}/{PER_RIVER}"), out)
            renewed = listed.select(folder.alias("folder")).distinct()
            listed = listed.unionByName(old.withColumn("folder", folder).join(renewed, "folder", "left_anti").drop("folder"))
        commit(spark, out, listed, whole=[COMBINED], by_folder=[PER_RIVER])
    finally:
        if not decided(spark, out):  # once decided, recover finishes it
            remove(spark, work)
    return spark.read.schema("file string, row_count long").option("header", "true").csv(f"{out}/{MANIFEST}")
