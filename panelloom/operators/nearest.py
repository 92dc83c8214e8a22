"""Nearest station per entity, preferring stations of the entity's own grid cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import planar_distance

SAME_CELL, FALLBACK = "same_era5_grid", "nearest_fallback"
# Sides of the cells: the finest in degrees, quadrupled from level to level; above the last, one cell holds everything.
FINEST, LEVELS = 0.02, 8
#: A cell with more stations is split, into pages and within pages into leaves.
PAGE, LEAF = 2048, 16


def _placed(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Rows whose coordinates are numbers: neither NULL nor NaN nor infinite."""
    number = lambda c: F.abs(F.col(c).cast("double")) < float("inf")  # noqa: E731  false for NaN, NULL for NULL
    return df.where(number(lat) & number(lon))


def _least(box: Column, lat: Column, lon: Column) -> Column:
    """Square of the distance to the nearest point of a box."""
    zero = F.lit(0.0)
    dlat = F.greatest(box["lat0"] - lat, lat - box["lat1"], zero)
    dlon = F.greatest(box["lon0"] - lon, lon - box["lon1"], zero)
    return dlat * dlat + dlon * dlon


def _most(box: Column, lat: Column, lon: Column) -> Column:
    """Square of the distance to its farthest point: a station of the box is as near as that."""
    dlat = F.greatest(F.abs(box["lat0"] - lat), F.abs(box["lat1"] - lat))
    dlon = F.greatest(F.abs(box["lon0"] - lon), F.abs(box["lon1"] - lon))
    return dlat * dlat + dlon * dlon


def _near(boxes: Column | str, lat: Column, lon: Column) -> Column:
    """The boxes that may hold the nearest station."""
    bound = F.array_min(F.transform(boxes, lambda x: _most(x, lat, lon))) * (1 + 1e-9) + 1e-300
    # the bound is a variable of its own: within the filter it would be worked out once more for each box
    return F.transform(F.array(bound), lambda b: F.filter(boxes, lambda x: _least(x, lat, lon) <= b))[0]


def _box() -> list[Column]:
    return [F.min("slat").alias("lat0"), F.max("slat").alias("lat1"), F.min("slon").alias("lon0"), F.max("slon").alias("lon1")]


def station_pages(right: DataFrame) -> DataFrame:
    """``g, page, lat0, lat1, lon0, lon1, leaves`` of stations (g, slat, slon, first): an adaptive tree of cells.

    A station's page is the largest cell around it that holds at most ``PAGE`` stations, its leaf the largest with at most
    ``LEAF``: crowded places get small cells, empty ones large cells.  What searches go by are the stations' own bounding
    boxes, so it doesn't matter where the borders of cells lie.
    """
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level")
    side = F.lit(FINEST) * F.pow(F.lit(4.0), F.col("level"))
    cells = right.select("*", level).withColumns({"bx": F.floor((F.col("slat") + 90) / side), "by": F.floor((F.col("slon") + 180) / side)})
    where = ["g", "level", "bx", "by"]
    crowded = cells.groupBy(*where).agg(F.count("*").alias("n")).where(F.col("n") > LEAF)
    split = cells.join(crowded, where, "left").groupBy("g", "slat", "slon").agg(
        F.min("first").alias("first"), F.min(F.when(F.col("n") > PAGE, F.col("level"))).alias("above_page"), F.min(F.when(F.col("n") > LEAF, F.col("level"))).alias("above_leaf"),
    )

    def cell(above: str) -> Column:  # the cell below the smallest crowded one
        level = F.greatest(F.coalesce(F.col(above), F.lit(LEVELS)) - 1, F.lit(0))
        side = F.lit(FINEST) * F.pow(F.lit(4.0), level)
        parts = [level, F.floor((F.col("slat") + 90) / side), F.floor((F.col("slon") + 180) / side)]
        whole = F.array(F.lit(-1).cast("long"))  # nothing crowded: one cell of all
        return F.when(F.col(above).isNull(), whole).otherwise(F.array(*(x.cast("long") for x in parts)))

    leaves = split.groupBy("g", cell("above_page").alias("page"), cell("above_leaf").alias("leaf")).agg(
        *_box(), F.collect_list(F.struct("slat", "slon", "first")).alias("stations")
    )
    box = [f(c).alias(c) for f, c in ((F.min, "lat0"), (F.max, "lat1"), (F.min, "lon0"), (F.max, "lon1"))]
    return leaves.groupBy("g", "page").agg(*box, F.collect_list(F.struct("lat0", "lat1", "lon0", "lon1", "stations")).alias("leaves"))


def nearest_join(
    entities: DataFrame,
    stations: DataFrame,
    key: str,
    station: str,
    *,
    cell: str = "cell",
    lat: str = "lat",
    lon: str = "lon",
    name: str | None = None,
    same_mode: str = SAME_CELL,
    fallback_mode: str = FALLBACK,
) -> DataFrame:
    """``(key, station, distance_deg, selection_mode)``, one row per entity with a place.

    Candidates are the stations of the same cell or, if it has none, all of
    them; least distance wins, then the smallest ``name`` (default: the station
    id), then the smallest id.  Stations and entities without numeric
    coordinates (NULL, NaN) take no part.

    The search is exact and goes down an adaptive tree (:func:`station_pages`).  An entity is sent to the pages whose boxes may
    hold its nearest station, two or three as a rule; there it looks only into the leaves that may.  One row leaves for each
    entity's place and page, however many stations lie there.  A group's row of page boxes grows with its stations / ``PAGE``.
    """
    name = name or station
    # Keys of the search groups: one per cell, and one of all stations.
    cell_group = F.concat(F.lit("="), F.col(cell).cast("string"))
    right = (
        _placed(stations, lat, lon)
        .select(
            F.explode(F.array(cell_group, F.lit("*"))).alias("g"),
            F.col(station).alias("station"),
            F.col(name).cast("string").alias("name"),
            F.col(lat).cast("double").alias("slat"),
            F.col(lon).cast("double").alias("slon"),
        )
        .where(F.col("g").isNotNull())
        # Of stations at one place only the first can win.
        .groupBy("g", "slat", "slon")
        .agg(F.min(F.struct("name", "station")).alias("first"))
    )
    occupied_cells = right.select(F.col("g").alias("own"), F.lit(True).alias("same")).distinct()
    left = (
        _placed(entities, lat, lon)
        .select(
            F.col(key).alias("entity"),
            cell_group.alias("own"),
            F.col(lat).cast("double").alias("elat"),
            F.col(lon).cast("double").alias("elon"),
        )
        .join(occupied_cells, "own", "left")
        .select("entity", F.when(F.col("same"), F.col("own")).otherwise(F.lit("*")).alias("g"), "elat", "elon")
    )
    place = ["g", "elat", "elon"]
    pages = station_pages(right)
    # mentioning the leaves lets Spark take the boxes from the same shuffle
    boxes = pages.where(F.size("leaves") > 0).groupBy("g").agg(F.collect_list(F.struct("page", "lat0", "lat1", "lon0", "lon1")).alias("boxes"))
    lat, lon = F.col("elat"), F.col("elon")
    asked = left.select(*place).distinct().join(boxes, "g").select(*place, F.explode(_near("boxes", lat, lon)["page"]).alias("page"))

    def first_of(leaf: Column) -> Column:
        return F.array_min(F.transform(leaf["stations"], lambda s: F.struct(
            planar_distance(lat, lon, s["slat"], s["slon"]).alias("distance_deg"), s["first"].alias("first")
        )))

    met = asked.join(pages.select("g", "page", "leaves"), ["g", "page"])
    best = met.select(*place, F.array_min(F.transform(_near("leaves", lat, lon), first_of)).alias("best"))
    best = best.groupBy(*place).agg(F.min("best").alias("best"))
    return left.join(best, place).select(
        F.col("entity").alias(key),
        F.col("best.first.station").alias(station),
        F.col("best.distance_deg").alias("distance_deg"),
        F.when(F.col("g") == "*", fallback_mode).otherwise(same_mode).alias("selection_mode"),
    )


def attach_nearest(
    base: DataFrame,
    choices: DataFrame,
    observations: DataFrame,
    *,
    key: str,
    t: str,
    station: str,
    measures: Sequence[str],
    source: DataFrame | None = None,
    source_name: str | None = None,
    out_source: str = "source",
) -> DataFrame:
    """Bring the chosen station's readings to each entity and period.

    The station id goes to the base rows and the readings are met on (station,
    time): they are never copied per entity first.  The provenance column is set
    on every row, also where the station has no reading.
    """
    named = choices.select(key, station)
    if source is not None:
        named = named.join(source.select(station, F.col(source_name).alias(out_source)), station, "left")
    else:
        named = named.withColumn(out_source, F.col(station))
    readings = observations.select(station, t, *measures)
    return (
        base.join(named, key, "left")
        .join(readings, [station, t], "left")
        .select(*base.columns, *measures, out_source)
    )


def source_coverage(
    panel: DataFrame,
    key: str,
    t: str,
    value: str,
    choices: DataFrame,
    columns: Sequence[str],
) -> DataFrame:
    """Range, rows (missing periods included) and missing periods per entity beside its chosen sources."""
    spans = panel.groupBy(key).agg(
        F.min(t).alias("first_date"),
        F.max(t).alias("last_date"),
        F.count("*").alias("n_total"),
        F.count_if(F.col(value).isNull()).alias("n_missing"),
    )
    return spans.join(choices.select(key, *columns), key, "left")
