"""Fill river levels from their own seasons, and find donor rivers."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import to_number
from ..functions.steps import monthly_date, step_number
from ..operators.aggregates import dedup_first
from ..operators.calendar import densify, fill_static
from ..operators.correlate import corr_class, pairwise_corr, ranked_pairs
from ..operators.impute import imputation_summary, impute_climatology
from ..operators.pair_blocks import best_donors
from ..sources import sheets

STATIC = ("Station_Name", "Lat", "Lon", "Elev")


def dense_levels(
    rows: DataFrame, river_regex: str = r"^(?:Niveaux d'eau de la Riviere )?(.*?)(?:\.\w+)?$"
) -> DataFrame:
    """Every month of every sheet: ``river, Date, Station_Name, Lat, Lon, Elev, haut_moy``."""
    header = sheets.headers(rows, sheets.detect_header_exact(rows))
    at = {
        "Station_Name": sheets.locate("columns", exact=["station_name", "name"]),
        "Lat": sheets.locate("columns", exact=["lat"]),
        "Lon": sheets.locate("columns", exact=["lon"]),
        "Elev": sheets.locate("columns", exact=["elev", "alt"]),
        "Year": sheets.locate("columns", exact=["year", "yy"]),
        "Month": sheets.locate("columns", exact=["month", "mm"]),
        "haut_moy": sheets.locate("columns", contains=["haut", "moy"]),
    }
    cells = sheets.data_rows(
        rows, header.withColumns({f"_{n}": p for n, p in at.items()}), [f"_{n}" for n in at]
    )
    read = cells.select(
        F.regexp_extract(F.substring_index("file", "/", -1), river_regex, 1).alias("river"),
        "row_idx",
        sheets.cell("cells", "_Station_Name").alias("Station_Name"),
        *[to_number(sheets.cell("cells", f"_{n}")).alias(n) for n in at if n != "Station_Name"],
    )
    dated = monthly_date(read, "Year", "Month", "Date").select(
        "river", "Date", "row_idx", *STATIC, "haut_moy"
    )
    unique = dedup_first(dated, ["river", "Date"], ["row_idx"]).drop("row_idx")
    return fill_static(densify(unique, ["river"], "Date", rolled_up=True), "river", "Date", STATIC)


def fill_levels(dense: DataFrame, on_complete: str = "skip") -> DataFrame:
    """The export layout: original and imputed level side by side."""
    filled = impute_climatology(dense, "river", "Date", "haut_moy", on_complete=on_complete)
    return filled.select(
        "river",
        "Date",
        *STATIC,
        F.year("Date").alias("Year"),
        F.month("Date").alias("Month"),
        F.col("haut_moy").alias("haut_moy_original"),
        F.col("haut_moy_imputed"),
    )


def summary(filled: DataFrame) -> DataFrame:
    return imputation_summary(filled, "river", "Date", "haut_moy_original", "haut_moy_imputed")


def donors(dense: DataFrame, entity_blocks: int, min_periods: int = 24) -> tuple[DataFrame, DataFrame]:
    """Ranked, classified pairs and the best donor of every river."""
    series = dense, "river", step_number("Date", "month"), "haut_moy"
    corr = pairwise_corr(*series, min_periods=min_periods, entity_blocks=entity_blocks)
    rivers = dense.select("river").distinct()
    best = best_donors(*series, rivers, "river", min_periods=min_periods, entity_blocks=entity_blocks)
    return ranked_pairs(corr).withColumn("class", corr_class("r")), best
