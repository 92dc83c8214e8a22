"""Whole panel jobs over the given tables.

Suppliers are the rivers, customers the climate stations, line items the hourly
readings of a grid cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.steps import month_start
from ..plans import climate_fill, hourly_export, panel_build
from ..plans import fixed_values as fv
from . import tables as tb
from .matching import customers_placed, suppliers_placed
from .registry import query
from .tables import cents, table


# A supplier's grid cell; far more cells than suppliers, so some hold no station.
CELLS = 997


def _hourly(spark: SparkSession, sf: str, key: str) -> DataFrame:
    amount = F.floor("l_extendedprice").cast("double")
    return table(spark, sf, "lineitem").select(
        F.pmod("l_suppkey", F.lit(CELLS)).cast("string").alias(key),
        F.col("l_shipdate").alias("timestamp"),
        amount.alias("t2m"),
        F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).alias("tp"),
        F.col("l_quantity").alias("u10"),
        F.col("l_linenumber").cast("double").alias("v10"),
        F.col("l_quantity").alias("d2m"),
        F.when(F.col("l_linestatus") == "O", amount).alias("msl"),
    )


_HOURLY = f"""hourly AS (
  SELECT CAST(l_suppkey % {CELLS} AS VARCHAR) AS grid, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         CAST(floor(l_extendedprice) AS DOUBLE) AS t2m, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS tp,
         l_quantity AS u10, CAST(l_linenumber AS DOUBLE) AS v10, l_quantity AS d2m,
         CASE WHEN l_linestatus = 'O' THEN CAST(floor(l_extendedprice) AS DOUBLE) END AS msl
  FROM lineitem)"""


def _panel(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    river = F.col("supplier").cast("string").alias("river")
    levels = tb.thin_levels(spark, sf).select(
        river, F.col("month").alias("date"), F.col("level").alias("water_level")
    )
    runoff = (
        tb.lines(spark, sf)
        .groupBy("supplier", "month")
        .agg(F.sum(F.when(F.col("flag") == "N", F.col("cents"))).cast("double").alias("runoff"))
        .select(river, F.col("month").alias("date"), "runoff")
    )
    cell = lambda c: F.pmod(c, F.lit(CELLS)).cast("string")
    rivers = suppliers_placed(spark, sf).select(river, "lat", "lon", cell("supplier").alias("cell"))
    stations = customers_placed(spark, sf).select(
        F.col("customer").cast("string").alias("station_key"),
        F.col("label").alias("station_name_raw"),
        "lat",
        "lon",
        # Stations of some nations are on no known cell.
        F.when(F.floor(F.col("cell") / 4) < 15, cell("customer")).alias("cell"),
    )
    done = F.when(F.col("o_orderstatus") == "F", cents("o_totalprice"))
    observed = (
        table(spark, sf, "orders")
        .groupBy(
            F.col("o_custkey").cast("string").alias("station_key"),
            month_start("o_orderdate").alias("date"),
        )
        .agg(
            F.max(cents("o_totalprice")).cast("double").alias("temp_max_observed"),
            F.min(cents("o_totalprice")).cast("double").alias("temp_min_observed"),
            F.sum(done).cast("double").alias("precip_observed"),
        )
    )
    temperature = observed.select("station_key", "date", "temp_max_observed", "temp_min_observed")
    precipitation = observed.select("station_key", "date", "precip_observed")
    monthly = panel_build.hourly_months(_hourly(spark, sf, "era5_grid"))
    return panel_build.assemble(
        levels, runoff, rivers, (temperature, stations), (precipitation, stations), monthly
    )


_PANEL = f"""{tb.DENSE_THIN}, {_HOURLY},
monthly AS (
  SELECT grid, date, avg(t2m) - 273.15 AS era5_t2m_mean, min(t2m) - 273.15 AS era5_t2m_min, max(t2m) - 273.15 AS era5_t2m_max,
         sum(tp) * 1000.0 AS era5_tp_sum, avg(u10) AS era5_u10_mean, avg(v10) AS era5_v10_mean,
         avg(d2m) - 273.15 AS era5_d2m_mean, avg(msl) AS era5_msl_mean
  FROM hourly GROUP BY ALL),
runoff AS (SELECT supplier, month, CAST(sum(CASE WHEN flag = 'N' THEN cents END) AS DOUBLE) AS runoff FROM lines GROUP BY ALL),
rivers AS (
  SELECT s_suppkey AS supplier, s_suppkey % {CELLS} AS cell,
         CAST(floor(s_acctbal / 100) AS DOUBLE) AS lat, CAST(s_suppkey % 180 AS DOUBLE) AS lon FROM supplier),
stations AS (
  SELECT c_custkey AS customer, c_name AS label, CASE WHEN c_nationkey < 15 THEN c_custkey % {CELLS} END AS cell,
         CAST(floor(c_acctbal / 100) AS DOUBLE) AS lat, CAST(c_custkey % 180 AS DOUBLE) AS lon FROM customer),
candidates AS (
  SELECT r.supplier, s.customer, s.label, 'same_era5_grid' AS mode,
         sqrt((r.lat - s.lat) * (r.lat - s.lat) + (r.lon - s.lon) * (r.lon - s.lon)) AS dist
  FROM rivers r JOIN stations s ON s.cell = r.cell
  UNION ALL
  SELECT r.supplier, s.customer, s.label, 'nearest_fallback',
         sqrt((r.lat - s.lat) * (r.lat - s.lat) + (r.lon - s.lon) * (r.lon - s.lon))
  FROM rivers r, stations s WHERE r.cell NOT IN (SELECT cell FROM stations WHERE cell IS NOT NULL)),
choice AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY dist, label, CAST(customer AS VARCHAR)) AS rn
                 FROM candidates) WHERE rn = 1),
obs AS (
  SELECT o_custkey AS customer, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         CAST(max(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS hi,
         CAST(min(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS lo,
         CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS DOUBLE) AS wet
  FROM orders GROUP BY ALL),
panel AS (
  SELECT CAST(d.supplier AS VARCHAR) AS river, d.month AS date, CAST(date_part('year', d.month) AS INTEGER) AS year,
         CAST(date_part('month', d.month) AS INTEGER) AS month, d.level AS water_level, f.runoff,
         o.hi AS temp_max_observed, o.lo AS temp_min_observed, o.wet AS precip_observed,
         c.label AS temp_source, c.label AS precip_source, CAST(r.cell AS VARCHAR) AS era5_grid,
         m.* EXCLUDE (grid, date)
  FROM dense d LEFT JOIN rivers r ON r.supplier = d.supplier
  LEFT JOIN runoff f ON f.supplier = d.supplier AND f.month = d.month
  LEFT JOIN choice c ON c.supplier = d.supplier
  LEFT JOIN obs o ON o.customer = c.customer AND o.month = d.month
  LEFT JOIN monthly m ON m.grid = CAST(r.cell AS VARCHAR) AND m.date = d.month)"""


@query(f"WITH {_PANEL} SELECT * FROM panel")
def master_panel(spark: SparkSession, sf: str) -> DataFrame:
    return _panel(spark, sf)[0]


@query(f"""
WITH {_PANEL},
spans AS (SELECT river, min(date) AS first_date, max(date) AS last_date, count(*) AS n_total,
                 count(*) - count(water_level) AS n_missing FROM panel GROUP BY ALL)
SELECT s.*, CAST(r.cell AS VARCHAR) AS era5_grid, c.label AS temp_source, c.dist AS temp_distance_deg, c.mode AS temp_mode,
       c.label AS precip_source, c.dist AS precip_distance_deg, c.mode AS precip_mode
FROM spans s LEFT JOIN rivers r ON CAST(r.supplier AS VARCHAR) = s.river
LEFT JOIN choice c ON CAST(c.supplier AS VARCHAR) = s.river
""")
def panel_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return panel_build.coverage_report(*_panel(spark, sf))


@query(f"""
WITH {_PANEL},
spans AS (SELECT river, min(date) AS first_date, max(date) AS last_date, count(*) AS n_total,
                 count(*) - count(water_level) AS n_missing FROM panel GROUP BY ALL),
dated AS (SELECT CAST(supplier AS VARCHAR) AS river, count(*) AS n_dated FROM thin GROUP BY ALL)
SELECT s.river, s.first_date, s.last_date, s.n_total, s.n_missing, n_dated FROM spans s LEFT JOIN dated d ON d.river = s.river
""")
def panel_coverage_dated(spark: SparkSession, sf: str) -> DataFrame:
    """Dated rows beside the rows of the calendar."""
    dated = tb.thin_levels(spark, sf).select(F.col("supplier").cast("string").alias("river"))
    report = panel_build.coverage_report(*_panel(spark, sf), dated)
    return report.select("river", "first_date", "last_date", "n_total", "n_missing", "n_dated")


_FILLED = f"""{_PANEL},
factors AS (
  SELECT river, CASE WHEN count(*) FILTER (WHERE precip_observed IS NOT NULL AND era5_tp_sum IS NOT NULL) >= 12
    THEN avg(precip_observed) FILTER (WHERE era5_tp_sum IS NOT NULL)
       / nullif(avg(era5_tp_sum) FILTER (WHERE precip_observed IS NOT NULL), 0) END AS precip_bias_factor
  FROM panel GROUP BY ALL),
filled AS (
  SELECT p.river, p.date, coalesce(temp_max_observed, era5_t2m_max) AS temp_max_filled,
         coalesce(temp_min_observed, era5_t2m_min) AS temp_min_filled,
         coalesce(precip_observed, era5_tp_sum * coalesce(precip_bias_factor, 1.0::DOUBLE)) AS precip_filled,
         temp_max_observed IS NULL AS temp_max_imputed, temp_min_observed IS NULL AS temp_min_imputed,
         precip_bias_factor, precip_observed IS NULL AS precip_imputed
  FROM panel p LEFT JOIN factors f ON f.river = p.river)"""


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    return climate_fill.fill_climate(_panel(spark, sf)[0])


@query(f"WITH {_FILLED} SELECT * FROM filled")
def climate_filled_panel(spark: SparkSession, sf: str) -> DataFrame:
    filled = _filled(spark, sf)
    return filled.select("river", "date", *[c for c in filled.columns if c not in fv.PANEL_COLUMNS])


@query(f"""
WITH {_FILLED}
SELECT river, count(*) AS n_total, count(*) FILTER (WHERE temp_max_imputed) AS temp_filled,
       count(*) FILTER (WHERE precip_imputed) AS precip_filled, max(precip_bias_factor) AS precip_bias_factor
FROM filled GROUP BY ALL
""")
def climate_fill_summary(spark: SparkSession, sf: str) -> DataFrame:
    return climate_fill.summary(_filled(spark, sf))


@query(f"""
WITH {_HOURLY},
sums AS (SELECT grid, date, avg(t2m) AS t, avg(d2m) AS d, sum(tp * 1000.0) AS tp, avg(msl) AS m, avg(u10) AS u10_mean,
                avg(v10) AS v10_mean FROM hourly GROUP BY ALL),
cal AS (SELECT grid, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS date
        FROM (SELECT grid, min(date) AS lo, max(date) AS hi FROM hourly GROUP BY ALL))
SELECT c.grid AS location, c.date AS month_start, round(t - 273.15, 5) AS "t2m_mean_C", round(d - 273.15, 5) AS "d2m_mean_C",
       coalesce(tp, 0) AS tp_sum_mm, round(m / 100, 7) AS "msl_mean_hPa", u10_mean, v10_mean
FROM cal c LEFT JOIN sums s ON s.grid = c.grid AND s.date = c.date
""")
def hourly_months(spark: SparkSession, sf: str) -> DataFrame:
    exported = hourly_export.export_months(_hourly(spark, sf, "location"))
    # Converted readings are no whole numbers: their sums depend on the order of rows.
    digits = {"t2m_mean_C": 5, "d2m_mean_C": 5, "msl_mean_hPa": 7}
    return exported.withColumns({c: F.round(c, n) for c, n in digits.items()})
