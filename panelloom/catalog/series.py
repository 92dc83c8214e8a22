"""Roll-ups, calendars, climatology, interpolation, imputation, correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import rounded
from ..functions.steps import month_start, step_number
from ..operators import aggregates, calendar, correlate, impute, interpolate, pair_blocks, pair_order, shape
from . import tables as tb
from .registry import query
from .tables import cents, table

_ORDER = ["orderkey", "line", "partkey", "cents"]
SERIES_SEEN = 1024

# ---- aggregates -------------------------------------------------------------


@query(f"""
WITH {tb.LINES}
SELECT supplier, month,
       arg_min(CASE WHEN line <> 2 THEN cents END, row(orderkey, line, partkey, cents))
         FILTER (WHERE line <> 2) AS value,
       arg_min(CASE WHEN flag = 'N' THEN quantity END, row(orderkey, line, partkey, cents))
         FILTER (WHERE flag = 'N') AS quantity
FROM lines GROUP BY ALL
""")
def first_non_null(spark: SparkSession, sf: str) -> DataFrame:
    rows = tb.lines(spark, sf).withColumns(
        {
            "value": F.when(F.col("line") != 2, F.col("cents")),
            "amount": F.when(F.col("flag") == "N", F.col("quantity")),
        }
    )
    return rows.groupBy("supplier", "month").agg(
        aggregates.first_non_null("value", _ORDER).alias("value"),
        aggregates.first_non_null("amount", _ORDER).alias("quantity"),
    )


@query(f"""
WITH {tb.LINES}
SELECT supplier, month, value FROM (
  SELECT supplier, month, CASE WHEN line <> 2 THEN cents END AS value,
         row_number() OVER (PARTITION BY supplier, month ORDER BY orderkey, line, partkey, cents) AS rn
  FROM lines) WHERE rn = 1
""")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = tb.lines(spark, sf).select(
        "supplier", "month", F.when(F.col("line") != 2, F.col("cents")).alias("value"), *_ORDER
    )
    return aggregates.dedup_first(rows, ["supplier", "month"], _ORDER).select(
        "supplier", "month", "value"
    )


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    """Events as fine-grained readings per (event type, user); purchases have no ``tp``."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("grid"),
        F.col("user_id").alias("user"),
        F.col("ts").alias("timestamp"),
        cents("value").cast("double").alias("t2m"),
        F.when(F.col("event_type") != "purchase", cents("value").cast("double")).alias("tp"),
    )


_READINGS = """readings AS (
  SELECT event_type AS grid, user_id AS "user", ts AS timestamp, CAST(round(value * 100) AS DOUBLE) AS t2m,
         CASE WHEN event_type <> 'purchase' THEN CAST(round(value * 100) AS DOUBLE) END AS tp
  FROM events)"""


@query(f"""
WITH {_READINGS}
SELECT grid, "user", CAST(timestamp AS DATE) AS date, avg(t2m) - 273.15 AS t2m_mean, min(t2m) - 273.15 AS t2m_min,
       max(t2m) - 273.15 AS t2m_max, sum(tp) * 1000.0 AS tp_sum
FROM readings GROUP BY ALL
""")
def rollup_sparse(spark: SparkSession, sf: str) -> DataFrame:
    rules = {
        "t2m_mean": ("t2m", "mean"),
        "t2m_min": ("t2m", "min"),
        "t2m_max": ("t2m", "max"),
        "tp_sum": ("tp", "sum"),
    }
    kelvin = (1.0, -273.15)
    units = {"t2m_mean": kelvin, "t2m_min": kelvin, "t2m_max": kelvin, "tp_sum": (1000.0, 0.0)}
    return aggregates.rollup_sparse(
        _readings(spark, sf), ["grid", "user"], "timestamp", rules, grain="day", units=units
    )


@query(f"""
WITH {_READINGS},
hours AS (SELECT grid, "user", date_trunc('hour', timestamp) AS hour, avg(t2m * 10.0 + 0.0) AS t2m_mean,
                 sum(tp * 1000.0 + 0.0) AS tp_sum FROM readings GROUP BY ALL),
cal AS (SELECT grid, "user", unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour
        FROM (SELECT grid, "user", min(hour) AS lo, max(hour) AS hi FROM hours GROUP BY ALL))
SELECT c.grid, c."user", c.hour, h.t2m_mean, coalesce(h.tp_sum, 0) AS tp_sum
FROM cal c LEFT JOIN hours h ON h.grid = c.grid AND h."user" = c."user" AND h.hour = c.hour
""")
def rollup_dense(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.rollup_dense(
        _readings(spark, sf),
        ["grid", "user"],
        "timestamp",
        {"t2m_mean": ("t2m", "mean"), "tp_sum": ("tp", "sum"), "msl_mean": ("msl", "mean")},
        grain="hour",
        out_t="hour",
        units={"t2m": (10.0, 0.0), "tp": (1000.0, 0.0), "msl": (0.01, 0.0)},
    )


@query(f"""
WITH {tb.THIN}
SELECT supplier, CAST(date_part('month', month) AS INTEGER) AS calendar_month, avg(level) AS climatology
FROM thin GROUP BY ALL
""")
def climatology(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.climatology(tb.thin_levels(spark, sf), "supplier", "month", "level")


@query(f"""
WITH {tb.WITH_MODEL}
SELECT supplier, CASE WHEN count(*) FILTER (WHERE level IS NOT NULL AND model IS NOT NULL) >= 12
  THEN avg(level) FILTER (WHERE model IS NOT NULL) / nullif(avg(model) FILTER (WHERE level IS NOT NULL), 0)
  END AS bias_factor
FROM panel GROUP BY ALL
""")
def bias_factor(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.bias_factor(tb.with_model(spark, sf), "supplier", "level", "model")


@query(f"""
WITH {tb.DENSE_SPENDING}
SELECT customer, count(*) AS n_total, count(*) - count(spent) AS n_missing,
       (count(*) - count(spent)) * 100.0::DOUBLE / count(*) AS pct_missing,
       min(month) AS first_date, max(month) AS last_date
FROM dense GROUP BY ALL
""")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.coverage(tb.dense_spending(spark, sf), "customer", "month", "spent")


@query(f"""
WITH {tb.LINES}
SELECT supplier,
       arg_min(CASE WHEN flag = 'R' THEN quantity END, row(orderkey, line, partkey, cents))
         FILTER (WHERE flag = 'R') AS lat,
       arg_min(CASE WHEN line = 3 THEN CAST(cents AS DOUBLE) END, row(orderkey, line, partkey, cents))
         FILTER (WHERE line = 3) AS lon
FROM lines GROUP BY ALL
""")
def entity_location(spark: SparkSession, sf: str) -> DataFrame:
    rows = tb.lines(spark, sf).withColumns(
        {
            "lat": F.when(F.col("flag") == "R", F.col("quantity")),
            "lon": F.when(F.col("line") == 3, F.col("cents").cast("double")),
        }
    )
    return aggregates.entity_location(rows, "supplier", "lat", "lon", _ORDER)


# ---- calendars --------------------------------------------------------------


@query(f"WITH {tb.DENSE_SPENDING} SELECT customer, month, spent FROM dense")
def densify_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return tb.dense_spending(spark, sf)


@query(f"""
WITH {tb.LEVELS},
cal AS (SELECT supplier, CAST(unnest(generate_series(DATE '1996-01-01', DATE '2002-12-01', INTERVAL 1 MONTH)) AS DATE) AS month
        FROM (SELECT DISTINCT supplier FROM levels))
SELECT c.supplier, c.month, l.level
FROM cal c LEFT JOIN levels l ON l.supplier = c.supplier AND l.month = c.month
""")
def densify_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return calendar.densify(
        tb.levels(spark, sf), ["supplier"], "month", bounds=("1996-01-01", "2002-12-01"), rolled_up=True
    )


_STATIC = f"""{tb.SPENDING}, known AS (
  SELECT o_custkey AS customer, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         max(CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderstatus END) AS grade FROM orders GROUP BY ALL)"""


@query(f"""
WITH {_STATIC},
cal AS (SELECT customer, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month
        FROM (SELECT customer, min(month) AS lo, max(month) AS hi FROM known GROUP BY ALL)),
first AS (SELECT customer, arg_min(grade, month) FILTER (WHERE grade IS NOT NULL) AS grade FROM known GROUP BY ALL)
SELECT c.customer, c.month, f.grade FROM cal c LEFT JOIN first f ON f.customer = c.customer
""")
def fill_static(spark: SparkSession, sf: str) -> DataFrame:
    high = F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_orderstatus"))
    known = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("customer"), month_start("o_orderdate").alias("month"))
        .agg(F.max(high).alias("grade"))
    )
    dense = calendar.densify(known, ["customer"], "month", rolled_up=True)
    return calendar.fill_static(dense, "customer", "month", ["grade"])


@query(f"""
WITH {tb.DENSE_THIN}
SELECT supplier, strftime(month, '%Y-%m') AS missing FROM dense WHERE level IS NULL
""")
def missing_periods(spark: SparkSession, sf: str) -> DataFrame:
    return calendar.missing_periods(tb.dense_thin(spark, sf), "supplier", "month", "level")


@query(f"""
WITH {tb.DENSE_THIN}
SELECT supplier, CAST(date_part('year', month) AS INTEGER) AS year,
       string_agg(strftime(month, '%Y-%m'), ',' ORDER BY month) AS missing
FROM dense WHERE level IS NULL GROUP BY ALL
""")
def missing_by_year(spark: SparkSession, sf: str) -> DataFrame:
    listed = calendar.missing_by_year(tb.dense_thin(spark, sf), "supplier", "month", "level")
    return listed.withColumn("missing", F.array_join("missing", ","))


# ---- interpolation and imputation -------------------------------------------

_BOUNDED = f"""{tb.THIN}, bounded AS (
  SELECT c.supplier, c.month, t.level
  FROM (SELECT supplier, CAST(unnest(generate_series(DATE '1994-06-01', DATE '2002-06-01', INTERVAL 1 MONTH)) AS DATE) AS month
        FROM (SELECT DISTINCT supplier FROM thin)) c
  LEFT JOIN thin t ON t.supplier = c.supplier AND t.month = c.month)"""


@query(f"""
WITH {_BOUNDED}{tb.interpolated_sql('supplier', 'level', 'bounded', 'done')}
SELECT supplier, month, level, filled AS interpolated FROM done
""")
def interpolate_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Over a range wider than the data, so leading and trailing gaps occur."""
    dense = calendar.densify(
        tb.thin_levels(spark, sf),
        ["supplier"],
        "month",
        bounds=("1994-06-01", "2002-06-01"),
        rolled_up=True,
    )
    return interpolate.interpolate_linear(dense, "supplier", step_number("month", "month"), "level")


@query(f"""
WITH {tb.DENSE_SPENDING}{tb.interpolated_sql('customer', 'spent', 'dense', 'done')}
SELECT customer, month, spent, filled AS interpolated FROM done
""")
def interpolate_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Many series, cut into blocks of a year to show that cuts leave no trace."""
    return interpolate.interpolate_linear(
        tb.dense_spending(spark, sf), "customer", step_number("month", "month"), "spent", block_steps=12
    )


_SEASON_FILL = """, season AS (
  SELECT supplier, date_part('month', month) AS cm, avg(level) AS mean FROM dense GROUP BY ALL),
seasoned AS (
  SELECT d.supplier, d.month, d.level, coalesce(d.level, s.mean) AS base
  FROM dense d LEFT JOIN season s ON s.supplier = d.supplier AND s.cm = date_part('month', d.month))""" + (
    tb.interpolated_sql("supplier", "base", "seasoned", "done")
)
_CLIMATE_FILL = tb.DENSE_THIN + _SEASON_FILL
_FULL_FILL = (
    tb.LINES
    + """, every AS (
  SELECT supplier, month, CAST(sum(cents) AS DOUBLE) AS level FROM lines GROUP BY ALL)"""
    + tb.dense_sql("every", "supplier", "level", "dense")
    + _SEASON_FILL
)


@query(f"""
WITH {_CLIMATE_FILL}
SELECT supplier, month, level, filled AS level_imputed FROM done
WHERE supplier IN (SELECT supplier FROM dense WHERE level IS NULL)
""")
def climatology_fill(spark: SparkSession, sf: str) -> DataFrame:
    return impute.impute_climatology(tb.dense_thin(spark, sf), "supplier", "month", "level")


@query(f"""
WITH {tb.LINES}, days AS (
  SELECT s_nationkey AS nation, CAST(shipdate AS DATE) AS day, CAST(sum(CASE WHEN flag = 'R' AND line = 1 THEN cents END) AS DOUBLE) AS level
  FROM lines JOIN supplier ON s_suppkey = supplier GROUP BY ALL),
dense AS (
  SELECT c.nation, c.day, d.level
  FROM (SELECT nation, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
        FROM (SELECT nation, min(day) AS lo, max(day) AS hi FROM days GROUP BY nation)) c
  LEFT JOIN days d ON d.nation = c.nation AND d.day = c.day),
season AS (SELECT nation, date_part('month', day) AS cm, avg(level) AS mean FROM dense GROUP BY ALL),
based AS (
  SELECT d.nation, d.day, d.level, date_diff('day', DATE '1970-01-01', d.day) AS i, coalesce(d.level, s.mean) AS base
  FROM dense d LEFT JOIN season s ON s.nation = d.nation AND s.cm = date_part('month', d.day)),
ends AS (
  SELECT *, last_value(base IGNORE NULLS) OVER back AS pv, last_value(CASE WHEN base IS NOT NULL THEN i END IGNORE NULLS) OVER back AS pi,
         first_value(base IGNORE NULLS) OVER ahead AS nv, first_value(CASE WHEN base IS NOT NULL THEN i END IGNORE NULLS) OVER ahead AS ni
  FROM based
  WINDOW back AS (PARTITION BY nation ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY nation ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT nation, day, level, coalesce(base, CASE WHEN ni IS NULL THEN pv END,
       pv + (nv - pv) * (CAST(i - pi AS DOUBLE) / CAST(ni - pi AS DOUBLE))) AS level_imputed
FROM ends WHERE nation IN (SELECT nation FROM dense WHERE level IS NULL)
""")
def climatology_fill_daily(spark: SparkSession, sf: str) -> DataFrame:
    """The same by day: neighbours are a day apart, seasons stay calendar months."""
    returned = F.when((F.col("flag") == "R") & (F.col("line") == 1), F.col("cents"))
    lines = tb.lines(spark, sf).join(tb.homes(spark, sf), "supplier").withColumn("day", F.col("shipdate").cast("date"))
    days = lines.groupBy("nation", "day").agg(F.sum(returned).cast("double").alias("level"))
    dense = calendar.densify(days, ["nation"], "day", grain="day", rolled_up=True)
    return impute.impute_climatology(dense, "nation", "day", "level", grain="day")


@query(f"""
WITH {_FULL_FILL}
SELECT supplier, month, level, filled AS level_imputed FROM done
""")
def climatology_fill_keep(spark: SparkSession, sf: str) -> DataFrame:
    """All lines count, so some suppliers miss nothing and pass through unchanged."""
    full = (
        tb.lines(spark, sf).groupBy("supplier", "month").agg(F.sum("cents").cast("double").alias("level"))
    )
    dense = calendar.densify(full, ["supplier"], "month", rolled_up=True)
    return impute.impute_climatology(dense, "supplier", "month", "level", on_complete="keep")


@query(f"""
WITH {_CLIMATE_FILL}
SELECT supplier, strftime(min(month), '%Y-%m') AS period_start, strftime(max(month), '%Y-%m') AS period_end,
       count(*) AS n_total, count(*) - count(level) AS missing_before, count(*) - count(filled) AS missing_after,
       (count(filled) - count(level)) * 100.0::DOUBLE / greatest(count(*) - count(level), 1) AS pct_filled
FROM done GROUP BY ALL
""")
def imputation_summary(spark: SparkSession, sf: str) -> DataFrame:
    filled = impute.impute_climatology(
        tb.dense_thin(spark, sf), "supplier", "month", "level", on_complete="keep"
    )
    return impute.imputation_summary(filled, "supplier", "month", "level", "level_imputed")


@query(f"""
WITH {tb.WITH_MODEL}
SELECT supplier, month, level, coalesce(level, model) AS level_filled, level IS NULL AS level_imputed FROM panel
""")
def model_fill(spark: SparkSession, sf: str) -> DataFrame:
    filled = impute.impute_from_model(tb.with_model(spark, sf), {"level": "model"})
    return filled.select("supplier", "month", "level", "level_filled", "level_imputed")


@query(f"""
WITH {tb.WITH_MODEL}
SELECT supplier, month, coalesce(level, model) AS value, level IS NULL AND model IS NOT NULL AS was_filled FROM panel
""")
def fill_from(spark: SparkSession, sf: str) -> DataFrame:
    filled = shape.fill_from(
        tb.with_model(spark, sf), "level", "model", "value", "was_filled", flag_rule="strict"
    )
    return filled.select("supplier", "month", "value", "was_filled")


_BIAS = (
    tb.WITH_MODEL
    + """, factors AS (
  SELECT supplier, CASE WHEN count(*) FILTER (WHERE level IS NOT NULL AND model IS NOT NULL) >= 12
    THEN avg(level) FILTER (WHERE model IS NOT NULL) / nullif(avg(model) FILTER (WHERE level IS NOT NULL), 0)
    END AS bias_factor FROM panel GROUP BY ALL),
filled AS (
  SELECT p.supplier, p.month, p.level, p.model, f.bias_factor,
         coalesce(p.level, p.model * coalesce(f.bias_factor, 1.0::DOUBLE)) AS level_filled,
         p.level IS NULL AS level_imputed
  FROM panel p LEFT JOIN factors f ON f.supplier = p.supplier)"""
)


@query(f"""
WITH {_BIAS} SELECT supplier, month, level, bias_factor, level_filled, level_imputed FROM filled
""")
def bias_corrected_fill(spark: SparkSession, sf: str) -> DataFrame:
    filled = impute.impute_bias_corrected(tb.with_model(spark, sf), "supplier", "level", "model")
    return filled.select("supplier", "month", "level", "bias_factor", "level_filled", "level_imputed")


@query(f"""
WITH {_BIAS}
SELECT supplier, count(*) AS n_total, count(*) FILTER (WHERE level_imputed) AS n_filled,
       max(bias_factor) AS bias_factor FROM filled GROUP BY ALL
""")
def fill_counts(spark: SparkSession, sf: str) -> DataFrame:
    filled = impute.impute_bias_corrected(tb.with_model(spark, sf), "supplier", "level", "model")
    return impute.fill_counts(filled, "supplier", {"n_filled": "level_imputed"}, "bias_factor")


# ---- correlation ------------------------------------------------------------



def _corr_sql(cte: str, source: str) -> str:
    return f"""{cte}, corr_pairs AS (
  SELECT x.supplier AS a, y.supplier AS b, count(*) AS n,
         CASE WHEN count(*) >= 24 AND min(x.level) < max(x.level) AND min(y.level) < max(y.level)
              THEN covar_pop(x.level, y.level) / (stddev_pop(x.level) * stddev_pop(y.level)) END AS r
  FROM {source} x JOIN {source} y ON x.month = y.month AND x.supplier < y.supplier
  WHERE x.level IS NOT NULL AND y.level IS NOT NULL GROUP BY ALL),
pairs AS (
  SELECT p.a, p.b, p.n, p.r,
         CASE WHEN r >= 0.7 THEN 'strong' WHEN r >= 0.5 THEN 'moderate' WHEN abs(r) < 0.3 THEN 'weak' END AS class
  FROM corr_pairs p)"""


_CORR_THIN = _corr_sql(tb.THIN, "thin")
_CORR = _corr_sql(tb.LEVELS, "levels")


def _series() -> tuple:
    return "supplier", step_number("month", "month"), "level"


def _blocks(spark: SparkSession, sf: str) -> int:
    return correlate.blocks_for(table(spark, sf, "supplier").count())


def _corr(spark: SparkSession, sf: str, series: DataFrame) -> DataFrame:
    return correlate.pairwise_corr(series, *_series(), entity_blocks=_blocks(spark, sf))


@query(f"WITH {_CORR_THIN} SELECT a, b, n, round(r, 9) AS r FROM pairs")
def pairwise_corr_thin(spark: SparkSession, sf: str) -> DataFrame:
    """Few shared months: many pairs fall below the minimum."""
    return _corr(spark, sf, tb.thin_levels(spark, sf)).withColumn("r", rounded(F.col("r"), 9))


@query(f"WITH {_CORR} SELECT a, b, n, round(r, 9) AS r FROM pairs")
def pairwise_corr(spark: SparkSession, sf: str) -> DataFrame:
    return _corr(spark, sf, tb.levels(spark, sf)).withColumn("r", rounded(F.col("r"), 9))


@query(f"WITH {_CORR} SELECT a, b, n, round(r, 9) AS r FROM pairs WHERE r IS NOT NULL ORDER BY r DESC, a, b")
def ranked_pairs(spark: SparkSession, sf: str) -> DataFrame:
    levels = tb.levels(spark, sf)
    suppliers = table(spark, sf, "supplier").count()
    # where to cut is learnt from the pairs of about SERIES_SEEN suppliers
    chosen = F.pmod(F.xxhash64("supplier", F.lit("chosen")), F.lit(max(1, suppliers // SERIES_SEEN))) == 0
    few = correlate.pairwise_corr(levels.where(chosen), *_series(), entity_blocks=correlate.blocks_for(min(suppliers, SERIES_SEEN)))
    cuts = pair_order.cuts(few, pair_order.parts_for(suppliers, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    corr = correlate.pairwise_corr(levels, *_series(), entity_blocks=correlate.blocks_for(suppliers), cuts=cuts)
    return correlate.ranked_pairs(corr, cuts).withColumn("r", rounded(F.col("r"), 9))


@query(f"""
WITH {_CORR} SELECT a, b, n, round(r, 9) AS r FROM (
  SELECT * FROM pairs WHERE r IS NOT NULL ORDER BY r DESC, a, b LIMIT 10)
""")
def top_pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = pair_blocks.strongest_pairs(tb.levels(spark, sf), *_series(), entity_blocks=_blocks(spark, sf))
    return found.withColumn("r", F.round("r", 9))


@query(f"WITH {_CORR} SELECT class, count(*) AS n_pairs FROM pairs GROUP BY ALL")
def corr_class(spark: SparkSession, sf: str) -> DataFrame:
    corr = _corr(spark, sf, tb.levels(spark, sf))
    return corr.groupBy(correlate.corr_class("r").alias("class")).agg(F.count("*").alias("n_pairs"))


@query(f"""
WITH {_CORR},
directed AS (SELECT a AS target, b AS donor, r FROM pairs WHERE r IS NOT NULL
             UNION ALL SELECT b, a, r FROM pairs WHERE r IS NOT NULL),
best AS (SELECT target, donor, r, row_number() OVER (PARTITION BY target ORDER BY r DESC, donor) AS rn FROM directed)
SELECT s.s_suppkey AS target, b.donor, round(b.r, 9) AS r
FROM supplier s LEFT JOIN best b ON b.target = s.s_suppkey AND b.rn = 1
""")
def best_donor(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier").select("s_suppkey")
    found = pair_blocks.best_donors(tb.levels(spark, sf), *_series(), suppliers, "s_suppkey", entity_blocks=_blocks(spark, sf))
    return found.withColumn("r", F.round("r", 9))


@query(f"""
WITH {_CORR}
SELECT a, b, n, round(r, 9) AS r FROM pairs JOIN supplier x ON x.s_suppkey = a JOIN supplier y ON y.s_suppkey = b
WHERE x.s_nationkey = y.s_nationkey
""")
def candidate_corr(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of one nation alone."""
    homes = tb.homes(spark, sf).select("supplier", "nation")
    found = pair_blocks.candidate_corr(tb.levels(spark, sf), None, *_series(), entity_blocks=_blocks(spark, sf), within=homes)
    return found.withColumn("r", F.round("r", 9))


@query(f"""
WITH {tb.LINES}, months AS (SELECT s_nationkey AS nation, month, sum(cents) AS cents FROM lines JOIN supplier ON s_suppkey = supplier GROUP BY ALL),
smooth AS (SELECT nation, month, sum(cents) OVER (PARTITION BY nation ORDER BY month ROWS 11 PRECEDING) AS x FROM months),
pairs AS (
  SELECT covar_pop(p.x, q.x) / (stddev_pop(p.x) * stddev_pop(q.x)) AS r
  FROM smooth p JOIN smooth q ON p.month = q.month AND p.nation < q.nation GROUP BY p.nation, q.nation HAVING count(*) >= 24)
SELECT CASE WHEN r >= 0.7 THEN 'strong' WHEN r >= 0.5 THEN 'moderate' WHEN abs(r) < 0.3 THEN 'weak' END AS class, count(*) AS n_pairs
FROM pairs GROUP BY ALL
""")
def corr_class_smooth(spark: SparkSession, sf: str) -> DataFrame:
    """Nations' sums over twelve months, which drift: pairs of every class."""
    months = tb.lines(spark, sf).groupBy("supplier", "month").agg(F.sum("cents").alias("cents")).join(tb.homes(spark, sf), "supplier")
    months = months.groupBy("nation", "month").agg(F.sum("cents").alias("cents"))
    year = Window.partitionBy("nation").orderBy("month").rowsBetween(-11, 0)
    smooth = months.select("nation", "month", F.sum("cents").over(year).cast("double").alias("x"))
    corr = correlate.pairwise_corr(smooth, "nation", step_number("month", "month"), "x", entity_blocks=1).where("n >= 24")
    return corr.groupBy(correlate.corr_class("r").alias("class")).agg(F.count("*").alias("n_pairs"))
