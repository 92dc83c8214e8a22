"""Gap inventory, policy, final values; sample reductions; static features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, gaps, reduce
from ..operators.aggregates import climatology
from . import tables as tb
from .registry import query
from .tables import table

# ---- gaps -------------------------------------------------------------------

_GAPS = (
    tb.DENSE_SPENDING
    + """, marks AS (
  SELECT *, count(spent) OVER (PARTITION BY customer ORDER BY month) AS g,
         count(spent) OVER (PARTITION BY customer) AS g_all
  FROM dense),
islands AS (
  SELECT customer, g, g_all, min(month) AS gap_start, max(month) AS gap_end, count(*) AS gap_length
  FROM marks WHERE spent IS NULL GROUP BY ALL),
gap_list AS (
  SELECT customer, g, customer || ':' || gap_start AS gap_id, gap_length,
         CASE WHEN g > 0 AND g < g_all THEN 'internal' ELSE 'edge' END AS gap_position, gap_start, gap_end
  FROM islands),
gap_rows AS (
  SELECT m.customer, m.month, m.spent, l.gap_id, l.gap_length, l.gap_position, l.gap_start, l.gap_end
  FROM marks m LEFT JOIN gap_list l ON l.customer = m.customer AND l.g = m.g AND m.spent IS NULL)"""
)


def _gap_rows(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.gap_rows(tb.dense_spending(spark, sf), "customer", "month", "spent")


@query(f"WITH {_GAPS} SELECT * FROM gap_rows")
def gap_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _gap_rows(spark, sf)


@query(f"""
WITH {_GAPS} SELECT customer, gap_id, gap_length, gap_position, gap_start, gap_end FROM gap_list
""")
def gap_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.gap_inventory(_gap_rows(spark, sf), "customer", "month")


def _rule(position, lo, hi, method, basis, table, confidence):
    return {
        "position": position, "lo": lo, "hi": hi, "method": method, "basis": basis,
        "note": f"{position} gaps of {lo} to {hi} months", "table": table, "confidence": confidence,
    }


POLICY = (
    _rule("internal", 1, 2, "linear_interpolation", "short_gap", "short_medium", "benchmark_supported"),
    _rule("internal", 3, 6, "seasonal_mean", "medium_gap", "short_medium", "benchmark_adjacent"),
    _rule("internal", 7, 12, "seasonal_mean", "long_gap", "long", "low_confidence_long_gap"),
)
_POLICY = "policy(position, lo, hi, method, basis, note, tab, confidence) AS (VALUES {})".format(
    ", ".join(
        "('{position}', {lo}, {hi}, '{method}', '{basis}', '{note}', '{table}', '{confidence}')".format(**r)
        for r in POLICY
    )
)
_RULED = f"""{_GAPS}, {_POLICY}, ruled AS (
  SELECT r.*, p.method AS policy_method, p.basis AS policy_basis, p.note AS policy_note,
         p.tab AS policy_table_source, p.confidence AS policy_confidence
  FROM gap_rows r LEFT JOIN policy p ON p.position = r.gap_position AND r.gap_length BETWEEN p.lo AND p.hi)"""


@query(f"WITH {_RULED} SELECT * FROM ruled")
def apply_policy(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.apply_policy(_gap_rows(spark, sf), POLICY)


_FINAL = f"""{_RULED}{tb.interpolated_sql('customer', 'spent', 'dense', 'line')},
season AS (SELECT customer, date_part('month', month) AS cm, avg(spent) AS mean FROM dense GROUP BY ALL),
offers AS (
  SELECT r.*, CASE policy_method WHEN 'linear_interpolation' THEN l.filled WHEN 'seasonal_mean' THEN s.mean END AS offer
  FROM ruled r LEFT JOIN line l ON l.customer = r.customer AND l.month = r.month
  LEFT JOIN season s ON s.customer = r.customer AND s.cm = date_part('month', r.month)),
final AS (
  SELECT customer, month, spent, gap_length, coalesce(spent, offer) AS value_final,
         spent IS NULL AND offer IS NOT NULL AS filled_flag,
         CASE WHEN spent IS NULL THEN CASE WHEN offer IS NOT NULL THEN policy_method ELSE 'manual_review_pending' END END AS fill_method,
         CASE WHEN spent IS NOT NULL THEN 'observed' WHEN offer IS NOT NULL THEN 'reconstructed'
              ELSE 'unresolved_missing' END AS fill_source,
         CASE WHEN spent IS NULL THEN CASE WHEN offer IS NOT NULL THEN policy_confidence ELSE 'manual_review_pending' END END AS fill_confidence
  FROM offers)"""
_FINAL_COLUMNS = ["customer", "month", "spent", "gap_length", "value_final", "filled_flag"]
_FINAL_COLUMNS += ["fill_method", "fill_source", "fill_confidence"]


def _final(spark: SparkSession, sf: str) -> DataFrame:
    dense = tb.dense_spending(spark, sf)
    seasons = climatology(dense, "customer", "month", "spent", "seasonal")
    offered = dense.withColumn("calendar_month", F.month("month")).join(
        seasons, ["customer", "calendar_month"], "left"
    )
    rows = gaps.gap_rows(offered, "customer", "month", "spent", line="on_line")
    ruled = gaps.apply_policy(rows, POLICY)
    methods = {"linear_interpolation": "on_line", "seasonal_mean": "seasonal"}
    return gaps.finalise(ruled, "spent", methods).select(*_FINAL_COLUMNS)


@query(f"WITH {_FINAL} SELECT * FROM final")
def finalise(spark: SparkSession, sf: str) -> DataFrame:
    return _final(spark, sf)


@query(f"""
WITH {_FINAL}
SELECT 'observed' AS subset, count(*) AS n, count(value_final) AS n_values FROM final WHERE fill_source = 'observed'
UNION ALL SELECT 'supported', count(*), count(value_final) FROM final
  WHERE fill_source = 'observed' OR (fill_source = 'reconstructed' AND fill_confidence = 'benchmark_supported')
UNION ALL SELECT 'all', count(*), count(value_final) FROM final WHERE fill_source <> 'unresolved_missing'
""")
def sensitivity_subsets(spark: SparkSession, sf: str) -> DataFrame:
    subsets = {"observed": (), "supported": ("benchmark_supported",), "all": None}
    return gaps.subset_counts(_final(spark, sf), subsets)


# ---- sample reductions ------------------------------------------------------


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as classified samples; the discount stands for a sample's weight."""
    code = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "N", 1).otherwise(0)
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("entity"),
        F.col("l_shipdate").alias("image_ts"),
        F.col("l_partkey").alias("cell"),
        code.alias("class"),
        F.col("l_discount").cast("decimal(6,2)").alias("weight"),
        F.col("l_quantity").alias("raw"),
        F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("tie"),
    )


_SAMPLES = """samples AS (
  SELECT l_suppkey AS entity, l_shipdate AS image_ts, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         l_partkey AS cell, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'N' THEN 1 ELSE 0 END AS class,
         CAST(l_discount AS DECIMAL(6,2)) AS weight, l_quantity AS raw,
         row(l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS tie
  FROM lineitem),
cal AS (SELECT entity, CAST(unnest(generate_series(DATE '1994-01-01', DATE '2002-12-01', INTERVAL 1 MONTH)) AS DATE) AS month
        FROM (SELECT DISTINCT entity FROM samples))"""
_RANGE = ("1994-01-01", "2002-12-01")
_YM = "CAST(date_part('year', c.month) AS INTEGER) AS year, CAST(date_part('month', c.month) AS INTEGER) AS month"


@query(f"""
WITH {_SAMPLES},
sums AS (SELECT entity, month, coalesce(sum(CASE WHEN class = 2 THEN weight END), 0) AS wet,
                coalesce(sum(CASE WHEN class >= 1 THEN weight END), 0) AS valid FROM samples GROUP BY ALL)
SELECT c.entity, {_YM},
       CASE WHEN valid > 0 THEN round(CAST(wet AS DOUBLE) / CAST(valid AS DOUBLE), 6) END AS water_fraction,
       CAST(trunc(coalesce(wet, 0)) AS BIGINT) AS water_pixels, CAST(trunc(coalesce(valid, 0)) AS BIGINT) AS total_pixels
FROM cal c LEFT JOIN sums s ON s.entity = c.entity AND s.month = c.month
""")
def class_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return reduce.class_fraction(samples(spark, sf), "entity", "image_ts", "class", "weight", _RANGE)


@query(f"""
WITH {_SAMPLES}
SELECT entity, cell, image_ts, class FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, cell, month ORDER BY image_ts DESC, tie DESC) AS rn FROM samples)
WHERE rn = 1
""")
def latest_per_cell(spark: SparkSession, sf: str) -> DataFrame:
    kept = samples(spark, sf).select("entity", "cell", "image_ts", "class", "tie")
    return reduce.latest_per_cell(kept, "entity", "cell", "image_ts", "class", "tie").drop("tie")


@query(f"""
WITH {_SAMPLES}, means AS (SELECT entity, month, avg(raw) AS raw FROM samples GROUP BY ALL)
SELECT c.entity, {_YM}, round(raw * 0.01::DOUBLE, 6) AS ndvi
FROM cal c LEFT JOIN means m ON m.entity = c.entity AND m.month = c.month
""")
def monthly_index(spark: SparkSession, sf: str) -> DataFrame:
    return reduce.monthly_index(samples(spark, sf), "entity", "image_ts", "raw", _RANGE, scale=0.01)


def order_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Finished orders as samples of their customers, some of whom have none."""
    code = F.when(F.col("o_orderpriority").startswith("1"), 2).when(F.col("o_orderpriority").startswith("5"), 0).otherwise(1)
    return (
        table(spark, sf, "orders")
        .where(F.col("o_orderstatus") == "F")
        .select(
            F.col("o_custkey").alias("entity"),
            F.col("o_orderdate").alias("image_ts"),
            code.alias("class"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("weight"),
            tb.cents("o_totalprice").alias("raw"),
        )
    )


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"))


_ORDER_SAMPLES = """samples AS (
  SELECT o_custkey AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 2 WHEN '5' THEN 0 ELSE 1 END AS class,
         CAST(o_totalprice AS DECIMAL(12,2)) AS weight, CAST(round(o_totalprice * 100) AS BIGINT) AS raw
  FROM orders WHERE o_orderstatus = 'F'),
cal AS (SELECT entity, CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS DATE) AS month
        FROM (SELECT c_custkey AS entity FROM customer UNION SELECT entity FROM samples))"""
_ORDER_RANGE = ("1995-01-01", "2001-08-01")


@query(f"""
WITH {_ORDER_SAMPLES},
sums AS (SELECT entity, month, coalesce(sum(CASE WHEN class = 2 THEN weight END), 0) AS wet,
                coalesce(sum(CASE WHEN class >= 1 THEN weight END), 0) AS valid FROM samples GROUP BY ALL)
SELECT c.entity, {_YM},
       CASE WHEN valid > 0 THEN round(CAST(wet AS DOUBLE) / CAST(valid AS DOUBLE), 6) END AS water_fraction,
       CAST(trunc(coalesce(wet, 0)) AS BIGINT) AS water_pixels, CAST(trunc(coalesce(valid, 0)) AS BIGINT) AS total_pixels
FROM cal c LEFT JOIN sums s ON s.entity = c.entity AND s.month = c.month
""")
def class_fraction_listed(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer gets all months, those without any finished order too."""
    return reduce.class_fraction(
        order_samples(spark, sf), "entity", "image_ts", "class", "weight", _ORDER_RANGE, _customers(spark, sf)
    )


@query(f"""
WITH {_ORDER_SAMPLES}, means AS (SELECT entity, month, avg(raw) AS raw FROM samples GROUP BY ALL)
SELECT c.entity, {_YM}, round(raw * 0.01::DOUBLE, 6) AS ndvi
FROM cal c LEFT JOIN means m ON m.entity = c.entity AND m.month = c.month
""")
def monthly_index_listed(spark: SparkSession, sf: str) -> DataFrame:
    return reduce.monthly_index(
        order_samples(spark, sf), "entity", "image_ts", "raw", _ORDER_RANGE, scale=0.01, entities=_customers(spark, sf)
    )


# ---- features ---------------------------------------------------------------


@query(f"""
WITH {tb.LINES}, v AS (SELECT *, CASE WHEN flag <> 'N' THEN CAST(cents AS DOUBLE) END AS depth FROM lines)
SELECT supplier, month, sum(depth * quantity) / sum(CASE WHEN depth IS NOT NULL THEN quantity END) AS mean,
       coalesce(sum(CASE WHEN depth IS NOT NULL THEN quantity END), 0) / sum(quantity) AS valid_area_fraction
FROM v GROUP BY ALL
""")
def area_weighted(spark: SparkSession, sf: str) -> DataFrame:
    cells = tb.lines(spark, sf).withColumn(
        "depth", F.when(F.col("flag") != "N", F.col("cents").cast("double"))
    )
    return features.area_weighted(cells, ["supplier", "month"], "depth", "quantity")


@query("""
SELECT s_suppkey, s_acctbal / 1000.0::DOUBLE * s_nationkey * 1000000.0::DOUBLE AS volume_m3 FROM supplier
""")
def volume_proxy(spark: SparkSession, sf: str) -> DataFrame:
    volume = features.volume_proxy("s_acctbal", F.col("s_nationkey").cast("double"))
    return table(spark, sf, "supplier").select("s_suppkey", volume.alias("volume_m3"))


_PROPS, _DEPTHS = ("A", "N", "R"), ("F", "O")
_FEATURES = [f"{p}_{d}" for p in _PROPS for d in _DEPTHS]
_PIVOT = "sums AS (SELECT l_partkey AS part, l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), wide AS (SELECT part, {} FROM sums GROUP BY ALL)".format(
    ", ".join(f"max(CASE WHEN f = '{p}' AND s = '{d}' THEN q END) AS \"{p}_{d}\"" for p in _PROPS for d in _DEPTHS)
)


def _features(spark: SparkSession, sf: str) -> DataFrame:
    sums = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("part"), "l_returnflag", "l_linestatus")
        .agg(F.sum("l_quantity").alias("q"))
    )
    return features.pivot_features(sums, "part", "l_returnflag", "l_linestatus", "q", _PROPS, _DEPTHS)


@query(f"WITH {_PIVOT} SELECT * FROM wide")
def pivot_features(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf)


_MISSING = " + ".join(f'CAST("{c}" IS NULL AS INTEGER)' for c in _FEATURES)


@query(f"""
WITH {_PIVOT}
SELECT p_partkey AS part, {_MISSING} AS missing_feature_count, {_MISSING} = 6 AS all_missing_flag
FROM part LEFT JOIN wide ON part = p_partkey
""")
def missing_flags(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("part"))
    joined = features.attach_static(parts, _features(spark, sf), "part")
    return features.missing_flags(joined, _FEATURES).select(
        "part", "missing_feature_count", "all_missing_flag"
    )


@query("""
WITH parts AS (SELECT l_suppkey AS supplier, p_type AS category, sum(l_quantity) AS w
               FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
tot AS (SELECT supplier, sum(w) AS total, arg_min(category, row(-w, category)) AS dominant FROM parts GROUP BY ALL)
SELECT p.supplier, p.category, p.w / t.total AS share, t.dominant, p.category = t.dominant AS is_dominant
FROM parts p JOIN tot t ON t.supplier = p.supplier
""")
def category_share(spark: SparkSession, sf: str) -> DataFrame:
    kinds = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category")
    )
    rows = (
        table(spark, sf, "lineitem")
        .select("l_partkey", F.col("l_suppkey").alias("supplier"), "l_quantity")
        .join(kinds, "l_partkey")
    )
    return features.category_share(rows, "supplier", "category", "l_quantity")


@query(f"""
WITH {tb.DENSE_LEVELS}
SELECT d.supplier, d.month, d.level, s.s_nationkey AS basin, s.s_acctbal AS basin_area_km2
FROM dense d LEFT JOIN supplier s ON s.s_suppkey = d.supplier
""")
def attach_static(spark: SparkSession, sf: str) -> DataFrame:
    static = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("supplier"),
        F.col("s_nationkey").alias("basin"),
        F.col("s_acctbal").alias("basin_area_km2"),
    )
    return features.attach_static(tb.dense_levels(spark, sf), static, "supplier")
