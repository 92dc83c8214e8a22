"""The given tables as panels, in Spark and, under the same name, in SQL.

* ``levels``: supplier by month of shipping; the level is the value of returned
  lines in cents, NULL in months without any.
* ``thin_levels``: the same from first lines only, so most months are missing.
* ``spending``: customer by month of order, in cents; months without an order
  have no row, months with nothing but pending orders have a NULL.
* ``modelled``: nation by month, the value of accepted lines of its suppliers.

Cents are whole numbers, so sums and means are the same in any order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.steps import month_start
from ..operators.calendar import densify
from ..operators.shape import attach_via


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(amount: str) -> Column:
    # rint stays a primitive operation; round goes through big decimals for every row.
    return F.rint(F.col(amount) * 100).cast("long")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as readings: supplier, month, cents and what orders them."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("supplier"),
        month_start("l_shipdate").alias("month"),
        cents("l_extendedprice").alias("cents"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_shipdate").alias("shipdate"),
    )


LINES = """lines AS (
  SELECT l_suppkey AS supplier, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_returnflag AS flag,
         l_linestatus AS status, l_orderkey AS orderkey, l_partkey AS partkey,
         l_linenumber AS line, l_quantity AS quantity, l_shipdate AS shipdate
  FROM lineitem)"""


def levels(spark: SparkSession, sf: str) -> DataFrame:
    returned = F.when(F.col("flag") == "R", F.col("cents"))
    return (
        lines(spark, sf)
        .groupBy("supplier", "month")
        .agg(F.sum(returned).cast("double").alias("level"))
    )


LEVELS = (
    LINES
    + """, levels AS (
  SELECT supplier, month, CAST(sum(CASE WHEN flag = 'R' THEN cents END) AS DOUBLE) AS level
  FROM lines GROUP BY ALL)"""
)


def thin_levels(spark: SparkSession, sf: str) -> DataFrame:
    kept = F.when((F.col("flag") == "R") & (F.col("line") == 1), F.col("cents"))
    return (
        lines(spark, sf)
        .groupBy("supplier", "month")
        .agg(F.sum(kept).cast("double").alias("level"))
    )


THIN = (
    LINES
    + """, thin AS (
  SELECT supplier, month,
         CAST(sum(CASE WHEN flag = 'R' AND line = 1 THEN cents END) AS DOUBLE) AS level
  FROM lines GROUP BY ALL)"""
)


def spending(spark: SparkSession, sf: str) -> DataFrame:
    settled = F.when(F.col("o_orderstatus") != "P", cents("o_totalprice"))
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("customer"), month_start("o_orderdate").alias("month"))
        .agg(F.sum(settled).cast("double").alias("spent"))
    )


SPENDING = """spending AS (
  SELECT o_custkey AS customer, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         CAST(sum(CASE WHEN o_orderstatus <> 'P'
                       THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS DOUBLE) AS spent
  FROM orders GROUP BY ALL)"""


def dense_levels(spark: SparkSession, sf: str) -> DataFrame:
    return densify(levels(spark, sf), ["supplier"], "month", rolled_up=True)


def dense_thin(spark: SparkSession, sf: str) -> DataFrame:
    return densify(thin_levels(spark, sf), ["supplier"], "month", rolled_up=True)


def dense_spending(spark: SparkSession, sf: str) -> DataFrame:
    return densify(spending(spark, sf), ["customer"], "month", rolled_up=True)


def dense_sql(source: str, key: str, value: str, out: str) -> str:
    """CTE ``out``: ``source`` with a row for every month of each key."""
    return f""", {out} AS (
  SELECT c.{key}, c.month, s.{value}
  FROM (SELECT {key}, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month
        FROM (SELECT {key}, min(month) AS lo, max(month) AS hi FROM {source} GROUP BY {key})) c
  LEFT JOIN {source} s ON s.{key} = c.{key} AND s.month = c.month)"""


DENSE_LEVELS = LEVELS + dense_sql("levels", "supplier", "level", "dense")
DENSE_THIN = THIN + dense_sql("thin", "supplier", "level", "dense")
DENSE_SPENDING = SPENDING + dense_sql("spending", "customer", "spent", "dense")


def homes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation")
    )


def modelled(spark: SparkSession, sf: str) -> DataFrame:
    """Summed per supplier first, so that months and not line items meet the nations."""
    accepted = F.when(F.col("flag") == "A", F.col("cents"))
    months = lines(spark, sf).groupBy("supplier", "month").agg(F.sum(accepted).alias("accepted"))
    return (
        months.join(homes(spark, sf), "supplier")
        .groupBy("nation", "month")
        .agg(F.sum("accepted").cast("double").alias("model"))
    )


MODELLED = """modelled AS (
  SELECT s_nationkey AS nation, month,
         CAST(sum(CASE WHEN flag = 'A' THEN cents END) AS DOUBLE) AS model
  FROM lines JOIN supplier ON s_suppkey = supplier GROUP BY ALL)"""


def with_model(spark: SparkSession, sf: str) -> DataFrame:
    """Dense levels with the nation's modelled value, as ``(supplier, month, level, nation, model)``."""
    joined = attach_via(
        dense_thin(spark, sf), "supplier", homes(spark, sf), modelled(spark, sf), ["nation", "month"]
    )
    return joined.select("supplier", "month", "level", "nation", "model")


WITH_MODEL = (
    DENSE_THIN
    + ", "
    + MODELLED
    + """, panel AS (
  SELECT d.supplier, d.month, d.level, s.s_nationkey AS nation, m.model
  FROM dense d LEFT JOIN supplier s ON s.s_suppkey = d.supplier
  LEFT JOIN modelled m ON m.nation = s.s_nationkey AND m.month = d.month)"""
)


def interpolated_sql(key: str, value: str, source: str, out: str) -> str:
    """CTE ``out``: ``source`` with ``filled``, the position-linear interpolation of ``value``."""
    back = f"OVER (PARTITION BY {key} ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = f"OVER (PARTITION BY {key} ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f""", {out}_n AS (
  SELECT *, CASE WHEN {value} IS NOT NULL THEN i END AS known
  FROM (SELECT *, date_part('year', month) * 12 + date_part('month', month) AS i FROM {source})),
{out}_w AS (
  SELECT *, last_value({value} IGNORE NULLS) {back} AS pv, last_value(known IGNORE NULLS) {back} AS pi,
         first_value({value} IGNORE NULLS) {ahead} AS nv, first_value(known IGNORE NULLS) {ahead} AS ni
  FROM {out}_n),
{out} AS (
  SELECT *, coalesce({value}, CASE WHEN ni IS NULL THEN pv END,
         pv + (nv - pv) * (CAST(i - pi AS DOUBLE) / CAST(ni - pi AS DOUBLE))) AS filled
  FROM {out}_w)"""
