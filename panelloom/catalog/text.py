"""Scalar functions over whole texts and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, steps
from ..functions import text as tx
from ..operators import shape
from .registry import query
from .tables import cents, table

_NORM = (
    "trim(regexp_replace(replace(lower(strip_accents({})), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
)


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def strip_accents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.strip_accents("text").alias("plain"))


@query(f"SELECT doc_id, coalesce({_NORM.format('text')}, '') AS words FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.normalize_text("text").alias("words"))


@query(f"SELECT page_id, replace({_NORM.format('url')}, ' ', '_') AS slug FROM pages")
def normalize_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.normalize_name("url").alias("slug"))


@query("""
SELECT p_partkey, trim(' ' || p_name || '  ') AS name,
       array_to_string(list_transform(string_split(replace(lower(p_type || '_' || p_name), '_', ' '), ' '),
         lambda w: upper(w[1]) || w[2:]), ' ') AS label
FROM part
""")
def title_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey",
        tx.strip_space(F.concat(F.lit(" "), "p_name", F.lit("  "))).alias("name"),
        tx.title_label(F.concat_ws("_", "p_type", "p_name")).alias("label"),
    )


@query(r"""
WITH raw AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE l_linenumber
      WHEN 1 THEN '  ' || CAST(l_quantity AS INTEGER) || ' '
      WHEN 2 THEN CAST(l_quantity AS INTEGER) || ',5'
      WHEN 3 THEN CAST(l_quantity AS INTEGER) || '.5d'
      WHEN 4 THEN CAST(l_quantity AS INTEGER) || 'e3'
      WHEN 5 THEN '1_' || CAST(l_quantity AS INTEGER)
      WHEN 6 THEN 'NaN'
      ELSE '-.' || CAST(l_quantity AS INTEGER) END AS raw
  FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN regexp_full_match(trim(raw), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?')
       THEN TRY_CAST(trim(raw) AS DOUBLE) END AS number
FROM raw
""")
def to_number(spark: SparkSession, sf: str) -> DataFrame:
    whole = F.col("l_quantity").cast("int").cast("string")
    line = F.col("l_linenumber")
    raw = (
        F.when(line == 1, F.concat(F.lit("  "), whole, F.lit(" ")))
        .when(line == 2, F.concat(whole, F.lit(",5")))
        .when(line == 3, F.concat(whole, F.lit(".5d")))
        .when(line == 4, F.concat(whole, F.lit("e3")))
        .when(line == 5, F.concat(F.lit("1_"), whole))
        .when(line == 6, F.lit("NaN"))
        .otherwise(F.concat(F.lit("-."), whole))
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.to_number(raw).alias("number")
    )


@query("""
WITH raw AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 81 ELSE date_part('year', o_orderdate) END AS y,
         date_part('month', o_orderdate) + CASE WHEN o_orderpriority = '1-URGENT' THEN 3 ELSE 0 END AS m
  FROM orders)
SELECT o_orderkey, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month,
       make_date(CAST(y AS BIGINT), CAST(m AS BIGINT), 1) AS date
FROM raw WHERE y BETWEEN 1678 AND 2261 AND m BETWEEN 1 AND 12
""")
def monthly_date(spark: SparkSession, sf: str) -> DataFrame:
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 3).otherwise(0)
    raw = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", 81.0)
        .otherwise(F.year("o_orderdate").cast("double"))
        .alias("yy"),
        (F.month("o_orderdate") + urgent + F.lit(0.7)).alias("mm"),
    )
    return steps.monthly_date(raw, "yy", "mm").select("o_orderkey", "year", "month", "date")


@query("""
SELECT event_id, CAST(date_trunc('month', ts) AS DATE) AS month_start, CAST(date_part('year', ts) AS INTEGER) AS year,
       CAST(date_part('month', ts) AS INTEGER) AS month, strftime(ts, '%Y-%m-%d') AS day,
       date_trunc('hour', ts) AS hour
FROM events
""")
def time_parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        steps.month_start("ts").alias("month_start"),
        F.year("ts").alias("year"),
        F.month("ts").alias("month"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        steps.truncate_to("ts", "hour").alias("hour"),
    )


@query("""
SELECT event_id, value + 1.0 * -273.15 AS celsius_like, value * 1000.0 + 0.0 AS millimetres,
       round(CAST(round(value * 100) AS BIGINT) * 0.0001::DOUBLE, 6) AS scaled
FROM events
""")
def convert_units(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(
        "event_id",
        F.col("value").alias("celsius_like"),
        F.col("value").alias("millimetres"),
        numbers.scale_round(cents("value"), 0.0001).alias("scaled"),
    )
    # A rule for a column that is not there is left out.
    rules = {"celsius_like": (1.0, -273.15), "millimetres": (1000.0, 0.0), "msl": (0.01, 0.0)}
    return numbers.convert_units(events, rules)


@query("""
SELECT c_custkey, c_mktsegment,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'works' WHEN 'MACHINERY' THEN 'works'
                         WHEN 'HOUSEHOLD' THEN 'home' END AS sector
FROM customer
""")
def map_values(spark: SparkSession, sf: str) -> DataFrame:
    sectors = {"BUILDING": "works", "MACHINERY": "works", "HOUSEHOLD": "home"}
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return shape.map_values(customers, "c_mktsegment", sectors, "sector")


@query("""
SELECT CAST(l_linenumber AS BIGINT) AS line, l_returnflag AS flag, count(*) AS n
FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_discount BETWEEN 0.02 AND 0.06 AND l_quantity <> 10
GROUP BY ALL
""")
def range_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = table(spark, sf, "lineitem").where(
        F.col("l_returnflag").isin("A", "R")
        & F.col("l_discount").between(0.02, 0.06)
        & (F.col("l_quantity") != 10)
    )
    return kept.groupBy(
        F.col("l_linenumber").cast("long").alias("line"), F.col("l_returnflag").alias("flag")
    ).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("lang", "source").distinct()
