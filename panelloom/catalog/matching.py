"""Names to entities, nearest stations, quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import names, nearest, quality
from . import tables as tb
from .registry import query
from .tables import table
from .text import _NORM

# "old" comes before "old gear", and "late" sits inside "plate".
ALIASES = (
    ("red ring", "Red rings"),
    ("ring", "Rings"),
    ("old", "Old stock"),
    ("old gear", "Old gears"),
    ("gear", "Gears"),
    ("late", "Plates"),
    ("hot", "Hot stock"),
)
_ALIAS_TABLE = "alias(alias, entity, ord) AS (VALUES {})".format(
    ", ".join(f"('{a}', '{e}', {i})" for i, (a, e) in enumerate(ALIASES))
)


def _canonical(source: str) -> str:
    """CTEs: ``source(key, raw)`` to ``matched(key, raw, entity)``."""
    return f"""{_ALIAS_TABLE}, source AS ({source}),
  names AS (SELECT raw, coalesce({_NORM.format('raw')}, '') AS name FROM (SELECT DISTINCT raw FROM source)),
  hits AS (
    SELECT n.raw, coalesce(arg_min(a.entity, a.ord) FILTER (WHERE n.name = a.alias),
                           arg_min(a.entity, a.ord) FILTER (WHERE contains(n.name, a.alias))) AS entity
    FROM names n JOIN alias a ON contains(n.name, a.alias) GROUP BY ALL),
  matched AS (SELECT s.key, s.raw, h.entity FROM source s LEFT JOIN hits h ON h.raw = s.raw)"""


_PARTS = "SELECT p_partkey AS key, p_name AS raw FROM part"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("raw"))


@query(f"WITH {_canonical(_PARTS)} SELECT key, raw, entity FROM matched")
def canonicalize(spark: SparkSession, sf: str) -> DataFrame:
    return names.canonicalize(_parts(spark, sf), "raw", ALIASES)


@query(f"""
WITH {_canonical("SELECT doc_id AS key, text AS raw FROM documents")} SELECT key, entity FROM matched
""")
def canonicalize_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The first alias found anywhere in a whole text."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("raw"))
    return names.canonicalize(texts, "raw", ALIASES).select("key", "entity")


@query(f"""
WITH alias AS (
  SELECT p_name AS alias, min(p_brand) AS entity, min(p_partkey) AS ord FROM part GROUP BY p_name),
source AS (SELECT l_suppkey AS key, s_name || ' - ' || p_name || '/' || p_type AS raw
           FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
names AS (SELECT raw, {_NORM.format('raw')} AS name FROM (SELECT DISTINCT raw FROM source)),
hits AS (SELECT n.raw, arg_min(a.entity, a.ord) AS entity
         FROM names n JOIN alias a ON contains(n.name, a.alias) GROUP BY ALL)
SELECT s.key, coalesce(h.entity, 'none') AS entity, count(*) AS n
FROM source s LEFT JOIN hits h ON h.raw = s.raw GROUP BY ALL
""")
def canonicalize_by_table(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases from a table; every line item's free-form label is matched."""
    part = table(spark, sf, "part")
    aliases = part.groupBy(F.col("p_name").alias("alias")).agg(
        F.min("p_brand").alias("entity"), F.min("p_partkey").alias("ord")
    )
    labelled = (
        table(spark, sf, "lineitem")
        .select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"))
        .join(part.select("p_partkey", "p_name", "p_type"), "p_partkey")
        .join(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
        .select(
            F.col("s_suppkey").alias("key"),
            F.concat("s_name", F.lit(" - "), "p_name", F.lit("/"), "p_type").alias("raw"),
        )
    )
    matched = names.canonicalize_by_table(labelled, "raw", aliases)
    return matched.groupBy("key", F.coalesce("entity", F.lit("none")).alias("entity")).agg(
        F.count("*").alias("n")
    )


@query(f"""
WITH {_canonical(_PARTS)} SELECT DISTINCT raw FROM matched WHERE entity IS NULL
""")
def unmatched_names(spark: SparkSession, sf: str) -> DataFrame:
    matched = names.canonicalize(_parts(spark, sf), "raw", ALIASES)
    return names.unmatched_names(matched, "raw", "entity")


@query("""
SELECT c_custkey AS customer FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')
""")
def unmatched_entities(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"))
    urgent = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    sources = urgent.select(F.col("o_custkey").alias("customer"))
    return names.unmatched_entities(targets, sources, "customer")


# ---- nearest stations: customers look for suppliers -------------------------


def _place(spark: SparkSession, sf: str, name: str, prefix: str, key: str) -> DataFrame:
    """Whole-degree places, so that equal distances happen; a cell is a quarter of a nation."""
    return table(spark, sf, name).select(
        F.col(key).alias(name),
        F.col(f"{prefix}_name").alias("label"),
        (F.col(f"{prefix}_nationkey") * 4 + F.pmod(key, F.lit(4))).alias("cell"),
        F.floor(F.col(f"{prefix}_acctbal") / 100).cast("double").alias("lat"),
        F.pmod(key, F.lit(180)).cast("double").alias("lon"),
    )


def customers_placed(spark: SparkSession, sf: str) -> DataFrame:
    return _place(spark, sf, "customer", "c", "c_custkey")


def suppliers_placed(spark: SparkSession, sf: str) -> DataFrame:
    return _place(spark, sf, "supplier", "s", "s_suppkey")


NEAREST = """customers AS (
  SELECT c_custkey AS customer, c_nationkey * 4 + c_custkey % 4 AS cell,
         CAST(floor(c_acctbal / 100) AS DOUBLE) AS lat, CAST(c_custkey % 180 AS DOUBLE) AS lon FROM customer),
stations AS (
  SELECT s_suppkey AS supplier, s_name AS label, s_nationkey * 4 + s_suppkey % 4 AS cell,
         CAST(floor(s_acctbal / 100) AS DOUBLE) AS lat, CAST(s_suppkey % 180 AS DOUBLE) AS lon FROM supplier),
candidates AS (
  SELECT c.customer, s.supplier, s.label, 'same_era5_grid' AS selection_mode,
         sqrt((c.lat - s.lat) * (c.lat - s.lat) + (c.lon - s.lon) * (c.lon - s.lon)) AS distance_deg
  FROM customers c JOIN stations s ON s.cell = c.cell
  UNION ALL
  SELECT c.customer, s.supplier, s.label, 'nearest_fallback',
         sqrt((c.lat - s.lat) * (c.lat - s.lat) + (c.lon - s.lon) * (c.lon - s.lon))
  FROM customers c, stations s WHERE c.cell NOT IN (SELECT cell FROM stations)),
choices AS (
  SELECT customer, supplier, distance_deg, selection_mode FROM (
    SELECT *, row_number() OVER (PARTITION BY customer ORDER BY distance_deg, label, supplier) AS rn
    FROM candidates) WHERE rn = 1)"""


def nearest_choices(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.nearest_join(
        customers_placed(spark, sf), suppliers_placed(spark, sf), "customer", "supplier", name="label"
    )


@query(f"WITH {NEAREST} SELECT customer, supplier, distance_deg, selection_mode FROM choices")
def nearest_join(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_choices(spark, sf)


@query(f"""
WITH {NEAREST}, {tb.LEVELS}, {tb.DENSE_SPENDING}
SELECT d.customer, d.month, d.spent, l.level, s.label AS source
FROM dense d LEFT JOIN choices c ON c.customer = d.customer LEFT JOIN stations s ON s.supplier = c.supplier
LEFT JOIN levels l ON l.supplier = c.supplier AND l.month = d.month
""")
def attach_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.attach_nearest(
        tb.dense_spending(spark, sf),
        nearest_choices(spark, sf),
        tb.levels(spark, sf),
        key="customer",
        t="month",
        station="supplier",
        measures=["level"],
        source=suppliers_placed(spark, sf),
        source_name="label",
    )


@query(f"""
WITH {NEAREST}, {tb.DENSE_SPENDING},
spans AS (SELECT customer, min(month) AS first_date, max(month) AS last_date, count(*) AS n_total,
                 count(*) - count(spent) AS n_missing FROM dense GROUP BY ALL)
SELECT p.*, c.supplier, c.selection_mode FROM spans p LEFT JOIN choices c ON c.customer = p.customer
""")
def source_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.source_coverage(
        tb.dense_spending(spark, sf),
        "customer",
        "month",
        "spent",
        nearest_choices(spark, sf),
        ["supplier", "selection_mode"],
    )


# ---- checks -----------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1
""")
def check_unique(spark: SparkSession, sf: str) -> DataFrame:
    return quality.check_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"""
WITH {tb.SPENDING}
SELECT customer, count(DISTINCT month) AS n_periods, count(*) AS n_rows,
       date_diff('month', min(month), max(month)) + 1 AS n_expected,
       count(DISTINCT month) = date_diff('month', min(month), max(month)) + 1
         AND count(*) = date_diff('month', min(month), max(month)) + 1 AS complete
FROM spending GROUP BY ALL
""")
def check_complete(spark: SparkSession, sf: str) -> DataFrame:
    return quality.check_complete(tb.spending(spark, sf), "customer", "month", only_bad=False)


@query("""
WITH part_rows AS (SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice >= 1000),
full_rows AS (SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'),
signed AS (SELECT *, 1 AS n FROM part_rows UNION ALL SELECT *, -1 FROM full_rows)
SELECT o_custkey, o_orderstatus, o_orderpriority, sum(n)::BIGINT AS surplus FROM signed GROUP BY ALL HAVING sum(n) <> 0
""")
def check_subset(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    columns = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return quality.check_subset(
        orders.where("o_totalprice >= 1000").select(*columns),
        orders.where("o_orderstatus <> 'P'").select(*columns),
    )
