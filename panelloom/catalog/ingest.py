"""Scans, payloads, sheets, upserts, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import to_number
from ..functions.steps import monthly_date
from ..operators import shape
from ..operators.shape import attach, attach_via
from ..sinks.write import manifest as output_manifest
from ..sources import files, payload, sheets
from . import tables as tb
from .registry import query
from .tables import cents, table


@query("""
SELECT 'orders' AS series, date_part('year', o_orderdate)::INTEGER AS year, count(*) AS n,
       sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents
FROM orders GROUP BY ALL
""")
def scan_series(spark: SparkSession, sf: str) -> DataFrame:
    """One scan over the matching files; the series id comes from the file name."""
    rows = files.read_series(
        spark,
        f"{sf}/order*.parquet",
        key_regex=r"^(.+)\.parquet$",
        columns=["o_orderdate", "o_totalprice"],
        exclude_regex="_imputed",
        expect_files=1,
        fmt="parquet",
    )
    return rows.groupBy("series", F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("cents")
    )


@query("""
SELECT c_custkey AS key, c_name AS name, CAST(NULL AS DOUBLE) AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier
""")
def union_series(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name")
    )
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return files.union_series([suppliers, customers])


@query("""
SELECT event_id, ts AS date, value AS water_level_m, CAST(json_extract(props, '$.k') AS DOUBLE) AS uncertainty_m
FROM events WHERE event_type <> 'error'
""")
def json_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Events as payloads, half of them wrapped, half bare lists, errors without a time."""
    stamp = F.when(F.col("event_type") != "error", F.col("ts").cast("string"))
    entries = F.array(
        F.struct(
            stamp.alias("datetime"),
            F.col("value").alias("wse"),
            F.get_json_object("props", "$.k").cast("double").alias("wse_u"),
        )
    )
    wrapped = F.to_json(F.struct(entries.alias("data")))
    text = F.when(F.pmod("event_id", F.lit(2)) == 0, wrapped).otherwise(F.to_json(entries))
    rows = table(spark, sf, "events").select("event_id", text.alias("payload"))
    return payload.lake_levels(rows, "payload", keep=("event_id",))


# ---- sheets -----------------------------------------------------------------


def _text_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as sheets: a line is a row, a word is a cell."""
    return (
        table(spark, sf, "documents")
        .select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("row_idx", "line"))
        .select("file", "row_idx", F.split("line", " ").alias("cells"))
    )


_TEXT_ROWS = """sheet AS (
  SELECT file, CAST(i AS INTEGER) - 1 AS row_idx, string_split(ls[i], ' ') AS cells
  FROM (SELECT file, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id AS file, string_split(text, chr(10)) AS ls FROM documents)))"""

_CELL = "trim(regexp_replace(replace(lower(strip_accents(c)), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def _any(words: tuple[str, ...]) -> str:
    tests = " OR ".join(f"contains(cell_text, '{w}')" for w in words)
    return f"CAST(({tests}) AS INTEGER)"


@query(f"""
WITH {_TEXT_ROWS},
scored AS (
  SELECT file, row_idx, {' + '.join(_any(g) for g in sheets.HEADER_GROUPS)} AS score
  FROM (SELECT file, row_idx, array_to_string(list_transform(cells, lambda c: {_CELL}), chr(10)) AS cell_text
        FROM sheet WHERE row_idx < 8))
SELECT file, row_idx AS header_row, score AS header_score
FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, row_idx) AS rn FROM scored) WHERE rn = 1
""")
def detect_header(spark: SparkSession, sf: str) -> DataFrame:
    return sheets.detect_header(_text_rows(spark, sf))


@query(f"""
WITH {_TEXT_ROWS}
SELECT file, CAST(coalesce(min(row_idx) FILTER (WHERE row_idx < 10 AND list_has_any(
         list_transform(cells, lambda c: lower(trim(c))), ['the', 'der', 'le'])), 0) AS INTEGER) AS header_row
FROM sheet GROUP BY file
""")
def detect_header_exact(spark: SparkSession, sf: str) -> DataFrame:
    return sheets.detect_header_exact(_text_rows(spark, sf), ("the", "der", "le"))


def _event_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """One sheet per event type: a title, a header worded in two ways, a row per event."""
    events = table(spark, sf, "events")
    english = F.col("event_type").isin("click", "view")
    stamp = [F.year("ts").cast("string"), F.month("ts").cast("string")]
    value, name = F.col("value").cast("string"), F.concat(F.lit(" "), "event_type")
    blank = F.lit(None).cast("string")
    data = events.select(
        F.col("event_type").alias("file"),
        (F.col("event_id") + 3).alias("row_idx"),
        F.when(english, F.array(name, *stamp, value)).otherwise(F.array(*stamp, value, name)).alias("cells"),
    )
    kinds = events.select("event_type").distinct()
    heads = F.array(
        F.struct(F.lit(0).cast("long").alias("row_idx"), F.array(F.lit("Niveaux"), blank, blank, blank).alias("cells")),
        F.struct(F.lit(1).cast("long").alias("row_idx"), F.array(blank, blank, F.lit(" "), blank).alias("cells")),
        F.struct(
            F.lit(2).cast("long").alias("row_idx"),
            F.when(english, F.array(*map(F.lit, ["Station_Name", "Year", "Month", "haut moy"])))
            .otherwise(F.array(*map(F.lit, ["YY", "MM", "Haut.moy", "Name"])))
            .alias("cells"),
        ),
    )
    return data.unionByName(
        kinds.select(F.col("event_type").alias("file"), F.inline(heads))
    )


@query("""
SELECT event_type AS file, event_id + 3 AS row_idx, event_type AS station,
       CAST(date_part('year', ts) AS INTEGER) AS year, CAST(date_part('month', ts) AS INTEGER) AS month,
       CAST(date_trunc('month', ts) AS DATE) AS date, value AS level
FROM events
""")
def sheet_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Detect headers, locate columns by name or token, read dated rows."""
    rows = _event_sheets(spark, sf)
    found = sheets.headers(rows, sheets.detect_header(rows))
    placed = found.withColumns(
        {
            "at_year": sheets.locate("columns", exact=["year", "yy"]),
            "at_month": sheets.locate("columns", exact=["month", "mm"]),
            "at_name": sheets.locate("columns", exact=["station_name", "name"]),
            "at_level": sheets.locate("columns", contains=["haut", "moy"]),
        }
    )
    places = ["at_year", "at_month", "at_name", "at_level"]
    cells = sheets.data_rows(rows, placed, places)
    read = cells.select(
        "file",
        "row_idx",
        F.trim(sheets.cell("cells", "at_name")).alias("station"),
        to_number(sheets.cell("cells", "at_year")).alias("yy"),
        to_number(sheets.cell("cells", "at_month")).alias("mm"),
        to_number(sheets.cell("cells", "at_level")).alias("level"),
    )
    return monthly_date(read, "yy", "mm").select(
        "file", "row_idx", "station", "year", "month", "date", "level"
    )


@query("""
SELECT event_type AS file, event_id + 3 AS row_idx, k AS name,
       CASE WHEN k IN ('station_name', 'name') THEN ' ' || event_type
            WHEN k IN ('year', 'yy') THEN CAST(date_part('year', ts) AS VARCHAR)
            WHEN k IN ('month', 'mm') THEN CAST(date_part('month', ts) AS VARCHAR)
            ELSE CAST(value AS VARCHAR) END AS cell
FROM (SELECT *, unnest(CASE WHEN event_type IN ('click', 'view') THEN ['station_name', 'year', 'month', 'haut_moy']
                            ELSE ['yy', 'mm', 'haut_moy', 'name'] END) AS k FROM events)
""")
def promote_header(spark: SparkSession, sf: str) -> DataFrame:
    rows = _event_sheets(spark, sf)
    found = sheets.headers(rows, sheets.detect_header(rows))
    promoted = sheets.promote_header(rows, found)
    return promoted.select("file", "row_idx", F.explode("values").alias("name", "cell"))


@query("""
SELECT s_name AS Station_Name, s_acctbal AS Lat, s_acctbal AS Lon, CAST(s_nationkey AS DOUBLE) AS Elev,
       1990 + s_nationkey AS Year, 1 AS Month, s_acctbal * 2 AS haut_moy
FROM supplier
""")
def harmonise(spark: SparkSession, sf: str) -> DataFrame:
    supplier = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("StationID"),
        F.col("s_name").alias("Name"),
        F.col("s_acctbal").alias("LAT"),
        F.col("s_acctbal").alias("lon"),
        F.col("s_nationkey").cast("double").alias("Alt"),
        (F.lit(1990) + F.col("s_nationkey")).alias("YY"),
        F.lit(1).alias("mm"),
        (F.col("s_acctbal") * 2).alias("Haut moy"),
    )
    return sheets.harmonise(supplier)


# ---- hourly frames, upserts, attachments ------------------------------------


@query("""
SELECT event_type AS grid, ts AS timestamp, value AS t2m FROM events
""")
def normalise_hourly(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events").select(
        F.col("event_type").alias("grid"),
        F.col("ts").alias("valid_time"),
        F.col("ts").alias("time"),
        F.col("value").alias("t2m"),
        F.lit(0).alias("number"),
    )
    return files.normalise_hourly(raw)


@query(f"""
WITH {tb.LEVELS}, {tb.MODELLED},
extra AS (SELECT supplier, month, count(*) AS level, sum(cents)::BIGINT AS total FROM lines
          GROUP BY ALL HAVING count(*) > 1)
SELECT l.supplier, l.month, e.level, e.total
FROM levels l LEFT JOIN extra e ON e.supplier = l.supplier AND e.month = l.month
""")
def upsert_columns(spark: SparkSession, sf: str) -> DataFrame:
    """``level`` is replaced by what the new frame brings, ``total`` is added."""
    extra = (
        tb.lines(spark, sf)
        .groupBy("supplier", "month")
        .agg(F.count("*").alias("level"), F.sum("cents").alias("total"))
        .where("level > 1")
    )
    return shape.upsert_columns(tb.levels(spark, sf), extra, ["supplier", "month"])


@query(f"""
WITH {tb.DENSE_LEVELS},
runoff AS (SELECT supplier, month, sum(CASE WHEN flag = 'N' THEN cents END)::BIGINT AS runoff FROM lines GROUP BY ALL)
SELECT d.supplier, d.month, d.level, r.runoff
FROM dense d LEFT JOIN runoff r ON r.supplier = d.supplier AND r.month = d.month
""")
def attach_left(spark: SparkSession, sf: str) -> DataFrame:
    runoff = (
        tb.lines(spark, sf)
        .groupBy("supplier", "month")
        .agg(F.sum(F.when(F.col("flag") == "N", F.col("cents"))).alias("runoff"))
    )
    return attach(tb.dense_levels(spark, sf), runoff, ["supplier", "month"])


@query(f"""
WITH {tb.DENSE_LEVELS}, {tb.MODELLED}
SELECT d.supplier, d.month, d.level, s.s_nationkey AS nation, m.model
FROM dense d LEFT JOIN supplier s ON s.s_suppkey = d.supplier
LEFT JOIN modelled m ON m.nation = s.s_nationkey AND m.month = d.month
""")
def attach_mapped(spark: SparkSession, sf: str) -> DataFrame:
    joined = attach_via(
        tb.dense_levels(spark, sf),
        "supplier",
        tb.homes(spark, sf),
        tb.modelled(spark, sf),
        ["nation", "month"],
    )
    return joined.select("supplier", "month", "level", "nation", "model")


@query("""
WITH sums AS (
  SELECT l_suppkey AS supplier, date_part('year', l_shipdate)::INTEGER AS year,
         sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS qty_a,
         sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS qty_n,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS qty_r
  FROM lineitem GROUP BY ALL)
SELECT supplier, year, 0 AS ord, 'qty_a' AS source_name, qty_a AS value FROM sums
UNION ALL SELECT supplier, year, 1, 'qty_n', qty_n FROM sums
UNION ALL SELECT supplier, year, 2, 'qty_r', qty_r FROM sums
""")
def unpivot_values(spark: SparkSession, sf: str) -> DataFrame:
    wide = (
        tb.lines(spark, sf)
        .groupBy("supplier", F.year("shipdate").alias("year"))
        .agg(*[F.sum(F.when(F.col("flag") == f, F.col("quantity"))).alias(f"qty_{f.lower()}") for f in "ANR"])
    )
    return shape.unpivot(wide, ["supplier", "year"])


@query(f"""
WITH {tb.LINES}, sums AS (SELECT status, month, sum(cents)::BIGINT AS total FROM lines GROUP BY ALL)
SELECT month, max(CASE WHEN status = 'F' THEN total END) AS "F", max(CASE WHEN status = 'O' THEN total END) AS "O"
FROM sums GROUP BY ALL
""")
def pivot_series(spark: SparkSession, sf: str) -> DataFrame:
    sums = tb.lines(spark, sf).groupBy("status", "month").agg(F.sum("cents").alias("total"))
    return shape.pivot_series(sums, "status", "month", "total", ["F", "O"])


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS v, CASE WHEN l_linenumber <> 2 THEN l_suppkey END AS k
FROM lineitem WHERE l_linenumber <> 2
""")
def drop_empty(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        F.col("l_quantity").alias("v"),
        F.when(F.col("l_linenumber") != 2, F.col("l_suppkey")).alias("k"),
    )
    return shape.drop_empty(rows, ["k"])


@query(f"""
WITH {tb.DENSE_LEVELS}, counts AS (SELECT supplier, count(*) AS n FROM dense GROUP BY ALL)
SELECT 'outputs/panel.csv' AS file, sum(n)::BIGINT AS row_count FROM counts
UNION ALL SELECT 'outputs/' || supplier || '_monthly.csv', n FROM counts
UNION ALL SELECT 'summary.md', NULL
""")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return output_manifest(
        tb.dense_levels(spark, sf),
        F.col("supplier").cast("string"),
        "outputs/panel.csv",
        "outputs/{slug}_monthly.csv",
        ["summary.md"],
    )
