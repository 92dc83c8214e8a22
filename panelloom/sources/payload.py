"""JSON payloads of level readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ENTRY = "struct<datetime:string,wse:double,wse_u:double>"


def lake_levels(df: DataFrame, payload: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``date, water_level_m, uncertainty_m`` from ``{"data": [...]}`` or a bare list.

    Entries without a time are dropped.  The order of rows is left to the sink.
    """
    text = F.col(payload)
    wrapped = F.from_json(text, f"struct<data:array<{_ENTRY}>>")["data"]
    bare = F.from_json(text, f"array<{_ENTRY}>")
    is_list = F.ltrim(text).startswith("[")
    entry = F.explode(F.when(is_list, bare).otherwise(wrapped)).alias("entry")
    return (
        df.select(*keep, entry)
        .where(F.col("entry.datetime").isNotNull())
        .select(
            *keep,
            F.col("entry.datetime").cast("timestamp_ntz").alias("date"),
            F.col("entry.wse").alias("water_level_m"),
            F.col("entry.wse_u").alias("uncertainty_m"),
        )
    )
