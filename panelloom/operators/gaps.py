"""Gaps of a dense series: inventory, fill policy, final values with provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.steps import step_number, step_start
from .interpolate import BLOCK_STEPS, on_the_line, with_neighbours

INTERNAL, EDGE = "internal", "edge"
GAP_COLUMNS = ("gap_id", "gap_length", "gap_position", "gap_start", "gap_end")

OBSERVED, RECONSTRUCTED, UNRESOLVED = "observed", "reconstructed", "unresolved_missing"
PENDING = "manual_review_pending"


def gap_rows(
    df: DataFrame,
    key: str,
    t: str,
    value: str,
    grain: str = "month",
    line: str | None = None,
    block_steps: int = BLOCK_STEPS,
) -> DataFrame:
    """Every row of a dense series with the gap it lies in (NULL outside gaps).

    The known neighbours of a row give its gap's ends, so nothing is grouped.
    A gap is ``internal`` when values exist on both sides, else ``edge``.
    ``line`` names a column for the linear interpolation, which needs the same
    neighbours.
    """
    found = with_neighbours(
        df.withColumn("_step", step_number(t, grain)), key, "_step", value, block_steps
    )
    missing = F.col(value).isNull()
    start = F.coalesce(F.col("prev_step") + 1, F.col("lo"))
    end = F.coalesce(F.col("next_step") - 1, F.col("hi"))
    inside = F.col("prev_step").isNotNull() & F.col("next_step").isNotNull()
    first = step_start(start, grain)
    name = F.concat_ws(":", F.col(key).cast("string"), first.cast("string"))
    extra = [on_the_line(value, "_step").alias(line)] if line else []
    return found.select(
        *df.columns,
        *extra,
        F.when(missing, name).alias("gap_id"),
        F.when(missing, end - start + 1).alias("gap_length"),
        F.when(missing, F.when(inside, INTERNAL).otherwise(EDGE)).alias("gap_position"),
        F.when(missing, first).alias("gap_start"),
        F.when(missing, step_start(end, grain)).alias("gap_end"),
    )


def gap_inventory(rows: DataFrame, key: str, t: str) -> DataFrame:
    """One row per gap, from :func:`gap_rows`: the row on which the gap begins."""
    return rows.where(F.col(t) == F.col("gap_start")).select(key, *GAP_COLUMNS)


def apply_policy(rows: DataFrame, policy: Sequence[Mapping[str, object]]) -> DataFrame:
    """Attach the first rule whose position and length range fit the gap.

    Rules are a short list in code: ``position, lo, hi, method, basis, note,
    table, confidence``.  The lookup is an expression, not a range join.
    """
    text = ("position", "method", "basis", "note", "table", "confidence")
    table = F.array(
        *[
            F.struct(
                F.lit(rule["lo"]).cast("long").alias("lo"),
                F.lit(rule["hi"]).cast("long").alias("hi"),
                *[F.lit(rule[c]).cast("string").alias(c) for c in text],
            )
            for rule in policy
        ]
    )
    fits = F.filter(
        table,
        lambda p: (p["position"] == F.col("gap_position"))
        & F.col("gap_length").between(p["lo"], p["hi"]),
    )
    rule = F.get(fits, F.lit(0))
    return rows.withColumn("_rule", rule).select(
        *rows.columns,
        F.col("_rule.method").alias("policy_method"),
        F.col("_rule.basis").alias("policy_basis"),
        F.col("_rule.note").alias("policy_note"),
        F.col("_rule.table").alias("policy_table_source"),
        F.col("_rule.confidence").alias("policy_confidence"),
    )


def finalise(rows: DataFrame, observed: str, candidates: Mapping[str, str]) -> DataFrame:
    """Final value and provenance.  Observed values never change.

    ``candidates`` maps a policy method to the column holding its values; a gap
    row is reconstructed when its method has a value, else it stays unresolved.
    """
    filled: Column = F.lit(None).cast("double")
    for method, column in candidates.items():
        filled = F.when(F.col("policy_method") == method, F.col(column)).otherwise(filled)
    seen = F.col(observed).isNotNull()
    rebuilt = ~seen & filled.isNotNull()
    return rows.select(
        *rows.columns,
        F.coalesce(F.col(observed), filled).alias("value_final"),
        rebuilt.alias("filled_flag"),
        F.when(rebuilt, F.col("policy_method")).when(~seen, PENDING).alias("fill_method"),
        F.when(seen, OBSERVED).when(rebuilt, RECONSTRUCTED).otherwise(UNRESOLVED).alias("fill_source"),
        F.when(rebuilt, F.col("policy_confidence")).when(~seen, PENDING).alias("fill_confidence"),
    )


def in_subset(confidences: Sequence[str] | None = ()) -> Column:
    """Whether a row is observed, or reconstructed with one of the confidences (None: any)."""
    source = F.col("fill_source")
    rebuilt = source == RECONSTRUCTED
    if confidences is not None:
        rebuilt = rebuilt & F.col("fill_confidence").isin(*confidences) if confidences else F.lit(False)
    return (source == OBSERVED) | rebuilt


def sensitivity_subset(rows: DataFrame, confidences: Sequence[str] | None = ()) -> DataFrame:
    """Observed rows plus reconstructed rows of the given confidences (None: all of them)."""
    return rows.where(in_subset(confidences))


def subset_counts(
    rows: DataFrame, subsets: Mapping[str, Sequence[str] | None], value: str = "value_final"
) -> DataFrame:
    """``(subset, n, n_values)`` of several subsets in one pass."""
    counted = [
        F.struct(
            F.lit(label).alias("subset"),
            F.count_if(in_subset(confidences)).alias("n"),
            F.count_if(in_subset(confidences) & F.col(value).isNotNull()).alias("n_values"),
        )
        for label, confidences in subsets.items()
    ]
    return rows.agg(F.array(*counted).alias("_all")).select(F.inline("_all"))
