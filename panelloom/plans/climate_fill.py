"""Fill the panel's observed climate from the modelled columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.impute import fill_counts, impute_bias_corrected, impute_from_model
from ..operators.quality import check_unique, require_empty
from ..sinks.write import slugs, write_panel, write_per_entity
from ..sources.files import read_series
from . import fixed_values as fv
from .settle import remove, settle

MIN_OVERLAP_MONTHS = 12


def fill_climate(panel: DataFrame, key: str = "river", flag_rule: str = "reference") -> DataFrame:
    """Temperatures from the model as they are, precipitation scaled by its ratio of means.

    Observed columns stay; filled values are in ``*_filled`` and flagged in
    ``temp_max_imputed``, ``temp_min_imputed`` and ``precip_imputed``.

    The panel is read twice (for the factors and for the fill): store a costly
    one first (:func:`panelloom.plans.settle.settle`).
    """
    models = {"temp_max_observed": "era5_t2m_max", "temp_min_observed": "era5_t2m_min"}
    filled = impute_from_model(panel, models, flag_rule)
    filled = impute_bias_corrected(
        filled, key, "precip_observed", "era5_tp_sum", min_overlap=MIN_OVERLAP_MONTHS, flag_rule=flag_rule
    )
    renamed = {"bias_factor": "precip_bias_factor"}
    for name in ("temp_max", "temp_min", "precip"):
        renamed[f"{name}_observed_filled"] = f"{name}_filled"
        renamed[f"{name}_observed_imputed"] = f"{name}_imputed"
    return filled.withColumnsRenamed(renamed).select(
        *panel.columns,
        "temp_max_filled",
        "temp_min_filled",
        "precip_filled",
        "temp_max_imputed",
        "temp_min_imputed",
        "precip_bias_factor",
        "precip_imputed",
    )


def in_place(filled: DataFrame) -> DataFrame:
    """The layout with filled values under the observed names, for readers that expect it."""
    names = ("temp_max", "temp_min", "precip")
    return filled.withColumns({f"{n}_observed": F.col(f"{n}_filled") for n in names}).drop(
        *[f"{n}_filled" for n in names]
    )


def summary(filled: DataFrame, key: str = "river") -> DataFrame:
    flags = {"temp_filled": "temp_max_imputed", "precip_filled": "precip_imputed"}
    return fill_counts(filled, key, flags, "precip_bias_factor")


def panel_schema() -> str:
    """Types of the published panel's columns."""
    kinds = {"date": "date", "year": "int", "month": "int"}
    kinds |= dict.fromkeys(("river", "temp_source", "precip_source", "era5_grid"), "string")
    return ", ".join(f"{c} {kinds.get(c, 'double')}" for c in fv.PANEL_COLUMNS)


def fill_files(
    spark: SparkSession, paths: str | Sequence[str], out: str, flag_rule: str = "reference", fmt: str = "csv"
) -> DataFrame:
    """From the per-river files to filled ones: a combined table, a folder per river, and the summary.

    Files whose name holds ``_imputed`` are results of an earlier run and left
    out.  The filled panel is evaluated once, beside ``out``.
    """
    panel = read_series(spark, paths, schema=panel_schema(), exclude_regex="_imputed", fmt=fmt)
    work = f"{out.rstrip('/')}_unpublished"
    try:
        filled = settle(in_place(fill_climate(panel, flag_rule=flag_rule)), work, "filled")
        require_empty(check_unique(filled, ["river", "date"]), slugs(filled, "river"))
        write_panel(filled, f"{out}/master_dataset_monthly_imputed", "river", "date", filled.columns, fmt)
        write_per_entity(filled, f"{out}/per_river_imputed", "river", "date", filled.columns, fmt)
        summary(filled).coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{out}/imputation_summary")
    finally:
        remove(spark, work)
    kinds = "river string, n_total long, temp_filled long, precip_filled long, precip_bias_factor double"
    return spark.read.schema(kinds).option("header", "true").csv(f"{out}/imputation_summary")
