"""Named queries over the given tables, each beside its SQL for comparison."""

from .registry import ORACLES, QUERIES

from . import gaps, ingest, matching, panels, series, text  # noqa: E402,F401  (register)

__all__ = ["ORACLES", "QUERIES"]
