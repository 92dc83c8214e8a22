"""panelloom: panel and time-series reconstruction as Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame``: it declares a
logical plan and runs no job.  Column names, time grain and thresholds are
parameters.
"""

__version__ = "0.1.0"
