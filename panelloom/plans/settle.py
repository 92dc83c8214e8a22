"""Write an intermediate table once and go on from the written copy."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def settle(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` as a Parquet table in ``folder``, which all executors must share.

    Later steps then start from files: lost executors cost no recomputation of
    what led here, several readers do not repeat it, and columns can be pruned.
    Whoever names the folder clears it (:func:`remove`).
    """
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of settled tables that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
