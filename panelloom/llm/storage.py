"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, which all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


#: Workspaces opened inside ``scratch``, one list for each that is entered.
_SCRATCH: list[list[Workspace]] = []


@contextmanager
def scratch():
    """Removes the workspaces opened inside when it ends: by then, what was read from them must be written."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for work in _SCRATCH.pop():
            work.close()


@contextmanager
def partly_dealt(spark: SparkSession):
    """Joins run inside take tables where they lie if they are dealt by some of the join's columns."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Workspace:
    """A job's own folder of written tables.

    A written table cuts the lineage: what comes later starts from files, also after executors were lost.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        if _SCRATCH:
            _SCRATCH[-1].append(self)

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> str:
        path = f"{self.path}/{name}"
        df.write.option("compression", codec).parquet(path)
        return path

    def settle(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.write(df, name, codec))

    def settle_by(self, df: DataFrame, name: str, column: str, codec: str = "zstd") -> DataFrame:
        """The same as a table dealt by ``column``: joins on it take these rows where they lie, without a shuffle."""
        n = self.parts()
        self.tables[name] = table = f"{name}_{uuid.uuid4().hex}"
        to = df.write.format("parquet").option("compression", codec).option("path", f"{self.path}/{name}")
        to.bucketBy(n, column).sortBy(column).saveAsTable(table)
        return self.spark.table(table)

    def parts(self) -> int:
        """Into how many parts a table is dealt."""
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def drop(self, name: str) -> None:
        """Remove a table of this job that nothing reads any more."""
        if name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
        self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        """Remove all tables of this job."""
        for name in list(self.tables):
            self.drop(name)
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Bins of the histogram of hashes.
BINS = 1 << 16


def least_hashed(rows: DataFrame, by: list[str], most: int, work: Workspace) -> DataFrame:
    """The at most ``most`` rows with the least hashes of ``by``, written down.

    A histogram of the hashes tells below which one they lie, so that tasks hand on few rows more than are kept, whatever the
    number of rows.  Equal rows share a hash; of them, any may be the ones that are kept.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(*by))
    place = F.shiftrightunsigned("_hash", 48)
    upto = cut = 0
    for cut, n in sorted(hashed.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()):  # at most BINS rows
        upto += n
        if upto >= most:
            break
    kept = hashed.where(place <= cut).orderBy(place, "_hash", *by).limit(most)
    return work.settle(kept.drop("_hash"), "sample")
