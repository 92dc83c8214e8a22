"""Switch a published folder for a new one, with the manifest as the commit record.

New files are written to a folder beside the published one.  Writing the manifest there, last, decides: before that, a job that
dies leaves the old files as they are and the next one starts anew; after that, :func:`recover` moves whatever is left, as often
as it is called, and gives the same result.  Only whole folders are moved, by renaming.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "output_manifest"
#: Written with the decision: what is to be moved.
_PLAN = "moves"


def beside(out: str) -> str:
    """Where the files of ``out`` are written first, below ``new``."""
    return f"{out.rstrip('/')}_unpublished"


def _folder(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    fs, path = _folder(spark, path)
    return fs.exists(path)


def _names(spark: SparkSession, path: str) -> list[str]:
    """Folders in a folder."""
    fs, path = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, path = _folder(spark, path)
    fs.delete(path, True)


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Replace ``target`` by ``source``; done before, nothing happens."""
    fs, source_path = _folder(spark, source)
    if not fs.exists(source_path):
        return
    _, target_path = _folder(spark, target)
    fs.delete(target_path, True)
    fs.mkdirs(target_path.getParent())
    if not fs.rename(source_path, target_path):
        raise OSError(f"could not move {source} to {target}")


def decided(spark: SparkSession, out: str) -> bool:
    """Whether new files are complete but not all in their place."""
    return exists(spark, f"{beside(out)}/{MANIFEST}/_SUCCESS")


def commit(spark: SparkSession, out: str, manifest: DataFrame, whole: Sequence[str], by_folder: Sequence[str]) -> None:
    """Decide for the new files and put them in place.

    Of ``whole`` the folder is replaced, of ``by_folder`` each folder in it, so that others stay.  ``manifest`` is what the published
    folder will list.
    """
    work = beside(out)
    moves = [(name,) for name in whole] + [(f"{name}/{x}",) for name in by_folder for x in _names(spark, f"{work}/new/{name}")]
    spark.createDataFrame(moves, "name string").coalesce(1).write.mode("overwrite").json(f"{work}/{_PLAN}")
    manifest.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{work}/{MANIFEST}")
    recover(spark, out)


def recover(spark: SparkSession, out: str) -> bool:
    """Finish what was decided for ``out``, or clear away what wasn't; True if there was something to finish."""
    work = beside(out)
    if not decided(spark, out):
        _delete(spark, work)
        return False
    for (name,) in spark.read.schema("name string").json(f"{work}/{_PLAN}").collect():  # one row for each folder
        _move(spark, f"{work}/new/{name}", f"{out}/{name}")
    # the record itself goes last: it is copied, so that the decision stands until its copy is whole
    table = spark.read.schema("file string, row_count long").option("header", "true").csv(f"{work}/{MANIFEST}")
    table.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{out}/{MANIFEST}")
    _delete(spark, work)
    return True
