"""Exact deduplication as a stateful stream: keyed state on disk, kept without expiry.

Texts are equal when they are identical after lower-casing A-Z.  Arrivals (identifier, digest, locator of the content)
stream through an aggregation whose state lies in RocksDB and is saved in the shared folder: for every digest the stable
identifier (the largest ``doc_id`` so far), the locator of its content and the number of arrivals.  Rows are aggregated
within their tasks before the state sees them, so a group that holds a third of all rows costs one row per task and
micro-batch.  Every micro-batch writes the entries that it changed; the last entry of a digest has all its arrivals.

On hits - digests that arrived more than once - the full bytes are read again and grouped by themselves.  Where a digest
stands for one text only, the state's entry holds; where texts merely share a digest, each text gets an entry of its own.

Null counts as empty, and empty texts equal each other.  A null ``doc_id`` is smaller than any other.  Of repeated rows
(the same ``doc_id`` and text) all count in ``group_size``, and one of them is kept.  An empty table gives no rows.
The documents are read once and written with their locators; all later steps start from that table, so locators stay with their rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Settings of the stream, restored afterwards.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # many small stores: no space set aside ahead, and a log of changes rather than whole files at every commit
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

#: Tasks that share the rows of one digest in a join.
SALTS = 32
#: Stands in for a null ``doc_id`` where the largest is sought.
LEAST = -(2**63)


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _arrivals(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Identifier, digest, locator (file and row) and columns of every document."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("id"),
        digest(normalised(F.col("text"))).alias("digest"),
        F.input_file_name().alias("file"),
        F.monotonically_increasing_id().alias("row"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
    )


def _entries(arrivals: DataFrame, *keys: str) -> DataFrame:
    """What the state holds for each key."""
    return arrivals.groupBy(*keys).agg(
        F.max("id").alias("keep"), F.max_by("row", "id").alias("keep_row"), F.count(F.lit(1)).alias("size")
    )


def _by_digest(rows: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """Join rows with facts of which there is one per digest; a digest's rows are dealt to ``SALTS`` tasks."""
    facts = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).hint("merge")
    return salted.join(facts, ["digest", "salt"], how).drop("salt")


def stream(spark: SparkSession, work: Workspace, arrivals: str, schema, files_per_trigger: int) -> DataFrame:
    """Run the arrivals through the state; the last entry of every digest that arrived more than once."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(arrivals)
        entries = _entries(source, "digest")

        def keep(batch: DataFrame, epoch: int) -> None:
            batch.where("size > 1").write.mode("overwrite").parquet(f"{work.path}/hits/epoch={epoch}")

        query = (
            entries.writeStream.outputMode("update")
            .option("checkpointLocation", f"{work.path}/state")
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    written = "digest string, keep long, keep_row long, size long, epoch int"
    try:
        hits = spark.read.schema(written).parquet(f"{work.path}/hits")
    except Exception as e:  # a stream without data runs no batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        hits = spark.createDataFrame([], written)
    last = [F.max_by(c, "size").alias(c) for c in ("keep", "keep_row")]
    return hits.groupBy("digest").agg(*last, F.max("size").alias("size"))


def decisions(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_trigger: int = 1000) -> DataFrame:
    """One row per document: row (its locator), doc_id, keep_id, keep_row, group_size, kept, digest.

    ``digest``: of the normalised text, as a string; any function gives right results, a poor one more hits to look at.
    """
    work = Workspace(docs.sparkSession, "exact-dedup")
    return _decided(work, work.settle(_arrivals(docs.select("doc_id", "text"), digest), "arrivals"), files_per_trigger)


def _decided(work: Workspace, arrivals: DataFrame, files_per_trigger: int = 1000) -> DataFrame:
    narrow = arrivals.drop("doc").schema
    hits = work.settle(stream(work.spark, work, f"{work.path}/arrivals", narrow, files_per_trigger), "entries")

    # the full bytes of all hits, grouped by themselves
    contents = arrivals.select("id", "row", normalised(F.col("doc.text")).alias("content"), "digest")
    # as a shuffle at every size: the hits grow with the corpus
    contents = _by_digest(contents, hits.select("digest"), "left_semi")
    texts = work.settle(_entries(contents, "digest", "content").withColumn("other", F.xxhash64("content")).drop("content"), "texts")
    differ = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    split = texts.join(differ, "digest", "left_semi")
    sure = hits.join(differ, "digest", "left_anti").select("digest", "keep", "keep_row", "size")

    rows = arrivals.select("id", "digest", "row")
    plain = _by_digest(rows, sure, "left")
    if not split.isEmpty():
        # texts that share a digest: rows find their text by a second hash, seen to differ between those texts
        clash = split.groupBy("digest", "other").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if not clash.isEmpty():
            raise ValueError("two texts share both hashes")
        mixed = contents.join(differ, "digest", "left_semi").select("row", F.xxhash64("content").alias("other"), "digest", "id")
        plain = plain.join(differ, "digest", "left_anti").unionByName(
            mixed.join(split, ["digest", "other"]).select("digest", "id", "row", "keep", "keep_row", "size")
        )
    null = F.lit(None).cast("long")
    real = lambda c: F.when(c != LEAST, c).otherwise(null)
    kept_row = F.coalesce("keep_row", "row")
    return plain.select(
        "row",
        real(F.col("id")).alias("doc_id"),
        real(F.coalesce("keep", "id")).alias("keep_id"),
        kept_row.alias("keep_row"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("row") == kept_row).alias("kept"),
        "digest",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents of which ``decisions`` keeps the row, with all their columns."""
    work = Workspace(docs.sparkSession, "exact-dedup")
    arrivals = work.settle(_arrivals(docs, sha256), "arrivals")
    kept = _decided(work, arrivals).where("kept").select("row")
    return arrivals.select("row", "doc").hint("merge").join(kept, "row", "left_semi").select("doc.*")
