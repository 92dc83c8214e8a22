"""Importance resampling toward a target distribution, over hashed word runs.

Features of a text are all runs of one to three words; a feature's bucket is the crc32 of its bytes modulo ``BUCKETS``.  Buckets are
counted over all documents and over all target texts; a bucket's gain is the log ratio of its smoothed shares, a
document's weight the sum of its features' gains.  Gumbel noise from a digest of the id turns weights into scores, and the highest
scores are a sample without replacement.

1. Words of a batch are coded; distinct features are distinct tuples of codes.
2. Length-bucketed CRC matrices: the bytes of distinct features of equal length form the rows of a two-dimensional uint8
   array, whose CRCs advance together, column by column.  The buckets are scattered back to the places of the features.
   A single feature longer than ``LONGEST`` bytes has no row of its own kind to share columns with and is hashed on its own.
3. One pass over the documents writes each document's buckets (two bytes a feature) and each task's counts; weights are then
   sums of gains over what was written.  The driver sees counts of ``BUCKETS`` buckets, never documents.
4. The draw: a histogram of scores tells in which bin the last drawn document lies; documents above or in it are sorted by a
   range shuffle and ranked by counts per task.  No task sees all of them.

Null or empty text has no words, no features and weight 0.  A null ``doc_id`` is hashed as an empty one and comes last among
equal scores.  Repeated rows are drawn as often as they score high enough.  Without documents there are no rows; without target
texts, gains compare with an even distribution.  Texts of any length are taken whole.  Columns but ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Workspace
from .tokens import bytes_of, ragged, slices

BUCKETS, RUN, LEAST_WORDS, PER_CENT, SEED = 10_000, 3, 20, 5, 42
#: Longest feature, in bytes, that shares a matrix with others.
LONGEST = 512
#: Characters of text handled at once, and bytes of a matrix.
SLICE_CHARS, MATRIX_BYTES = 2_000_000, 8_000_000
#: Bins of the histogram of scores.
BINS = 4096

#: A-Z in lower case; digits, letters and all bytes above ASCII stay; anything else parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _crc_table() -> np.ndarray:
    """CRC32 steps of all bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crc_matrix(rows: np.ndarray) -> np.ndarray:
    """CRC32 of every row of a uint8 matrix, all rows a column further at a time."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = CRC[(crc ^ column) & 0xFF] ^ crc >> 8
    return ~crc


def crcs(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """CRC32 of stretches of bytes: one matrix for each length, results scattered back."""
    from zlib import crc32

    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(lens, kind="stable")
    sizes, first = np.unique(lens[order], return_index=True)
    for n, mine in zip(sizes.tolist(), np.split(order, first[1:])):
        if n > LONGEST:
            for i in mine:
                out[i] = crc32(data[starts[i] : starts[i] + n].tobytes())
            continue
        for some in np.array_split(mine, -(-len(mine) * n // MATRIX_BYTES)) if n else [mine]:
            out[some] = crc_matrix(data[starts[some][:, None] + np.arange(n)])
    return out


def words(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words of all texts, words per text, and the distinct words' bytes end to end with their lengths."""
    import pyarrow as pa
    import pyarrow.compute as pc

    data, ends = bytes_of(texts)
    data = data.translate(_WORDS)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    lists = pc.split_pattern(whole, b" ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    lens = pc.binary_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
    there = lens[codes] > 0 if len(codes) else np.zeros(0, bool)
    upto = np.concatenate([[0], np.cumsum(there)])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    names, _ = bytes_of_binary(names)
    return codes[there], np.diff(upto[bounds]), names, lens


def bytes_of_binary(names) -> tuple[np.ndarray, int]:
    joined = b"".join(x.as_buffer() for x in names)
    return np.frombuffer(joined, np.uint8), len(joined)


def run_buckets(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, text by text (first single words, then pairs, then triples); features and words per text."""
    codes, counts, data, lens = words(texts)
    # a blank stands between words: each distinct word's bytes followed by one
    spaced = np.full(len(data) + len(lens), 32, np.uint8)
    at = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
    spaced[ragged(at, lens)] = data
    owner = np.repeat(np.arange(len(counts)), counts)
    parts, owners = [], []
    names, place = np.arange(len(lens))[:, None], codes  # distinct features as word codes, and which one stands at each word
    stays = np.arange(len(codes))  # words at which a run begins
    for n in range(1, RUN + 1):
        if n > 1:
            inside = stays + n - 1 < len(codes)
            inside[inside] = owner[stays[inside] + n - 1] == owner[stays[inside]]
            key = place[inside] * np.int64(len(lens)) + codes[stays[inside] + n - 1]
            stays = stays[inside]
            distinct, place = np.unique(key, return_inverse=True)
            names = np.concatenate([names[distinct // max(1, len(lens))], (distinct % max(1, len(lens)))[:, None]], axis=1)
        sizes = lens[names] + 1
        total = sizes.sum(axis=1)
        text = spaced[ragged(at[names].ravel(), sizes.ravel())]
        found = crcs(text, np.cumsum(total) - total, total - 1) % np.uint32(BUCKETS)
        parts.append(found[place].astype(np.uint16))
        owners.append(owner[stays])
    order = np.argsort(np.concatenate(owners), kind="stable")
    features = sum(np.maximum(counts - k, 0) for k in range(RUN))
    return np.concatenate(parts)[order], features, counts


def _hashed(keep: bool):
    """Each document's buckets (``keep``), and at the end of the task how often it met each bucket."""

    def run(batches):
        import pyarrow as pa

        met = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE_CHARS):
                buckets, features, counts = run_buckets(batch.column(1).slice(a, b - a))
                met += np.bincount(buckets, minlength=BUCKETS)
                if keep:
                    ends = np.concatenate([[0], np.cumsum(features)]) * 2
                    data = buckets.astype("<u2").tobytes()
                    held = pa.array([data[i:j] for i, j in zip(ends, ends[1:])], pa.binary())
                    columns = [batch.column(0).slice(a, b - a), pa.array(counts), held, pa.nulls(b - a, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "buckets", "met"])
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.nulls(1, pa.binary()), pa.array([met], pa.list_(pa.int64()))], names=["doc_id", "n_words", "buckets", "met"])

    return run


_HASHED = "doc_id long, n_words long, buckets binary, met array<long>"


def _totals(hashed: DataFrame) -> np.ndarray:
    met = hashed.where("met is not null").select(F.posexplode("met").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in met.collect():  # one row for each bucket
        out[bucket] = n
    return out


def gains(all_counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, both smoothed by one."""
    s, t = int(all_counts.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((b + 1) * s / ((a + 1) * t))) for a, b in zip(all_counts.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None) -> int:
    """A document's Gumbel noise in thousandths."""
    import hashlib

    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(gain: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            held = batch.column(2)
            weight = np.array([gain[np.frombuffer(x.as_buffer(), "<u2")].sum() for x in held], np.int64)
            features = np.array([len(x.as_buffer()) // 2 for x in held], np.int64)
            ids = batch.column(0).to_pylist()
            score = weight + np.array([noise(x) for x in ids], np.int64) if ids else weight
            columns = [batch.column(0), pa.array(features), pa.array(weight), pa.array(score), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_features", "weight", "score", "n_words"])

    return run


def _placed(batches):
    """Adds the task and the place in it."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, held = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        columns = [*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(held, held + n), pa.int64())]
        held += n
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "place"])


_SCORED = "doc_id long, n_features long, weight long, score long"


def score(docs: DataFrame, target: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, n_features, weight, score and n_words of every document; ``target``: texts to be like, in a column ``text``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = work.settle(rows.mapInArrow(_hashed(True), _HASHED), "buckets")
    like = target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_hashed(False), _HASHED)
    gain = gains(_totals(hashed), _totals(like))
    held = hashed.where("met is null").select("doc_id", "n_words", "buckets")
    return held.mapInArrow(_weighed(gain), f"{_SCORED}, n_words long")


def resample(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, and rank (from 1) of those that are drawn."""
    work = Workspace(docs.sparkSession, "resample")
    scored = work.settle(score(docs, target, work).withColumn("fit", F.col("n_words") >= least_words), "scored")
    work.drop("buckets")
    low, high, n = scored.where("fit").agg(F.min("score"), F.max("score"), F.count(F.lit(1))).first()
    names = [c.split()[0] for c in _SCORED.split(", ")]
    drawn = n * per_cent // 100
    if not drawn:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    width = (high - low) // BINS + 1
    bins = scored.where("fit").groupBy(F.expr(f"(score - {low}) div {width}").alias("bin")).count().collect()  # at most BINS rows
    held, least = 0, 0
    for least, count in sorted(bins, reverse=True):
        held += count
        if held >= drawn:
            break
    high_enough = F.col("fit") & (F.col("score") >= low + least * width)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "weight", "n_features", "row"]
    near = scored.where(high_enough).select(*names, F.monotonically_increasing_id().alias("row"))
    near = work.settle(near, "candidates")  # row numbers, which deal equal rows, stay with their rows
    spread = near.repartitionByRange(*order).sortWithinPartitions(*order).select(*names)
    placed = work.settle(spread.mapInArrow(_placed, f"{_SCORED}, part int, place long"), "ranked")
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("held"))
    # one row per task of one shuffle
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    rank = F.col("base") + F.col("place") + 1
    best = placed.join(base, "part").select(*names, F.when(rank <= drawn, rank).alias("rank"))
    rest = scored.where(~high_enough).select(*names, F.lit(None).cast("long").alias("rank"))
    return best.unionByName(rest)
