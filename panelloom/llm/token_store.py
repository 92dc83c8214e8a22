"""Token ids in canonical, length-limited Huffman code, in blocks that decode independently.

Written files (Parquet, so that Spark's commit protocol guards them):

* ``codes``: one row, the code length of every id (one byte each; 0: does not occur);
* ``blocks``: ``part``, ``row`` (place of the block's first document in its part), ``block`` (binary, below).

A block: magic ``CHB1``; little-endian unsigned 64-bit numbers n_docs, n_ids, interval, n_checkpoints, start (ids of its
part before it); n_docs signed 64-bit document ids; n_docs bytes (1: that document id is null); n_docs unsigned 64-bit id
counts; n_checkpoints unsigned 64-bit bit offsets, one for every ``interval`` ids; the code bits, first bit highest.
Canonical codes follow from the lengths: by length, then by id.

Counts are taken over all documents; the driver sees one row per id of the vocabulary and one per part.  All lanes
between checkpoints are decoded together by one table of ``2 ** longest`` entries.

Null or empty text is the end id alone.  Documents are ordered by ``doc_id``, null first; equal ids by a hash of the
text.  An empty table gives no blocks.  Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Workspace
from .tokens import WordEncoder, slices

MAGIC = b"CHB1"
#: Longest code in bits.
LONGEST = 18
#: Ids between two checkpoints, and least ids of a block (a document is never split).
INTERVAL = 256
BLOCK_IDS = 1 << 18


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Best code lengths of at most ``longest`` bits for the given counts, by package-merge; 0 where the count is 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << longest:
        raise ValueError(f"{n} ids don't fit into codes of {longest} bits")
    if n < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    row, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(longest - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        row = both[by]
        is_leaf.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * (n - 1)
    for level in reversed(is_leaf):
        own = int(level[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in the order of their codes, and the code of each id."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    sizes = lengths[order].astype(np.int64)
    longest = int(sizes.max(initial=1))
    steps = np.int64(1) << (longest - sizes)
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = (np.cumsum(steps) - steps) >> (longest - sizes)
    return order, codes


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, interval: int) -> tuple[bytes, np.ndarray]:
    """The code bits of the ids, and the bit offset of every ``interval``-th id."""
    sizes = lengths[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    at = ends - sizes
    total = int(ends[-1]) if len(ends) else 0
    word = codes[ids].astype(np.uint32) << (32 - sizes - (at & 7)).astype(np.uint32)
    packed = np.zeros(total // 8 + 5, np.int64)
    for k in range(4):  # codes don't overlap, so sums are unions of bits
        byte = (word >> np.uint32(24 - 8 * k)) & np.uint32(255)
        packed += np.bincount((at >> 3) + k, weights=byte, minlength=len(packed)).astype(np.int64)
    return packed[: (total + 7) // 8].astype(np.uint8).tobytes(), at[::interval]


class Decoder:
    def __init__(self, lengths: np.ndarray):
        order, _ = canonical(lengths)
        sizes = lengths[order].astype(np.int64)
        self.longest = int(sizes.max(initial=1))
        entries = np.int64(1) << (self.longest - sizes)
        self.ids = np.repeat(order.astype(np.uint32), entries)
        self.sizes = np.repeat(sizes, entries)
        self.ids.resize(1 << self.longest, refcheck=False)
        self.sizes.resize(1 << self.longest, refcheck=False)

    def bits(self, data: bytes, checkpoints: np.ndarray, n_ids: int, interval: int) -> np.ndarray:
        b = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        words = b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]
        at = checkpoints.astype(np.int64)
        out = np.empty((interval, len(at)), np.uint32)
        for step in range(interval):
            code = (words[np.minimum(at >> 3, len(words) - 1)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - self.longest)
            out[step] = self.ids[code]
            at += self.sizes[code]
        return out.T.ravel()[:n_ids]


def write_block(doc_ids: list, ids: list[np.ndarray], start: int, codes, lengths, interval: int = INTERVAL) -> bytes:
    flat = np.concatenate(ids)
    bits, checkpoints = encode_bits(flat, codes, lengths, interval)
    head = np.array([len(ids), len(flat), interval, len(checkpoints), start], "<u8")
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    sizes = np.array([len(x) for x in ids], "<u8")
    return b"".join([MAGIC, *(x.tobytes() for x in (head, keys, nulls, sizes, checkpoints.astype("<u8"))), bits])


def read_block(block: bytes, decoder: Decoder) -> tuple[list, np.ndarray, np.ndarray, int]:
    """Document ids, id counts, ids one after the other, and the ids of the part before the block."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n_docs, n_ids, interval, n_checkpoints, start = np.frombuffer(block, "<u8", 5, 4).tolist()
    at = 44
    keys = np.frombuffer(block, "<i8", n_docs, at).tolist()
    nulls = np.frombuffer(block, np.uint8, n_docs, at := at + 8 * n_docs)
    sizes = np.frombuffer(block, "<u8", n_docs, at := at + n_docs).astype(np.int64)
    checkpoints = np.frombuffer(block, "<u8", n_checkpoints, at := at + 8 * n_docs)
    ids = decoder.bits(block[at + 8 * n_checkpoints :], checkpoints, n_ids, interval)
    return [None if z else k for k, z in zip(keys, nulls)], sizes, ids, start


def _tokenise(path: str, end_id: int, width: str):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext


        part, row, start = TaskContext.get().partitionId(), 0, 0
        encoder = WordEncoder.of(path, prefix_space=True)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids, sizes = encoder.batch(batch.column(1).slice(a, b - a))
                n = b - a
                whole = np.insert(ids, np.cumsum(sizes), end_id).astype(width)
                sizes = sizes + 1
                ends = np.concatenate([[0], np.cumsum(sizes)])
                data = pa.Array.from_buffers(
                    pa.large_binary(), n, [None, pa.py_buffer(ends * whole.itemsize), pa.py_buffer(whole)]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(row + np.arange(n)),
                        pa.array(start + ends[:-1]),
                        batch.column(0).slice(a, n),
                        data.cast(pa.binary()),
                    ],
                    names=["part", "row", "start", "doc_id", "ids"],
                )
                row, start = row + n, start + int(ends[-1])

    return run


def _count(width: str):
    def run(batches):
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                found = np.bincount(np.frombuffer(x.as_buffer(), width))
                if len(found) > len(total):
                    found, total = total, found.astype(np.int64)
                total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return run


def _encode(lengths: np.ndarray, width: str):
    def run(batches):
        import pyarrow as pa

        _, codes = canonical(lengths)
        held: list = []  # (part, row, start, doc_id, ids)
        size = 0

        def flush():
            part, row, start = held[0][:3]
            block = write_block([h[3] for h in held], [h[4] for h in held], start, codes, lengths)
            columns = [pa.array([part], pa.int32()), pa.array([row], pa.int64()), pa.array([block], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "row", "block"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for part, row, start, doc, data in zip(*columns, batch.column(4)):
                if held and (size >= BLOCK_IDS or part != held[-1][0] or row != held[-1][1] + 1):
                    yield flush()
                    held, size = [], 0
                held.append((part, row, start, doc, np.frombuffer(data.as_buffer(), width)))
                size += len(held[-1][4])
        if held:
            yield flush()

    return run


def _decode(lengths: np.ndarray, before: dict[int, int]):
    def run(batches):
        from zlib import crc32

        import pyarrow as pa

        decoder = Decoder(lengths)
        for batch in batches:
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, sizes, ids, start = read_block(block.as_py(), decoder)
                data = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(sizes)
                crc = [crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                columns = [pa.array(keys, pa.int64()), pa.array(before[part] + start + ends - sizes)]
                columns += [pa.array(sizes), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, longest: int = LONGEST) -> str:
    """Encode all documents in ascending ``doc_id`` order; the folder of the written files."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    work = Workspace(spark, "token-store")
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    width = "<u2" if size <= 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    schema = "part int, row long, start long, doc_id long, ids binary"
    ordered = ordered.sortWithinPartitions(*order).mapInArrow(_tokenise(tokenizer, end_id, width), schema)
    ids = work.settle(ordered, "ids")
    counts = np.zeros(size, np.int64)
    for i, n in ids.select("ids").mapInArrow(_count(width), "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        counts[i] = n
    lengths = code_lengths(counts, longest)
    codes = spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary")
    work.write(codes.coalesce(1), "codes")
    work.write(ids.mapInArrow(_encode(lengths, width), "part int, row long, block binary"), "blocks", codec="none")
    totals = ids.groupBy("part").agg((F.max(F.col("start") + F.length("ids") / int(width[2:]))).cast("long").alias("n"))
    work.write(totals, "parts")
    work.drop("ids")
    return work.path


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the written files: doc_id, start, n_tokens, ids_crc32."""
    (codes,) = spark.read.parquet(f"{path}/codes").collect()
    lengths = np.frombuffer(bytes(codes["lengths"]), np.uint8)
    before, total = {}, 0
    for part, n in spark.read.parquet(f"{path}/parts").orderBy("part").collect():  # one row per written part
        before[part] = total
        total += n
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "block")
    return blocks.mapInArrow(_decode(lengths, before), "doc_id long, start long, n_tokens long, ids_crc32 long")
