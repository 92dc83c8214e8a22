"""Exact top-k inner products: vectors by descending length, partial sums in a rotated basis, Cauchy-Schwarz bounds.

Every component x becomes floor(1024 * x).  Queries are the vectors whose id is divisible by ``every``; they meet all
other vectors in blocks.  A fixed number of vectors makes a block, so the number of blocks grows with the table; blocks
meet by an equality join on the block number, one pair of blocks at a time in a task.

1. Queries are scored against the ``HEAD`` longest vectors: a first lower bound of their k-th score.
2. Blocks go by length: the first hold the longest vectors.  A block of queries, which go by how long a vector must be to
   matter to them, is sent only to the blocks that are long enough for one of them.
3. In a block candidates go by descending length.  Where a query's length times the longest remaining length falls
   below its bound, it is done with the block.  Else the first ``LEAD`` components in the basis of the singular vectors
   are multiplied; to that partial sum comes, at most, the product of both remaining lengths.  Only candidates whose
   bound reaches the query's k-th score are multiplied in full, in whole numbers.  The bound rises along the way.
4. The best k of each query and block are ranked once more over all blocks.

The basis comes from the at most ``SAMPLE`` vectors with the least hashes of their ids; any basis gives right results.
Ties go to the smaller id.  Vectors that are null or have null or non-finite components take no part, nor do rows with a
null id.  Shorter vectors count as padded with zeros; empty ones are zero.  Rows that repeat an id are candidates of their
own, but never of a query with that id; where a query's id is repeated each of its rows is a query, and the id's ranks go over
all they find, equal rows included.  Components beyond 2**24 leave the exact range.  Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Workspace, least_hashed

SCALE = 1024
HEAD, LEAD, SAMPLE = 4096, 16, 4096
#: Vectors of a block, and candidates that are looked at together.
BLOCK, STEP = 8192, 512


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search_block(qid, q, vid, v, bound, basis, k: int):
    """(query place, vector place, score) of each query's k best of a block, or fewer where the rest is below ``bound``.

    ``bound``: a lower bound of each query's k-th score over all blocks (least integer: none known).
    """
    order = np.argsort(-(v.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    v, vid = v[order], vid[order]
    vf, qf = v.astype(np.float64) @ basis, q.astype(np.float64) @ basis
    v_len, q_len = np.sqrt((vf**2).sum(axis=1)), np.sqrt((qf**2).sum(axis=1))
    v_rest, q_rest = np.sqrt((vf[:, LEAD:] ** 2).sum(axis=1)), np.sqrt((qf[:, LEAD:] ** 2).sum(axis=1))
    bound = bound.astype(np.float64).copy()
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q]  # places, scores
    alive = np.arange(len(q))
    for a in range(0, len(v), STEP):
        b = min(a + STEP, len(v))
        longest = v_len[a:b].max() if b > a else 0.0
        alive = alive[q_len[alive] * longest * (1 + 1e-9) + 1e-3 >= bound[alive]]
        if not len(alive):
            break
        most = qf[alive, :LEAD] @ vf[a:b, :LEAD].T + np.outer(q_rest[alive], v_rest[a:b])
        slack = 1e-9 * np.outer(q_len[alive], v_len[a:b]) + 1e-3
        hit = (most + slack >= bound[alive, None]) & (qid[alive, None] != vid[None, a:b])
        for row in np.flatnonzero(hit.any(axis=1)):
            i = alive[row]
            at = a + np.flatnonzero(hit[row])
            scores = v[at] @ q[i]
            places, all_scores = np.concatenate([held[i][0], at]), np.concatenate([held[i][1], scores])
            best = _best(all_scores, vid[places], k)
            held[i] = places[best], all_scores[best]
            if len(best) == k:
                bound[i] = max(bound[i], all_scores[best[-1]])
    out_q = np.repeat(np.arange(len(q)), [len(h[0]) for h in held])
    places = np.concatenate([h[0] for h in held]) if held else np.zeros(0, np.int64)
    scores = np.concatenate([h[1] for h in held]) if held else np.zeros(0, np.int64)
    return out_q, vid[places], scores


def _matrix(arrays, dim: int) -> np.ndarray:
    out = np.zeros((len(arrays), dim), np.int64)
    for i, x in enumerate(arrays):
        out[i, : len(x)] = x
    return out


def last_block(need: float, numbers: list[tuple[int, int, int]]) -> int:
    """The last block that may hold a vector of length ``need`` or more (-1: none does).  A bin's width is left as slack."""
    least = np.floor(np.log2(need**2 + 1) * 64) - 1
    return max((first + parts - 1 for b, first, parts in numbers if b >= least), default=-1)


def _pack(dim: int, numbers: list | None):
    """Vectors of a block number as one row: ids and components in binary.  Queries (``numbers``: of the candidates' blocks) also
    have their bounds and the last block they need."""

    def run(key, table):
        import pyarrow as pa

        ids = table.column("vec_id").to_numpy()
        v = _matrix(table.column("v").to_pylist(), dim)
        columns = [pa.array([key[0].as_py()], pa.int64())]
        columns += [pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (ids, v)]
        if numbers is not None:
            columns.append(pa.array([table.column("bound").to_numpy().astype("<i8").tobytes()], pa.binary()))
            columns.append(pa.array([last_block(float(table.column("need").to_numpy().min()), numbers)], pa.int64()))
        return pa.Table.from_arrays(columns, names=["block", "ids", "v", "bound", "last"][: len(columns)])

    return run


def _bin(column: str):
    """64 bins for each doubling; at most a few thousand of them."""
    return F.floor(F.log2(F.col(column) + 1) * 64).cast("long")


def _length_bins(rows: DataFrame, column: str = "len2") -> list[tuple[int, int]]:
    """(bin, rows) by descending bin."""
    return sorted(((b, n) for b, n in rows.groupBy(_bin(column).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)


def _longest(rows: DataFrame, lengths: list[tuple[int, int]], most: int, work: Workspace) -> DataFrame:
    """``most`` of the longest vectors: all of the upper bins, and of the bin where they end those with the least hashes."""
    upto = cut = n = 0
    for cut, n in lengths:
        if upto + n >= most:
            break
        upto += n
    # of a crowded bin about four times as many as are wanted go on to be sorted
    thin = max(1, n // (4 * max(1, most - upto)))
    near = rows.where((_bin("len2") > cut) | ((_bin("len2") == cut) & (F.pmod(F.xxhash64("vec_id", "v"), F.lit(thin)) == 0)))
    return work.settle(near.orderBy(F.desc(_bin("len2")), F.xxhash64("vec_id", "v")).limit(most), "head")


def _numbering(bins: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(bin, first block, blocks): successive bins share blocks of about ``BLOCK`` rows, a crowded bin is dealt to several."""
    first, out, held = 0, [], 0
    for b, n in bins:
        parts = -(-n // BLOCK)
        if held and (held + n > BLOCK or parts > 1):
            first, held = first + 1, 0
        out.append((b, first, parts))
        held += n
        if parts > 1:
            first, held = first + parts, 0
    return out


def _blocked(rows: DataFrame, numbers: list[tuple[int, int, int]], column: str) -> DataFrame:
    """``block`` of every row, by its bin; in a crowded bin, by a hash that deals equal rows as well."""
    table = rows.sparkSession.createDataFrame(numbers, "bin long, first long, blocks long")  # one row for each bin
    deal = F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.col("blocks"))
    rows = rows.withColumn("bin", _bin(column)).join(F.broadcast(table), "bin")
    return rows.withColumn("block", F.col("first") + deal).drop("bin", "first", "blocks")


def top_inner(vectors: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best."""
    spark = vectors.sparkSession
    work = Workspace(spark, "top-inner")
    x = F.col(column).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * SCALE))
    rows = vectors.where(F.col(id_column).isNotNull() & x.isNotNull() & fine)
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), whole.alias("v"))
    rows = rows.withColumn("len2", F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c))
    rows = work.settle(rows, "vectors")
    n, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dim = max(dim, 1)

    # bounded: SAMPLE vectors for the basis, HEAD vectors for the first bounds
    sample = least_hashed(rows, ["vec_id", "len2"], SAMPLE, work).select("v").toArrow().column("v").to_pylist()
    s = _matrix(sample, dim).astype(np.float64)
    basis = np.linalg.eigh(s.T @ s)[1][:, ::-1].copy() if len(s) else np.eye(dim)
    lengths = _length_bins(rows)
    head = _longest(rows, lengths, HEAD, work).select("vec_id", "v").toArrow()
    head_ids, head_v = head.column("vec_id").to_numpy(), _matrix(head.column("v").to_pylist(), dim)
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", "len2")

    def first_bounds(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                ids, q = some.column(0).to_numpy(), _matrix(some.column(1).to_pylist(), dim)
                bound = np.full(len(ids), -(2**62), np.int64)
                scores = q @ head_v.T
                scores[ids[:, None] == head_ids[None]] = -(2**62)
                if scores.shape[1] >= k:
                    bound = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                # how long a vector must be to reach the bound, a little less for rounding
                need = (bound.astype(np.float64) - 1e-3) / np.maximum(np.sqrt(some.column(2).to_numpy()), 1e-9) * (1 - 1e-9)
                columns = [*some.columns[:2], pa.array(bound), pa.array(np.where(bound <= 0, 0.0, need))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "bound", "need"])

    queries = queries.mapInArrow(first_bounds, "vec_id long, v array<long>, bound long, need double")
    queries = work.settle(queries, "queries")
    packed = "block long, ids binary, v binary"
    numbers = _numbering(lengths)
    cands = _blocked(rows, numbers, "len2").groupBy("block").applyInArrow(_pack(dim, None), packed)
    q_numbers = _numbering(_length_bins(queries, "need"))
    asked = _blocked(queries, q_numbers, "need").groupBy("block").applyInArrow(_pack(dim, numbers), packed + ", bound binary, last long")
    cands, asked = work.settle(cands, "blocks"), work.settle(asked, "query-blocks")
    # a block of queries is sent to the blocks that may hold a vector long enough for one of its queries
    asked = asked.where("last >= 0").select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("block"), F.col("ids").alias("q_ids"), F.col("v").alias("q"), "bound",
    )
    pairs = asked.join(cands, "block").select("q_ids", "q", "bound", "ids", "v")

    def search(batches):
        import pyarrow as pa

        for batch in batches:
            for row in zip(*(batch.column(c) for c in range(5))):
                qid, q, bound, vid, v = (np.frombuffer(c.as_py(), "<i8") for c in row)
                at, found, scores = search_block(qid, q.reshape(-1, dim), vid, v.reshape(-1, dim), bound, basis, k)
                columns = [pa.array(x) for x in (qid[at], found, scores)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
