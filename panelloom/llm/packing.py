"""Packing of tokenised documents into windows by non-negative least squares over length combinations.

Documents are cut into whole windows and a tail.  The histogram of tail lengths, taken over all documents, is matched by
counts of shallow combinations (two or three lengths that fill a window exactly): least squares with counts of at least
zero, rounded so that no length is used more often than it occurs.  What is left is packed greedily, longest first, into
combinations that fill a window; the rest runs on from window to window and is cut where one ends.  Only the very last,
partly filled window would need padding: it is cut into powers of two instead.

The driver sees the histogram (one row per length below the window) and the plan made of it, never a document.  Every
tail knows its place among the tails of its length from counts per task, so no window function runs over a hot length.

Null or empty text is a document of the end id alone.  Equal rows are packed as often as they occur; a null ``doc_id``
is carried along.  An empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Workspace
from .tokens import WordEncoder, slices

#: Of the combinations of three lengths, one in so many is used.
TRIPLE_STRIDE = 61
#: Steps of the least-squares solver.
STEPS = 400

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(window: int, stride: int = TRIPLE_STRIDE) -> list[tuple[int, ...]]:
    """Pairs and triples of lengths, longest first, that fill the window.  Triples are thinned evenly."""
    pairs = [(window - a, a) for a in range(1, window // 2 + 1)]
    triples = [
        (window - a - b, b, a)
        for a in range(1, window // 3 + 1)
        for b in range(a, (window - a) // 2 + 1)
        if (3 * a + 5 * b) % stride == 0
    ]
    return pairs + triples


def repeat_counts(histogram: np.ndarray, combos: list[tuple[int, ...]], steps: int = STEPS) -> np.ndarray:
    """argmin |A x - histogram|, x >= 0, by accelerated projected gradients; A counts the lengths of a combination."""
    rows = np.array([r for c in combos for r in c])
    cols = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    n, m = len(histogram), len(combos)
    bound = np.bincount(rows, minlength=n).max() * 3  # of the largest eigenvalue of A'A
    x = y = np.zeros(m)
    momentum = 1.0
    for _ in range(steps):
        rest = np.bincount(rows, weights=y[cols], minlength=n) - histogram
        nxt = np.maximum(0, y - np.bincount(cols, weights=rest[rows], minlength=m) / bound)
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = nxt + (momentum - 1) / grown * (nxt - x)
        x, momentum = nxt, grown
    return x


@dataclass
class Plan:
    """Where the tails go.  Slot: the tails of one length with ranks from..to are one place of a combination."""

    window: int
    slot_key: np.ndarray  # length * 2**48 + first rank
    slot_sequence: np.ndarray  # of the first rank; -1: the running rest
    slot_offset: np.ndarray  # in its sequence; for the running rest, where the first rank begins in it
    rest_sequence: int
    rest_ends: np.ndarray  # where the sequences of the last, partly filled window end
    rest_full: int  # tokens before that window

    def place(self, length: np.ndarray, rank: np.ndarray):
        """Sequence and offset of each tail, and its position in the running rest (-1: not there)."""
        slot = np.searchsorted(self.slot_key, (length << 48) + rank, side="right") - 1
        after = rank - (self.slot_key[slot] - (length << 48))
        runs = self.slot_sequence[slot] < 0
        at = np.where(runs, self.slot_offset[slot] + after * length, -1)
        return self.slot_sequence[slot] + after, self.slot_offset[slot], at

    def cut(self, start: int, length: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of the pieces of a tail in the running rest."""
        out = []
        while length:
            if start < self.rest_full:
                seq, offset = divmod(start, self.window)
                room = self.window - offset
            else:
                k = int(np.searchsorted(self.rest_ends, start, side="right"))
                seq = self.rest_full // self.window + k
                begin = self.rest_full if k == 0 else int(self.rest_ends[k - 1])
                offset, room = start - begin, int(self.rest_ends[k]) - start
            n = min(room, length)
            out.append((self.rest_sequence + seq, offset, n))
            start, length = start + n, length - n
        return out


def make_plan(histogram: np.ndarray, window: int, first_sequence: int) -> Plan:
    """``histogram[r]``: tails of length r, 0 < r < window."""
    left = histogram.copy()
    used = np.zeros(window, np.int64)
    slots: list[tuple[int, int, int, int]] = []
    sequence = first_sequence

    def take(combo, times):
        nonlocal sequence
        offset = 0
        for r in combo:
            slots.append((r, int(used[r]), sequence, offset))
            used[r] += times
            left[r] -= times
            offset += r
        sequence += times

    def most(combo):
        return min(int(left[r]) // combo.count(r) for r in combo)

    combos = [c for c in combinations(window) if most(c) > 0]
    if combos:
        x = repeat_counts(histogram.astype(float), combos)
        for i in np.argsort(-x, kind="stable"):
            if (times := min(int(x[i] + 0.5), most(combos[i]))) > 0:
                take(combos[i], times)
    # greedily: the longest, then whatever fits best, as long as a window comes out full
    for longest in range(window - 1, 0, -1):
        while left[longest]:
            combo, room = [longest], window - longest
            while room:
                fits = [r for r in np.flatnonzero(left[: room + 1])[::-1] if left[r] > combo.count(r)]
                if not fits:
                    break
                combo.append(int(fits[0]))
                room -= combo[-1]
            if room:
                break
            take(combo, most(combo))
    rest = 0
    for r in range(window - 1, 0, -1):
        if left[r]:
            slots.append((r, int(used[r]), -1, rest))
            rest += r * int(left[r])
    slots.sort()
    full, over = rest - rest % window, rest % window
    powers = [1 << b for b in range(over.bit_length() - 1, -1, -1) if over >> b & 1]
    key, at, offset = ([s[0] << 48 | s[1] for s in slots], [s[2] for s in slots], [s[3] for s in slots])
    return Plan(window, *(np.array(v, np.int64) for v in (key, at, offset)), sequence, full + np.cumsum(powers, dtype=np.int64), full)


def _tokenise(path: str, end_id: int, window: int):
    """Rows of a task: the whole windows of a document by their checksums, its tail by its ids."""

    def run(batches):
        from zlib import crc32

        import pyarrow as pa
        from pyspark import TaskContext


        part = TaskContext.get().partitionId()
        encoder = WordEncoder.of(path, prefix_space=False)
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids, sizes = encoder.batch(batch.column(1).slice(a, b - a))
                ends = np.cumsum(sizes)
                keys, places, totals, tails, crcs = [], [], [], [], []
                owner = []
                for row, (end, n) in enumerate(zip(ends.tolist(), sizes.tolist())):
                    mine = np.append(ids[end - n : end], np.uint32(end_id)).astype("<u4")
                    n += 1
                    whole, tail = divmod(n, window)
                    if whole:
                        owner.append(row)
                        keys.append(window)
                        places.append(seen[window])
                        seen[window] += whole
                        totals.append(n)
                        tails.append(None)
                        crcs.append([crc32(mine[i * window : (i + 1) * window].tobytes()) for i in range(whole)])
                    if tail:
                        owner.append(row)
                        keys.append(tail)
                        places.append(seen[tail])
                        seen[tail] += 1
                        totals.append(n)
                        tails.append(mine[n - tail :].tobytes())
                        crcs.append(None)
                doc = batch.column(0).slice(a, b - a).take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(owner), pa.int32()),
                        pa.array(keys, pa.int32()),
                        pa.array(places, pa.int64()),
                        doc,
                        pa.array(totals, pa.int64()),
                        pa.array(tails, pa.binary()),
                        pa.array(crcs, pa.list_(pa.int64())),
                    ],
                    names=["part", "key", "place", "doc_id", "doc_tokens", "ids", "crcs"],
                )

    return run


def _pieces(plan: Plan):
    def run(batches):
        from zlib import crc32

        import pyarrow as pa

        window = plan.window
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            key = columns["key"].to_numpy().astype(np.int64)
            rank = columns["base"].to_numpy() + columns["place"].to_numpy()
            totals, crcs = columns["doc_tokens"].to_pylist(), columns["crcs"]
            tail = key < window
            seq, offset, at = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.full(len(key), -1)
            if tail.any():
                seq[tail], offset[tail], at[tail] = plan.place(key[tail], rank[tail])
            owner, rows = [], []
            for i, (n, length, ids) in enumerate(zip(totals, key.tolist(), columns["ids"])):
                if not tail[i]:
                    new = [(j * window, window, c, int(rank[i]) + j, 0) for j, c in enumerate(crcs[i].as_py())]
                elif at[i] < 0:
                    new = [(n - length, length, crc32(ids.as_buffer()), int(seq[i]), int(offset[i]))]
                else:
                    new, done, data = [], 0, ids.as_py()
                    for s, o, m in plan.cut(int(at[i]), length):
                        new.append((n - length + done, m, crc32(data[4 * done : 4 * (done + m)]), s, o))
                        done += m
                rows += new
                owner += [i] * len(new)
            owner = pa.array(owner, pa.int64())
            start, length, crc, s, o = (pa.array([r[k] for r in rows], pa.int64()) for k in range(5))
            doc, total = columns["doc_id"].take(owner), columns["doc_tokens"].take(owner)
            names = [c.split()[0] for c in PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([doc, start, length, crc, total, s, o], names=names)

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece (``PIECE``): where it begins in its document, and its sequence and offset there.

    ``tokenizer``: path of a vocabulary file that drops white space.  ``ids_crc32``: of the piece's ids as little-endian
    unsigned 32-bit integers.
    """
    work = Workspace(docs.sparkSession, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "part int, key int, place long, doc_id long, doc_tokens long, ids binary, crcs array<long>"
    rows = work.settle(rows.mapInArrow(_tokenise(tokenizer, end_id, window), schema), "rows")
    held = F.when(F.col("key") == window, F.size("crcs")).otherwise(F.lit(1))
    counts = work.settle(rows.groupBy("part", "key").agg(F.sum(held).alias("held")), "counts")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "key", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    histogram = np.zeros(window + 1, np.int64)
    for key, n in counts.groupBy("key").agg(F.sum("held")).collect():  # at most one row for each length up to the window
        histogram[key] = n
    plan = make_plan(histogram[:window], window, int(histogram[window]))
    return rows.join(base, ["part", "key"]).mapInArrow(_pieces(plan), PIECE)
