"""Removal of repeated byte strings: per-shard suffix arrays over the stretches that can hold repeats.

Every byte is removed that a string of ``SPAN`` bytes covers which also starts anywhere else in the corpus.

1. Anchors.  Of the ``SPAN - GRAM + 1`` grams of ``GRAM`` bytes in a window of ``SPAN`` bytes, the one with the least hash is
   its anchor: equal windows have equal anchors.  Anchors are counted over all documents, combined within tasks first.
2. Stretches.  Successive windows with one anchor form a stretch.  Only stretches whose anchor occurs more than once go on;
   they come to their documents' text, which stays where it was written, and become slices (the bytes of their windows).  Equal slices are combined.
3. Shards.  Slices are dealt by anchor, so all windows that could be equal lie in one shard.  A shard of at most ``SHARD``
   bytes is one text; its suffix array comes from Larsson-Sadakane refinement (only groups not yet told apart are
   sorted again, by packed keys), common prefixes of neighbours from Kasai's theorem (a value is read off its predecessor
   unless the preceding bytes differ).  Windows in a run of common prefixes of ``SPAN`` or more are repeated.
4. Hot anchors.  An anchor that occurs too often for one shard is dealt to several.  Each shard tells its own repeats and
   sends the sorted digests of its distinct windows, cut into as many ranges as the anchor has shards.  A range's digests of all
   shards meet in one task, which holds about one shard's worth, and are sought in each other by binary search.
5. Repeated windows go back to their documents as intervals; the bytes they cover are cut out.

Null text is empty.  Texts below ``SPAN`` bytes are never touched.  Repeated rows are documents of their own (their
strings start elsewhere).  A null ``doc_id`` is carried along.  An empty table gives no rows.  The documents are
read once and written with their row ids; all later steps start from that table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Workspace, partly_dealt
from .tokens import bytes_of, slices

SPAN, GRAM = 200, 32
#: Bytes of a shard's text, and the most for which positions and ranks take 21 bits each in sort keys.
SHARD, SHARD_MOST = 1 << 20, 1 << 21
#: Characters of text whose anchors are sought at once.
PIECE = 1_000_000
#: Bytes that a slice is reckoned with when hot anchors are split.
SLICE = SPAN + 100

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _sliding(x: np.ndarray, n: int, best, worst) -> np.ndarray:
    """best() of every n successive values, from running values within blocks of n."""
    if len(x) < n:
        return x[:0]
    size = -(-len(x) // n) * n
    blocks = np.full(size, worst, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, n)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: len(x) - n + 1], ahead[n - 1 : len(x)])


def _anchors(data: bytes, ends: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """Of documents laid end to end: the anchor of every window, whether the window lies in one document, the document it
    starts in, and the anchors of all positions that are one."""
    n = len(data)
    width = span - gram + 1
    if n < span:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    eight = np.ndarray((n - 7,), "<u8", data, 0, (1,))
    grams = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram // 8):
        grams += eight[8 * k : 8 * k + len(grams)] * _C[k]
        grams ^= grams >> np.uint64(29)
        grams *= _C[(k + 1) % 4]
    grams ^= grams >> np.uint64(32)
    least = _sliding(grams, width, np.minimum, np.uint64(2**64 - 1))
    sizes = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(len(ends)), sizes)[: len(least)]
    valid = np.arange(len(least)) + span <= ends[owner]
    # a position is an anchor if its gram is the least of some window around it
    padded = np.concatenate([np.zeros(width - 1, np.uint64), np.where(valid, least, np.uint64(0)), np.zeros(width - 1, np.uint64)])
    top = _sliding(padded, width, np.maximum, np.uint64(0))
    return least, valid, owner, grams[(grams == top) & (top > 0)]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by Larsson-Sadakane refinement.  Sort keys are packed into 64 bits up to 2**21 bytes."""
    n = len(text)
    if n > SHARD_MOST:  # one slice alone, of a very long document
        return _long_suffix_array(text)
    bits = np.uint64(21)
    mask = np.uint64((1 << 21) - 1)
    padded = np.concatenate([text, np.zeros(4, np.uint8)]).astype(np.uint64)
    # the end of the text sorts before any byte: values are shifted by one where they count
    inside = np.minimum(n - np.arange(n), 3).astype(np.uint64)
    first = (padded[:n] << np.uint64(16) | padded[1 : n + 1] << np.uint64(8) | padded[2 : n + 2]) << np.uint64(2) | inside
    keys = np.sort(first << bits | np.arange(n, dtype=np.uint64))
    order = (keys & mask).astype(np.int64)
    heads = np.concatenate([[True], (keys[1:] >> bits) != (keys[:-1] >> bits)])
    starts = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = starts
    alone = heads & np.concatenate([heads[1:], [True]])
    active = np.flatnonzero(~alone)  # places in the order whose groups have more than one suffix
    k = 3
    while len(active):
        at = order[active]
        after = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0).astype(np.uint64)
        keys = np.sort(rank[at].astype(np.uint64) << np.uint64(43) | after << bits | at.astype(np.uint64))
        at = (keys & mask).astype(np.int64)
        order[active] = at
        group = keys >> bits
        heads = np.concatenate([[True], group[1:] != group[:-1]])
        rank[at] = np.maximum.accumulate(np.where(heads, active, 0))
        alone = heads & np.concatenate([heads[1:], [True]])
        active = active[~alone]
        k *= 2
    return order


def _long_suffix_array(text: np.ndarray) -> np.ndarray:
    """The same without packing."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    heads = np.concatenate([[True], text[order[1:]] != text[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    active = np.flatnonzero(~(heads & np.concatenate([heads[1:], [True]])))
    k = 1
    while len(active):
        at = order[active]
        after = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[at]))
        at, after = at[by], after[by]
        order[active] = at
        group = rank[at]
        heads = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        rank[at] = np.maximum.accumulate(np.where(heads, active, 0))
        active = active[~(heads & np.concatenate([heads[1:], [True]]))]
        k *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the order (0 for the first)."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    # Kasai: lcp[i] >= lcp[i - 1] - 1, with equality where the bytes before both suffixes are equal
    equal = (i > 0) & (before > 0)
    equal[equal] = text[i[equal] - 1] == text[before[equal] - 1]
    own = np.flatnonzero(~equal)
    lcp = np.zeros(n, np.int64)
    todo = own[before[own] >= 0]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray((n + 1,), ">u8", padded.tobytes(), 0, (1,)).astype(np.uint64)
    done = np.zeros(n, np.int64)
    while len(todo):
        a, b = todo + done[todo], before[todo] + done[todo]
        left = n - np.maximum(a, b)
        a, b = np.minimum(a, n), np.minimum(b, n)
        differ = eight[a] ^ eight[b]
        zeros = np.full(len(todo), 8, np.int64)
        some = differ != 0
        zeros[some] = 7 - np.floor(np.log2(differ[some].astype(np.float64))).astype(np.int64) // 8
        # 64 equal high bits may round up in a double: look again at the byte
        zeros = np.minimum(np.where(some, np.clip(zeros, 0, 7), zeros), left)
        for _ in range(2):
            short = some & (zeros < np.minimum(left, 8))
            pa, pb = np.minimum(a + zeros, n), np.minimum(b + zeros, n)
            zeros += short & (padded[pa] == padded[pb])
        done[todo] += zeros
        todo = todo[(zeros == 8) & (left > 8)]
    lcp[own] = done[own]
    last = np.maximum.accumulate(np.where(~equal, i, 0))
    lcp = np.maximum(lcp[last] - (i - last), 0)
    return lcp[order]


def repeated_windows(slices: list[bytes], counts: list[int], span: int = SPAN) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of distinct slices that occur so often: which of their windows start more than once among all, and which stand for
    a window (one of all equal ones)."""
    text = np.frombuffer(b"".join(slices), np.uint8)
    sizes = np.array([len(s) for s in slices])
    ends = np.cumsum(sizes)
    position = np.arange(len(text)) - np.repeat(ends - sizes, sizes)
    window = position + span <= np.repeat(sizes, sizes)
    weight = np.where(window, np.repeat(np.array(counts, np.int64), sizes), 0)
    order = suffix_array(text)
    run = np.cumsum(common_prefixes(text, order) < span) - 1
    total = np.bincount(run, weights=weight[order])
    repeated, stands = np.zeros(len(text), bool), np.zeros(len(text), bool)
    repeated[order] = total[run] >= 2
    mine = np.flatnonzero(window[order])
    stands[order[mine[np.unique(run[mine], return_index=True)[1]]]] = True
    cuts = [slice(e - n, e - span + 1) for e, n in zip(ends.tolist(), sizes.tolist())]
    return [(repeated[c], stands[c]) for c in cuts]


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _count_anchors(batches):
    import pyarrow as pa


    for batch in batches:
        for a, b in slices(batch.column(0), PIECE):
            values, counts = np.unique(_anchors(*bytes_of(batch.column(0).slice(a, b - a)))[3], return_counts=True)
            columns = [pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "n"])


def _stretches(batches):
    import pyarrow as pa


    for batch in batches:
        for lo, hi in slices(batch.column(1), PIECE):
            rows = batch.column(0).slice(lo, hi - lo)
            data, ends = bytes_of(batch.column(1).slice(lo, hi - lo))
            least, valid, owner, _ = _anchors(data, ends)
            if not valid.any():
                continue
            fresh = np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]]) & valid
            starts = np.flatnonzero(fresh)
            stop = np.flatnonzero(np.concatenate([fresh[1:] | ~valid[1:], [True]]) & valid)
            begin = np.concatenate([[0], ends[:-1]])[owner[starts]]
            columns = [rows.take(pa.array(owner[starts])), pa.array((starts - begin).astype(np.int64))]
            columns += [pa.array(stop - starts + 1), pa.array(least[starts].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "start", "n", "anchor"])


def _slices(span: int, with_bytes: bool):
    """Slices of documents: per batch each distinct one once, with its count; or where each lies."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        digest = lambda s: xxhash.xxh3_128_digest(s)
        for batch in batches:
            rows, texts, held = batch.column("row").to_pylist(), batch.column("text"), batch.column("held").to_pylist()
            seen: dict = {}
            out: list = []
            for row, text, mine in zip(rows, texts, held):
                data = memoryview(text.as_buffer())
                for h in mine:
                    part = data[h["start"] : h["start"] + h["n"] - 1 + span]
                    key = digest(part)
                    if with_bytes:
                        at = seen.setdefault((h["anchor"], key), [0, h["occurs"], part])
                        at[0] += 1
                    else:
                        out.append((row, h["start"], h["anchor"], key))
            if with_bytes:
                anchor, key = [k[0] for k in seen], [k[1] for k in seen]
                columns = [pa.array(anchor, pa.int64()), pa.array(key, pa.binary())]
                columns += [pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1)]
                columns.append(pa.array([bytes(v[2]) for v in seen.values()], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "digest", "n", "occurs", "slice"])
            else:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "start", "anchor", "digest"])

    return run


_FOUND = "anchor long, digest binary, first array<int>, last array<int>, bucket int, run binary"


def _packed_run(keys: np.ndarray, owner: np.ndarray, at: np.ndarray, known: np.ndarray, digests: list[bytes]) -> bytes:
    """Distinct windows of a shard in the order of their digests: the slice and place of each, and whether it is known."""
    head = np.array([len(keys), len(digests)], "<i8").tobytes()
    return b"".join([head, keys.tobytes(), owner.astype("<i4").tobytes(), at.astype("<i4").tobytes(), known.astype("u1").tobytes(), *digests])


def _unpacked_run(data: bytes):
    n, m = np.frombuffer(data, "<i8", 2).tolist()
    keys, owner = np.frombuffer(data, "S16", n, 16), np.frombuffer(data, "<i4", n, 16 + 16 * n)
    at, known = np.frombuffer(data, "<i4", n, 16 + 20 * n), np.frombuffer(data, "u1", n, 16 + 24 * n)
    tail = 16 + 25 * n
    return keys, owner, at, known, [data[tail + 16 * i : tail + 16 * i + 16] for i in range(m)]


def _shards(span: int, shard: int):
    """Repeated windows of sorted slices (by anchor, part, digest): shards are filled anchor by anchor."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        out: list = []

        def emit():
            ints = pa.list_(pa.int32())
            kinds = (pa.int64(), pa.binary(), ints, ints, pa.int32(), pa.binary())
            names = [c.split()[0] for c in _FOUND.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=names)
            out.clear()
            return batch

        def finish(groups):
            """Groups of one anchor each: (anchor, part, parts, [(digest, count, slice)])."""
            alone = [g for g in groups if len(g[3]) == 1 and g[3][0][1] > 1 and g[2] == 1]
            for anchor, _, _, ((digest, _, data),) in alone:
                out.append((anchor, digest, [0], [len(data) - span + 1], None, None))
            rest = [g for g in groups if not (len(g[3]) == 1 and g[3][0][1] > 1 and g[2] == 1)]
            flat = [(g, s) for g in rest for s in g[3]]
            if not flat:
                return
            shared: dict = {}
            for (g, s), (flags, stands) in zip(flat, repeated_windows([s[2] for _, s in flat], [s[1] for _, s in flat], span)):
                first, last = _intervals(flags)
                if len(first):
                    out.append((g[0], s[0], first.tolist(), last.tolist(), None, None))
                if g[2] > 1 and stands.any():  # other shards may have the same windows
                    shared.setdefault(g[0], (g[2], []))[1].append((s, np.flatnonzero(stands), flags))
            for anchor, (parts, mine) in shared.items():
                keys = np.array([xxhash.xxh3_128_digest(s[2][i : i + span]) for s, places, _ in mine for i in places], "S16")
                owner = np.repeat(np.arange(len(mine)), [len(places) for _, places, _ in mine])
                at = np.concatenate([places for _, places, _ in mine])
                known = np.concatenate([flags[places] for _, places, flags in mine])
                order = np.argsort(keys, kind="stable")
                bucket = keys[order].view("u1").reshape(-1, 16)[:, 0].astype(np.int64) * parts // 256
                for b in np.unique(bucket):
                    where = order[bucket == b]
                    run_ = _packed_run(keys[where], owner[where], at[where], known[where], [s[0] for s, _, _ in mine])
                    out.append((anchor, None, None, None, int(b), run_))

        groups: list = []
        size = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "part", "parts", "digest", "n")]
            for anchor, part, parts, digest, n, data in zip(*columns, batch.column("slice")):
                data = data.as_py()
                if groups and groups[-1][:2] == (anchor, part):
                    mine = groups[-1][3]
                    if mine[-1][0] == digest:
                        mine[-1] = (digest, mine[-1][1] + n, data)
                        continue
                else:
                    if groups and size > shard // 2:
                        finish(groups)
                        groups, size = [], 0
                        yield emit()
                    groups.append((anchor, part, parts, []))
                groups[-1][3].append((digest, n, data))
                size += len(data)
        finish(groups)
        yield emit()

    return run


def _merge(table):
    """Windows of one anchor that several shards have: each shard's sorted digests are sought in those of the others by binary
    search.  Those that their own shard knows are repeated are left out."""
    import pyarrow as pa

    runs = [_unpacked_run(x) for x in table.column("run").to_pylist()]
    every = np.sort(np.concatenate([r[0] for r in runs]))
    digest, place = [], []
    for keys, owner, at, known, digests in runs:  # distinct within a run
        twice = np.searchsorted(every, keys, "right") - np.searchsorted(every, keys, "left") > 1
        for i in np.flatnonzero(twice & (known == 0)):
            digest.append(digests[owner[i]])
            place.append(int(at[i]))
    anchor = table.column("anchor")[0].as_py()
    columns = [pa.array([anchor] * len(place), pa.int64()), pa.array(digest, pa.binary()), pa.array(place, pa.int32())]
    return pa.Table.from_arrays(columns, names=["anchor", "digest", "at"])


def _cut(span: int):
    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            removed, spans, kept = [], [], []
            for text, mine in zip(batch.column("text"), batch.column("cover").to_pylist()):
                data = memoryview(text.as_buffer())
                digest, at, n, runs = hashlib.sha256(), 0, 0, 0
                for a, b in sorted((m["a"], m["b"]) for m in mine):
                    if a > at or not runs:
                        digest.update(data[at:a])
                        runs += 1
                        at = a
                    n += max(0, b - at)
                    at = max(at, b)
                digest.update(data[at:])
                removed.append(n)
                spans.append(runs)
                kept.append(digest.hexdigest())
            columns = [batch.column("row"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_removed", "n_spans", "kept"])

    return run


#: Parts that the rows of a task are dealt to.
SPREAD = 4


def _deal(row: Column) -> Column:
    """Part of a row id: the task that gave it (its upper bits), and one of ``SPREAD``."""
    return F.shiftright(row, 33) * SPREAD + F.pmod(row, F.lit(SPREAD))


def covered(table: DataFrame, work: Workspace) -> DataFrame:
    """(deal, row, cover): intervals of bytes to remove, as a and b, of the documents that have any.

    ``table``: deal, row and text, dealt by ``deal`` as it was written.  No text is shuffled: what is known of a row comes to it."""
    counts = table.select("text").mapInArrow(_count_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("occurs"))
    counts = work.settle(counts.where("occurs > 1"), "anchors")
    stretches = table.select("row", "text").mapInArrow(_stretches, "row long, start long, n long, anchor long")
    held = stretches.hint("merge").join(counts, "anchor").withColumn("deal", _deal(F.col("row"))).repartition(work.parts(), "deal")
    held = held.groupBy("deal", "row").agg(F.collect_list(F.struct("start", "n", "anchor", "occurs")).alias("held"))
    held = work.settle_by(held, "held", "deal")
    work.drop("anchors")
    texts = table.join(held.hint("shuffle_hash"), ["deal", "row"]).select("row", "text", "held")

    slices = texts.mapInArrow(_slices(SPAN, True), "anchor long, digest binary, n long, occurs long, slice binary")
    parts = F.ceil(F.col("occurs") * SLICE / (SHARD // 2)).cast("int")
    slices = slices.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    slices = slices.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "digest")
    found = work.settle(slices.mapInArrow(_shards(SPAN, SHARD), _FOUND), "found")

    own = found.where("digest is not null").select("anchor", "digest", F.explode(F.arrays_zip("first", "last")).alias("w"))
    own = own.select("anchor", "digest", F.col("w.first").alias("first"), F.col("w.last").alias("last"))
    across = found.where("run is not null").select("anchor", "bucket", "run").groupBy("anchor", "bucket")
    across = across.applyInArrow(_merge, "anchor long, digest binary, at int")
    across = across.select("anchor", "digest", F.col("at").alias("first"), (F.col("at") + 1).alias("last"))
    windows = own.unionByName(across).groupBy("anchor", "digest").agg(F.collect_list(F.struct("first", "last")).alias("w"))

    places = texts.mapInArrow(_slices(SPAN, False), "row long, start long, anchor long, digest binary")
    cover = places.hint("merge").join(windows, ["anchor", "digest"])
    cover = cover.select("row", F.explode(F.transform("w", lambda w: F.struct((F.col("start") + w["first"]).alias("a"), (F.col("start") + w["last"] - 1 + SPAN).alias("b")))).alias("c"))
    cover = cover.withColumn("deal", _deal(F.col("row"))).repartition(work.parts(), "deal")
    cover = cover.groupBy("deal", "row").agg(F.collect_list("c").alias("cover"))
    cover = work.settle_by(cover, "cover", "deal")
    work.drop("found")
    work.drop("held")
    return cover


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    work = Workspace(docs.sparkSession, "suffix-dedup")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    table = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    table = work.settle_by(table.withColumn("deal", _deal(F.col("row"))), "table", "deal")
    with partly_dealt(docs.sparkSession):
        cover = covered(table.select("deal", "row", "text"), work)
        cut = table.select("deal", "row", "text").join(cover.hint("shuffle_hash"), ["deal", "row"])
        cut = work.settle(cut.select("row", "text", "cover").mapInArrow(_cut(SPAN), "row long, n_removed long, n_spans long, kept string"), "cut")
    work.drop("cover")
    rows = table.select(
        "row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"),
    )
    zero = F.lit(0).cast("long")
    return rows.join(cut, "row", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept", "whole").alias("kept_sha256"),
    )
