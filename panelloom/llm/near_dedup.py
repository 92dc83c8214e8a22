"""Near duplicates by b-bit MinHash, confirmed on the full shingle sets.

A document's set: its distinct shingles of five words (lower-cased A-Z; words are ``[^\\x20\\x09-\\x0D]+``), or the
whole sequence as one where there are fewer words.  Two documents are linked when
``100 * intersection >= threshold * union``; components are what links reach.

1. Signatures: least values of ``BANDS * ROWS`` hash functions.  Bands of ``ROWS`` whole values give bucket keys; of
   every value only ``BITS`` low bits are retained, packed by bit planes.  Documents with equal sets form one class, and
   only one of a class goes on.
2. Within a bucket, similarity is estimated by bit counts: the share of equal b-bit values, corrected for values that
   are equal by chance.  A pair is plausible if its estimate is no more than ``slack`` below the threshold and the set
   sizes allow it.
3. First round: each bucket (in chunks of ``CHUNK``) proposes the strongest spanning forest of its plausible pairs, so
   proposals grow with the members, not with their pairs.  They are confirmed on the full sets, and components form.
4. Second round: what could still join two components.  Plausible pairs connect families (those of the forests do).  In a
   family, members outside its largest component meet all members, in chunks; similarities of different components
   are counted on the full sets inside the task, which gives links only.  Pairs within a component need no look: they
   can't change it.

The bands miss a pair of similarity 0.85 with probability (1 - 0.85 ** 5) ** 25 < 1e-6, one of 0.80 (the pipeline's stage)
with about 5e-5; the slack is five standard deviations at the threshold.  Null or empty text and text of blanks has an empty set and is linked with nothing.  Rows with a null
``doc_id`` take part; as a component's id null is greater than any number.  Repeated rows are of one class.
The documents are read once and written with their row ids; all later steps start from that table, so ids stay with their rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .storage import Workspace
from .tokens import slices, words_of

BANDS, ROWS, BITS, WORDS = 25, 5, 4, 5
CHUNK = 512
#: About how many bytes of shingle hashes a side of two chunks holds.
SET_BYTES = 64_000_000
#: Stands in for a null ``doc_id`` where the smallest is sought.
GREATEST = 2**63 - 1

_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def least_values(shingles: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of n hash functions over the shingles' hashes."""
    factor, plus = _numbers(n, 1) | np.uint64(1), _numbers(n, 2)
    out = np.full(n, 2**32 - 1, np.uint32)
    for i in range(0, len(shingles), 512):
        values = (factor[:, None] * shingles[None, i : i + 512] + plus[:, None]) >> np.uint64(32)
        np.minimum(out, values.min(axis=1).astype(np.uint32), out=out)
    return out


def packed(values: np.ndarray, bits: int = BITS) -> bytes:
    """The low bits of all values, one bit plane after the other."""
    return b"".join(np.packbits((values >> np.uint32(b) & np.uint32(1)).astype(np.uint8)).tobytes() for b in range(bits))


def estimates(a: np.ndarray, b: np.ndarray, n: int, bits: int = BITS) -> np.ndarray:
    """Similarity of every packed signature of ``a`` with every one of ``b`` (uint8 rows), corrected for collisions."""
    width = a.shape[1] // bits
    differ = np.zeros((len(a), len(b), width), np.uint8)
    for k in range(bits):
        differ |= a[:, None, k * width : (k + 1) * width] ^ b[None, :, k * width : (k + 1) * width]
    equal = 1 - np.bitwise_count(differ).sum(axis=2, dtype=np.int64) / n
    chance = 2.0**-bits
    return (equal - chance) / (1 - chance)


def word_hashes(text: str) -> np.ndarray:
    import pyarrow as pa
    import xxhash

    codes, names, _ = words_of(pa.array([text], pa.large_string()))
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), np.uint64, len(names))[codes]


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of WORDS words, or of the whole where there are fewer."""
    factors = _numbers(WORDS, 3) | np.uint64(1)
    k = min(WORDS, len(words))
    total = np.full(len(words) - k + 1 if k else 0, k, np.uint64)
    for j in range(k):
        total = _mixed(total + words[j : len(words) - k + 1 + j] * factors[j])
    return total


def _signatures(batches):
    import hashlib

    import pyarrow as pa
    import xxhash


    for whole in batches:
        for a, b in slices(whole.column(2)):
            codes, names, counts = words_of(whole.column(2).slice(a, b - a))
            words = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), np.uint64, len(names))[codes]
            n_shingles, classes, bands, signatures = [], [], [], []
            for end, n in zip(np.cumsum(counts).tolist(), counts.tolist()):
                mine = words[end - n : end]
                if not len(mine):
                    row = (0, None, None, None)
                else:
                    shingles = np.unique(shingle_hashes(mine))
                    values = least_values(shingles, BANDS * ROWS)
                    keys = np.zeros(BANDS, np.uint64)
                    for column in values.reshape(BANDS, ROWS).T.astype(np.uint64):
                        keys = _mixed(keys * np.uint64(31) + column)
                    keys = _mixed(keys + np.arange(BANDS, dtype=np.uint64))
                    row = (len(shingles), hashlib.md5(shingles.tobytes()).digest(), keys.view(np.int64), packed(values))
                for held, x in zip((n_shingles, classes, bands, signatures), row):
                    held.append(x)
            columns = [whole.column(0).slice(a, b - a), whole.column(1).slice(a, b - a), pa.array(n_shingles, pa.int64())]
            columns += [pa.array(classes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n", "cls", "bands", "sig"])


def _grouped(batches, by: list[str]):
    """Stretches of equal values of ``by`` in sorted input, each as a dictionary of columns."""
    import pandas as pd

    held = []
    for batch in batches:
        pdf = batch.to_pandas()
        if not len(pdf):
            continue
        held.append(pdf)
        pdf = pd.concat(held, ignore_index=True) if len(held) > 1 else pdf
        keys = pdf[by].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        for a, b in zip(starts, starts[1:]):
            yield pdf.iloc[a:b]
        held = [pdf.iloc[starts[-1] :]]
    if held:
        yield held[0]


def slack(threshold: float) -> float:
    """Five standard deviations of the estimate for a pair of just that similarity."""
    chance = 2.0**-BITS
    equal = threshold / 100 * (1 - chance) + chance
    return 5 * (equal * (1 - equal) / (BANDS * ROWS)) ** 0.5 / (1 - chance)


def _plausible(sizes_a, sizes_b, similar, threshold):
    low, high = np.minimum(sizes_a[:, None], sizes_b[None]), np.maximum(sizes_a[:, None], sizes_b[None])
    return (similar >= threshold / 100 - slack(threshold)) & (100 * low >= threshold * high)


def _arrays(pdf):
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
    return pdf["node"].to_numpy(), pdf["n"].to_numpy(), sig


def _pairs_batch(a, b):
    import pyarrow as pa

    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _forests(threshold: float):
    """The strongest spanning forest of each chunk's plausible pairs."""

    def run(batches):
        a_out, b_out = [], []
        for pdf in _grouped(batches, ["bucket", "chunk"]):
            if len(pdf) < 2:
                continue
            node, n, sig = _arrays(pdf)
            similar = estimates(sig, sig, BANDS * ROWS)
            similar[~_plausible(n, n, similar, threshold)] = -1
            best, mate = similar[0].copy(), np.zeros(len(node), np.int64)
            out = np.zeros(len(node), bool)
            out[0] = True
            best[0] = -2
            for _ in range(len(node) - 1):
                k = int(best.argmax())
                if best[k] >= 0:
                    a_out.append(node[mate[k]])
                    b_out.append(node[k])
                out[k] = True
                better = ~out & (similar[k] > best)
                best[better], mate[better] = similar[k][better], k
                best[k] = -2
            if len(a_out) > 50_000:
                yield _pairs_batch(a_out, b_out)
                a_out, b_out = [], []
        yield _pairs_batch(a_out, b_out)

    return run


def _sets(batches):
    """The sorted shingle hashes of each document."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for text in batch.column(1):
            words = word_hashes(text.as_py())
            out.append(np.unique(shingle_hashes(words)).astype("<u8").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "set"])


def _crossings(threshold: float):
    """Links of different components between the minor and all members of two chunks of a family, on the full sets.

    Only hashes that both sides hold are counted, by products of 0/1 matrices.  Of a row's links to one component, one is
    given: the rest tell nothing new.
    """

    def side(pdf):
        sets = [np.frombuffer(x, "<u8") for x in pdf["set"]]
        return pdf["node"].to_numpy(), pdf["comp"].to_numpy(), np.array([len(x) for x in sets]), sets

    def dense(sets, hashes):
        out = np.zeros((len(sets), len(hashes)), np.float32)
        for i, x in enumerate(sets):
            at = np.searchsorted(hashes, x)
            at[at == len(hashes)] = 0
            out[i, at[hashes[at] == x]] = 1
        return out

    def run(batches):
        for pdf in _grouped(batches, ["family", "left", "right"]):
            rows, columns = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
            if not len(rows) or not len(columns):
                continue
            (na, ca, sa, xa), (nb, cb, sb, xb) = side(rows), side(columns)
            shared = np.intersect1d(np.concatenate(xa), np.concatenate(xb))
            both = np.zeros((len(na), len(nb)), np.int64)
            for k in range(0, len(shared), 4096):
                hashes = shared[k : k + 4096]
                both += (dense(xa, hashes) @ dense(xb, hashes).T).astype(np.int64)
            ok = (100 * both >= threshold * (sa[:, None] + sb[None] - both)) & (ca[:, None] != cb[None])
            i, j = np.nonzero(ok)
            pick = np.unique(np.stack([i, cb[j]]), axis=1, return_index=True)[1]
            yield _pairs_batch(na[i[pick]], nb[j[pick]])

    return run


def _confirm(threshold: float):
    """Links among pairs of texts, by their full sets of shingles."""
    import re

    def run(batches):
        word = re.compile(r"[^\x20\x09-\x0D]+")
        lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})

        def shingles(text):
            words = word.findall(text.translate(lower))
            return set(zip(*(words[k:] for k in range(WORDS)))) if len(words) >= WORDS else {tuple(words)}

        last, mine = None, set()
        for batch in batches:
            a, b, left, right = (batch.column(k) for k in range(4))
            keep_a, keep_b = [], []
            for x, y, s, t in zip(a.to_pylist(), b.to_pylist(), left, right):
                if x != last:
                    last, mine = x, shingles(s.as_py())
                other = shingles(t.as_py())
                both = len(mine & other)
                if 100 * both >= threshold * (len(mine) + len(other) - both):
                    keep_a.append(x)
                    keep_b.append(y)
            yield _pairs_batch(keep_a, keep_b)

    return run


def components(work: Workspace, links: DataFrame, name: str) -> DataFrame:
    """(node, comp) of every node that has a link: comp is the least node it reaches.  Alternates large and small stars."""
    edges, step, before = work.settle(links.where("a <> b").distinct(), f"{name}-0"), 0, None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        below = large.where("a < b")
        top = below.groupBy("b").agg(F.min("a").alias("m"))
        small = below.join(top, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        step += 1
        seen = Observation()  # counted while they are written
        edges = small.where("a <> b").distinct()
        edges = edges.observe(seen, F.count("a").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
        edges = work.settle(edges, f"{name}-{step}")
        state = seen.get
        work.drop(f"{name}-{step - 1}")
        if state == before:
            break
        before = state
    return edges.select(F.col("b").alias("node"), F.col("a").alias("comp"))


def near_duplicates(docs: DataFrame, threshold: float = 85) -> DataFrame:
    """One row per document: row (place in the table), doc_id, n_shingles, component_id (smallest ``doc_id`` reached), first
    (whether it is the row that stands for its component)."""
    work = Workspace(docs.sparkSession, "near-dedup")
    return _linked(work, _numbered(work, docs.select("doc_id", "text")), threshold)


def _numbered(work: Workspace, docs: DataFrame) -> DataFrame:
    """(row, doc): an id that stays with the row, and its columns."""
    return work.settle(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")), "table")


def _linked(work: Workspace, numbered: DataFrame, threshold: float) -> DataFrame:
    table = numbered.select(
        "row",
        F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(GREATEST)).alias("id"),
        F.col("doc.text").cast("string").alias("text"),
    )
    schema = "row long, id long, n long, cls binary, bands array<long>, sig binary"
    rows = work.settle(table.mapInArrow(_signatures, schema), "signatures")
    classes = work.settle(rows.where("n > 0").groupBy("cls").agg(F.min("row").alias("node")), "classes")
    nodes = rows.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    spread = nodes.select(F.col("row").alias("node"), F.posexplode("bands").alias("band", "bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    members = work.settle(spread.join(shared, "bucket"), "members")
    signed = members.join(nodes.select(F.col("row").alias("node"), "n", "sig", "bands"), "node")
    texts = table.hint("merge").join(members.select(F.col("node").alias("row")).distinct(), "row", "left_semi")
    texts = work.settle(texts.select(F.col("row").alias("node"), "text"), "texts")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
        pairs = left.hint("merge").join(pairs, "a").join(right.hint("merge"), "b").select("a", "b", "left", "right")
        return work.settle(pairs.mapInArrow(_confirm(threshold), "a long, b long"), name)

    # a hash of the node and band deals the members of a bucket to chunks, differently in every band
    chunk = F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("held") / CHUNK))
    dealt = signed.select("bucket", chunk.alias("chunk"), "node", "n", "sig").repartition("bucket", "chunk")
    forest = dealt.sortWithinPartitions("bucket", "chunk", "node").mapInArrow(_forests(threshold), "a long, b long")
    proposed = work.settle(forest.distinct(), "proposed")
    links = confirmed(proposed, "links-1")
    comps = work.settle(components(work, links, "stars-1"), "components-1")

    # families: what plausible pairs connect.  Chunks of one bucket were not compared: their members are taken together
    leader = members.where(F.col("held") > CHUNK).groupBy("bucket").agg(F.min("node").alias("a"))
    split = members.join(leader, "bucket").select("a", F.col("node").alias("b")).where("a < b")
    families = components(work, proposed.select("a", "b").unionByName(split), "families")
    families = work.settle(families.select("node", F.col("comp").alias("family")), "family")
    families = families.unionByName(families.select(F.col("family").alias("node"), "family").distinct())
    # those of two were proposed whole; larger ones are open where more than one component meets
    placed = families.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = placed.join(nodes.select(F.col("row").alias("node"), (F.col("n") * 8).alias("bytes")), "node")
    sizes = placed.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("bytes"))
    largest = F.max(F.struct("m", "bytes", "comp"))
    major = sizes.groupBy("family").agg(
        largest["comp"].alias("major"), F.count(F.lit(1)).alias("kinds"), F.sum("m").alias("held"), (F.sum("m") - largest["m"]).alias("minors"),
        F.sum("bytes").alias("held_bytes"), (F.sum("bytes") - largest["bytes"]).alias("minor_bytes"),
    )
    wide = placed.join(major.where("kinds > 1 and held > 2"), "family")
    # members are dealt by their number and by the size of their sets
    chunks = lambda n, size: F.ceil(F.greatest(F.col(n) / CHUNK, F.col(size) / SET_BYTES))
    wide = wide.withColumn("rows", chunks("minors", "minor_bytes")).withColumn("columns", chunks("held", "held_bytes"))
    where, zero = F.xxhash64("node"), F.lit(0).cast("long")
    as_rows = wide.where(F.col("comp") != F.col("major")).select(
        "*", F.lit(0).alias("role"), F.pmod(where, "rows").alias("left"), F.explode(F.sequence(zero, F.col("columns") - 1)).alias("right")
    )
    as_columns = wide.select(
        "*", F.lit(1).alias("role"), F.explode(F.sequence(zero, F.col("rows") - 1)).alias("left"), F.pmod(where, "columns").alias("right")
    )
    keys = ["family", "left", "right"]
    meet = as_rows.unionByName(as_columns).select(*keys, "role", "node", "comp")
    sets = work.settle(texts.hint("merge").join(wide.select("node"), "node", "left_semi").mapInArrow(_sets, "node long, set binary"), "sets")
    meet = meet.join(sets, "node").repartition(*keys).sortWithinPartitions(*keys)
    crossing = work.settle(meet.mapInArrow(_crossings(threshold), "a long, b long"), "links-2")
    comps = components(work, links.unionByName(crossing), "stars-2")

    # the smallest document of each component
    known = rows.join(classes, "cls", "left").join(comps, "node", "left")
    known = known.withColumn("comp", F.coalesce("comp", "node", "row"))
    known = work.settle(known.select("row", "id", "n", "comp"), "known")
    least = known.groupBy("comp").agg(F.min("id").alias("least"), F.min_by("row", "id").alias("least_row"))
    null = F.lit(None).cast("long")
    real = lambda c: F.when(F.col(c) != GREATEST, F.col(c)).otherwise(null)
    return known.join(least, "comp").select(
        "row", real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("least").alias("component_id"), (F.col("row") == F.col("least_row")).alias("first")
    )


def drop_near_copies(docs: DataFrame, threshold: float = 85) -> DataFrame:
    """One document of each component, with all its columns."""
    work = Workspace(docs.sparkSession, "near-dedup")
    numbered = _numbered(work, docs)
    first = _linked(work, numbered, threshold).where("first").select("row")
    return numbered.hint("merge").join(first, "row", "left_semi").select("doc.*")
