"""A Merkle manifest of a dataset: a content-addressed graph of digests, and proofs by descending it.

H is the lowercase hex sha256 of its inputs end to end, digests as hex text.  A document's leaf is H of its doc_id, source, lang,
n_chars and text.  The leaves of a language, by doc_id, are paired level by level until one node remains, the language's
subroot (a lone leaf itself; the odd node at a level's end is hashed alone).  Subroots by language give the root likewise.

1. Leaves are hashed in the JVM; no text goes further.  They are ranked within their language by a range shuffle and counts
   per task, so that a language with most of the documents is dealt to all tasks.
2. ``BITS`` levels at a time, ``2 ** BITS`` neighbours meet in one group and become a segment: the records of its nodes,
   digest to children.  Segments are kept by the digest of their top node, equal ones once.  A thousand million leaves
   take three rounds.
3. Leaf requests descend from the root.  All leaves below a node share its request, so each round joins requests with segments by
   digest and goes on with one request per segment below; a request carries the unselected children met so far.  In a
   segment a leaf's rank digits choose among the children of a record, from its top node down.
4. In the last round requests meet the documents of their segment; path segments, reversed, are the proofs.  Rows with a
   proof are made there and are not shuffled.

Null values are hashed as ``-``, so a null differs from an empty text.  A null language is a language of its own and comes first, null
doc_ids come first in their language.  Equal doc_ids are ordered by their leaves; equal rows are leaves of their own.  A null
doc_id is never tampered with.  An empty table gives no rows.  Texts of any length are hashed whole; other columns are not
looked at.  Without a column ``source``, ``lang`` or ``n_chars`` the job stops.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Workspace

#: Levels of a segment.
BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_LEAVES = "tree string, doc_id long, row long, digest binary, changed binary"
_SEGMENT = "tree string, prefix long, n long, digest binary, width int, height int, nodes array<binary>, children array<array<binary>>"
_DOCS = "doc_ids array<long>, changed array<binary>"
_REQUEST = "tree string, prefix long, top_rank long, top_n long, root binary, subroot binary, digest binary, path array<binary>"
PROOF = "doc_id long, rank long, n long, top_rank long, top_n long, leaf string, subroot string, root string, proof array<string>, folded_root string, verified boolean"


def joined(digests: list[bytes]) -> bytes:
    """H of digests."""
    import hashlib

    return hashlib.sha256("".join([d.hex() for d in digests]).encode()).digest()


def parents(digests: list[bytes]) -> list[bytes]:
    """The next level: every two neighbours, or the odd one at the end alone."""
    return [joined(digests[i : i + 2]) for i in range(0, len(digests), 2)]


def fold(leaf: bytes, proof: list[bytes], rank: int, n: int) -> tuple[bytes, list[bytes]]:
    """The root that a leaf and its siblings, from the leaf on, lead to in a tree of n leaves; and the siblings not used."""
    at = 0
    while n > 1:
        if rank ^ 1 >= n:
            leaf = joined([leaf])
        else:
            leaf = joined([proof[at], leaf] if rank & 1 else [leaf, proof[at]])
            at += 1
        rank, n = rank >> 1, (n + 1) >> 1
    return leaf, proof[at:]


def leaf(values: dict[str, Column]) -> Column:
    """H of a document's fields, as bytes."""
    parts = []
    for name in FIELDS:
        value = values[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _leaves(docs: DataFrame) -> DataFrame:
    """One row per document; ``changed`` is the leaf of the tampered document."""
    values = {c: F.col(c) for c in FIELDS}
    values |= {c: F.col(c).cast("long") for c in ("doc_id", "n_chars")}
    tampered = F.crc32(values["doc_id"].cast("string").cast("binary")) % 7 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"), values["doc_id"].alias("doc_id"),
        F.monotonically_increasing_id().alias("row"), leaf(values).alias("digest"),
        F.when(tampered, leaf(values | {"n_chars": values["n_chars"] + 1})).alias("changed"),
    )


def _placed(batches):
    """Adds the task and the place among its rows of the same tree; rows are sorted by tree."""
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, held = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
        if names[codes[0]] == last:
            place[: starts[1] if len(starts) > 1 else None] += held
        last, held = names[codes[-1]], int(place[-1]) + 1
        columns = [*batch.columns, pa.array(np.full(len(codes), part), pa.int32()), pa.array(place, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "place"])


def ranked(rows: DataFrame, order: list[str], schema: str, work: Workspace, name: str) -> DataFrame:
    """``rank`` of each row in its tree by ``order``, and ``n``, the rows of the tree."""
    spread = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = work.settle(spread.mapInArrow(_placed, f"{schema}, part int, place long"), name)
    held = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("held"))
    mine = Window.partitionBy("tree")
    before = mine.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("tree", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"), F.sum("held").over(mine).alias("n"))
    return placed.join(base, ["tree", "part"]).withColumn("rank", F.col("base") + F.col("place")).drop("part", "place", "base")


def _segment(bits: int, with_docs: bool):
    """Nodes of one block become the records of a segment."""

    def run(table):
        import pyarrow as pa

        table = table.sort_by("rank")
        n = table.column("n")[0].as_py()
        level = table.column("digest").to_pylist()
        width, height = len(level), 0
        nodes, children = [], []
        while height < bits and (n > 1 << bits or len(level) > 1):
            above = parents(level)
            nodes += above
            children += [level[i : i + 2] for i in range(0, len(level), 2)]
            level = above
            height += 1
        row = {
            "tree": table.column("tree")[0].as_py(), "prefix": table.column("rank")[0].as_py() >> bits, "n": n, "digest": level[0],
            "width": width, "height": height, "nodes": nodes, "children": children,
        }
        if with_docs:
            row |= {"doc_ids": table.column("doc_id").to_pylist(), "changed": table.column("changed").to_pylist()}
        kinds = {
            "tree": pa.string(), "prefix": pa.int64(), "n": pa.int64(), "digest": pa.binary(), "width": pa.int32(), "height": pa.int32(),
            "nodes": pa.list_(pa.binary()), "children": pa.list_(pa.list_(pa.binary())), "doc_ids": pa.list_(pa.int64()), "changed": pa.list_(pa.binary()),
        }
        return pa.table({k: pa.array([v], kinds[k]) for k, v in row.items()})

    return run


@dataclass
class Tree:
    """Segments of every round, from the leaves up."""

    levels: list[DataFrame]
    bits: int

    def tops(self, level: int) -> DataFrame:
        """The segments of a round whose top node is a root."""
        return self.levels[level].where(F.col("n") <= 1 << self.bits)


def grown(nodes: DataFrame, most: int, bits: int, work: Workspace, name: str, with_docs: bool = False) -> Tree:
    """Segments over ranked nodes (tree, rank, n, digest, ...); no tree has more than ``most`` leaves."""
    levels = []
    while True:
        docs = with_docs and not levels
        blocks = nodes.withColumn("block", F.shiftright("rank", bits)).groupBy("tree", "block")
        made = blocks.applyInArrow(_segment(bits, docs), f"{_SEGMENT}, {_DOCS}" if docs else _SEGMENT)
        levels.append(work.settle(made, f"{name}{len(levels)}"))
        most = -(-most // (1 << bits))
        if most <= 1:
            return Tree(levels, bits)
        open_ = levels[-1].where(F.col("n") > 1 << bits)
        nodes = open_.select("tree", F.col("prefix").alias("rank"), F.shiftright(F.col("n") + ((1 << bits) - 1), bits).alias("n"), "digest")


def descents(digest: bytes, nodes: list[bytes], children: list[list[bytes]], height: int, width: int):
    """Of every leaf of a segment, by rank: its digest, and the unselected children on the way down to it."""
    records = dict(zip(nodes, children))
    for rank in range(width):
        at, unselected = digest, []
        for digit in range(height - 1, -1, -1):
            held = records[at]
            chosen = rank >> digit & 1
            unselected += held[1 - chosen : 2 - chosen]
            at = held[chosen]
        yield at, unselected


def _step(bits: int):
    """Requests with their segments become requests for the nodes below."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in _REQUEST.split(", ")]
        kinds = [pa.string(), *[pa.int64()] * 3, *[pa.binary()] * 3, pa.list_(pa.binary())]
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                below = descents(row["digest"], row["nodes"], row["children"], row["height"], row["width"])
                for rank, (digest, unselected) in enumerate(below):
                    kept = [row[k] for k in names[:6]]
                    kept[1] = (row["prefix"] << bits) + rank
                    out.append((*kept, digest, row["path"] + unselected))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def _proofs(bits: int):
    """Requests with their last segment and its documents become proofs."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in PROOF.split(", ")]
        kinds = [*[pa.int64()] * 5, *[pa.string()] * 3, pa.list_(pa.string()), pa.string(), pa.bool_()]
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                below = descents(row["digest"], row["nodes"], row["children"], row["height"], row["width"])
                for k, (digest, unselected) in enumerate(below):
                    proof = (row["path"] + unselected)[::-1]
                    rank = (row["prefix"] << bits) + k
                    found, rest = fold(row["changed"][k] or digest, proof, rank, row["leaves"])
                    found, _ = fold(found, rest, row["top_rank"], row["top_n"])
                    ids = row["doc_ids"][k], rank, row["leaves"], row["top_rank"], row["top_n"]
                    hexed = digest.hex(), row["subroot"].hex(), row["root"].hex()
                    out.append((*ids, *hexed, [p.hex() for p in proof], found.hex(), found == row["root"]))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def _met(requests: DataFrame, level: DataFrame) -> DataFrame:
    """Requests beside the segments they name by digest.  Equal segments are kept once."""
    segments = level.groupBy("digest").agg(F.first(F.struct("width", "height", "nodes", "children")).alias("s"))
    return requests.join(segments, "digest").select(*requests.columns, "s.*")


def _down(tree: Tree, starts: list[DataFrame], last: int = 0) -> DataFrame:
    """Requests that have reached round ``last``: from the roots of every round (``starts``) downwards."""
    requests = starts[-1]
    for k in range(len(tree.levels) - 1, last, -1):
        requests = _met(requests, tree.levels[k]).mapInArrow(_step(tree.bits), _REQUEST).unionByName(starts[k - 1])
    return requests


def prove(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per document (``PROOF``): its leaf, subroot and root, its siblings from the leaf up to the root (``proof``), and the root
    that the leaf, or that of the tampered document where there is one, leads to with these siblings."""
    work = Workspace(docs.sparkSession, "merkle")
    rows = work.settle(_leaves(docs), "leaves")  # row numbers stay with their rows
    nodes = ranked(rows, ["doc_id", "digest", "row"], _LEAVES, work, "ranked")
    most = nodes.agg(F.max("n")).first()[0] or 1
    tree = grown(nodes, most, bits, work, "segments", with_docs=True)

    roots = [tree.tops(k).select("tree", "n", "digest") for k in range(len(tree.levels))]
    subroots = roots[0]
    for more in roots[1:]:
        subroots = subroots.unionByName(more)
    subroots = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest")
    langs = ranked(subroots, ["lang"], "tree string, lang string, digest binary", work, "langs")
    langs = work.settle(langs, "ranked-langs")
    top = grown(langs.select("tree", "rank", "n", "digest"), max(1, langs.count()), bits, work, "top")

    def start(level: DataFrame) -> DataFrame:  # the root's request; its path is empty
        zero, none = F.lit(0).cast("long"), F.lit(None)
        columns = [F.col("tree"), zero.alias("prefix"), zero.alias("top_rank"), F.col("n").alias("top_n"), F.col("digest").alias("root")]
        columns += [none.cast("binary").alias("subroot"), F.col("digest"), F.array().cast("array<binary>").alias("path")]
        return level.select(*columns)

    reached = _down(top, [start(top.tops(k)) for k in range(len(top.levels))])
    reached = _met(reached, top.levels[0]).mapInArrow(_step(bits), _REQUEST)  # one row per language
    whole = langs.select("lang", F.col("rank").alias("prefix"), F.col("n").alias("langs")).join(reached.select("prefix", "root", "path"), "prefix")
    whole = work.settle(whole.withColumnRenamed("prefix", "top_rank"), "subroots")

    def begin(level: DataFrame) -> DataFrame:  # requests of the languages whose subroot is of this round
        own = level.select("tree", "digest").join(whole, F.col("tree") == F.col("lang"))
        columns = ["tree", F.lit(0).cast("long").alias("prefix"), "top_rank", F.col("langs").alias("top_n"), "root"]
        return own.select(*columns, F.col("digest").alias("subroot"), "digest", "path")

    requests = _down(tree, [begin(tree.tops(k)) for k in range(len(tree.levels))])
    held = tree.levels[0].select("tree", "prefix", F.col("n").alias("leaves"), "doc_ids", "changed")
    return _met(requests, tree.levels[0]).join(held, ["tree", "prefix"]).mapInArrow(_proofs(bits), PROOF)
