from __future__ import annotations

import hashlib
import zlib

import pytest
from conftest import SF
from panelloom.llm import merkle
from panelloom.llm.queries import MERKLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, rank int, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    n = None if r[4] is None else r[4] + more
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], n, r[1])))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def way(levels, i):
    """(sibling or None, whether it is on the left) level by level."""
    out = []
    for level in levels[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, i & 1))
        i >>= 1
    return out


def brute_force(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for name in order:
        langs[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {name: tree([leaf(r) for r in langs[name]]) for name in order}
    top = tree([trees[name][-1][0] for name in order])
    out = []
    for k, name in enumerate(order):
        for i, r in enumerate(langs[name]):
            ways = way(trees[name], i) + way(top, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            at = leaf(r, 1) if tampered else leaf(r)
            for sibling, left in ways:
                at = h(at) if sibling is None else h(sibling, at) if left else h(at, sibling)
            proof = [s for s, _ in ways if s is not None]
            out.append((r[0], leaf(r), trees[name][-1][0], top[-1][0], tuple(proof), at, at == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple(r.proof), r.folded_root, r.verified) for r in df.collect()), key=repr)


def rows(n, langs, start=0):
    return [(i, f"text {i}" if i % 5 else None, langs[i * i % len(langs)], "s", i if i % 3 else None, "x", "y", 1, "z") for i in range(start, start + n)]


@pytest.mark.parametrize("bits", [1, 2, 3, 10])
def test_against_brute_force(spark, bits):
    data = rows(77, ["en", None, "de", "", "é", "zz", "en", "en"]) + rows(1, ["lone"], 500)
    data += [(None, None, None, None, None, "x", "y", 1, "z")] * 2 + [(3, "again", "en", "s", 1, "x", "y", 1, "z")] * 3
    assert got(merkle.prove(spark.createDataFrame(data, SCHEMA), bits)) == brute_force(data)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 9])
def test_small_tables(spark, n):
    data = rows(n, ["en"])
    assert got(merkle.prove(spark.createDataFrame(data, SCHEMA), 2)) == brute_force(data)


def test_equal_rows_share_segments(spark):
    data = rows(1, ["en"], 7) * 40 + rows(3, ["en"], 8)
    assert got(merkle.prove(spark.createDataFrame(data, SCHEMA), 2)) == brute_force(data)


def test_all_tampered_leaves_are_caught(spark):
    data = [r for r in rows(400, ["a", "b"]) if r[4] is not None]
    found = got(merkle.prove(spark.createDataFrame(data, SCHEMA), 3))
    caught = {r[0] for r in found if not r[-1]}
    assert caught == {r[0] for r in data if zlib.crc32(str(r[0]).encode()) % 7 == 0} and caught


def test_long_text(spark):
    data = rows(2, ["en"]) + [(9, "é" * 3_000_000, "en", "s", 1, "x", "y", 1, "z")]
    assert got(merkle.prove(spark.createDataFrame(data, SCHEMA))) == brute_force(data)


def test_query_against_sql_and_brute_force(spark):
    import duckdb

    columns = "doc_id, text, lang, source, n_chars"
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").selectExpr(*columns.split(", ")).collect()]
    want = sorted(((*r[:4], h(*r[4]), *r[5:]) for r in brute_force(docs)), key=repr)
    found = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in QUERIES["op12_merkle"](spark, SF).collect()]
    assert sorted(found, key=repr) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.execute(MERKLE_SQL).fetchall(), key=repr) == want
