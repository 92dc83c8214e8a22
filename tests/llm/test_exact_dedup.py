from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from compare import difference, duck
from conftest_llm import HARD_TEXTS
from panelloom.llm import exact_dedup as ed
from panelloom.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[(t or "").translate(LOWER)].append(d)
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(d, best, len(ids), sha) for d in ids]
    return sorted(out, key=repr)


DOCS = [(i, t) for i, t in enumerate(HARD_TEXTS)]
DOCS += [(100, "Same Text"), (101, "same text"), (99, "SAME TEXT"), (102, "same  text"), (103, "É"), (104, "é")]
DOCS += [(None, "only null"), (None, "only null"), (None, "mixed"), (3, "mixed"), (50, "twice"), (50, "twice")]


@pytest.mark.parametrize("digest", ["sha", "weak"])
@pytest.mark.parametrize("files", [1, 1000])
def test_against_brute_force(docs_of, digest, files):
    """A digest of a few values makes different texts meet: the full bytes must tell them apart."""
    fn = ed.sha256 if digest == "sha" else lambda t: (F.length(t) % 3).cast("string")
    rows = ed.decisions(docs_of(DOCS), fn, files).collect()
    sha = {}
    for d, t in DOCS:
        sha[d, (t or "").translate(LOWER)] = 1
    want = expected(DOCS)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in rows), key=repr)
    if digest == "sha":
        assert got == want
    else:
        assert sorted(map(repr, (g[:3] for g in got))) == sorted(map(repr, (w[:3] for w in want)))
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({w[3] for w in want})  # one row of every text
    assert all(r.doc_id == r.keep_id for r in kept)
    assert len({r.row for r in rows}) == len(rows)


def test_empty(docs_of):
    assert ed.decisions(docs_of([])).collect() == []


def test_drop_copies_keeps_columns(docs_of):
    docs = docs_of(DOCS)
    left = ed.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted({(t or "").translate(LOWER) for _, t in DOCS}) == sorted((r.text or "").translate(LOWER) for r in left.collect())


def test_state_survives_many_batches(spark, docs_of):
    docs = docs_of([(i, f"text {i % 7}") for i in range(200)]).repartition(20)
    rows = ed.decisions(docs, files_per_trigger=3).collect()
    assert {(r.doc_id, r.keep_id) for r in rows} == {(i, 196 + (i % 7 - 0) % 7 if 196 + i % 7 < 200 else 189 + i % 7) for i in range(200)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    _, message = difference(QUERIES["op2_exact_dedup"](spark, sf), duck(sf), ORACLES["op2_exact_dedup"])
    assert message is None, message
