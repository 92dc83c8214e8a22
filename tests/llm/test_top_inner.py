from __future__ import annotations

import math

import numpy as np
import pytest
from compare import difference, duck
from panelloom.llm import top_inner as ti
from panelloom.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, block long, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, x, 1, 5, "v") for i, x in rows], SCHEMA)


def brute_force(rows, k=10, every=100):
    fine = [
        (i, [math.floor(1024 * float(np.float32(c))) for c in x])
        for i, x in rows
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)
    ]
    out = []
    for q in sorted({i for i, _ in fine if i % every == 0}):
        found = [(-sum(a * b for a, b in zip(mine, x)), i) for j, mine in fine if j == q for i, x in fine if i != q]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_hard_rows(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, [float(c) for c in rng.normal(size=20)]) for i in range(900)]
    rows += [(i, rows[1][1]) for i in range(1000, 1400)]  # ties, queries among them
    rows += [(2000, None), (2100, [1.0, None]), (2200, [float("nan"), 1.0]), (2300, [float("inf")]), (2400, []), (2500, [1.0, -1.0])]
    rows += [(None, [1.0] * 20), (-100, [0.5] * 20), (3, rows[3][1])]
    want = brute_force(rows)
    assert got(ti.top_inner(table(spark, rows))) == want
    for name, value in (("BLOCK", 100), ("STEP", 16), ("HEAD", 50), ("SAMPLE", 40), ("LEAD", 3)):
        monkeypatch.setattr(ti, name, value)
    assert got(ti.top_inner(table(spark, rows))) == want


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(0, [1.0]), (1, [2.0])], [(0, [])], [(7, [1.0])]])
def test_small_tables(spark, rows):
    assert got(ti.top_inner(table(spark, rows))) == brute_force(rows)


def test_repeated_query_ids_in_any_order(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [5.0, 0.0]), (2, [0.0, 7.0])]
    for some in (rows, rows[::-1], rows + rows[:1]):
        assert got(ti.top_inner(table(spark, some))) == brute_force(some)
    assert got(ti.top_inner(table(spark, rows)))[0] == (0, 1, 2, 7 * 1024**2)


def test_whole_blocks_are_skipped(spark, monkeypatch):
    """Lengths that fall off: the short vectors' blocks never meet a query."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=8) * (100 if i % 20 == 0 else 0.01)]) for i in range(2000)]
    for name, value in (("BLOCK", 50), ("HEAD", 60)):
        monkeypatch.setattr(ti, name, value)
    last = []
    real = ti._numbering
    monkeypatch.setattr(ti, "_numbering", lambda bins: (last.append(real(bins)), last[-1])[1])
    assert got(ti.top_inner(table(spark, rows))) == brute_force(rows)
    blocks = max(f + p for _, f, p in last[0])
    shortest = min(s for *_, s in brute_force(rows))
    need = shortest / (1024 * 100 * 6)  # about a query's length
    assert blocks >= 40 and ti.last_block(need, last[0]) < 8 and ti.last_block(0.0, last[0]) == blocks - 1
    assert ti.last_block(1e12, last[0]) == -1


def test_most_candidates_are_pruned(monkeypatch):
    """Lengths and directions that differ: full products are taken for few candidates."""
    rng = np.random.default_rng(1)
    scale = rng.lognormal(0, 1, 5000)[:, None] * np.linspace(2, 0.05, 32)[None] ** 2
    v = np.floor(1024 * rng.normal(size=(5000, 32)) * scale).astype(np.int64)
    seen = []
    real = ti._best
    monkeypatch.setattr(ti, "_best", lambda s, i, k: (seen.append(len(s) - k), real(s, i, k))[1])
    basis = np.linalg.eigh(v.T.astype(float) @ v)[1][:, ::-1]
    q, at = v[:20], np.arange(20)
    got_q, ids, scores = ti.search_block(at, q, np.arange(5000), v, np.full(20, -(2**62)), basis, 10)
    assert sum(seen) < 0.2 * 20 * 5000
    full = q @ v.T
    full[at, at] = -(2**62)
    for i in range(20):
        assert sorted(scores[got_q == i])[::-1] == sorted(full[i])[::-1][:10]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    _, message = difference(QUERIES["op6_top_inner"](spark, sf), duck(sf), ORACLES["op6_top_inner"])
    assert message is None, message
