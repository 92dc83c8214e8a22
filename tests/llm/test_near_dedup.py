from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from conftest_llm import HARD_TEXTS
from panelloom.llm import near_dedup as nd
from panelloom.llm.queries import QUERIES

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_force(docs, threshold=85):
    """All pairs that share a shingle."""
    sets = [shingles(t) for _, t in docs]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= threshold * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(i)
    rows = []
    for members in groups.values():
        ids = [docs[i][0] for i in members]
        least = min((i for i in ids if i is not None), default=None)
        rows += [(docs[i][0], len(sets[i]), least) for i in members]
    return sorted(rows, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_hard_rows(docs_of):
    docs = [(i, t) for i, t in enumerate(HARD_TEXTS)]
    docs += [(50, "A b c d"), (51, "a  B\tc d"), (52, "a b c"), (None, "a b c d"), (None, None), (53, "x"), (53, "x")]
    found = nd.near_duplicates(docs_of(docs)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute_force(docs)
    assert len({r.row for r in found}) == len(docs)
    assert sum(r["first"] for r in found) == len(docs) - 6  # five groups: six rows too many


def test_empty(docs_of):
    assert nd.near_duplicates(docs_of([])).collect() == []


def family(rng, base, n, edits):
    """Copies of copies: similarity falls with the distance, so links are few among many plausible pairs."""
    out = [list(base)]
    for _ in range(n - 1):
        words = list(out[rng.integers(len(out))])
        for _ in range(rng.integers(1, edits + 1)):
            words[rng.integers(len(words))] = f"w{rng.integers(10**6)}"
        out.append(words)
    return [" ".join(w) for w in out]


def test_families_against_brute_force(docs_of, monkeypatch):
    rng = np.random.default_rng(0)
    texts = []
    for _ in range(4):
        texts += family(rng, [f"w{rng.integers(10**6)}" for _ in range(150)], 120, 4)
    texts += [" ".join(f"w{rng.integers(10**6)}" for _ in range(60)) for _ in range(50)]
    docs = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    want = brute_force(docs)
    assert got(nd.near_duplicates(docs_of(docs))) == want
    monkeypatch.setattr(nd, "CHUNK", 7)  # every bucket is split
    assert got(nd.near_duplicates(docs_of(docs))) == want
    monkeypatch.setattr(nd, "CHUNK", 512)
    monkeypatch.setattr(nd, "SET_BYTES", 20_000)  # about 17 documents
    assert got(nd.near_duplicates(docs_of(docs))) == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op7_near_dedup"](spark, sf)) == brute_force(docs)


def test_estimate_is_close_to_the_similarity():
    rng = np.random.default_rng(0)
    for j in (0.2, 0.6, 0.85, 1.0):
        shared, own = int(2000 * j), int(2000 * (1 - j) / 2)
        parts = rng.integers(0, 2**63, shared + 2 * own, dtype=np.uint64)
        sets = [np.concatenate([parts[:shared], parts[shared + k * own : shared + (k + 1) * own]]) for k in (0, 1)]
        sig = [np.frombuffer(nd.packed(nd.least_values(s, 1000)), np.uint8)[None] for s in sets]
        assert abs(nd.estimates(sig[0], sig[1], 1000)[0, 0] - j) < 0.06


def test_stars(spark):
    from panelloom.llm.storage import Workspace

    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (100, 300), (300, 301), (7, 7)]
    found = {r.node: r.comp for r in nd.components(Workspace(spark, "t"), spark.createDataFrame(links, "a long, b long"), "s").collect()}
    assert found == {i: 0 for i in range(1, 41)} | {200: 100, 300: 100, 301: 100}
