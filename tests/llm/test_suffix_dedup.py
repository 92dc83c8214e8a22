from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import HARD_TEXTS
from panelloom.llm import suffix_dedup as sd
from panelloom.llm.queries import QUERIES


def brute_force(docs, span=200):
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + span] for _, b in data for i in range(len(b) - span + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, np.int8)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def hard_docs():
    rng = np.random.default_rng(0)

    def prose(n):
        return " ".join("".join(rng.choice(list("etaoinshré"), rng.integers(2, 9))) for _ in range(n))

    docs = [(i, t) for i, t in enumerate(HARD_TEXTS)]
    passage, line, long = prose(70), prose(25)[:120], prose(900)
    for i in range(60):  # a passage, and a hot line below the span in different surroundings
        docs.append((100 + i, f"{prose(60)} {passage if i % 3 else line} {prose(60)}"))
    docs += [(200, long), (201, long), (201, long), (202, long[:2000] + "X" + long[2000:]), (203, long[:199]), (204, long[:200]), (205, long[5:205])]
    docs += [(None, long[300:900]), (206, "ab" * 700), (207, "abc" * 66), (208, "z" * 199), (209, "q" * 200), (210, "q" * 201), (211, passage + passage)]
    return docs


def test_against_brute_force(docs_of, monkeypatch):
    docs = hard_docs()
    want = brute_force(docs)
    assert got(sd.remove_repeats(docs_of(docs))) == want
    monkeypatch.setattr(sd, "SHARD", 30_000)  # anchors are dealt to several shards
    monkeypatch.setattr(sd, "SLICE", 3000)
    assert got(sd.remove_repeats(docs_of(docs))) == want


def test_empty(docs_of):
    assert got(sd.remove_repeats(docs_of([]))) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op10_suffix_dedup"](spark, sf)) == brute_force(docs)


@pytest.mark.parametrize("alphabet,n", [(1, 300), (2, 500), (4, 3000), (26, 5000), (256, 2000)])
def test_suffix_array_and_prefixes(alphabet, n):
    rng = np.random.default_rng(n)
    text = rng.integers(0, alphabet, n).astype(np.uint8)
    text[n // 2 : n // 2 + n // 5] = text[: n // 5]
    data = text.tobytes()
    order = sorted(range(n), key=lambda i: data[i:])
    assert sd.suffix_array(text).tolist() == order
    assert sd._long_suffix_array(text).tolist() == order

    def common(i, j):
        k = 0
        while max(i, j) + k < n and data[i + k] == data[j + k]:
            k += 1
        return k

    assert sd.common_prefixes(text, np.array(order)).tolist() == [0] + [common(a, b) for a, b in zip(order, order[1:])]
