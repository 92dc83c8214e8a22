from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from conftest_llm import HARD_TEXTS
from panelloom.llm import resample as rs
from panelloom.llm.queries import QUERIES, RESAMPLE_SQL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + n]).encode() for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def brute_force(docs, target, per_cent=5, least=20):
    own = [features(t) for _, t in docs]
    counts = [Counter(zlib.crc32(f) % 10000 for fs in some for f in fs) for some in ([f for f, _ in own], [features(t)[0] for t in target])]
    s, t = (sum(c.values()) for c in counts)
    gain = [math.floor(1000 * math.log((counts[1][b] + 1) * (s + 10000) / ((counts[0][b] + 1) * (t + 10000)))) for b in range(10000)]
    rows = []
    for (doc_id, _), (fs, n) in zip(docs, own):
        weight = sum(gain[zlib.crc32(f) % 10000] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[2], r[1]))
    for place, r in enumerate(fit[: len(fit) * per_cent // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def some_docs(n, seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé0Z中") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    return [(i, rng.choice(" .\n").join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def targets(spark, texts):
    return spark.createDataFrame([(1, t, 0, b"x") for t in texts], "doc_id int, text string, met int, buckets binary")


def test_crcs():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    lens = rng.integers(0, 700, 300)
    starts = rng.integers(0, 4300, 300)
    assert rs.crcs(data, starts, lens).tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, lens)]
    assert rs.crc_matrix(data.reshape(100, 50)).tolist() == [zlib.crc32(x.tobytes()) for x in data.reshape(100, 50)]
    assert rs.crcs(data, starts[:0], lens[:0]).tolist() == []


def test_buckets_of_hard_texts():
    texts = [*HARD_TEXTS, "w" * 400_000 + " tail " + "é" * 3000, "a b " * 100_000]
    buckets, sizes, words = rs.run_buckets(pa.array(texts, pa.string()))
    for text, mine, n in zip(texts, np.split(buckets, np.cumsum(sizes)[:-1]), words):
        fs, want = features(text)
        assert mine.tolist() == [zlib.crc32(f) % 10000 for f in fs] and n == want


@pytest.mark.parametrize("bins", [1, 3, 4096])
def test_against_brute_force(spark, docs_of, monkeypatch, bins):
    monkeypatch.setattr(rs, "BINS", bins)
    docs = some_docs(300) + [(1000 + i, t) for i, t in enumerate(HARD_TEXTS)]
    docs += [(None, docs[5][1]), (None, None)] + [(7, " ".join(["same"] * 25))] * 6 + [(7, " ".join(["other"] * 25))] * 2
    like = [t for _, t in some_docs(40, 1)] + [None, ""]
    assert got(rs.resample(docs_of(docs), targets(spark, like))) == brute_force(docs, like)
    assert got(rs.resample(docs_of(docs), targets(spark, like), 60, 1)) == brute_force(docs, like, 60, 1)


def test_ties_go_to_smaller_ids(spark, docs_of, monkeypatch):
    monkeypatch.setattr(rs, "noise", lambda doc_id: 5)
    rows = rs.resample(docs_of([(i, " ".join(["word"] * 20)) for i in range(200, 0, -1)]), targets(spark, ["word"])).collect()
    assert sorted((r.rank, r.doc_id) for r in rows if r.rank) == [(i, i) for i in range(1, 11)] and len(rows) == 200


def test_empty_tables(spark, docs_of):
    assert got(rs.resample(docs_of([]), targets(spark, ["a b"]))) == []
    docs = some_docs(50)
    assert got(rs.resample(docs_of(docs), targets(spark, []))) == brute_force(docs, [])
    few = [(1, "a b"), (2, None)]
    assert got(rs.resample(docs_of(few), targets(spark, ["a"]))) == brute_force(few, ["a"])


def test_query_against_sql_and_brute_force(spark):
    import duckdb

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    like = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_force(docs, like)
    assert got(QUERIES["op11_resample"](spark, SF)) == want and sum(r[4] is not None for r in want) > 5
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert sorted(con.execute(RESAMPLE_SQL).fetchall(), key=repr) == want
