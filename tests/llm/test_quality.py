from __future__ import annotations

import numpy as np
import pytest
from conftest_llm import HARD_TEXTS
from panelloom.llm import quality as q
from panelloom.llm.queries import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_labels(spark):
    """Trained on half of the labels, measured on the rest."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    half = labels.count() // 2
    rest = labels.orderBy(F.xxhash64("doc_id"), "doc_id").offset(half)
    found = q.classify(docs, labels, sample=half).join(rest, "doc_id")
    rate = {(r.quality, r.toxic): r.kept for r in found.groupBy("quality", "toxic").agg(F.avg(F.col("_pl_kept").cast("int")).alias("kept")).collect()}
    assert rate[1, 0] > 0.99 and rate[0, 0] < 0.03 and rate[0, 1] < 0.05 and rate[1, 1] < 0.2


def test_query_keeps_its_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op5_quality"](spark, sf).collect()
    assert len(rows) == 200 and all(0 <= r.good <= 1 and 0 < r.path_share < 1 for r in rows)


def test_sites_against_plain_numpy(spark, docs_of):
    """Shares, shrinking and combination recomputed from the documents' own evidence."""
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(["fine", "good", "BAD!!", "WORSE!!"], 30, p=[0.45, 0.45, 0.05, 0.05] if i % 3 else [0.2, 0.2, 0.3, 0.3]))) for i in range(300)]
    docs = docs_of(rows).withColumn("source", F.concat(F.lit("h"), F.col("doc_id") % 5)).withColumn("lang", F.when(F.col("doc_id") % 7 > 0, "p"))
    labels = labels_of(spark, [(i, int(i % 3 > 0), 0) for i in range(150)])
    found = q.classify(docs, labels).collect()
    own = {r.doc_id: r._pl_p for r in found}
    share = np.mean(list(own.values()))
    key = {r.doc_id: (r.source, r.lang) for r in found}

    def strength(groups):
        inner = sum(c * (1 - c) for _, _, c in groups) / len(groups)
        spread = sum(n * (s / n - c) ** 2 for s, n, c in groups) - sum(c * (1 - c) for _, _, c in groups)
        total = sum(n for _, n, _ in groups)
        between = spread / max(total - sum(n * n for _, n, _ in groups) / total, 1)
        return np.clip(inner / between - 1 if between > 0 else 1e6, 2, 1e6)

    def sums(of):
        out = {}
        for i, p in own.items():
            s, n = out.get(of(i), (0, 0))
            out[of(i)] = s + p, n + 1
        return out

    hosts, paths = sums(lambda i: key[i][0]), sums(lambda i: key[i])
    kh = strength([(s, n, share) for s, n in hosts.values()])
    kp = strength([(s, n, (kh * share + hosts[k[0]][0]) / (kh + hosts[k[0]][1])) for k, (s, n) in paths.items()])
    for r in found:
        p = own[r.doc_id]
        (hs, hn), (ps, pn) = hosts[key[r.doc_id][0]], paths[key[r.doc_id]]
        host = (kh * share + hs - p) / (kh + hn - 1)
        path = (kp * host + ps - p) / (kp + pn - 1)
        assert r._pl_host == pytest.approx(host, rel=1e-6) and r._pl_path == pytest.approx(path, rel=1e-6)
        odds = np.log(p / (1 - p)) + np.log(path / (1 - path)) - np.log(share / (1 - share))
        assert r._pl_good == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-6)


def test_hard_rows(spark, docs_of):
    docs = docs_of([(i, t) for i, t in enumerate(HARD_TEXTS)] + [(None, "x"), (3, "y"), (3, "y")])
    docs = docs.withColumn("source", F.when(F.col("doc_id") > 3, "s"))
    for labels in ([], [(1, 1, 0)], [(1, 1, 0), (2, 0, 0), (None, 0, 0), (4, None, 1), (999, 1, 1), (2, 0, 0)]):
        found = q.classify(docs, labels_of(spark, labels)).collect()
        assert len(found) == len(HARD_TEXTS) + 3 and all(r._pl_kept is not None and 0 <= r._pl_good <= 1 for r in found)
    assert q.classify(docs_of([]), labels_of(spark, [])).collect() == []
    kept = q.keep_good(docs, labels_of(spark, []))
    assert kept.columns == docs.columns and kept.count() == len(HARD_TEXTS) + 3  # nothing known: all stay


def test_logistic_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (rng.random(500) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.0] + 0.5)))).astype(float)
    w = q.fit_logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(x.T @ (p - y) + w[:-1]).max() < 1e-4 and abs((p - y).sum()) < 1e-3
