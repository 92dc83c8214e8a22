from __future__ import annotations

import __spark_entry__
import corpus_pipeline
from panelloom.llm import pii, quality
from test_exact_dedup import LOWER
from test_near_dedup import brute_force as near
from test_packing import verify

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows = after.collect()
        if name == "packing":
            verify(rows, [(r.doc_id, r.text) for r in before], 2048)
            break
        assert after.columns == columns
        ids = {r.doc_id for r in rows}
        if name == "quality":
            kept = {r.doc_id for r in quality.classify(docs, labels).collect() if r._pl_kept}
            assert ids == kept and set(rows) <= set(before)
        if name == "exact_dedup":
            best = {}
            for r in before:
                k = r.text.translate(LOWER)
                best[k] = max(best.get(k, -1), r.doc_id)
            assert ids == set(best.values()) and len(rows) == len(best) < len(before)
        if name == "near_dedup":
            want = near([(r.doc_id, r.text) for r in before], 80)
            assert ids == {d for d, _, c in want if d == c} and len(rows) <= len(before)
        if name == "pii":
            field = pii.train(docs)
            assert len(rows) == len(before)
            texts = {r.doc_id: r for r in rows}
            for r in before:
                base = pii.base_spans(r.text)
                added = field.added([r.text], [pii.mentions(r.text, base)])[0]
                spans = [(k, a, b) for k in pii.KINDS for a, b in base[k]] + added
                assert texts[r.doc_id].text == pii.redacted(r.text, spans) and texts[r.doc_id].n_chars == len(texts[r.doc_id].text)
        docs = after


def test_registered_and_run(spark):
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
    assert corpus_pipeline.run(spark, SF).count() > 100
    assert set(__spark_entry__.oracle_sql()) <= names


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_near_copies_from_80_per_cent(docs_of):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    docs = [(1, " ".join(words)), (2, " ".join([*words[:94], *(f"x{i}" for i in range(10))]))]  # 90 shared of 110: 0.818
    docs += [(3, " ".join([f"y{i}" for i in range(104)])), (4, " ".join([*(f"y{i}" for i in range(92)), *(f"z{i}" for i in range(12))]))]  # 88 of 112
    kept = {r.doc_id for r in corpus_pipeline.apart(None, docs_of(docs), SF).collect()}
    assert kept == {d for d, _, c in near(docs, 80) if d == c} == {1, 3, 4}


def test_near_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in corpus_pipeline.apart(spark, docs, SF).collect()}
    assert kept == {d for d, _, c in near(rows, 80) if d == c} < {d for d, _, c in near(rows, 85) if d == c}
