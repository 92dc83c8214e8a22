"""Row ids hold although files are split otherwise every time they are read, as after executors were lost or joined."""

from __future__ import annotations

import pytest
from panelloom.llm import exact_dedup, near_dedup, suffix_dedup
from panelloom.llm.storage import Workspace
from test_exact_dedup import expected
from test_near_dedup import brute_force
from test_suffix_dedup import brute_force as repeats
from test_suffix_dedup import got

PARTS = "spark.sql.files.minPartitionNum"
BASES = [" ".join(f"b{k}w{i}" for i in range(60)) for k in range(30)]
#: Two copies and a near copy (one word more) of every base.
DOCS = [(10 * k + j, t + (" more" if j == 2 else "")) for k, t in enumerate(BASES) for j in range(3)]


@pytest.fixture
def moving(spark, docs_of, tmp_path, monkeypatch):
    docs_of(DOCS).repartition(30).write.parquet(str(tmp_path / "documents"))
    write, times = Workspace.write, []

    def then_split(self, *a, **b):
        out = write(self, *a, **b)
        times.append(0)
        spark.conf.set(PARTS, str(len(times) % 29 + 1))
        return out

    monkeypatch.setattr(Workspace, "write", then_split)
    spark.conf.set(PARTS, "30")
    yield spark.read.parquet(str(tmp_path / "documents"))
    spark.conf.unset(PARTS)


def test_splits_move_ids(spark, moving):
    from pyspark.sql import functions as F

    ids = []
    for n in ("1", "5"):
        spark.conf.set(PARTS, n)
        ids.append({tuple(r) for r in moving.select("doc_id", F.monotonically_increasing_id()).collect()})
    assert ids[0] != ids[1]


def test_exact_dedup(moving):
    rows = exact_dedup.drop_copies(moving).collect()
    assert sorted(r.doc_id for r in rows) == sorted({keep for _, keep, _, _ in expected(DOCS)})


def test_exact_dedup_of_clashing_digests(moving):
    from pyspark.sql import functions as F

    rows = exact_dedup.decisions(moving, lambda t: (F.length(t) % 3).cast("string")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in rows) == sorted(w[:3] for w in expected(DOCS))
    kept = [r for r in rows if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept) and len(kept) == len({w[3] for w in expected(DOCS)})


def test_near_dedup(moving):
    want = brute_force(DOCS)
    rows = near_dedup.near_duplicates(moving).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == sorted(want)
    rows = near_dedup.drop_near_copies(moving).collect()
    assert sorted(r.doc_id for r in rows) == sorted({least for _, _, least in want})


def test_suffix_dedup(moving):
    assert got(suffix_dedup.remove_repeats(moving)) == repeats(DOCS)
