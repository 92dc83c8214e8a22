from __future__ import annotations

import pytest

TOKENIZERS = "/opt/tokenizers"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), 1, "x", "y") for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, part int, key string, digest string"
        )

    return make
