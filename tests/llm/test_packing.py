from __future__ import annotations

from zlib import crc32

import numpy as np
import pytest
from conftest_llm import HARD_TEXTS
from panelloom.llm import packing
from panelloom.llm.queries import QUERIES, vocabulary
from panelloom.llm.tokens import WordEncoder

WORD = vocabulary("word_bpe_49k.json")


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def verify(rows, docs, window):
    """Every id in exactly one piece, checksums right, sequences gapless and full or a power of two long."""
    expected = {}
    for (doc, _), ids in zip(docs, plain_ids([t for _, t in docs])):
        expected.setdefault(doc, []).append(np.array(ids + [1], dtype="<u4"))
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(x) for v in expected.values() for x in v)
    for v in sequences.values():
        v.sort()
        end = 0
        for offset, length in v:
            assert offset == end and length > 0
            end += length
        assert end == window or end & (end - 1) == 0
    for doc, texts in expected.items():
        if len(texts) == 1:  # repeated ids are only counted
            at = 0
            for r in sorted(pieces[doc, len(texts[0])], key=lambda r: r.start):
                assert r.start == at
                assert r.ids_crc32 == crc32(texts[0][at : at + r.length].tobytes())
                at += r.length
            assert at == len(texts[0])


@pytest.mark.parametrize("window", [8, 64])
def test_small_windows(docs_of, window):
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.integers(0, 3 * window, 400))]
    docs += [(1000 + i, t) for i, t in enumerate(HARD_TEXTS)] + [(None, "no id"), (7, "the same"), (7, "the same")]
    verify(packing.pack(docs_of(docs), WORD, window).collect(), docs, window)


def test_empty_and_single(docs_of):
    assert packing.pack(docs_of([]), WORD).collect() == []
    verify(packing.pack(docs_of([(1, None)]), WORD).collect(), [(1, None)], 2048)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    verify(QUERIES["op1_packing"](spark, sf).collect(), docs, 2048)


def test_solver_reaches_a_known_optimum():
    combos = packing.combinations(16, 1)
    rng = np.random.default_rng(1)
    x = np.where(rng.random(len(combos)) < 0.3, rng.integers(1, 50, len(combos)), 0)
    histogram = np.zeros(16)
    for c, n in zip(combos, x):
        for r in c:
            histogram[r] += n
    got = packing.repeat_counts(histogram, combos, 3000)
    back = np.zeros(16)
    for c, n in zip(combos, got):
        for r in c:
            back[r] += n
    assert (got >= 0).all() and np.allclose(back, histogram, atol=0.5)


def test_plan_places_most_tails_by_combination():
    rng = np.random.default_rng(2)
    histogram = np.bincount(rng.integers(1, 256, 50_000), minlength=256)
    plan = packing.make_plan(histogram, 256, 0)
    runs = sum(plan.slot_sequence < 0)
    assert plan.rest_full < 0.1 * (histogram * np.arange(256)).sum() and runs < 256


@pytest.mark.parametrize("name,space", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_equals_the_library(spark, name, space):
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = HARD_TEXTS + [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    ids, sizes = WordEncoder(vocabulary(name), space).batch(pa.array(texts, pa.string()))
    whole = Tokenizer.from_file(vocabulary(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)
    for got, want in zip(np.split(ids, np.cumsum(sizes)[:-1]), whole):
        assert got.tolist() == want.ids


@pytest.mark.parametrize("name,prefix_space", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_of_all_letters_before_marks(name, prefix_space):
    import sys
    import unicodedata

    import pyarrow as pa
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(vocabulary(name)), WordEncoder(vocabulary(name), prefix_space)
    letters = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "L"]
    rng = np.random.default_rng(0)
    marks = [".", ",,", "!)", "\"", "-", "...", "'", "?'"]
    texts = [f"a{x}{marks[i % len(marks)]} b {x}{x}{marks[(i + 3) % len(marks)]}" for i, x in enumerate(letters)]
    odd = [*"İक़ড়ਲ਼ଡ଼གྷיִשׁéßẞΣ̧́aZ", *".,!'-()\n ", "Å", "\U0001f602"]
    texts += ["".join(rng.choice(odd, 30)) for _ in range(5000)]
    ids, sizes = encoder.batch(pa.array(texts))
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
