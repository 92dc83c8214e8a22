from __future__ import annotations

from zlib import crc32

import numpy as np
import pytest
from conftest_llm import HARD_TEXTS
from panelloom.llm import token_store as ts
from panelloom.llm.queries import QUERIES, vocabulary

BYTES = vocabulary("byte_bpe_50k.json")


def expected(docs):
    from tokenizers import Tokenizer

    out, start = [], 0
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    for (doc, _), e in zip(docs, Tokenizer.from_file(BYTES).encode_batch([t or "" for _, t in docs], add_special_tokens=False)):
        ids = np.array(e.ids + [2], "<u4")
        out.append((doc, start, len(ids), crc32(ids.tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[1])


def test_hard_rows(spark, docs_of):
    docs = [(i * 3, t) for i, t in enumerate(HARD_TEXTS)] + [(None, "no id"), (500, "twice the same"), (500, "twice the same")]
    assert got(ts.read(spark, ts.write(docs_of(docs), BYTES))) == expected(docs)


def test_empty(spark, docs_of):
    assert got(ts.read(spark, ts.write(docs_of([]), BYTES))) == []
    assert got(ts.read(spark, ts.write(docs_of([(1, None)]), BYTES))) == [(1, 0, 1, crc32(np.array([2], "<u4").tobytes()))]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op3_token_store"](spark, sf)) == expected(docs)


@pytest.mark.parametrize("n,longest", [(1, 4), (2, 4), (16, 4), (300, 9), (300, 12), (5000, 18)])
def test_code_is_prefix_free_limited_and_round_trips(n, longest):
    rng = np.random.default_rng(n)
    counts = np.concatenate([[0], (1.3 ** rng.integers(0, 60, n)).astype(np.int64), [0]])
    lengths = ts.code_lengths(counts, longest)
    used = lengths[lengths > 0].astype(int)
    assert len(used) == n and used.max() <= longest and (2.0 ** -used).sum() <= 1
    _, codes = ts.canonical(lengths)
    words = {format(codes[i], f"0{lengths[i]}b") for i in np.flatnonzero(lengths)}
    assert len(words) == n and not any(a != b and b.startswith(a) for a in list(words)[:200] for b in words)
    ids = rng.choice(np.flatnonzero(counts), 3001)
    bits, checkpoints = ts.encode_bits(ids, codes, lengths, 64)
    assert len(bits) == -(-int(lengths[ids].astype(int).sum()) // 8)
    assert (ts.Decoder(lengths).bits(bits, checkpoints, len(ids), 64) == ids).all()


def test_lengths_are_optimal_where_the_limit_does_not_bind():
    import heapq

    counts = np.random.default_rng(0).integers(1, 1000, 200)
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    best = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        best += a
        heapq.heappush(heap, a)
    assert int((ts.code_lengths(counts, 30).astype(int) * counts).sum()) == best


def test_blocks_decode_alone():
    lengths = ts.code_lengths(np.array([5, 9, 1, 30]))
    _, codes = ts.canonical(lengths)
    texts = [np.array([3, 3, 0]), np.array([1]), np.array([2, 3] * 700)]
    block = ts.write_block([7, None, 9], texts, 11, codes, lengths)
    keys, sizes, ids, start = ts.read_block(block, ts.Decoder(lengths))
    assert keys == [7, None, 9] and sizes.tolist() == [3, 1, 1400] and start == 11
    assert (ids == np.concatenate(texts)).all()
    with pytest.raises(ValueError):
        ts.read_block(b"xxxx" + block[4:], ts.Decoder(lengths))
