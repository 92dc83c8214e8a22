from __future__ import annotations

from zlib import crc32

import numpy as np
import pytest
from conftest_llm import HARD_TEXTS
from panelloom.llm.pieces import BLANK, Pieces, decode, encode
from panelloom.llm.queries import QUERIES, vocabulary

MODEL = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return Pieces.of(MODEL)


def brute_force(pieces, text):
    """One text, one character at a time, from a dictionary of pieces."""
    table = {pieces.names[i]: (s, i) for i, s in zip(pieces.ids.tolist(), pieces.scores.tolist())}
    text = (" " + text).replace(" ", BLANK)
    best, back = [0.0] + [None] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - pieces.longest), end):
            score, i = table.get(text[start:end], (None, None))
            if score is None:
                if start < end - 1:
                    continue
                score = pieces.unknown_score
            if best[end] is None or best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, (start, i)
    ids, end = [], len(text)
    while end:
        start, i = back[end]
        ids = ([i] if i is not None else [pieces.bytes[b] for b in text[start:end].encode()]) + ids
        end = start
    return ids


def encoded(pieces, texts):
    ids, sizes = pieces.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_hard_texts(pieces):
    texts = [t for t in HARD_TEXTS if t] + ["  two", "a   b    c", f"x{BLANK}y", "☃中\x07", "zz" * 40]
    assert encoded(pieces, texts) == [brute_force(pieces, t) for t in texts]
    assert encoded(pieces, [None, ""]) == [[], []]
    for t in texts:
        assert pieces.decode(encoded(pieces, [t])[0]) == t.replace(BLANK, " ")


def test_units_equal_the_library_run_over_the_same_scores(spark, pieces):
    """The library's lattice search for the greatest total score, on the same pieces (its faster search isn't exact).  Where
    two paths tie, the totals must be equal."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    words = sorted({w for t in texts for w in t.split() if w})
    got = encoded(pieces, words)
    assert len(words) > 5000
    score = dict(zip(pieces.ids.tolist(), pieces.scores.tolist()))
    differ = 0
    for mine, word in zip(got, words):
        theirs = library.nbest_encode_as_ids(word, 2)[0]
        if mine != theirs and all(i in score for i in mine):
            assert sum(score[i] for i in mine) == sum(score[i] for i in theirs), word
            differ += 1
    assert differ < 0.005 * len(words)
    assert [pieces.decode(x) for x in got] == words


def test_frames(spark, docs_of):
    docs = [(i, t) for i, t in enumerate(HARD_TEXTS)] + [(None, "x"), (3, "again"), (3, "again")]
    rows = decode(encode(docs_of(docs), MODEL), MODEL).collect()
    assert sorted((repr(r.doc_id), r.decoded) for r in rows) == sorted((repr(i), t or "") for i, t in docs)
    assert encode(docs_of([]), MODEL).collect() == []


def test_query(spark, pieces):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in QUERIES["op4_pieces"](spark, sf).collect()}
    assert len(rows) == len(docs) and all(r.round_trip for r in rows.values())
    for d in docs[:40]:
        ids = np.array(brute_force(pieces, d.text), "<u4")
        assert (rows[d.doc_id].n_pieces, rows[d.doc_id].ids_crc32) == (len(ids), crc32(ids.tobytes()))
