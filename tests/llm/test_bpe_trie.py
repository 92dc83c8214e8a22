from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, TOKENIZERS
from conftest_llm import HARD_TEXTS
from panelloom.llm import bpe_trie
from panelloom.llm.queries import QUERIES

PATH = f"{TOKENIZERS}/word_bpe_49k.json"
MORE = ["\U0001f602" * 40, "\U0001f1fa\U0001f1f8" * 20, "</w>a</w>", "a</w", "<|endoftext|><|endoftext|>", "<|END", "x<|startoftext|>y", "Σς'S'LL", "!" * 100]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def same(library, texts):
    encoder = bpe_trie.TrieEncoder.of(PATH)
    ids, sizes = encoder.batch(pa.array(texts, pa.string()))
    got = np.split(ids, np.cumsum(sizes)[:-1])
    want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for text, mine, ours in zip(texts, got, want):
        assert mine.tolist() == ours, text
        assert encoder.spell(ours) == library.decode(ours, skip_special_tokens=False)


def test_hard_texts(library):
    same(library, HARD_TEXTS + MORE)


@pytest.mark.parametrize("letters", ["ab", "aeotnhisr", "abcdefghijklmnopqrstuvwxyzAEIOU'0123456789.,!</w>|éİΣß中あ\U0001f602\U0001f1fa\u0301\u093c \t"])
def test_random_texts(library, letters):
    rng = random.Random(1)
    same(library, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 70))) for _ in range(4000)])


def test_all_letters_before_a_mark(library):
    same(library, [chr(i) + "." for i in [*range(0x20, 0xD800), *range(0xE000, 0x20000)]])


def test_runs_of_one_letter(library):
    same(library, [x * n for x in ("a", "ha", "!", "1", "é") for n in range(1, 150)])


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe_trie, "KNOWN_CHUNKS", 1)
    monkeypatch.setattr(bpe_trie, "KNOWN_WORDS", 1)
    monkeypatch.setattr(bpe_trie, "KNOWN_PAIRS", 2)
    same(library, ["some words and other words", "other words still", *HARD_TEXTS])


def test_shared_prefixes_are_worked_out_once(monkeypatch):
    encoder = bpe_trie.TrieEncoder(PATH)
    grown = []
    descend = encoder._descend
    monkeypatch.setattr(encoder, "_descend", lambda word, shared, *rest: grown.extend(word[:d] for d in range(shared + 1, len(word))) or descend(word, shared, *rest))
    stem = "interna"
    encoder.words([stem + x for x in ("lly", "l", "lize", "tional")])
    # prefixes of 1 to 7 letters, then l, ll, li, liz | t, ti, tio, tion, tiona: each of them once
    assert len(grown) == len(set(grown)) == 7 + 4 + 5


def test_one_very_long_word(library):
    rng = random.Random(2)
    same(library, ["".join(rng.choice("abcdefgh") for _ in range(300_000)), "word " * 400_000])


def test_operators(spark, library, docs_of):
    texts = HARD_TEXTS + MORE
    docs = docs_of([*enumerate(texts), (None, "no id"), (3, "same id"), (3, "same id")])
    rows = bpe_trie.encode(docs, PATH).collect()
    assert len(rows) == len(texts) + 3 and sum(r.doc_id == 3 for r in rows) == 3 and sum(r.doc_id is None for r in rows) == 1
    by_id = {r.doc_id: r.ids for r in rows}
    assert all(by_id[i] == library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts) if i != 3)
    back = {r.doc_id: r.text for r in bpe_trie.decode(bpe_trie.encode(docs, PATH), PATH).collect()}
    assert all(back[i] == library.decode(by_id[i], skip_special_tokens=False) for i in range(len(texts)) if i != 3)
    odd = spark.createDataFrame([(1, None, "x"), (2, [], "x"), (3, [320, 999999, 49407], "x")], "doc_id long, ids array<int>, text string")
    assert {r.doc_id: r.text for r in bpe_trie.decode(odd, PATH).collect()} == {1: "", 2: "", 3: library.decode([320, 49407], skip_special_tokens=False)}


def test_empty_table(docs_of):
    assert bpe_trie.round_trip(docs_of([]), PATH).collect() == []


def test_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, QUERIES["op13_bpe_trie"](spark, SF).collect())) == sorted(want)
