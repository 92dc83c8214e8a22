"""Ids of public tokenizers for batches of texts, word by word with a bounded memory of known words."""

from __future__ import annotations

import itertools
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most words remembered by a Python worker; beyond it all are forgotten, and encoded again when they come back.
KNOWN_WORDS = 1_000_000
#: Words encoded by one call.
JOINED = 1000
#: ASCII punctuation and symbols but the apostrophe, which begins contractions.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters of text handled at once.
SLICE_CHARS = 8_000_000


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printing]
    return {b: b for b in printing} | {b: 256 + i for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def broken_letters() -> str:
    """Letters whose normal form in lower case (NFC) ends in a mark that is no letter; found once for each Python worker."""
    kept = vars(sys)  # a cached function would travel by its name alone
    if "_panelloom_broken_letters" not in kept:
        letters = (chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "L")
        broken = (x for x in letters if not unicodedata.category(unicodedata.normalize("NFC", x).lower()[-1]).startswith("L"))
        kept["_panelloom_broken_letters"] = "".join(broken)
    return kept["_panelloom_broken_letters"]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every stretch, one after the other."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


class WordEncoder:
    """Exactly the ids ``Tokenizer.encode_batch(texts, add_special_tokens=False)`` gives.

    ``prefix_space=False`` is for vocabularies that drop white space: any blank or line feed is then a
    boundary.  ``prefix_space=True`` is for byte-level ones, where one blank belongs to the word after it: texts in
    which white space stands beside white space are encoded whole, since runs of it may form tokens.  So are texts
    that may hold special tokens.
    """

    def __init__(self, path: str, prefix_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.prefix_space = prefix_space
        self.between = "<|endoftext|>"
        self.between_id = self.tokenizer.token_to_id(self.between)
        self._forget()

    @staticmethod
    def of(path: str, prefix_space: bool) -> WordEncoder:
        """One for each Python worker."""
        kept = vars(sys).setdefault("_panelloom_encoders", {})
        if (path, prefix_space) not in kept:
            kept[path, prefix_space] = WordEncoder(path, prefix_space)
        return kept[path, prefix_space]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _apart(self, words: list[str]) -> list[list[int]]:
        """Ids of each word.  A special token between words keeps them apart, so that one call does for many."""
        out = []
        for i in range(0, len(words), JOINED):
            text = self.between.join(words[i : i + JOINED])
            ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
            cuts = np.flatnonzero(ids == self.between_id)
            out += [x[x != self.between_id].tolist() for x in np.split(ids, cuts)]
        return out

    def _one_piece(self, word: str) -> bool:
        """Whether the vocabulary's own rules leave the word alone: letters only, already in its normal form."""
        if self.prefix_space:
            return (word[1:] if word[0] == " " else word).isalpha()
        return word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word)

    def _look_up(self, words: list[str]) -> np.ndarray:
        """Where the ids of each word stand in ``self.flat``."""
        known = self.known
        if len(known) > KNOWN_WORDS:
            self._forget()
            known = self.known
        places = np.fromiter((known.get(x, -1) for x in words), np.int64, len(words))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            new = [words[i] for i in missing]
            model, table = self.tokenizer.model, BYTE_LETTERS
            alone = [bool(x) and self._one_piece(x) for x in new]
            ids: list = [[t.id for t in model.tokenize(x.encode().decode("latin-1").translate(table))] if ok else None for x, ok in zip(new, alone)]
            rest = [i for i, ok in enumerate(alone) if not ok]
            for i, got in zip(rest, self._apart([new[i] for i in rest])):
                ids[i] = got
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            places[missing] = len(self.lens) + np.arange(len(new))
            known.update(zip(new, places[missing].tolist()))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, lens.sum())])
        return places

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.starts = self.lens = np.zeros(0, np.int64)

    def _places(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of every chunk stand: of its letters, and of the marks at its end (or -1).

        Marks after a letter stand apart from it in either vocabulary, so both are looked up on their own.  Where a vocabulary
        normalises first, letters that come apart don't count: what they end in joins the marks.
        """
        core = pc.utf8_rtrim(chunks, MARKS)
        sizes, whole = pc.binary_length(core).to_numpy(), pc.binary_length(chunks).to_numpy()
        letter = pc.match_substring_regex(core, r"\pL$").to_numpy(zero_copy_only=False)
        if not self.prefix_space:
            letter &= ~pc.match_substring_regex(core, f"[{broken_letters()}]$").to_numpy(zero_copy_only=False)
        apart = (sizes < whole) & letter
        core = pc.if_else(pa.array(apart), core, chunks)
        if not self.prefix_space:
            core = pc.ascii_lower(core)
        coded = pc.dictionary_encode(core)
        where = np.flatnonzero(apart)
        texts = chunks.take(pa.array(where)).to_pylist()
        marks = pc.dictionary_encode(pa.array([x[len(x.rstrip(MARKS)) :] for x in texts], pa.large_string()))
        names = coded.dictionary.to_pylist()
        places = self._look_up(names + marks.dictionary.to_pylist())
        tail = np.full(len(chunks), -1, np.int64)
        tail[where] = places[len(names) + marks.indices.to_numpy()]
        return places[coded.indices.to_numpy()], tail

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has.  Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        if self.prefix_space:
            beside = re.compile(r"\s\s")
            whole |= np.fromiter((beside.search(x) is not None for x in texts.to_pylist()), bool, len(texts))
        marked = pc.replace_substring(texts, "\n", " \n") if self.prefix_space else pc.replace_substring(texts, "\n", " ")
        if whole.any():
            marked = pc.if_else(pa.array(whole), "", marked)
        lists = pc.split_pattern(marked, " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(lists.flatten())
        codes, names = coded.indices.to_numpy(), coded.dictionary
        if self.prefix_space:
            first = np.cumsum(counts) - counts  # the first word of a text has no blank before it
            firsts = names.take(pa.array(codes[first]))
            codes = codes.astype(np.int64)
            codes[first] = len(names) + np.arange(len(first))
            fed = pc.starts_with(names, "\n")
            spaced = pc.binary_join_element_wise(pa.scalar(" ", names.type), names, pa.scalar("", names.type))
            names = pa.concat_arrays([pc.if_else(fed, names, spaced), firsts])
        head, tail = self._places(names)
        # the ids of each distinct chunk, one after the other, then of all chunks
        both = np.stack([head, tail], axis=1).ravel()
        lens = np.where(both >= 0, self.lens[both], 0)
        flat = self.flat[ragged(self.starts[both], lens)]
        lens = lens.reshape(-1, 2).sum(axis=1)
        at = np.cumsum(lens) - lens
        many = lens[codes]
        ids = flat[ragged(at[codes], many)]
        ends = np.concatenate([[0], np.cumsum(many)])
        upto = np.cumsum(counts)
        sizes = ends[upto] - ends[upto - counts]
        if whole.any():
            where = np.flatnonzero(whole)
            parts = self._whole([texts[int(i)].as_py() for i in where])
            cuts = np.split(ids, np.cumsum(sizes)[:-1])
            for i, part in zip(where, parts):
                cuts[i] = part
            ids, sizes = np.concatenate(cuts), np.array([len(x) for x in cuts], dtype=np.int64)
        return ids, sizes


def slices(texts: pa.Array, chars: int = SLICE_CHARS):
    """(from, to) of stretches of rows with about so much text; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > chars:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def bytes_of(column) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of a column of texts, end to end, and where each ends.  Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return b"".join(x.as_buffer() for x in column), np.cumsum(sizes)


_SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))
_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in _SPACES)


def words_of(column, lower: bool = True) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words between ASCII white space, A-Z lower-cased if asked: their codes, what the codes mean, words per text."""
    data, ends = bytes_of(column)
    data = data.translate(_LOWERED if lower else _SPACES)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    lists = pc.split_pattern(texts, " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    if "" in names:
        there = codes != names.index("")
        upto = np.concatenate([[0], np.cumsum(there)])
        codes, counts = codes[there], np.diff(upto[np.concatenate([[0], np.cumsum(counts)])])
    return codes, names, counts
