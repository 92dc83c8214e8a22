"""Byte-pair encoding by depth-first walks over the trie of distinct words, and decoding.

The encoding of a word's prefix is the encoding of a shorter prefix and one more token, so a prefix needs to remember no more
than its **last token**.  The last token of a prefix is the one vocabulary entry that ends it, whose remaining prefix has a last
token that it can stand beside: merging the two never joins anything across the border.

1. Texts are cut at ASCII white space.  The distinct chunks of a batch are cut into words by the vocabulary's own rules.
2. The distinct words that are new form a trie, kept as the sorted array of its words: in that order its nodes (the distinct
   prefixes) are visited depth first.  The path from the root holds the last token of every prefix; a word starts where it
   leaves the path of the word before it, so a shared prefix is worked out once.
3. A word's last letter carries the end-of-word sign and is a symbol of its own, below the trie's inner nodes.  Reading
   last tokens backwards from there gives the word's ids.
4. Ids of chunks are laid out by numpy.

Decoding looks up each id's entry; entries are parted by a blank, since the vocabulary has no decoder of its own.  Ids that the
vocabulary doesn't hold are left out, as the tokenizers library does.

Null text is empty and has no ids; null ids decode to an empty text.  Texts are whole however long they are: time is linear, and a
word of n letters takes n small numbers.  A null ``doc_id`` and repeated rows are rows like any other; an empty table gives
none.  Columns other than ``doc_id`` and ``text`` (for decoding ``doc_id`` and ``ids``) are not looked at.
"""

from __future__ import annotations

import itertools
import json
import re
import sys
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import BYTE_LETTERS, ragged, slices, words_of

#: Most chunks, words and pairs of tokens remembered by a Python worker; beyond it all are forgotten and worked out again.
KNOWN_CHUNKS, KNOWN_WORDS, KNOWN_PAIRS = 300_000, 300_000, 1_000_000
#: Characters of text handled at once.
SLICE_CHARS = 4_000_000

#: Fixed values of the vocabulary: its end-of-word sign, and how it cuts words, for printing ASCII in lower case.
END = "</w>"
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_PRINTING = re.compile(r"[!-~]+")


class TrieEncoder:
    """Exactly the ids ``Tokenizer.encode(text, add_special_tokens=False)`` gives, for vocabularies with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)  # its rules for normal forms and word borders
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        ids, merges = rules["model"]["vocab"], rules["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.names = {i: x for x, i in ids.items()}
        self.special = {x["content"]: x["id"] for x in rules["added_tokens"]}
        self.names |= {i: x for x, i in self.special.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        # tokens by their letters: inside a word, and at its end
        letters = [chr(c) for c in BYTE_LETTERS.values()]
        self.inside = {x: ids[x] for x in letters}
        self.ending = {x: ids[x + END] for x in letters}
        spelt = {i: x for table in (self.inside, self.ending) for x, i in table.items()}
        ends = set(self.ending.values())
        #: rank of the merge that forms a token, the tokens it joins, and the rank by pair
        self.rank, self.parts, self.pair = {}, {}, {}
        for rank, (a, b) in enumerate(merges):
            left, right, joined = ids[a], ids[b], ids[a + b]
            spelt[joined] = spelt[left] + spelt[right]
            (self.ending if right in ends else self.inside)[spelt[joined]] = joined
            if right in ends:
                ends.add(joined)
            self.rank[joined], self.parts[joined], self.pair[left, right] = rank, (left, right), rank
        self.length = {i: len(x) for i, x in spelt.items()}
        self._automaton()
        self.known: dict[str, tuple[int, ...]] = {}
        self.known_words: dict[str, tuple[int, ...]] = {}
        self.fitting: dict[int, bool] = {}

    def _automaton(self) -> None:
        """What a path ends in: its longest end that begins some token.  Moves, and the tokens that end there, are filled in when met."""
        begun = {x[:i] for x in self.inside for i in range(len(x) + 1)} | {x[:i] for x in self.ending for i in range(len(x))}
        self.begun = {x: i for i, x in enumerate(sorted(begun))}  # 0: nothing
        self.ends = list(self.begun)
        self.moves: list[dict[str, int]] = [{} for _ in self.ends]
        self.inside_at: list[tuple | None] = [None] * len(self.ends)
        self.ending_at: list[dict[str, tuple]] = [{} for _ in self.ends]

    def _move(self, state: int, letter: str) -> int:
        end = self.ends[state] + letter
        while end not in self.begun:
            end = end[1:]
        self.moves[state][letter] = to = self.begun[end]
        if self.inside_at[to] is None:
            self.inside_at[to] = self._tokens(end, self.inside)
        return to

    def _ending(self, state: int, letter: str) -> tuple:
        self.ending_at[state][letter] = found = self._tokens(self.ends[state] + letter, self.ending)
        return found

    @staticmethod
    def _tokens(end: str, tokens: dict[str, int]) -> tuple:
        """(letters, id) of the tokens that ``end`` ends in, longest first."""
        return tuple((len(end) - i, tokens[end[i:]]) for i in range(len(end)) if end[i:] in tokens)

    @staticmethod
    def of(path: str) -> TrieEncoder:
        """One for each Python worker."""
        kept = vars(sys).setdefault("_panelloom_trie_encoders", {})
        if path not in kept:
            kept[path] = TrieEncoder(path)
        return kept[path]

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' letters is just these tokens.

        Merging forms the tokens at both sides of the border step by step.  Going back in time, the tokens that touch the border
        are taken apart, the later one first; no pair of them may have been joined before either changed."""
        key = left << 32 | right
        fine, until = True, len(self.pair)  # rank before which the two tokens touch
        while True:
            if self.pair.get((left, right), until) < until:
                fine = False
                break
            formed_left, formed_right = self.rank.get(left, -1), self.rank.get(right, -1)
            if formed_left < 0 and formed_right < 0:
                break
            # of equal merges the left one comes first: it goes back last, and leaves no time for an equal one at the border
            if formed_left > formed_right:
                until, left = formed_left, self.parts[left][1]
            else:
                until, right = formed_right + 1, self.parts[right][0]
        if len(self.fitting) >= KNOWN_PAIRS:
            self.fitting.clear()
        self.fitting[key] = fine
        return fine

    def _token(self, depth: int, tokens: tuple, last: array) -> int:
        """Last token of a prefix of ``depth`` letters; ``tokens`` are those that end it, ``last[d]`` the last token of d letters."""
        fitting = self.fitting
        for letters, token in tokens:
            begin = depth - letters
            if not begin:
                return token
            fine = fitting.get(last[begin] << 32 | token)
            if fine or (fine is None and self.fits(last[begin], token)):
                return token
        raise ValueError("no token ends the word")  # single letters are tokens, so this is no vocabulary of merges

    def _descend(self, word: str, shared: int, last: array, states: array) -> None:
        """From the prefix of ``shared`` letters down to the word without its last letter."""
        state = states[shared]
        for depth in range(shared + 1, len(word)):
            letter = word[depth - 1]
            to = self.moves[state].get(letter)
            state = self._move(state, letter) if to is None else to
            last.append(self._token(depth, self.inside_at[state], last))
            states.append(state)

    def words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct words in byte letters, none of them empty: the trie of all of them, depth first."""
        out = {}
        last, states = array("I", [0]), array("I", [0])  # of every prefix on the path
        before = ""
        for word in sorted(words):
            size = len(word)
            shared, most = 0, min(size, len(before)) - 1
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            self._descend(word, shared, last, states)
            state = states[-1]
            tokens = self.ending_at[state].get(word[-1]) or self._ending(state, word[-1])
            token = self._token(size, tokens, last)
            ids, at = [token], size - self.length[token]
            while at:
                token = last[at]
                ids.append(token)
                at -= self.length[token]
            out[word] = tuple(reversed(ids))
            before = word
        return out

    def _cut(self, chunk: str) -> list[str | int]:
        """Words of a chunk in byte letters, and ids of special tokens."""
        if "<|" not in chunk:
            return self._cut_plain(chunk)
        out: list[str | int] = []
        at = 0
        for found in self.cut.finditer(chunk):
            out += [*self._cut_plain(chunk[at : found.start()]), self.special[found[0]]]
            at = found.end()
        return out + self._cut_plain(chunk[at:])

    def _cut_plain(self, chunk: str) -> list[str]:
        if _PRINTING.fullmatch(chunk):  # printing ASCII stands for itself
            return _ASCII_WORDS.findall(chunk.lower())
        chunk = self.library.normalizer.normalize_str(chunk)
        return [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk) if x]

    def chunks(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """Ids of chunks without ASCII white space."""
        for kept, most in ((self.known, KNOWN_CHUNKS), (self.known_words, KNOWN_WORDS)):
            if len(kept) > most:
                kept.clear()
        ids = self.known_words
        new = {x: self._cut(x) for x in chunks if x not in self.known}
        ids |= self.words(list({w for parts in new.values() for w in parts if isinstance(w, str) and w not in ids}))
        for x, parts in new.items():
            self.known[x] = ids[parts[0]] if len(parts) == 1 and isinstance(parts[0], str) else tuple(
                itertools.chain.from_iterable(ids[w] if isinstance(w, str) else (w,) for w in parts)
            )
        return [self.known[x] for x in chunks]

    def batch(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow column one after the other, and how many each text has."""
        codes, names, counts = words_of(texts, lower=False)
        held = self.chunks(names)
        lens = np.fromiter(map(len, held), np.int64, len(held))
        flat = np.fromiter(itertools.chain.from_iterable(held), np.int32, lens.sum())
        many = lens[codes] if len(codes) else np.zeros(0, np.int64)
        ids = flat[ragged((np.cumsum(lens) - lens)[codes], many)] if len(codes) else flat
        upto = np.concatenate([[0], np.cumsum(many)])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(upto[ends])

    def spell(self, ids) -> str:
        """What ``Tokenizer.decode(ids, skip_special_tokens=False)`` gives."""
        return " ".join(filter(None, map(self.names.get, ids)))


def _encoded(path: str, decode: bool):
    def run(batches):
        import pyarrow as pa

        encoder = TrieEncoder.of(path)
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE_CHARS):
                ids, sizes = encoder.batch(batch.column(1).slice(a, b - a))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]
                if decode:
                    columns.append(pa.array([encoder.spell(ids[i:j].tolist()) for i, j in zip(ends, ends[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids of every document; ``tokenizer``: path of a vocabulary file with word ends."""
    return _rows(docs).mapInArrow(_encoded(tokenizer, False), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows with ``ids``."""

    def run(batches):
        import pyarrow as pa

        encoder = TrieEncoder.of(tokenizer)
        for batch in batches:
            texts = pa.array([encoder.spell(x or ()) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and what they decode to, in one pass over the documents."""
    return _rows(docs).mapInArrow(_encoded(tokenizer, True), "doc_id long, ids array<int>, decoded string")
