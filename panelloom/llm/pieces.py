"""Encoding into SentencePiece vocabularies by batched Viterbi, and decoding.

A text gets a blank in front, blanks become U+2581, and it is cut into units: a run of U+2581 and what follows up to the
next.  No piece reaches from one unit into the next (pieces hold U+2581 at the front, or nothing else).  Units that are
new to a worker are encoded together by length: all units of one length advance a character at a time.  Hashes of the
substrings that end there, taken from prefix hashes, are looked up in the sorted keys of all pieces; the best sum of
scores, and the piece that reaches it, are array maxima.  Ties go to the longer piece.  A character without a piece costs
more than any piece and becomes the pieces of its UTF-8 bytes (or the unknown piece, where there are none).

Scores are the vocabulary file's own, whatever its kind: the encoding is the one of greatest total score.

Null counts as empty, which has no pieces.  U+2581 in a text can't be told from a blank and decodes as one.  Repeated rows
and null ids are rows like any other.  An empty table gives no rows.
"""

from __future__ import annotations

import re
import sys

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ragged, slices

BLANK = "▁"
#: Most units that a worker remembers; beyond it all are forgotten.
KNOWN_UNITS = 600_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNIT = re.compile(f"{BLANK}+[^{BLANK}]*")


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Of equally long rows of code points: column j hashes the first j."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    letters = _scrambled(codes.astype(np.uint64) + np.uint64(1))
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _FACTOR + letters[:, j]
    return out


class Pieces:
    """A vocabulary and its batched encoder."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        kinds = [(model.is_byte(i), model.is_unknown(i), model.is_control(i), model.is_unused(i)) for i in range(size)]
        names = [model.id_to_piece(i) for i in range(size)]
        self.unknown = model.unk_id()
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if kinds[i][0]}
        plain = [i for i in range(size) if not any(kinds[i])]
        if any(BLANK in names[i].lstrip(BLANK) for i in plain):
            raise ValueError("pieces with a blank inside or at the end aren't supported")
        self.names = {i: names[i] for i in plain}
        # what an id decodes to
        self.raw = [names[i].replace(BLANK, " ").encode() for i in range(size)]
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])
        for i, kind in enumerate(kinds):
            if kind[2]:
                self.raw[i] = b""
            elif kind[1]:
                self.raw[i] = " ⁇ ".encode()
        lengths = np.array([len(names[i]) for i in plain])
        self.longest = int(lengths.max())
        keys = np.zeros(len(plain), np.uint64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            keys[at] = _prefix_hashes(self._codes([names[plain[i]] for i in at], int(n)))[:, -1] + np.uint64(n)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        scores = np.array([model.get_score(i) for i in plain], np.float64)
        self.scores, self.unknown_score = scores[order], float(scores.min() - 10)
        self.known: dict[str, np.ndarray] = {}

    @staticmethod
    def of(path: str) -> Pieces:
        """One for each Python worker."""
        kept = vars(sys).setdefault("_panelloom_pieces", {})
        if path not in kept:
            kept[path] = Pieces(path)
        return kept[path]

    @staticmethod
    def _codes(units: list[str], n: int) -> np.ndarray:
        return np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(units), n)

    def _paths(self, units: list[str], n: int) -> list[np.ndarray]:
        """Ids of units of n characters; -1 - code point stands for a character without a piece."""
        codes = self._codes(units, n)
        hashes = _prefix_hashes(codes)
        rows = np.arange(len(units))
        best = np.full((len(units), n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((len(units), n + 1), np.int64)
        piece = np.zeros((len(units), n + 1), np.int64)
        power = np.cumprod(np.full(self.longest + 1, _FACTOR, np.uint64)) * np.uint64(pow(int(_FACTOR), -1, 1 << 64))
        for end in range(1, n + 1):
            starts = np.arange(max(0, end - self.longest), end)  # the longest piece first
            keys = hashes[:, end, None] - hashes[:, starts] * power[end - starts] + (end - starts).astype(np.uint64)
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            gain = np.where(hit, self.scores[at], -np.inf)
            gain[:, -1] = np.where(hit[:, -1], gain[:, -1], self.unknown_score)
            total = best[:, starts] + gain
            k = total.argmax(axis=1)
            best[:, end], back[:, end] = total[rows, k], starts[k]
            piece[:, end] = np.where(hit[rows, k], self.ids[at[rows, k]], -1 - codes[:, end - 1].astype(np.int64))
        out = np.zeros((len(units), n), np.int64)
        used, where = np.zeros(len(units), np.int64), np.full(len(units), n)
        while (on := np.flatnonzero(where > 0)).size:
            out[on, n - 1 - used[on]] = piece[on, where[on]]
            used[on] += 1
            where[on] = back[on, where[on]]
        return [out[i, n - m :] for i, m in enumerate(used)]

    def _finished(self, unit: str, path: np.ndarray) -> np.ndarray:
        """With bytes for characters without a piece; the pieces must spell the unit."""
        ids: list[int] = []
        spelt = []
        for p in path.tolist():
            if p >= 0:
                ids.append(p)
                spelt.append(self.names[p])
                continue
            spelt.append(chr(-1 - p))
            data = chr(-1 - p).encode("utf-8", "surrogatepass")
            ids += [self.bytes[b] for b in data] if self.bytes else [self.unknown]
        if "".join(spelt) != unit:
            raise ValueError("a substring shares the hash of a piece")
        return np.array(ids, np.int32)

    def units(self, units: list[str]) -> list[np.ndarray]:
        if len(self.known) > KNOWN_UNITS:
            self.known.clear()
        known = self.known
        new: dict[int, list[str]] = {}
        for u in units:
            if u not in known:
                new.setdefault(len(u), []).append(u)
        fresh = {}
        for n, some in new.items():
            step = max(1, 2_000_000 // (n * max(n, self.longest)))
            for i in range(0, len(some), step):
                part = some[i : i + step]
                fresh.update(zip(part, map(self._finished, part, self._paths(part, n))))
        known.update((u, ids) for u, ids in fresh.items() if len(u) < 64)
        return [known[u] if u in known else fresh[u] for u in units]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""

        index: dict[str, int] = {}
        codes, counts = [], []
        for t in texts:
            mine = _UNIT.findall((" " + t).replace(" ", BLANK)) if t else []
            codes += [index.setdefault(u, len(index)) for u in mine]
            counts.append(len(mine))
        table = self.units(list(index))
        lens = np.fromiter(map(len, table), np.int64, len(table))
        flat = np.concatenate([*table, np.zeros(0, np.int32)])
        codes = np.array(codes, np.int64)
        many = lens[codes]
        ids = flat[ragged((np.cumsum(lens) - lens)[codes], many)]
        ends = np.concatenate([[0], np.cumsum(many)])
        upto = np.cumsum(np.array(counts, np.int64))
        return ids, ends[upto] - ends[upto - np.array(counts, np.int64)]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, text (null as empty), ids."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc


        pieces = Pieces.of(model)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                texts = pc.fill_null(batch.column(1).slice(a, b - a), "")
                ids, sizes = pieces.encode(texts.to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), texts, lists], names=["doc_id", "text", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """All columns of ``encode`` (text may be left out), and ``decoded``.  Null ids decode as empty."""
    from pyspark.sql.types import StringType, StructField, StructType

    place = encoded.columns.index("ids")
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])

    def run(batches):
        import pyarrow as pa

        pieces = Pieces.of(model)
        for batch in batches:
            texts = pa.array([pieces.decode(x.values.to_numpy().tolist()) if x.is_valid else "" for x in batch.column(place)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=schema.names)

    return encoded.mapInArrow(run, schema)


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), n_chars, round_trip
    (whether the decoded text is the text)."""

    def run(batches):
        from zlib import crc32

        import pyarrow as pa


        pieces = Pieces.of(model)
        for batch in batches:
            for a, b in slices(batch.column(1), 2_000_000):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                ids, sizes = pieces.encode(texts)
                ids = np.split(ids, np.cumsum(sizes)[:-1])
                same = [pieces.decode(x.tolist()) == t.replace(BLANK, " ") for x, t in zip(ids, texts)]
                numbers = sizes, [crc32(x.astype("<u4").tobytes()) for x in ids], list(map(len, texts))
                columns = [batch.column(0).slice(a, b - a), *(pa.array(x, pa.int64()) for x in numbers), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "ids_crc32", "n_chars", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, n_chars long, round_trip boolean")
