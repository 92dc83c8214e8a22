"""Personal data by rules and a skip-chain conditional random field.

Rules (fixed, leftmost and without overlap for each kind) find e-mail addresses, IP addresses, card and phone numbers; their
finds always stay.  Other numbers and written-out addresses of a document are candidates.  Finds and candidates are the
variables of a conditional random field over one document:

* own potentials: a multinomial logistic model of a number's shape and of the word before it;
* chain potentials between neighbours in the text;
* skip potentials between distant mentions of the same or a similar thing (equal digits, equal last eight of 9 to 15 digits, equal
  address).  The mentions of one thing share a hub variable, so edges grow with mentions, not with their pairs.

The model is fitted to the rules' finds in at most ``SAMPLE`` documents (those with the least hashes of their ids among
documents with a digit or an at sign).  Loopy message passing over all documents of a batch at once gives each candidate's
label; one that is likely enough is added as a span.  So a card number or phone number that a rule misses in one
place is found where the document has it in a form the rule knows.

Offsets count code points.  Null text is empty and has no spans.  Rows with a null ``doc_id`` and repeated rows are treated
like any other.  An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace, least_hashed
from .tokens import slices

KINDS = ("email", "ip", "card", "phone")
#: Most documents that the model is fitted to.
SAMPLE = 1000
#: Rounds of message passing, and the least probability of an added span.
ROUNDS, LIKELY = 12, 0.6
#: Most digits of a candidate.
MOST_DIGITS = 19
#: A candidate is nothing unless so much, in log odds, speaks for it.
CAUTION = 2.0
#: Words before a number that have a weight of their own.
CONTEXT = 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9])*+")
_SPELT = re.compile(
    r"([A-Za-z0-9][A-Za-z0-9._%+-]{0,63}) ?(?:\(at\)|\[at\]| at ) ?([A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63})+)"
)
_DOT = re.compile(r" ?(?:\(dot\)|\[dot\]| dot ) ?")
_WORD_BEFORE = re.compile(r"([^\W\d_]+)\W{0,3}$")


def luhn(digits: str) -> bool:
    double = "0246813579"
    return sum(int(double[int(d)]) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """What the rules find, in time linear in the text."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out["email"].append((start, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    ip_end = card_end = 0
    for run in _DIGITS.finditer(text):  # both begin where a run of digits begins
        start = run.start()
        if start >= ip_end and (found := _IP.match(text, start)):
            ip_end = found.end()
            if all(map(_small, found[0].split("."))):
                out["ip"].append((start, ip_end))
        if start >= card_end and (found := _CARD.match(text, start)):
            card_end = found.end()
            digits = found[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append((start, card_end))
    at = text.find("+")
    while at >= 0:
        found = _PHONE.match(text, at)
        if found and 9 <= sum(map(str.isdigit, found[0])) <= 15:
            out["phone"].append(found.span())
        at = text.find("+", found.end() if found else at + 1)
    return out


def _free(text: str, a: int, b: int) -> bool:
    """Whether no letter or digit touches the stretch."""
    return not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())


def mentions(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, int, str]]:
    """(start, end, label, key) of the variables, by start: label 1.. of a find, 0 of a candidate; the key is what it says."""
    out = []
    for label, kind in enumerate(KINDS, 1):
        for a, b in base[kind]:
            part = text[a:b]
            out.append((a, b, label, part.lower() if kind in ("email", "ip") else re.sub(r"[^0-9]", "", part)))
    taken = sorted((a, b) for a, b, _, _ in out)
    starts = [a for a, _ in taken]
    ends = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []

    def clear(a, b):
        from bisect import bisect_left

        k = bisect_left(starts, b)
        return k == 0 or ends[k - 1] <= a

    def add(a, b):
        digits = re.sub(r"[^0-9]", "", text[a:b])
        if 7 <= len(digits) <= MOST_DIGITS and _free(text, a, b) and clear(a, b):
            out.append((a, b, 0, digits))
            return True
        return False

    at = 0
    while found := _NUMBER.search(text, at):
        a, at = found.span()
        if at - a >= 7 and not add(a, at):  # else every run of groups that blanks part; MOST_DIGITS groups hold too many digits
            groups = [(a + g.start(), a + g.end(), sum(map(str.isdigit, g[0]))) for g in re.finditer(r"[^ ]+", text[a:at])]
            for i, (start, _, _) in enumerate(groups):
                digits = 0
                for _, end, more in groups[i : i + MOST_DIGITS]:
                    digits += more
                    if digits > MOST_DIGITS:
                        break
                    add(start, end)
    if "(at)" in text or "[at]" in text or " dot " in text:
        for found in _SPELT.finditer(text):
            if clear(*found.span()):
                key = f"{found[1]}@{_DOT.sub('.', found[2])}".lower()
                out.append((*found.span(), 0, key))
    return sorted(out)


def shape(text: str, a: int, b: int, key: str, words: dict[str, int]) -> list[int]:
    """Which features a mention has."""
    part = text[a:b]
    digits = len(key) if key.isdigit() else 0
    out = [min(digits, 20)]
    found = _WORD_BEFORE.search(text, max(0, a - 40), a)
    for k, yes in enumerate(
        (
            part[0] == "+" or (a and text[a - 1] == "+"), "(" in part or (a and text[a - 1] == "("), "-" in part, part.count(".") == 3, " " in part,
            digits > 12 and luhn(key), "@" in key, "@" in part,
        )
    ):
        if yes:
            out.append(21 + k)
    if found and (w := words.get(found[1].lower())) is not None:
        out.append(29 + w)
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def pass_messages(own: np.ndarray, left: np.ndarray, right: np.ndarray, potential: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Log marginals of all variables; edge e joins left[e] and right[e] with the table potential[e] (left, right)."""
    n, k = own.shape
    to_right, to_left = np.zeros((len(left), k)), np.zeros((len(left), k))
    belief = own
    for _ in range(rounds if len(left) else 0):
        new_right = _lse((belief[left] - to_left)[:, :, None] + potential, 1)
        new_left = _lse((belief[right] - to_right)[:, None, :] + potential, 2)
        to_right = 0.5 * to_right + 0.5 * (new_right - _lse(new_right, 1)[:, None])
        to_left = 0.5 * to_left + 0.5 * (new_left - _lse(new_left, 1)[:, None])
        belief = own.copy()
        np.add.at(belief, right, to_right)
        np.add.at(belief, left, to_left)
    return belief - _lse(belief, 1)[:, None]


class Field:
    """The fitted model."""

    def __init__(self, words, weights, chain, same):
        self.words, self.weights, self.chain, self.same = words, weights, chain, same

    def own(self, text, found) -> np.ndarray:
        out = np.zeros((len(found), len(KINDS) + 1))
        for i, (a, b, label, key) in enumerate(found):
            if label:  # a find is certain
                out[i] = -40
                out[i, label] = 0
            else:
                out[i] = self.weights[shape(text, a, b, key, self.words)].sum(axis=0) + self.weights[-1]
                out[i] -= _lse(out[i][None], 1)
                out[i, 0] += CAUTION
                possible = (False, "@" in key, False, 13 <= len(key) <= 19, 7 <= len(key) <= 15)  # an IP address is never a candidate
                out[i, [k for k in (1, 2, 3, 4) if not possible[k] or (k > 1 and "@" in key)]] = -40
        return out

    def added(self, texts: list[str], all_found: list) -> list[list[tuple[str, int, int]]]:
        """Spans that the field adds to each text."""
        out: list = [[] for _ in texts]
        k = len(KINDS) + 1
        own, left, right, tables, which = [], [], [], [], []
        n = 0
        same = np.eye(k) * self.same
        for t, found in enumerate(all_found):
            if not any(f[2] == 0 for f in found):
                continue
            own.append(self.own(texts[t], found))
            which += [(t, i) for i in range(len(found))]
            hubs: dict[str, list[int]] = {}
            for i, (_, _, _, key) in enumerate(found):
                # the end of a number stands for it where a country code may be left out
                for name in ["=" + key, "~" + key[-8:]] if key.isdigit() and 8 < len(key) <= 15 else ["=" + key]:
                    hubs.setdefault(name, []).append(n + i)
            left += range(n, n + len(found) - 1)
            right += range(n + 1, n + len(found))
            tables += [self.chain] * (len(found) - 1)
            n += len(found)
            for mine in hubs.values():
                if len(mine) > 1:
                    own.append(np.zeros((1, k)))
                    which.append(None)
                    left += mine
                    right += [n] * len(mine)
                    tables += [same] * len(mine)
                    n += 1
        if not own:
            return out
        logs = pass_messages(np.concatenate(own), np.array(left, np.int64), np.array(right, np.int64), np.array(tables).reshape(-1, k, k))
        best = logs.argmax(axis=1)
        likely: dict[int, list] = {}
        for i, place in enumerate(which):
            if place and best[i] and np.exp(logs[i, best[i]]) >= LIKELY:
                a, b, label, _ = all_found[place[0]][place[1]]
                if not label:
                    likely.setdefault(place[0], []).append((-round(float(logs[i, best[i]]), 9), a - b, a, b, KINDS[best[i] - 1]))
        for t, spans in likely.items():
            out[t] = _apart(spans)
        return out


def _apart(spans: list) -> list[tuple[str, int, int]]:
    """Of spans (unlikeliness, less its length, start, end, kind) that overlap, the likelier stays, then the longer, then the first."""
    from bisect import bisect_left

    taken: list[tuple[int, int, str]] = []
    for _, _, a, b, kind in sorted(spans):
        k = bisect_left(taken, (a,))
        if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b):
            taken.insert(k, (a, b, kind))
    return [(kind, a, b) for a, b, kind in taken]


def fit(texts: list[str], steps: int = 300) -> Field:
    """Own potentials by logistic regression on shape and context, chain and skip potentials by how often labels agree."""
    from collections import Counter

    found = [mentions(t, base_spans(t)) for t in texts]
    before: Counter = Counter()
    for t, f in zip(texts, found):
        for a, _, label, _ in f:
            if m := _WORD_BEFORE.search(t, max(0, a - 40), a):
                before[m[1].lower()] += 1
    words = {w: i for i, (w, n) in enumerate(sorted(before.items(), key=lambda x: (-x[1], x[0]))[:CONTEXT]) if n > 1}
    k, size = len(KINDS) + 1, 29 + CONTEXT + 1
    rows = [(shape(t, a, b, key, words), label) for t, f in zip(texts, found) for a, b, label, key in f]
    x, y = np.zeros((len(rows), size)), np.zeros((len(rows), k))
    for i, (features, label) in enumerate(rows):
        x[i, features] = 1
        x[i, -1] = 1
        y[i, label] = 1
    weights = np.zeros((size, k))
    for _ in range(steps if rows else 0):
        p = x @ weights
        p = np.exp(p - _lse(p, 1)[:, None])
        weights -= 0.5 * (x.T @ (p - y) / len(rows) + 0.003 * weights)
    pairs, agree, total = np.ones((k, k)), 1.0, 2.0
    for f in found:
        keys: dict[str, int] = {}
        for one, two in zip(f, f[1:]):
            pairs[one[2], two[2]] += 1
        for _, _, label, key in f:
            if label and key in keys:
                agree += keys[key] == label
                total += 1
            keys[key] = label or keys.get(key, 0)
    share = pairs / pairs.sum()
    chain = np.clip(np.log(share / np.outer(share.sum(axis=1), share.sum(axis=0))), -1, 1)
    rate = np.clip(agree / total, 0.5, 0.999)
    return Field(words, weights, chain, max(4.0, float(np.log(rate * (k - 1) / (1 - rate)))))


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    text = F.col("text").cast("string")
    held = docs.select("doc_id", text.alias("text")).where(text.rlike("[0-9@]"))
    held = least_hashed(held, ["doc_id", "text"], sample, Workspace(docs.sparkSession, "pii-model"))
    return fit([r[0] for r in held.select("text").collect()])


def _analyse(field: Field, text_at: int, names: list[str], redact: bool):
    def run(batches):
        import hashlib

        import pyarrow as pa


        order = {k: i for i, k in enumerate(KINDS)}

        def written(spans):
            return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))

        for batch in batches:
            for lo, hi in slices(batch.column(text_at)):
                some = batch.slice(lo, hi - lo)
                texts = [t or "" for t in some.column(text_at).to_pylist()]
                bases = [base_spans(t) for t in texts]
                added = field.added(texts, [mentions(t, b) for t, b in zip(texts, bases)])
                all_base = [[(k, a, b) for k in KINDS for a, b in base[k]] for base in bases]
                if redact:
                    clean = [redacted(t, b + x) if b or x else t for t, b, x in zip(texts, all_base, added)]
                    columns = [pa.array(clean, pa.string()) if k == text_at else c for k, c in enumerate(some.columns)]
                else:
                    columns = [some.column(0), *(pa.array([len(b[k]) for b in bases], pa.int64()) for k in KINDS)]
                    base_text = [hashlib.sha256(written(b).encode()).hexdigest() for b in all_base]
                    columns += [pa.array(base_text), pa.array([written(b + x) for b, x in zip(all_base, added)], pa.string())]
                    columns.append(pa.array([len(x) for x in added], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans replaced by their kind; where spans overlap, the first (then the longest) names the stretch."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (rules' finds), base_sha256, spans (all), n_added."""
    field = field or train(docs)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_analyse(field, 1, names, False), schema)


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """All rows and columns; in ``text`` every span is replaced by its kind, and ``n_chars`` counts anew.  Null stays empty."""
    field = field or train(docs)
    clean = docs.mapInArrow(_analyse(field, docs.columns.index("text"), docs.columns, True), docs.schema)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean
