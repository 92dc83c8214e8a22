from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
from conftest_llm import HARD_TEXTS
from hypothesis import given, settings
from hypothesis import strategies as st
from panelloom.llm import pii
from panelloom.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The rules, word for word."""
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def luhn(d):
        total = 0
        for i, c in enumerate(d[::-1]):
            v = int(c) * (1 + i % 2)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15],
    }


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab1250@.+-() \n_é", max_size=40))
def test_rules_on_any_text(text):
    assert pii.base_spans(text) == plain(text)


def test_rules_on_numbers():
    rng = np.random.default_rng(0)
    for _ in range(3000):
        text = "".join(rng.choice(list("0123456789 -.+("), 60, p=[0.08] * 10 + [0.06, 0.04, 0.06, 0.02, 0.02]))
        assert pii.base_spans(text) == plain(text)


def test_rules_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000, "a.b@c" * 60_000):
        found = pii.base_spans(text)
        pii.mentions(text, found)


FIELD = pii.fit([f"call +1 (555) 555-{i:04d} or pay 4111 1111 1111 1111 from 10.0.0.{i % 256} to a{i}@b.org thanks {i}" for i in range(1000, 1400)])


def added(text):
    return [(k, text[a:b]) for k, a, b in FIELD.added([text], [pii.mentions(text, pii.base_spans(text))])[0]]


def test_mentions_agree_within_a_document():
    assert added("ring +1 (555) 867-5309 tonight. Again: 555 867 5309 or 15558675309, not 7654321.") == [("phone", "555 867 5309"), ("phone", "15558675309")]
    assert added("mail jo.doe@mail.example.com; that is jo.doe (at) mail dot example dot com") == [("email", "jo.doe (at) mail dot example dot com")]
    assert added("card 4111 1111 1111 1111 and 4111111111111111 5500005555555559 in a row") [:1] == [("card", "4111111111111111")]


def test_grouped_numbers_beside_others():
    """Every run of successive groups is a candidate where the whole run has too many digits."""
    text = "card 4111111111111111 seen as 4111 1111 1111 1111 2024 05 17"
    assert added(text) == [("card", "4111 1111 1111 1111")]
    keys = {k for _, _, label, k in pii.mentions(text, pii.base_spans(text)) if not label}
    assert {"4111111111111111", "1111111111112024", "11112024"} <= keys
    assert added("call +1 (555) 867-5309 or 1 555 867 5309 555 867 5309 20") [:1] == [("phone", "1 555 867 5309")]
    many = " ".join(["12"] * 20_000)
    assert len(pii.mentions(many, pii.base_spans(many))) < 20 * 20_000


def test_clean_documents_stay_clean():
    for text in ("order 123456789 of 1234567890123", "token 99168226c4d3cee7e953ef", "in 2020 there were 1234567 people at home dot", ""):
        assert added(text) == []


def test_messages_are_exact_on_a_tree_and_settle_on_a_loop():
    rng = np.random.default_rng(0)
    k = 3

    def brute(own, edges, tables):
        logs = np.full((len(own), k), -np.inf)
        for ys in itertools.product(range(k), repeat=len(own)):
            s = sum(own[i, y] for i, y in enumerate(ys)) + sum(t[ys[a], ys[b]] for (a, b), t in zip(edges, tables))
            for i, y in enumerate(ys):
                logs[i, y] = np.logaddexp(logs[i, y], s)
        return logs - np.log(np.exp(logs).sum(axis=1))[:, None]

    own = rng.normal(size=(5, k))
    for edges, close in (([(0, 1), (1, 2), (1, 3), (4, 3)], 1e-6), ([(0, 1), (1, 2), (2, 0), (3, 4)], 0.25)):
        tables = rng.normal(size=(len(edges), k, k)) * 0.7
        left, right = np.array(edges).T
        assert np.abs(pii.pass_messages(own, left, right, tables, 60) - brute(own, edges, tables)).max() < close


def check(rows, docs):
    want = {}
    for d, t in docs:
        found = plain(t or "")
        base = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in found[k])
        want.setdefault(d, []).append((*(len(found[k]) for k in pii.KINDS), hashlib.sha256(base.encode()).hexdigest(), set(base.split(",")) - {""}))
    assert len(rows) == len(docs)
    for r in rows:
        spans = [s for s in r.spans.split(",") if s]
        assert any(tuple(r[1:6]) == w[:5] and w[5] <= set(spans) and len(spans) == len(w[5]) + r.n_added for w in want[r.doc_id])
        keys = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert keys == sorted(keys)


def test_hard_rows(docs_of):
    docs = [(i, t) for i, t in enumerate(HARD_TEXTS)]
    docs += [(100, "é a@b.cd 4111 1111 1111 1111"), (100, "é a@b.cd 4111 1111 1111 1111"), (None, "+1 (555) 867-5309 x 555 867 5309")]
    check(pii.find(docs_of(docs)).collect(), docs)
    clean = pii.redact(docs_of(docs))
    assert clean.columns == docs_of(docs).columns
    texts = {r.doc_id: r for r in clean.collect()}
    assert texts[100].text == "é <EMAIL> <CARD>" and texts[100].n_chars == 16 and texts[0].text == ""
    assert pii.find(docs_of([])).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op9_pii"](spark, sf).collect(), docs)
