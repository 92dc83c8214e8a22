from __future__ import annotations

import gzip
import hashlib
import html
import pathlib

import duckdb
from compare import difference, duck
from panelloom.llm import warc
from panelloom.llm.queries import ORACLES, QUERIES

PAGE = """<!DOCTYPE html><html lang='en'><head><meta charset="utf-8"><title>A &amp; B
 &lt;x&gt;</title><style>p{}</style></head><body><!-- no <p> --><nav><a class="c" href="/a?b=1&amp;c=2">one</a></nav>
<script>var t="</p>";</script><p>First   &quot;line&quot;<br/>second <b>bo</b>ld</p><pre>x</pre> 1 < 2 &copy; &amp;lt; é</body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, block string, title int")


def test_one_page(spark):
    found = warc.responses(pages(spark, [(1, "http://a/", PAGE)]))
    source = found.first()
    meta, text = sorted(warc.derive(found).collect(), key=lambda r: r.warc_type, reverse=True)
    assert text.block == 'one\nFirst "line"\nsecond bold\nx\n1 < 2 © &lt; é'
    assert meta.refers_to == text.refers_to == source.response_id != meta.record_id != text.record_id
    body = PAGE.encode()
    lines = meta.block.split("\r\n")
    assert lines[:2] == [
        "source-block-digest: sha256:" + hashlib.sha256((source.http_headers + "\r\n\r\n").encode() + body).hexdigest(),
        "source-payload-digest: sha256:" + hashlib.sha256(body).hexdigest(),
    ]
    assert lines[2:] == [
        "source-header: HTTP/1.1 200 OK", "source-header: Content-Type: text/html; charset=UTF-8",
        f"source-header: Content-Length: {len(body)}", "title: A & B <x>", "language: en", "outlink: /a?b=1&c=2", "",
    ]
    for r in (meta, text):
        assert r.content_length == len(r.block.encode()) and r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()


def test_hard_rows(spark):
    rows = [(1, None, "x"), (2, "http://b/", None), (None, None, None), (3, "u", ""), (3, "u", ""), (4, "v", "<p>" * 20000 + "a" * 50000)]
    out = warc.derive(warc.responses(pages(spark, rows))).collect()
    assert len(out) == 2 * len(rows) and all(r.record_id and r.block is not None for r in out)
    assert len({r.record_id for r in out}) == 2 * (len(rows) - 1)
    assert warc.derive(warc.responses(pages(spark, []))).collect() == []


NUMBERED = (
    "&#233;|&#xE9;|&#XE9;|&#0233;|&#39;|&#38;|&#38;lt;|&#38;amp;|&amp;#233;|&amp;amp;#38;|&#x26;#233;|&#128;x|&#150;|&#x9f;|"
    "&#65279;x|&#x1F600;|&#0;|&#xD800;|&#x110000;|&#9999999;|&lt;&#60;&#x3C;|&#;|&#x;|&# 1;|&#x26;|a&#98;c&#100;|&#66;&#67;"
)


def test_numeric_entities(spark, tmp_path):
    """As the standard library takes them (it also knows more names and references without a semicolon)."""
    cases = NUMBERED.split("|")
    rows = [(i, "u", f"<head><title>{x}</title></head><a href=\"{x}\">y{x}</a>") for i, x in enumerate(cases)]
    whole = (len(rows), "u", "<p>" + NUMBERED + "</p><p>a&<b>#98;c</p>")
    df = pages(spark, [*rows, whole]).select("page_id", "url", "html")
    got = warc.derive(warc.responses(df)).where("warc_type = 'conversion'").orderBy("page_id").collect()
    assert [r.block for r in got[:-1]] == ["y" + html.unescape(x) for x in cases]
    assert got[-1].block == html.unescape(NUMBERED) + "\nabc"
    fields = warc.derive(warc.responses(df)).where("warc_type = 'metadata'").orderBy("page_id").collect()
    for x, r in zip(cases, fields):
        assert f"title: {html.unescape(x)}\r\n" in r.block and f"outlink: {html.unescape(x)}\r\n" in r.block
    df.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    _, message = difference(QUERIES["op8_warc"](spark, str(tmp_path)), con, ORACLES["op8_warc"])
    assert message is None, message


def test_an_unbroken_blank_is_a_blank(spark):
    (text,) = warc.derive(warc.responses(pages(spark, [(1, "u", "a&#160;&#xA0;&nbsp;b&#10;&#13;c")]))).where("warc_type = 'conversion'").collect()
    assert text.block == "a b\nc"


def test_no_value_adds_a_header(spark):
    rows = [(1, "http://a/\r\nWARC-Type: response\n\nx", "<title>a&#13;&#10;b: c</title><a href=\"x&#10;y: z\">t</a>")]
    derived = warc.derive(warc.responses(pages(spark, rows)))
    for r in derived.select(warc.record().alias("whole"), "block", "warc_type").collect():
        head, block = r.whole.split("\r\n\r\n", 1)
        assert block == r.block and len(head.split("\r\n")) == 9 and len(head.splitlines()) == 9
        assert "WARC-Target-URI: http://a/%0D%0AWARC-Type: response%0A%0Ax" in head
        if r.warc_type == "metadata":
            assert block.splitlines()[-3:] == ["title: a b: c", "language: ", "outlink: x y: z"]


def test_files_can_be_read_record_by_record(spark, tmp_path):
    derived = warc.derive(warc.responses(pages(spark, [(1, "http://a/", PAGE), (2, None, None)])))
    warc.write(derived.coalesce(1), str(tmp_path / "out"))
    (file,) = pathlib.Path(tmp_path, "out").glob("*.gz")
    data, seen = gzip.decompress(file.read_bytes()), []
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        first, *lines = head.decode().split("\r\n")
        assert first == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        block, end, data = data[:n], data[n : n + 4], data[n + 4 :]
        assert end == b"\r\n\r\n" and fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        seen.append((fields["WARC-Record-ID"], fields["WARC-Refers-To"]))
    assert sorted(seen) == sorted((r.record_id, r.refers_to) for r in derived.collect())


def test_query(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        _, message = difference(QUERIES["op8_warc"](spark, sf), duck(sf), ORACLES["op8_warc"])
        assert message is None, message
