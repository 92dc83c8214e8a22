"""Derived WARC records: for every response a metadata record and a plain-text conversion record.

Both refer to the response by its identifier and carry on its target URI, its date and, in the metadata, its HTTP headers
and digests; every derived block has a digest of its own.  Only column expressions are used: one pass over the rows, no
shuffle.  Records are whole WARC/1.1 text, so ``write`` lays them out as files that any reader of the format takes.

Plain text: comments and script, style, noscript, template and head elements (but not the title, which the metadata has)
go; tags of blocks end a line, others vanish; the named entities below and all numeric ones become characters (U+FFFD
where a number has none); white space is folded.

Null html is an empty payload.  A null URI leaves its header out; line ends in a URI are written percent-encoded, those in
other header values as blanks, so no value can add a header.  Identifiers follow from the response's, so repeated
rows give repeated records.  An empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: A crawl table without dates gets this one.
NO_DATE = "1970-01-01T00:00:00Z"

_GONE = r"(?is)<!--.*?-->|<script(?:[\s/][^>]*)?>.*?</script\s*>|<style(?:[\s/][^>]*)?>.*?</style\s*>|<noscript(?:[\s/][^>]*)?>.*?</noscript\s*>|<template(?:[\s/][^>]*)?>.*?</template\s*>|<head(?:[\s/][^>]*)?>.*?</head\s*>"
_LINE = r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|nav|header|footer|main|aside|blockquote|pre|form)(?:[\s/][^>]*)?>"
_TAG = r"</?[A-Za-z!?][^>]*>"
_TITLE = r"(?is)<title(?:[\s/][^>]*)?>(.*?)</title\s*>"
_LANG = r"(?i)<html[^>]*\slang=[\"']([A-Za-z0-9-]+)"
_LINK = r"(?i)<a\s[^>]*href=\"([^\"]*)\""
#: Fixed values of the format: named entities, but for the ampersand's.
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&copy;": "©", "&reg;": "®",
    "&middot;": "·", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—",
}
#: References by number, decimal or hexadecimal.
NUMERIC = r"&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"
#: Numbers 128 to 159 mean the characters of windows-1252, as in HTML; the unbroken blank (160) is a blank.
_OLD = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
OLD_FROM, OLD_TO = "".join(map(chr, _OLD)) + "\xa0", bytes(_OLD).decode("cp1252") + " "
UNKNOWN = "\ufffd"


def _sign(reference: Column) -> Column:
    """The character of a reference by number; U+FFFD where there is none."""
    digits = F.regexp_replace(reference, "[&#;xX]", "")
    code = F.when(reference.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    # Decoding would take U+FEFF for a byte order mark.
    sign = F.when(code == 0xFEFF, F.lit("\ufeff")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    return F.when(known, F.translate(sign, OLD_FROM, OLD_TO)).otherwise(F.lit(UNKNOWN))


def _numbered(text: Column) -> Column:
    signs = F.transform(F.regexp_extract_all(text, F.lit(NUMERIC), F.lit(0)), _sign)
    between = F.split(text, NUMERIC, -1)
    return F.array_join(F.zip_with(between, signs, lambda part, sign: F.concat(part, F.coalesce(sign, F.lit("")))), "")


def _decoded(text: Column) -> Column:
    """Entities to characters, none of them twice: what an ampersand's reference leaves is not looked at again."""
    for name, sign in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(sign))

    def rest(t: Column) -> Column:
        amp = F.lit("&amp;")
        numbered = _numbered(F.replace(t, amp, F.lit("&#38;")))
        return F.when(F.contains(t, F.lit("&#")), numbered).otherwise(F.replace(t, amp, F.lit("&")))

    # An array of one, so that the text is made once for all its uses.
    return F.transform(F.array(text), rest)[0]


def _folded(text: Column) -> Column:
    """Blanks to one, line ends with blanks around them to one, none at the ends."""
    text = F.regexp_replace(text, r"[\t\r\f\x0B ]+", " ")
    return F.btrim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def plain_text(html: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _GONE, ""), _LINE, "\n"), _TAG, "")
    return _folded(_decoded(text))


def record_id(*parts: Column) -> Column:
    """A name-based identifier, the same for the same parts."""
    h = F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256)
    cuts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """Response records of a table of fetched pages: page_id, response_id, target_uri, warc_date, http_headers, payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    headers = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "),
        F.octet_length(payload).cast("string"),
    )
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("page_id", "url")]
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        record_id(F.lit("response"), *key, payload).alias("response_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        headers.alias("http_headers"),
        payload.alias("payload"),
    )


def derive(found: DataFrame) -> DataFrame:
    """Metadata and conversion records of responses (columns as ``responses`` gives them)."""
    c = F.col
    held = found.withColumns({
        "block_digest": digest(F.concat(c("http_headers"), F.lit(CRLF * 2), c("payload"))),
        "payload_digest": digest(c("payload")),
        "title": _folded(F.replace(_decoded(F.regexp_extract("payload", _TITLE, 1)), F.lit("\n"), F.lit(" "))),
        "language": F.regexp_extract("payload", _LANG, 1),
        "links": F.regexp_extract_all("payload", F.lit(_LINK), F.lit(1)),
        "text": plain_text(c("payload")),
    })
    lines = F.filter(F.split("http_headers", CRLF), lambda x: x != "")
    fields = F.concat(
        F.array(
            F.concat(F.lit("source-block-digest: "), c("block_digest")),
            F.concat(F.lit("source-payload-digest: "), c("payload_digest")),
        ),
        F.transform(lines, lambda x: F.concat(F.lit("source-header: "), x)),
        F.array(F.concat(F.lit("title: "), c("title")), F.concat(F.lit("language: "), c("language"))),
        F.transform("links", lambda x: F.concat(F.lit("outlink: "), _folded(F.replace(_decoded(x), F.lit("\n"), F.lit(" "))))),
    )
    metadata = F.concat(F.array_join(fields, CRLF), F.lit(CRLF))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), metadata.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=UTF-8").alias("content_type"), c("text").alias("block")),
    )
    rows = held.select("page_id", "response_id", "target_uri", "warc_date", "payload_digest", F.inline(kinds))
    return rows.select(
        "page_id",
        "warc_type",
        record_id(c("warc_type"), c("response_id")).alias("record_id"),
        c("response_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        "content_type",
        F.octet_length("block").cast("long").alias("content_length"),
        digest(c("block")).alias("block_digest"),
        c("payload_digest").alias("source_payload_digest"),
        "block",
    )


def record(row_block: str = "block") -> Column:
    """The whole record of a derived row, without the two line ends after it."""

    def c(name: str) -> Column:
        return F.regexp_replace(F.col(name).cast("string"), r"[\r\n]+", " ")

    uri = F.replace(F.replace(F.col("target_uri"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.array(
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), c("warc_type")),
        F.concat(F.lit("WARC-Record-ID: "), c("record_id")),
        F.concat(F.lit("WARC-Refers-To: "), c("refers_to")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Date: "), c("warc_date")),
        F.concat(F.lit("WARC-Block-Digest: "), c("block_digest")),
        F.concat(F.lit("Content-Type: "), c("content_type")),
        F.concat(F.lit("Content-Length: "), c("content_length")),
    )
    return F.concat(F.array_join(header, CRLF), F.lit(CRLF * 2), F.col(row_block))


def write(derived: DataFrame, path: str) -> None:
    """Records as gzipped files, one after the other with the two line ends that the format wants."""
    files = derived.select(record().alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip")
    files.text(path)
