"""WARC derivatives: metadata and plain-text conversion records made from responses.

A response gives two records. The ``metadata`` record (``application/warc-fields``) has the title, the language and
the outlinks, resolved against the target URI. The ``conversion`` record is the page's plain text. Both refer to the
response by identifier, target URI and date, name each other as concurrent, and carry the response's HTTP headers and
payload digest unchanged. Identifiers are name-based, so a run repeated after a lost executor gives the same records.

All of it is column expressions over one row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements without text of the page, and elements that begin a line.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script[^<>]*>|<style\b.*?</style[^<>]*>|<noscript\b.*?</noscript[^<>]*>|<template\b.*?</template[^<>]*>"
LINES = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html"
    r"|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^<>]*>"
)
TAGS = r"</?[A-Za-z!][^<>]*>"
#: Named and numbered characters that are written out; the ampersand comes last.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
    ("&reg;", "®"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&euro;", "€"), ("&amp;", "&"),
)
LINK = r"""(?i)<(?:a|area|link|img|script|iframe|source)\b[^<>]*?[ \t\r\n\f](?:href|src)[ \t\r\n\f]*=[ \t\r\n\f]*["']([^"'<>]*)["']"""
TITLE = r"(?is)<title[^<>]*>(.*?)</title"
LANGUAGE = r"""(?i)<html[^<>]*?[ \t\r\n\f]lang[ \t\r\n\f]*=[ \t\r\n\f]*["']([^"'<>]*)["']"""
BLANKS, EDGES = r"[ \t\r\f\x0b]+", r" ?\n[ \n]*"


def decoded(text: Column) -> Column:
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0b]+", " "))


def plain_text(html: Column) -> Column:
    """The text of a page: hidden elements gone, a line for each block, other tags gone, characters written out."""
    text = F.regexp_replace(html, HIDDEN, "")
    text = F.regexp_replace(text, LINES, "\n")
    text = F.regexp_replace(text, TAGS, "")
    text = F.regexp_replace(decoded(text), BLANKS, " ")
    return F.trim(F.regexp_replace(text, EDGES, "\n"), F.lit(" \n"))


def urn(name: Column) -> Column:
    """A name-based identifier."""
    h = F.md5(F.encode(name, "UTF-8"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(text, "UTF-8"), 256))


def resolved(link: Column, base: Column) -> Column:
    """A link as an absolute URI."""
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    path = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.when(path == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_extract(path, r"^.*/", 0))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^[A-Za-z0-9+.-]*:", 0), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("#") | link.startswith("?"), F.concat(path, link))
        .otherwise(F.concat(folder, link))
    )


def responses(
    pages: DataFrame, date: str = "1970-01-01T00:00:00Z", key: str = "page_id", uri: str = "url", html: str = "html"
) -> DataFrame:
    """``key, record_id, target_uri, date, http_headers, payload, payload_digest``: a response for each crawled page.
    Null addresses and pages count as empty. Rows alike in all three columns get the same identifier."""
    address, body = F.coalesce(F.col(uri), F.lit("")), F.coalesce(F.col(html), F.lit(""))
    digest = sha256(body)
    name = F.concat_ws("|", F.lit("response"), F.coalesce(F.col(key).cast("string"), F.lit("")), address, digest)
    length = F.octet_length(body).cast("string")
    headers = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit("\r\n")
    )
    return pages.select(
        key,
        urn(name).alias("record_id"),
        address.alias("target_uri"),
        F.lit(date).alias("date"),
        headers.alias("http_headers"),
        body.alias("payload"),
        digest.alias("payload_digest"),
    )


def derivatives(source: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows for each response: ``key, record_type, record_id, refers_to, refers_to_target_uri, refers_to_date,
    concurrent_to, source_headers, source_digest, content_type, content_length, block_digest, block``.

    A page without text gives an empty block, never a missing record. Very long pages are one record. Nulls count as
    empty texts. Repeated responses give repeated records. An empty table gives an empty result. Columns other than
    those of ``responses`` are ignored, whatever their names.
    """
    page = {c: F.coalesce(F.col(c), F.lit("")) for c in ("record_id", "target_uri", "date", "http_headers", "payload", "payload_digest")}
    read = source.select(F.col(key).alias("_key"), *(v.alias(c) for c, v in page.items()))
    links = F.regexp_extract_all("payload", F.lit(LINK), F.lit(1))
    out = F.transform(links, lambda x: resolved(one_line(decoded(x)), F.col("target_uri")))
    title = one_line(decoded(F.regexp_extract("payload", TITLE, 1)))
    about = F.concat(
        F.lit("title: "), title,
        F.lit("\r\nlanguage: "), one_line(F.regexp_extract("payload", LANGUAGE, 1)),
        F.lit("\r\noutlinks: "), F.size("_links").cast("string"), F.lit("\r\n"),
        F.concat_ws("", F.transform("_links", lambda x: F.concat(F.lit("outlink: "), x, F.lit("\r\n")))),
    )
    ids = {kind: urn(F.concat(F.lit(f"{kind}|"), F.col("record_id"))) for kind in ("metadata", "conversion")}
    made = read.withColumn("_links", out)
    record = lambda kind, other, form, block: F.struct(
        F.lit(kind).alias("record_type"), ids[kind].alias("id"), ids[other].alias("other"), F.lit(form).alias("form"), block.alias("block")
    )
    both = F.array(
        record("metadata", "conversion", "application/warc-fields", about),
        record("conversion", "metadata", "text/plain; charset=utf-8", plain_text(F.col("payload"))),
    )
    rows = made.withColumn("_record", F.explode(both))
    return rows.select(
        F.col("_key").alias(key),
        F.col("_record.record_type").alias("record_type"),
        F.col("_record.id").alias("record_id"),
        F.col("record_id").alias("refers_to"),
        F.col("target_uri").alias("refers_to_target_uri"),
        F.col("date").alias("refers_to_date"),
        F.col("_record.other").alias("concurrent_to"),
        F.col("http_headers").alias("source_headers"),
        F.col("payload_digest").alias("source_digest"),
        F.col("_record.form").alias("content_type"),
        F.octet_length("_record.block").cast("bigint").alias("content_length"),
        sha256(F.col("_record.block")).alias("block_digest"),
        F.col("_record.block").alias("block"),
    )


def record_text(records: DataFrame) -> DataFrame:
    """One column ``value``: each record of ``derivatives`` as WARC/1.1 text without the two line ends that close it.
    The response's HTTP headers are kept in ``WARC-Source-Header`` fields, one for each of their lines."""
    headers = F.transform(
        F.filter(F.split("source_headers", "\r\n"), lambda x: x != ""),
        lambda x: F.concat(F.lit("WARC-Source-Header: "), x, F.lit("\r\n")),
    )
    fields = (
        ("WARC-Type", "record_type"),
        ("WARC-Record-ID", "record_id"),
        ("WARC-Date", "refers_to_date"),
        ("WARC-Target-URI", "refers_to_target_uri"),
        ("WARC-Refers-To", "refers_to"),
        ("WARC-Refers-To-Target-URI", "refers_to_target_uri"),
        ("WARC-Refers-To-Date", "refers_to_date"),
        ("WARC-Concurrent-To", "concurrent_to"),
        ("WARC-Source-Payload-Digest", "source_digest"),
        ("WARC-Block-Digest", "block_digest"),
        ("Content-Type", "content_type"),
        ("Content-Length", "content_length"),
    )
    lines = [p for name, c in fields for p in (F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n"))]
    value = F.concat(F.lit("WARC/1.1\r\n"), *lines, F.concat_ws("", headers), F.lit("\r\n"), F.col("block"))
    return records.select(value.alias("value"))


def write_warc(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write records as gzipped WARC files, one for each partition."""
    record_text(records).write.mode(mode).option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
