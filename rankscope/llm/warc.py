"""WARC derivatives: metadata and plain-text conversion records made from response records.

A response record is a row: record_id, target_uri, warc_date, http (status line
and headers, CRLF between lines), payload (binary).  Each gives one metadata
and one conversion record, both with the response in WARC-Refers-To, its
target and date, its HTTP headers and its digests.  ``write_records`` stores
records as WARC/1.1 files, ``parse_records`` reads the bytes of one.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ("record_type string, record_id string, refers_to string, target_uri string, warc_date string, "
          "content_type string, content_length long, block_digest string, source_payload_digest string, "
          "source_block_digest string, source_headers string, block string")

_UNSEEN = re.compile(r"<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
_BREAK = re.compile(r"<(?:/?(?:address|article|aside|blockquote|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head"
                    r"|header|li|main|nav|ol|p|pre|section|table|title|tr|ul)|br|hr)\b[^>]*>", re.I)
_CELL = re.compile(r"</?t[dh]\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title", re.I)
_ANCHOR, _HREF = re.compile(r"<a\s", re.I), re.compile(r"\bhref\s*=\s*|>", re.I)
_VALUE = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s>]+)")
_LONG_ZERO, _LONG_NUMBER = re.compile(r"&#0{8,}"), re.compile(r"&#0?[1-9][0-9]{7,};?")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9._:-]+)", re.I)
_ORIGIN = re.compile(r"[a-z][a-z0-9+.-]*://[^/?#]*", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same parts always give the same identifier, so that a lost task's records come back unchanged."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(chr(31).join(parts).encode('utf-8', 'surrogatepass')).digest())}>"


def _tags_to(new: str, pattern: re.Pattern, page: str) -> str:
    """``pattern.sub`` up to the last ``>``: every tag begun there ends, so that no place is looked at twice."""
    end = page.rfind(">") + 1
    return pattern.sub(new, page[:end]) + page[end:]


def _unescaped(text: str) -> str:
    """html.unescape, which cannot read numbers of thousands of digits."""
    return html.unescape(_LONG_NUMBER.sub("\ufffd", _LONG_ZERO.sub("&#0", text)))


def plain_text(page: str) -> str:
    """The visible text of a page: a line per block, white space collapsed, entities decoded."""
    page = _tags_to("\n", _BREAK, _UNSEEN.sub(" ", page))
    page = _tags_to("", _TAG, _tags_to(" ", _CELL, page))
    lines = (" ".join(line.split()) for line in _unescaped(page).split("\n"))
    return "\n".join(line for line in lines if line)


def page_title(page: str) -> str:
    """Text of the first title that ends; white space collapsed, entities decoded."""
    start = _TITLE.search(page, 0, page.rfind(">") + 1)
    end = _TITLE_END.search(page, start.end()) if start else None
    return " ".join(_unescaped(page[start.end():end.start()]).split()) if end else ""


def _hrefs(page: str) -> Iterator[str]:
    """The first href of each anchor as written, in one pass from left to right."""
    at = 0
    while anchor := _ANCHOR.search(page, at):
        at = anchor.end()
        while True:
            found = _HREF.search(page, at)
            if not found:
                return
            at = found.end()
            if found.group() == ">":
                break
            if value := _VALUE.match(page, at):
                yield "".join(g or "" for g in value.groups())
                at = value.end()
                break


def outlinks(page: str, base: str) -> list[str]:
    """Absolute targets of the anchors, each once, in order."""
    origin = _ORIGIN.match(base)
    out: dict[str, None] = {}
    for written in _hrefs(_UNSEEN.sub(" ", page)):
        href = _unescaped(written).strip()
        if href.startswith("/") and not href.startswith("//") and origin:
            href = origin.group() + href
        elif not _ORIGIN.match(href):
            try:
                href = urljoin(base, href)
            except ValueError:
                pass  # kept as it stands
        if href:
            out[re.sub(r"[\r\n]+", " ", href)] = None
    return list(out)


def decode(payload: bytes, http: str) -> tuple[str, str]:
    """Text and charset: of the HTTP header, else of the page's head, else UTF-8."""
    found = _CHARSET.search(http) or _CHARSET.search(payload[:2048].decode("latin-1"))
    name = found.group(1).lower() if found else "utf-8"
    try:
        return payload.decode(name, "replace"), name
    except LookupError:
        return payload.decode("utf-8", "replace"), "utf-8"


def derivatives(source: str, uri: str, date: str, http: str, payload: bytes) -> list[tuple]:
    page, charset = decode(payload, http)
    text, links = plain_text(page), outlinks(page, uri)
    block = http.encode() + b"\r\n\r\n" + payload
    status, *headers = http.split("\r\n")
    fields = [("source-record-id", source), ("source-status", status),
              *[("source-header", h) for h in headers if h],
              ("source-block-digest", digest(block)), ("source-payload-digest", digest(payload)),
              ("source-payload-length", str(len(payload))), ("charset", charset),
              ("title", page_title(page)),
              ("conversion-record-id", record_id(source, "conversion")), ("text-length", str(len(text.encode()))),
              *[("outlink", x) for x in links]]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields)
    out = []
    for kind, content_type, body in (("metadata", "application/warc-fields", meta),
                                     ("conversion", "text/plain; charset=utf-8", text)):
        data = body.encode("utf-8", "replace")
        out.append((kind, record_id(source, kind), source, uri, date, content_type, len(data), digest(data),
                    digest(payload), digest(block), http, data.decode()))
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              warc_date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records for a table of fetched pages (id, record_id, target_uri, warc_date, http, payload).

    The identifier follows from id, address and payload; a null page is an
    empty payload, a null address an empty target.
    """
    body = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    uri = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    number = F.md5(F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), uri,
                               F.sha2(body, 256)).cast("binary"))
    parts = [F.substring(number, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(body).cast("string"))
    return pages.select(F.col(id_col).alias("id"),
                        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
                        uri.alias("target_uri"), F.lit(warc_date).alias("warc_date"), http.alias("http"),
                        body.alias("payload"))


def build_derivatives(records: DataFrame, id_col: str | None = None) -> DataFrame:
    """Two rows for each response record: its metadata and its conversion record (columns of RECORD).

    ``id_col`` is carried through as ``id``.  Work is by row, so nothing is
    shuffled and hot hosts don't matter.  A null payload, header or target is
    an empty one; repeated rows give repeated records with the same
    identifiers; an empty table gives an empty one; other columns aren't read.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("record_id", "target_uri", "warc_date",
                                                                              "http")]
    own = F.col(id_col) if id_col else F.lit(None).cast("long")
    rows = records.select(own.alias("id"), *text, F.coalesce("payload", F.lit(b"")).alias("payload"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for pdf in batches:
            made = [derivatives(*r) for r in zip(pdf["record_id"], pdf["target_uri"], pdf["warc_date"], pdf["http"],
                                                 pdf["payload"])]
            out = pd.DataFrame([x for two in made for x in two], columns=names)
            out.insert(0, "id", pdf["id"].repeat(2).array)
            yield out

    return rows.mapInPandas(run, f"id {id_type}, {RECORD}")


def record_text() -> Column:
    """The record as WARC/1.1 text, without the two line ends behind the block."""
    fields = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "warc_date"),
              ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"),
              ("WARC-Refers-To-Date", "warc_date"), ("WARC-Target-URI", "target_uri"),
              ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"),
              ("Content-Length", "content_length")]
    lines = [F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) for name, c in fields]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit("\r\n\r\n"), F.col("block"))


def write_records(records: DataFrame, path: str) -> None:
    """Writes records as WARC files, one per partition, compressed with gzip."""
    (records.select(record_text().alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .text(path))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, headers, block) of every record of the WARC files under ``path``, compressed with gzip or not.

    A file is parsed in one task, as gzip has to be; those of ``write_records`` hold a partition each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                content = bytes(content)
                found = parse_records(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content)
                yield pd.DataFrame([(name, *r) for r in found], columns=["file", "headers", "block"])

    return (spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
            .mapInPandas(run, "file string, headers map<string, string>, block binary"))


def parse_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC file."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        out.append((headers, data[end + 4:end + 4 + size]))
        at = end + 4 + size + 4
    return out
