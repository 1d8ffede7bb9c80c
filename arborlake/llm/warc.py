"""WARC derivatives: a metadata and a plain-text conversion record for each response.

Both derived records carry WARC-Refers-To (the response's identifier), its target URI and date, and
the source's payload digest; the metadata record also keeps the source's HTTP headers, the title and
the outlinks. Identifiers are uuids of the content, so a task that runs again makes the same records.
``read_warc`` and ``to_bytes`` read and write the file format; records that are read and written
again are the same bytes.

Every page is one row's work; nothing is shuffled and a task holds one Arrow batch. Archives are read as
streams, from wherever their path is, a record at a time.

Defined results: null html is an empty payload and null url an empty target; a page without text has
an empty conversion record; markup is read as browsers forgive it: a declaration that isn't one is a
comment up to the next >, and a tag that never ends is text; rows that repeat a page
yield the same records each time; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from typing import BinaryIO
from urllib.parse import urljoin

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from arborlake.llm.textops import table

VERSION, DATE, BATCH = "WARC/1.1", "2024-01-01T00:00:00Z", 1 << 22
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_SKIP = {"script", "style", "noscript", "template", "svg"}
_BLOCK = set("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
_LINKS = {"a": "href", "area": "href", "img": "src", "link": "href", "script": "src", "iframe": "src", "form": "action", "source": "src", "video": "src", "audio": "src"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


class _Reader(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.title, self.links, self.skip, self.in_title = base, [], [], [], [], False

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # such as <![foo[x]]>
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        if at := _LINKS.get(tag):
            for k, v in attrs:
                if k == at and v and not v.strip().lower().startswith(("javascript:", "data:", "#")):
                    try:
                        self.links.append((urljoin(self.base, v.strip()), f"{tag.upper()}/@{at}"))
                    except ValueError:
                        pass
        if tag in _SKIP:
            self.skip.append(tag)
        elif tag == "title":
            self.in_title = True
        elif tag in _BLOCK:
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in _SKIP:
            self.skip.pop()

    def handle_endtag(self, tag):
        if tag in self.skip:
            while self.skip.pop() != tag:
                pass
        elif tag == "title":
            self.in_title = False
        elif tag in _BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if self.skip:
            return
        (self.title if self.in_title else self.out).append(data)


def read_html(html: str, base: str) -> tuple[str, str, list[tuple[str, str]]]:
    """Title, plain text (one line per block, inner space as one) and distinct outlinks in order."""
    r = _Reader(base)
    # what never ends is text; said here, as the parser would look for its end again at each of many
    closed, last = max(html.rfind("-->"), html.rfind("--!>"), 0), html.rfind(">") + 1
    r.feed(html[:closed] + html[closed:last].replace("<!--", "&lt;!--"))
    r.close()
    r.handle_data(unescape(html[last:]))
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(r.out).split("\n"))
    return re.sub(r"\s+", " ", "".join(r.title)).strip(), "\n".join(x for x in lines if x), list(dict.fromkeys(r.links))


def http_response(html: str) -> bytes:
    body = html.encode("utf-8", "replace")
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body


def response_record(url: str, html: str, date: str = DATE) -> dict:
    block = http_response(html)
    payload = block.partition(b"\r\n\r\n")[2]
    head = {
        "WARC-Type": "response", "WARC-Record-ID": record_id("response", url, date, digest(payload)), "WARC-Date": date, "WARC-Target-URI": url,
        "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    return {"headers": head, "block": block}


def derive(response: dict) -> list[dict]:
    """The metadata and the conversion record of a response record."""
    head = response["headers"]
    http, _, payload = response["block"].partition(b"\r\n\r\n")
    source, url, date = head["WARC-Record-ID"], head.get("WARC-Target-URI", ""), head.get("WARC-Date", DATE)
    of = head.get("WARC-Payload-Digest") or digest(payload)
    charset = re.search(rb"charset=([\w-]+)", http, re.I)
    try:
        html = payload.decode(charset[1].decode() if charset else "utf-8", "replace")
    except LookupError:
        html = payload.decode("utf-8", "replace")
    title, text, links = read_html(html, url)
    fields = [("title", title)] + [("source-header", re.sub(r"\s+", " ", h)) for h in http.decode("latin-1").split("\r\n")] + [("outlink", f"{re.sub(chr(92) + 's', '%20', u)} {via}") for u, via in links]
    out = []
    for kind, content_type, block in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")),
        ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")),
    ):
        out.append({
            "headers": {
                "WARC-Type": kind, "WARC-Record-ID": record_id(kind, source, digest(block)), "WARC-Date": date, "WARC-Target-URI": url, "WARC-Refers-To": source,
                "WARC-Refers-To-Target-URI": url, "WARC-Refers-To-Date": date, "WARC-Source-Payload-Digest": of, "WARC-Block-Digest": digest(block), "Content-Type": content_type, "Content-Length": str(len(block)),
            },
            "block": block,
        })
    return out


def to_bytes(record: dict) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in record["headers"].items())
    return f"{VERSION}\r\n{head}\r\n".encode("utf-8", "replace") + record["block"] + b"\r\n\r\n"


def from_stream(f: BinaryIO) -> Iterator[dict]:
    """Records of a WARC file, plain or gzipped (by member or as a whole), one at a time."""
    f = io.BufferedReader(f) if not hasattr(f, "peek") else f
    if f.peek(2)[:2] == b"\x1f\x8b":
        f = io.BufferedReader(gzip.GzipFile(fileobj=f))
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record here")
        head: dict[str, str] = {}
        while (h := f.readline()).strip():
            k, _, v = h.decode("utf-8", "replace").rstrip("\r\n").partition(":")
            head[k.strip()] = v.strip()
        yield {"headers": head, "block": f.read(int(head.get("Content-Length", 0)))}


def from_bytes(data: bytes) -> Iterator[dict]:
    return from_stream(io.BytesIO(data))


RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, source_digest string, block_digest string, content_type string, content_length long, block string"
_FIELDS = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Source-Payload-Digest", "WARC-Block-Digest", "Content-Type", "Content-Length")


def _row(page, record: dict) -> tuple:
    v = [record["headers"].get(k) for k in _FIELDS]
    return (page, *v[:-1], int(v[-1]), record["block"].decode("utf-8", "replace"))


def derivatives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """pages: page_id, url, html. Two rows a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [_row(p, r) for p, u, h in zip(b.page_id.array, b.url, b.html) for r in derive(response_record(u or "", h or "", date))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")]).astype({"page_id": "Int64"})

    return pages.select("page_id", "url", "html").mapInPandas(run, RECORD)


RECORDS = "path string, headers map<string,string>, block binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: path, headers, block. A file is a task's work, as its records can't be found from the middle; it is streamed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b.path:
                held, n = [], 0
                system, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", p))
                with system.open_input_stream(at, compression=None) as f:
                    for r in from_stream(f):
                        held.append((p, r["headers"], r["block"]))
                        n += len(r["block"])
                        if n >= BATCH:
                            yield pd.DataFrame(held, columns=["path", "headers", "block"])
                            held, n = [], 0
                if held:
                    yield pd.DataFrame(held, columns=["path", "headers", "block"])

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, RECORDS)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(table(spark, sf_dir, "pages"))
