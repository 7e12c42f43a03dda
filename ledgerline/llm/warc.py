"""WARC derivatives: metadata and conversion records of responses (operator 8).

A response record yields a ``metadata`` record (JSON: HTTP status and headers, title, language,
meta fields, links, and the digests of its source) and a ``conversion`` record (plain text).
Both name the response in WARC-Refers-To, keep its WARC-Target-URI and WARC-Date, and carry
digests of their own block. Record ids are name-based (of the source record and the type), so
a task that runs again writes the same records.

Scale: one map over the scan, without a shuffle; a page's records stand side by side. Reading a page
takes time in proportion to its length, whatever it holds. ``file_derivatives`` does the same for the
response records of WARC files, plain or in gzip members, which are unpacked piece by piece in time
proportional to their length; a file is one task's work and one value, so at most 2 GB.

Defined cases: a null html is an empty body; a null url leaves WARC-Target-URI out and links
unresolved; equal rows give equal records; very long pages are read whole; a tag whose quotes never
close ends at its first ">", as do all after it, and one without any ">" is text; an element of
scripts or styles that never closes takes the rest; there is nothing to tie; an empty table gives no
rows; further columns are ignored; bytes that are no WARC record raise ValueError in ``parse`` and are rows
with an error in ``read_files`` and ``file_derivatives``, which go on at the next record; a body
whose encoding or charset is unknown or broken is read as it stands.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import lean, table, tune

#: The date of records made from pages that have none.
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("7b1d0c0e-6f0b-5a53-9c1d-2f2b7d9a4c11")

#: Elements whose content is no text, and elements that end a line.
RAW = frozenset("script style noscript template svg iframe".split())
RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
LINE = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


@dataclass
class Record:
    headers: list[tuple[str, str]]
    block: bytes = b""

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def to_bytes(self) -> bytes:
        return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in self.headers), "\r\n"]).encode() + self.block + b"\r\n\r\n"


@dataclass
class Broken:
    """What is no record: where it begins in the unpacked bytes, and why."""

    at: int
    reason: str


#: Bytes that are unpacked at once.
PIECE = 1 << 16
_GZIP = b"\x1f\x8b\x08"


def pieces(data: bytes) -> Iterator[bytes | None]:
    """The unpacked bytes of data, which is plain or gzip members, in pieces; None where a member is broken.
    What follows a broken member is read from the next one's first bytes on."""
    if data[:2] != _GZIP[:2]:
        for at in range(0, len(data), PIECE):
            yield data[at : at + PIECE]
        return
    view, at = memoryview(data), 0
    while 0 <= at < len(data):
        unpack, began = zlib.decompressobj(31), at
        try:
            while not unpack.eof and at < len(data):
                part = view[at : at + PIECE]
                out = unpack.decompress(part)
                at += len(part) - len(unpack.unused_data)
                if out:
                    yield out
            if not unpack.eof:
                yield None
                return
        except zlib.error:
            yield None
            at = data.find(_GZIP, max(at, began + 1))
            continue
        if data[at : at + 2] != _GZIP[:2]:  # fill after the last member
            return


class _Stream:
    """The unpacked bytes of a file from a place on, read as they are asked for."""

    def __init__(self, data: bytes):
        self.pieces, self.buffer, self.start, self.dropped = pieces(data), bytearray(), 0, 0
        self.ended = self.damaged = False

    def more(self) -> bool:
        """Whether there are more bytes now. No bytes are added over a broken member; what follows it
        begins on a new line."""
        piece = next(self.pieces, b"") if not self.ended else b""
        if piece is None:
            self.damaged = True
            self.buffer += b"\r\n"
        elif piece:
            self.buffer += piece
        else:
            self.ended = True
        return bool(piece)

    def find(self, what: bytes, at: int) -> int:
        """Where ``what`` stands from ``at`` on; -1 if not before a broken member or the end."""
        while (k := self.buffer.find(what, at)) < 0:
            at = max(at, len(self.buffer) - len(what) + 1)
            if not self.more():
                return -1
        return k

    def go(self, to: int) -> None:
        self.start = to
        if self.start > 4 * PIECE or self.start == len(self.buffer):
            self.dropped += self.start
            del self.buffer[: self.start]
            self.start = 0

    def next_record(self, at: int) -> None:
        """On to the next version line."""
        while (k := self.find(b"\nWARC/1.", at)) < 0 and not self.ended:
            at = max(at, len(self.buffer) - 8)
        self.go(k + 1 if k >= 0 else len(self.buffer))


VERSION = re.compile(rb"WARC/1\.[01]\r?\n")


def records(data: bytes) -> Iterator[Record | Broken]:
    """The records of a WARC file's bytes and what of them is broken, in time proportional to its length.
    After broken bytes the next version line begins a record."""
    s = _Stream(data)
    while True:
        while s.start < len(s.buffer) and s.buffer[s.start] in b"\r\n":
            s.start += 1
        s.go(s.start)
        if s.damaged:
            s.damaged = False
            yield Broken(s.dropped + s.start, "a broken gzip member")
        if s.start == len(s.buffer):
            if not s.more() and s.ended:
                return
            continue
        at, begin = s.dropped + s.start, s.start
        s.find(b"\n", begin)
        if not VERSION.match(s.buffer, begin):
            yield Broken(at, "no WARC record")
            s.next_record(begin)
            continue
        end = s.find(b"\r\n\r\n", begin)
        if end < 0:
            yield Broken(at, "the record is cut off")
            s.next_record(begin)
            continue
        lines = bytes(s.buffer[begin:end]).decode("utf-8", "replace").split("\r\n")
        record = Record([tuple(x.strip() for x in line.split(":", 1)) for line in lines[1:] if ":" in line])
        length = record.get("Content-Length") or "0"
        if not re.fullmatch(r"[0-9]{1,18}", length):
            yield Broken(at, f"Content-Length {length[:40]!r}")
            s.next_record(end)
            continue
        last = end + 4 + int(length)
        while len(s.buffer) < last and s.more():
            pass
        if len(s.buffer) < last:
            yield Broken(at, "the record is cut off")
            s.next_record(end)
            continue
        record.block = bytes(s.buffer[end + 4 : last])
        yield record
        s.go(last)


def parse(data: bytes) -> Iterator[Record]:
    """The records of a WARC file's bytes, plain or in gzip members; ValueError for broken ones."""
    for r in records(data):
        if isinstance(r, Broken):
            raise ValueError(f"{r.reason} at byte {r.at}")
        yield r


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def response(page_id, url: str | None, body: str | None, date: str = DATE) -> Record:
    payload = (body or "").encode("utf-8", "replace")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), url or "", digest(payload))), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _one_line(url)))
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return Record(headers, block)


@dataclass
class Page:
    title: str = ""
    lang: str | None = None
    text: str = ""
    meta: dict[str, str] = field(default_factory=dict)
    links: list[dict[str, str]] = field(default_factory=list)


def _raw_end(source: str, name: str, at: int) -> int:
    close = RAW_END[name].search(source, at)
    return close.end() if close else len(source)


def tags(source: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of all markup; comments, declarations and the contents
    of RAW elements have no name. Each place is looked at a bounded number of times."""
    at, quotes = 0, True
    while (start := source.find("<", at)) >= 0:
        at = start + 1
        if quotes and (m := TAG.match(source, start)):
            at, name = m.end(), m[2].lower()
            if name in RAW and not m[1]:
                at = _raw_end(source, name, at)
                yield start, at, False, "", ""
            else:
                yield start, at, bool(m[1]), name, m[3]
            continue
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = len(source) if end < 0 else end + 3
            yield start, at, False, "", ""
            continue
        m = NAME.match(source, at)
        if not m and source[at : at + 1] not in ("!", "?"):
            continue
        end = source.find(">", m.end() if m else at) + 1
        if not end:
            return  # no tag ends after this place
        quotes &= not m
        at = end
        name = m[2].lower() if m else ""
        if name in RAW and not m[1]:
            at = _raw_end(source, name, end)
            yield start, at, False, "", ""
        else:
            yield start, end, bool(m and m[1]), name, source[m.end() : end - 1] if m else ""


def read_html(source: str, base: str | None) -> Page:
    """Title, language, meta fields, links and visible text."""
    page, out, title, last, in_title, seen_title = Page(), [], [], 0, False, False
    for start, end, closing, name, attributes in tags(source):
        (title if in_title else out).append(html.unescape(source[last:start]))
        last = end
        if name == "title":
            in_title = not closing and not seen_title
            seen_title |= closing
        if name in LINE:
            out.append("\n")
        if closing or not attributes:
            continue
        found = {a.lower(): html.unescape(b or c or d or "") for a, b, c, d in ATTRIBUTE.findall(attributes)}
        if name == "html":
            page.lang = found.get("lang")
        elif name == "base" and "href" in found:
            base = _join(base, found["href"])
        elif name == "meta" and "content" in found and (key := found.get("name") or found.get("property") or found.get("http-equiv")):
            page.meta[key.lower()] = found["content"]
        elif name in ("a", "link", "area") and "href" in found:
            page.links.append({"path": f"{name.upper()}@/href", "url": _join(base, found["href"])})
        elif name in ("img", "source", "video", "audio") and "src" in found:
            page.links.append({"path": f"{name.upper()}@/src", "url": _join(base, found["src"])})
    (title if in_title else out).append(html.unescape(source[last:]))
    page.title = " ".join("".join(title).split())
    lines = [" ".join(line.split()) for line in "".join(out).split("\n")]
    page.text = "\n".join(line for line in lines if line)
    return page


def _join(base: str | None, target: str) -> str:
    try:
        return urljoin(base, target) if base else target
    except ValueError:
        return target


def _http(block: bytes) -> tuple[str, list[list[str]], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, [[x.strip() for x in line.split(":", 1)] for line in lines if ":" in line], payload


#: A chunk's size, before any extensions.
CHUNK_SIZE = re.compile(rb"[ \t]*([0-9A-Fa-f]{1,16})[ \t]*(?=;|\r|$)")


def _unchunked(body: bytes) -> bytes:
    """The body of a chunked transfer; what is no chunk is left as it stands."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        told = CHUNK_SIZE.match(body, at, end)
        if not told:
            break
        size = int(told[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out) + body[at:] if out else body


def body_text(headers: list[list[str]], body: bytes) -> str:
    """The text of an HTTP body: without chunks and compression, in its charset."""
    named = {k.lower(): v for k, v in reversed([h for h in headers if len(h) == 2])}
    if "chunked" in named.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    coding = named.get("content-encoding", "").strip().lower()
    if coding in ("gzip", "x-gzip", "deflate"):
        for wbits in (47, -15):  # gzip or zlib by their headers, else bare deflate
            try:
                unpack = zlib.decompressobj(wbits)
                body = unpack.decompress(body) + unpack.flush()
                break
            except zlib.error:
                continue
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", named.get("content-type", ""), re.I)
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def derive(source: Record) -> tuple[Record, Record]:
    """The metadata and the conversion record of a response record."""
    status, http, payload = _http(source.block)
    own = source.get("WARC-Record-ID") or record_id("source", digest(source.block))
    page = read_html(body_text(http, payload), source.get("WARC-Target-URI"))
    kept = [list(h) for h in source.headers]
    meta = {"source": kept, "http": {"status": status, "headers": http}, "title": page.title, "lang": page.lang, "meta": page.meta, "links": page.links, "text_chars": len(page.text)}
    made = []
    for kind, content_type, block in (("metadata", "application/json", json.dumps(meta, ensure_ascii=False, sort_keys=True).encode()), ("conversion", "text/plain; charset=utf-8", page.text.encode())):
        headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, own)), ("WARC-Refers-To", own)]
        headers += [(k, v) for k, v in source.headers if k in ("WARC-Date", "WARC-Target-URI", "WARC-IP-Address")]
        headers += [("Content-Type", content_type), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
        made.append(Record(headers, block))
    return made[0], made[1]


def derivatives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, record_type, record_id, refers_to, target_uri, source_payload_digest,
    block_digest, content_length, and the whole record as bytes: three rows per page, the
    response as the derivatives' source among them."""
    names = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "source_payload_digest", "block_digest", "content_length", "record"]
    kinds = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page_id, url, body in zip(*(b.column(i).to_pylist() for i in range(3))):
                source = response(page_id, url, body, date)
                for r in (source, *derive(source)):
                    rows.append((page_id, r.get("WARC-Type"), r.get("WARC-Record-ID"), r.get("WARC-Refers-To"), r.get("WARC-Target-URI"), source.get("WARC-Payload-Digest"), r.get("WARC-Block-Digest"), len(r.block), r.to_bytes()))
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(lean(run), "page_id long, record_type string, record_id string, refers_to string, target_uri string, source_payload_digest string, block_digest string, content_length long, record binary")


def _files(spark, path: str) -> DataFrame:
    """The files as values, one an Arrow batch."""
    tune(spark, 1)
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _from_files(spark, path: str, names: list[str], rows_of) -> DataFrame:
    """Rows that rows_of(record or what is broken) gives for each record of WARC files, with its path."""
    kinds = [pa.string() if n != "record" else pa.binary() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r in records(data):
                    if rows := [(name, *row) for row in rows_of(r)]:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return _files(spark, path).mapInArrow(lean(run), ", ".join(f"{n} {'binary' if n == 'record' else 'string'}" for n in names))


def read_files(spark, path: str) -> DataFrame:
    """(path, record, error) of the records in WARC files, read through Spark. Bytes that are no record
    are a row with an error in place of a record, beside the others."""
    told = lambda r: [(None, f"{r.reason} at byte {r.at}")] if isinstance(r, Broken) else [(r.to_bytes(), None)]
    return _from_files(spark, path, ["path", "record", "error"], told)


def file_derivatives(spark, path: str) -> DataFrame:
    """(path, record_type, record_id, refers_to, record, error): the metadata and conversion records of all
    HTTP response records in WARC files, and a row with an error for bytes that are no record."""

    def made(source: Record | Broken) -> list[tuple]:
        if isinstance(source, Broken):
            return [(None, None, None, None, f"{source.reason} at byte {source.at}")]
        if source.get("WARC-Type") != "response" or "http" not in (source.get("Content-Type") or ""):
            return []
        return [(r.get("WARC-Type"), r.get("WARC-Record-ID"), r.get("WARC-Refers-To"), r.to_bytes(), None) for r in derive(source)]

    return _from_files(spark, path, ["path", "record_type", "record_id", "refers_to", "record", "error"], made)


def op8_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    tune(spark, 200)
    return derivatives(table(spark, sf_dir, "pages"))
