"""WARC derivatives: responses with linked metadata and plain-text conversion records, and WARC files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.store import mapped, small_batches

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, URLs
#: Fixed values of HTML: elements without readable text, and elements that end a line.
SILENT = frozenset({"script", "style", "head", "noscript", "template", "svg"})
BREAKS = frozenset({"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "blockquote", "pre", "hr", "title"})
IN_HEAD = frozenset({"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"})
_RECORDS = "page_id long, record_id string, type string, refers_to string, concurrent_to string, target_uri string, date string, content_type string, content_length long, block_digest string, payload_digest string, source_headers map<string,string>, content binary"
_NAMES = [x.split()[0] for x in _RECORDS.replace("map<string,string>", "map").split(", ")]
_KINDS = {"page_id": pa.int64(), "content_length": pa.int64(), "source_headers": pa.map_(pa.string(), pa.string()), "content": pa.binary()}
#: Fixed values of WARC 1.1: its field names, in the order of the columns they stand for.
_FIELDS = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "concurrent_to": "WARC-Concurrent-To", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type", "content_length": "Content-Length"}
#: Extension fields of the files written here: a page's number, and the HTTP headers of the source, one a line.
_PAGE, _SOURCE = "X-Page-ID", "X-Source-Header"
#: A gzip member without content. It stands between records, as Spark's text writer wants a separator.
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)


@dataclass(frozen=True)
class Warc:
    """``date``: capture time of a page whose table has none; ``largest``: bytes that a payload
    may have once its compression is undone, so that a small record can't fill a task."""

    date: str = "1970-01-01T00:00:00Z"
    largest: int = 256 << 20


class _Text(HTMLParser):
    """Collects readable text. The text inside a silent element is dropped when its end tag
    comes, so one that is never ended hides nothing; script and style hide theirs at once. A head
    ends, as in HTML, at its end tag or before the first thing that may not stand in it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str | None] = []  # None: a line ends
        self.title: list[str] = []
        self.open: list[tuple[str, int]] = []  # silent elements, and where their text starts
        self.links, self.in_title = 0, False

    def _place(self, tag: str) -> int | None:
        return next((k for k in reversed(range(len(self.open))) if self.open[k][0] == tag), None)

    def _top(self) -> str:
        return self.open[-1][0] if self.open else ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open:
            if tag == "body" and self._place("template") is None:
                self.open.clear()
            elif self._top() == "head" and tag not in IN_HEAD:
                self.open.pop()
        if tag == "noscript" and (k := self._place(tag)) is not None:  # can't stand in itself: the first was not ended
            del self.open[k]
        if tag in SILENT:
            self.open.append((tag, len(self.out)))
        if tag == "title":
            self.in_title = True
        elif tag == "a":
            self.links += any(k == "href" and v for k, v in attrs)
        if tag in BREAKS:
            self.out.append(None)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT and (k := self._place(tag)) is not None:
            start = self.open[k][1]
            del self.open[k:]
            if tag != "head":
                self.out[start:] = [x for x in self.out[start:] if x is None]
        if tag == "title":
            self.in_title = False
        if tag in BREAKS:
            self.out.append(None)

    def handle_data(self, data: str) -> None:
        if not self.open and not self.in_title:
            self.out.append(data)
        elif self.in_title:
            self.title.append(data)
        elif self._top() not in ("script", "style"):
            if self._top() == "head":
                if not data.strip():
                    return
                self.open.pop()
            self.out.append(data)


#: Markup that is read without the parser: plain tags, comments without a double hyphen inside, and a document type.
#: A slash behind a value without quotes is part of the value, so such a tag is left to the parser.
_ATTRIBUTE = r"""\s+[a-zA-Z][a-zA-Z0-9-]*(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[a-zA-Z0-9_.:#-]+(?!/)))?"""
_MARKUP = re.compile(rf"""<(?:([a-zA-Z][a-zA-Z0-9]*)((?:{_ATTRIBUTE})*)\s*(/?)>|/([a-zA-Z][a-zA-Z0-9]*)\s*>|!--(?!-?>)(?:(?!--)[^<>])*-->|!(?i:doctype)\s[^<>]*>)""")
_HREF = re.compile(r"""\shref\s*=\s*(?:"[^"]|'[^']|[^\s"'])""", re.I)
_CLOSE = {tag: re.compile(f"</{tag}", re.I) for tag in ("script", "style", "title")}
#: Elements whose content has rules of its own.
_RARE = frozenset({"textarea", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext", "svg", "math", "listing"})


def _read_plainly(parser: _Text, html: str) -> bool:
    """Feed ``parser`` the events of a page made of plain markup alone, or tell that it isn't one.

    The events are those that the parser finds itself, at a third of its cost; a page with
    anything else is left to it as a whole.
    """
    at, events = 0, []
    while (spot := html.find("<", at)) >= 0:
        if spot > at:
            events.append((None, html[at:spot], True))
        m = _MARKUP.match(html, spot)
        if not m:
            return False
        at = m.end()
        start, attributes, closed, end = m.groups()
        if end:
            events.append((end.lower(), None, False))
        elif start:
            tag = start.lower()
            if tag in _RARE:
                return False
            events.append((tag, attributes if tag == "a" else "", True))
            if closed:
                if tag in ("script", "style", "title"):
                    return False
                events.append((tag, None, False))
            elif tag in ("script", "style", "title"):
                m = _CLOSE[tag].search(html, at)
                if not m or html[m.end() : m.end() + 1] != ">" or ("<" if tag == "title" else "<!--") in html[at : m.start()]:
                    return False
                if m.start() > at:
                    events.append((None, html[at : m.start()], tag == "title"))
                at = m.start()
    if at < len(html):
        events.append((None, html[at:], True))
    for tag, value, flag in events:
        if tag is None:
            parser.handle_data(unescape(value) if flag and "&" in value else value)
        elif flag:
            parser.handle_starttag(tag, [("href", "x")] if value and _HREF.search(value) else [])
        else:
            parser.handle_endtag(tag)
    return True


def plain_text(html: str) -> tuple[str, str, int]:
    """Readable text, title and number of links of a page; markup that doesn't parse is read as text."""
    parser = _Text()
    try:
        if not _read_plainly(parser, html):
            parser.feed(html)
            parser.close()
    except (AssertionError, ValueError):  # html.parser gives up on some broken declarations
        return re.sub(r"<[^>]*>", " ", html).strip(), "", 0
    lines = (" ".join(x.split()) for x in "".join("\n" if x is None else x for x in parser.out).split("\n"))
    return "\n".join(x for x in lines if x), " ".join("".join(parser.title).split()), parser.links


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(31).join(parts))}>"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _host(url: str) -> str:
    try:
        return urlsplit(url).hostname or ""
    except ValueError:  # broken brackets, or a host that changes under Unicode normalization
        return ""


def _line(text: str) -> str:
    """A header value on one line."""
    return " ".join(str(text).split())


def http_parts(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers (names in small letters, repeated ones joined by commas) and payload of an HTTP response."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or not found:
        return "", {}, block
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            headers[name] = f"{headers[name]}, {value.strip()}" if name in headers else value.strip()
    return status, headers, payload


def _inflated(data: bytes, window: int, limit: int) -> bytes | None:
    """All compressed members of ``data``; None where one is broken or cut off, or their content is over ``limit`` bytes."""
    parts, size = [], 0
    while data:
        one = zlib.decompressobj(window)
        try:
            parts.append(one.decompress(data, limit - size + 1))
        except zlib.error:
            return None
        size += len(parts[-1])
        if not one.eof or size > limit:
            return None
        data = one.unused_data.lstrip(b"\0") if window == 31 else b""  # files are padded with zeros
    return b"".join(parts)


def _decoded(payload: bytes, coding: str, limit: int) -> bytes | None:
    """The payload without its content codings, the last one first; None where one is unknown or doesn't hold."""
    for kind in reversed([c.strip() for c in coding.lower().split(",")]):
        if kind in ("gzip", "x-gzip"):
            if payload.startswith(b"\x1f\x8b"):  # else whoever wrote the file has undone it
                payload = _inflated(payload, 31, limit)
        elif kind == "deflate":
            wrapped = _inflated(payload, 15, limit)
            payload = wrapped if wrapped is not None else _inflated(payload, -15, limit)
        elif kind not in ("", "identity"):
            return None
        if payload is None:
            return None
    return payload


def readable(headers: dict[str, str], payload: bytes, limit: int = Warc.largest) -> str | None:
    """The payload as text: chunks joined, compression undone, bytes decoded by the charset named.

    None where the text can't be had: unknown codings, broken or cut-off compression, more than
    ``limit`` bytes.
    """
    if "chunked" in headers.get("transfer-encoding", "").lower():
        rest, parts = memoryview(payload), []
        while m := re.match(rb"\s*([0-9A-Fa-f]{1,8})[^\r\n]*\r\n", rest):
            size = int(m[1], 16)
            parts.append(rest[m.end() : m.end() + size])
            rest = rest[m.end() + size :] if size else rest[:0]
        payload = b"".join(parts) if parts else payload
    payload = _decoded(payload, headers.get("content-encoding", ""), limit)
    if payload is None:
        return None
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", headers.get("content-type", ""), re.I) or re.search(r"<meta[^>]*charset\s*=\s*[\"']?([\w.:-]+)", payload[:4096].decode("latin-1"), re.I)
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except (LookupError, ValueError):  # no charset, or one that has no such bytes
        return payload.decode("utf-8", "replace")


def _rows(records: Iterable[dict]) -> pa.RecordBatch:
    records = list(records)
    columns = [pa.array([list((r.get(n) or {}).items()) if n == "source_headers" else r.get(n) for r in records], _KINDS.get(n, pa.string())) for n in _NAMES]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def _response(page: int | None, url: str | None, html: bytes | None, date: str | None, status: int | None, headers: dict | None, given: str | None, p: Warc) -> dict:
    url, body = _clean(url or "urn:unknown"), html or b""
    named = {_line(k).lower(): _line(v) for k, v in (headers or {}).items() if v is not None}
    named = {"content-type": "text/html; charset=utf-8"} | named | {"content-length": str(len(body))}
    for gone in ("transfer-encoding", "content-encoding"):  # the table holds the text itself
        named.pop(gone, None)
    lines = "".join(f"{k}: {v}\r\n" for k, v in named.items())
    block = f"HTTP/1.1 {status or 200} {'OK' if (status or 200) == 200 else ''}\r\n{lines}\r\n".encode() + body
    payload = digest(body)
    return {
        "page_id": page, "record_id": given or record_id("response", str(page), url, payload), "type": "response", "target_uri": url, "date": date or p.date,
        "content_type": "application/http; msgtype=response", "content_length": len(block), "block_digest": digest(block), "payload_digest": payload, "source_headers": named, "content": block,
    }


def responses(pages: DataFrame, p: Warc = Warc(), page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a table of pages.

    ``date``, ``status``, ``headers`` (a map) and ``record_id`` are taken from columns of these
    names where the table has them and a row a value; otherwise they are ``p.date``, 200, a
    content type of HTML in UTF-8, and an id that follows from page, URI and payload, so that
    a repeated task writes the same one and repeated rows have the same. A null page is an
    empty one, a null URL ``urn:unknown``; white space and control characters in a URL are
    percent-encoded. An empty table gives an empty result; further columns are not read.
    """
    given = {"date": "string", "status": "int", "headers": "map<string,string>", "record_id": "string"}
    columns = [(F.col(c) if c in pages.columns else F.lit(None)).cast(k).alias(c) for c, k in given.items()]
    slim = pages.select(F.col(page_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").cast("binary").alias("html"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(1).cast(pa.binary()).to_pylist()
            for i in range(0, batch.num_rows, 50):
                part = [batch.column(c).slice(i, 50).to_pylist() for c in (0, 2, 3, 4, 5, 6)]
                texts = (None if u is None else u.decode("utf-8", "replace") for u in urls[i : i + 50])
                yield _rows(_response(page, url, html, date, status, dict(headers or ()), given, p) for url, page, html, date, status, headers, given in zip(texts, *part, strict=True))

    return mapped(slim, run, _RECORDS)


def _derived(r: dict) -> Iterator[dict]:
    """The metadata and the conversion record of a response."""
    status, headers, payload = http_parts(r["content"] or b"")
    kind = headers.get("content-type", "").split(";")[0].strip().lower()
    html = readable(headers, payload)
    text, title, links = (None, "", 0) if html is None else plain_text(html) if kind in ("", "text/html", "application/xhtml+xml") else (html, "", 0) if kind.startswith("text/") else (None, "", 0)
    source = r["payload_digest"] or digest(payload)
    fields = {"title": title, "host": _host(r["target_uri"] or ""), "links": links, "text-characters": len(text or ""), "source-status": status, "source-payload-digest": source}
    fields |= {f"source-header-{k}": v for k, v in headers.items()}
    block = "".join(f"{k}: {_line(v)}\r\n" for k, v in fields.items()).encode()
    common = {"page_id": r["page_id"], "target_uri": r["target_uri"], "date": r["date"], "source_headers": headers, "refers_to": r["record_id"]}

    def record(kind: str, content: bytes, content_type: str, **more: str) -> dict:
        return common | more | {"record_id": record_id(kind, r["record_id"] or ""), "type": kind, "content_type": content_type, "content_length": len(content), "block_digest": digest(content), "content": content}

    yield record("metadata", block, "application/warc-fields", concurrent_to=r["record_id"])
    if text is not None:
        yield record("conversion", text.encode("utf-8", "replace"), "text/plain; charset=utf-8", payload_digest=source)


def derivatives(records: DataFrame, with_response: bool = True) -> DataFrame:
    """Linked derivatives of the response records among ``records`` (from ``responses`` or ``read_warc``).

    Each response gives a metadata record (title, host, links, status and every HTTP header of
    the source) and, if it is HTML or other text, a conversion record whose block is the plain
    text; a payload whose compression is unknown, broken or larger than ``Warc.largest`` has
    metadata alone. Both name the response in ``refers_to`` and carry its URI, date and HTTP headers;
    the conversion carries the digest of the payload it was made from: the response's own
    one, or a computed one where it has none. Their ids follow from the response's id, so
    repeated tasks and repeated rows give the same. Responses that are no HTTP message are read
    as HTML; broken URLs have no host; bytes that the charset doesn't know become U+FFFD.
    Pages of any length are converted whole. Records of other types give nothing, an empty
    table gives an empty result, further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 50):
                part = [r | {"source_headers": dict(r["source_headers"] or ())} for r in batch.slice(i, 50).to_pylist() if r["type"] == "response"]
                yield _rows(x for r in part for x in (*((r,) if with_response else ()), *_derived(r)))

    return mapped(records.select(*_NAMES), run, _RECORDS)


def _written(r: dict) -> bytes:
    """A record as WARC 1.1, in a gzip member of its own, so that a reader can seek it."""
    content = r["content"] or b""
    lines = ["WARC/1.1"] + [f"{name}: {_line(r[column])}" for column, name in _FIELDS.items() if r[column] is not None and column != "content_length"]
    lines += [f"{_PAGE}: {r['page_id']}"] * (r["page_id"] is not None)
    lines += [f"{_SOURCE}: {k}: {_line(v)}" for k, v in r["source_headers"] or () if r["type"] != "response"]  # a response's stand in its block
    return gzip.compress("\r\n".join([*lines, f"Content-Length: {len(content)}", "", ""]).encode() + content + b"\r\n\r\n", 1, mtime=0)


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as WARC files, each record compressed by itself.

    Spark's text writer commits the files, so lost tasks are redone; between two records it
    writes an empty gzip member, which readers pass over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 50):
                yield pa.RecordBatch.from_arrays([pa.array([_written(r) for r in batch.slice(i, 50).to_pylist()], pa.binary())], ["value"])

    with small_batches(records.sparkSession):
        members = mapped(records.select(*_NAMES), run, "value binary").select(F.col("value").cast("string"))
        members.write.option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def _members(data: bytes) -> Iterator[bytes]:
    """The decompressed gzip members of a file, up to a broken one, or the file itself if it isn't compressed."""
    view = memoryview(data)
    if bytes(view[:2]) != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(view):
        one, parts = zlib.decompressobj(31), []
        while at < len(view) and not one.eof:
            piece = view[at : at + (1 << 16)]
            try:
                parts.append(one.decompress(piece))
            except zlib.error:
                return
            at += len(piece) - len(one.unused_data)
        yield b"".join(parts)


def _parsed(data: bytes) -> Iterator[dict]:
    """The records of a member; it ends at the first thing that isn't one, a length of other than digits included.

    Each record lies behind the one before, whatever its header says. One that is cut off has
    the bytes that are there.
    """
    at = 0
    while data.startswith(b"WARC/", at) and (end := data.find(b"\r\n\r\n", at)) >= 0:
        known, sources, page = {}, {}, None
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            name, value = name.strip().lower(), value.strip()
            if name == _SOURCE.lower():
                key, _, value = value.partition(": ")
                sources[key] = value
            elif name == _PAGE.lower():
                page = int(value) if re.fullmatch(r"-?[0-9]{1,18}", value) else None
            else:
                known[name] = value
        length = known.get("content-length", "0")
        if not re.fullmatch("[0-9]{1,18}", length):
            return
        size = int(length)
        content = data[end + 4 : end + 4 + size]
        row = {column: known.get(name.lower()) for column, name in _FIELDS.items()}
        if row["type"] == "response":
            sources = http_parts(content)[1]
        yield row | {"page_id": page, "content_length": size, "source_headers": sources, "content": content}
        at = end + 8 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, compressed record by record, as one member, or not at all.

    A file is one row of Spark's binary source until it is cut, so files may have 2 GB at most
    and a task holds one. The HTTP headers of a response are read from its block. Records of
    all types come back, in any order; columns are those of ``responses``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held, size = [], 0
                for member in _members(batch.column(0)[row].as_py()):
                    for r in _parsed(member):
                        held.append(r)
                        size += len(r["content"])
                        if len(held) == 50 or size > 1 << 20:
                            yield _rows(held)
                            held, size = [], 0
                if held:
                    yield _rows(held)

    files = spark.read.format("binaryFile").load(path).select("content")
    return mapped(files, run, _RECORDS, 1)
