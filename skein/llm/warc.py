"""Derivatives of web archives: each response gets a metadata record and a plain-text conversion record that refer to it."""

from __future__ import annotations

import base64
import gzip
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()), ("payload_digest", pa.string()), ("source_headers", pa.string()), ("block", pa.string())]
)
DDL = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, source_headers string, block string"
#: A capture time for pages that come without one.
UNDATED = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: A comment's start, a tag to its end (or to the end of the page, if it is never closed) or a declaration. Every match takes what it has looked at, so a page is read once.
TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?|["'<>/=]""")
#: Elements whose content is no text, with what ends them; elements that end a line.
HIDDEN = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "noscript", "template")}
TITLE_END = re.compile(r"</title", re.IGNORECASE)
BREAKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section header footer nav blockquote pre hr title main aside form dd dt".split())
#: Numbers of characters that no text can hold; html.unescape() would turn them into integers of any length.
ENDLESS = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
CHARSET = re.compile(rb"""charset\s{0,9}=\s{0,9}["']?([A-Za-z0-9_-]{1,40})""", re.IGNORECASE)


#: Bytes that a record's header has at most.
HEADER = 1 << 20


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1(data, usedforsecurity=False).digest()).decode()


def unescaped(text: str) -> str:
    return html.unescape(ENDLESS.sub("\ufffd", text)) if "&" in text else text


def attributes(inside: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name, entities resolved; the first of a name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(inside):
        if m[1]:
            out.setdefault(m[1].lower(), unescaped(next((x for x in m.groups()[1:] if x is not None), "")))
    return out


class Page:
    """Title, language, character set, link targets (as written) and visible text of a page, from one pass over its tags.

    Comments, head, scripts and styles give no text, block tags end lines, entities are resolved, runs of blanks are one. Whatever is never closed goes on to the end.
    """

    def __init__(self, page: str):
        self.title = self.lang = self.charset = None
        self.links: list[str] = []
        parts: list[str] = []
        at, head, titled = 0, False, True
        while m := TOKEN.search(page, at):
            if not head:
                parts.append(page[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if m[0] == "<!--":
                end = page.find("-->", at)
                at = end + 3 if end >= 0 else len(page)
                parts.append(" ")
            elif name in HIDDEN and not m[1]:
                end = HIDDEN[name].search(page, at)
                at = end.end() if end else len(page)
                parts.append(" ")
            elif name == "head":
                head = not m[1]
                parts.append(" ")
            elif name == "title" and not m[1] and self.title is None and titled:
                end = TITLE_END.search(page, at)
                titled = end is not None
                self.title = " ".join(unescaped(page[at : end.start()]).split()) if end else None
            elif not m[1] and name in ("a", "html", "meta"):
                own = attributes(m[3])
                if name == "a" and "href" in own:
                    self.links.append(own["href"])
                elif name == "html" and self.lang is None:
                    self.lang = own.get("lang", "").strip().lower() or None
                elif name == "meta" and self.charset is None:
                    found = CHARSET.search(own.get("content", "").encode()) if own.get("http-equiv", "").lower() == "content-type" else None
                    self.charset = own.get("charset", "").strip().lower() or (found[1].decode().lower() if found else None)
            if name == "body":
                head = False
            if name in BREAKS:
                parts.append("\n")
        if not head:
            parts.append(page[at:])
        lines = (" ".join(line.split()) for line in unescaped("".join(parts)).split("\n"))
        self.text = "\n".join(line for line in lines if line)


def plain_text(page: str) -> str:
    return Page(page).text


def decoded(payload: bytes, headers: str) -> str:
    """The payload as text: by the character set of its HTTP headers, else of a meta tag in its first 1 024 bytes, else UTF-8; bytes that don't fit become U+FFFD."""
    found = CHARSET.search(headers.encode()) or CHARSET.search(payload[:1024])
    try:
        return payload.decode(found[1].decode() if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def record_id(kind: str, *parts: str) -> str:
    """A name-based identifier: reruns, and retried tasks, give the same."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join([kind, *parts]))}>"


def derive(page_id: int | None, uri: str, date: str, headers: str, payload: str | bytes, source_id: str | None = None, ordinal: str = "", block_digest: str | None = None, payload_digest: str | None = None, source: str | None = None) -> list[tuple]:
    """The response as rebuilt, its metadata record and its conversion record. A payload of bytes is digested as it is; its rebuilt block is its decoded text."""
    data = payload.encode() if isinstance(payload, str) else payload
    text_of = payload if isinstance(payload, str) else decoded(payload, headers)
    before = headers.rstrip("\r\n") + "\r\n\r\n" if headers else ""
    own_payload, own_block = digest(data), digest(before.encode() + data)
    own = source_id or record_id("response", str(page_id), uri, date, own_payload, ordinal)
    page = Page(text_of)
    links = list(dict.fromkeys(safe_join(uri, x) for x in page.links))
    meta = json.dumps(
        {
            "title": page.title,
            "lang": page.lang,
            "charset": page.charset,
            "links": links,
            "payload_bytes": len(data),
            "text_chars": len(page.text),
            "source_block_digest": block_digest or own_block,
            "source_payload_digest": payload_digest or own_payload,
            "payload_intact": payload_digest in (None, own_payload) if (payload_digest or "sha1:").startswith("sha1:") else None,
            "source_headers": headers or None,
            "source_record": source,
        },
        ensure_ascii=False,
        separators=(",", ":"),
    )
    kind = "application/http; msgtype=response" if headers else "text/html"
    out = [(page_id, "response", own, None, uri, date, kind, len(before.encode()) + len(data), own_block, own_payload, headers or None, before + text_of)]
    for name, content, body in (("metadata", "application/json", meta), ("conversion", "text/plain", page.text)):
        d = digest(body.encode())
        out.append((page_id, name, record_id(name, own), own, uri, date, content, len(body.encode()), d, (payload_digest or own_payload) if name == "metadata" else d, headers or None, body))
    return out


def safe_join(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return link


#: Columns that read_responses() gives beside page_id, url and html, by the arguments of derivatives() that name them.
SOURCE = {"date": "date", "headers": "headers", "source_id": "source_id", "payload": "payload", "block_digest": "block_digest", "payload_digest": "payload_digest", "source": "source"}


def derivatives(pages: DataFrame, date: str | None = None, headers: str | None = None, source_id: str | None = None, responses: bool = False, ordinal: str | None = None, payload: str | None = None, block_digest: str | None = None, payload_digest: str | None = None, source: str | None = None) -> DataFrame:
    """The metadata and conversion records of every page (page_id, url, html), linked to its response; with responses=True those too.

    date, headers, source_id: names of the columns that hold the capture time, the HTTP header block and the response's record id; where there
    are none, UNDATED, no headers and a name-based identifier stand in. payload: a binary column that stands for html; digests and lengths are of its bytes, and its text is decoded by
    its declared character set (html is then not read, and responses must be False, as a text can't hold every payload). block_digest, payload_digest, source: the response's own WARC
    digests, and its other WARC headers; metadata keeps them, and says whether the payload still has its sha1. Where there are none, sha1 in base 32 is computed.
    refers_to is the response's identifier; source_headers is its header block as it was, which metadata keeps too.

    Null html is an empty payload, whose text is empty; a null url is an empty target; a null page_id stays null; an empty table gives no rows; other columns are ignored. Equal rows are one
    capture and give equal identifiers, unless ordinal names a column that tells them apart. Pages are read once, in time linear in their length, however broken; rows of long pages go out early.
    """
    if payload and responses:
        raise ValueError("responses of binary payloads stay in their files")
    page = F.col(payload).cast("binary") if payload else F.col("html").cast("string")
    named = (date, headers, source_id, ordinal, block_digest, payload_digest, source)
    given = [F.col(c).cast("string").alias(f"g{i}") if c else F.lit(None).cast("string").alias(f"g{i}") for i, c in enumerate(named)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in sliced(batches, 64):
            for number, uri, body, d, h, s, o, bd, pd, src in zip(*(batch.column(c).to_pylist() for c in range(10)), strict=True):
                made = derive(number, uri or "", d or UNDATED, h or "", body or ("" if not payload else b""), s, o or "", bd, pd, src)
                rows += made if responses else made[1:]
                held += len(body or "") + 256
                if held > 4 << 20:
                    yield to_batch(rows)
                    rows, held = [], 0
        if rows:
            yield to_batch(rows)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("u"), page.alias("p"), *given).mapInArrow(run, DDL)


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def serialize(record: dict) -> bytes:
    """One record as a gzip member of a WARC file."""
    block = (record["block"] or "").encode()
    head = {
        "WARC-Type": record["record_type"], "WARC-Record-ID": record["record_id"], "WARC-Refers-To": record["refers_to"], "WARC-Target-URI": record["target_uri"], "WARC-Date": record["warc_date"],
        "WARC-Block-Digest": record["block_digest"], "WARC-Payload-Digest": record["payload_digest"], "Content-Type": record["content_type"], "Content-Length": str(len(block)),
    }
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items() if v is not None)]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", mtime=0)


def inflated(data: bytes, step: int = 1 << 16) -> Iterator[bytes | None]:
    """The bytes of a WARC file in parts, gzip members one after the other. After a damage: None, then what follows from the next member that can be read."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), step):
            yield data[at : at + step]
        return
    at = 0
    while (at := data.find(b"\x1f\x8b\x08", at)) >= 0:
        member, start = zlib.decompressobj(wbits=31), at
        try:
            while at < len(data) and not member.eof:
                part = member.decompress(data[at : at + step])
                at = min(at + step, len(data))
                if part:
                    yield part
        except zlib.error:
            yield None
            at = start + 3
            continue
        if not member.eof:
            return
        at -= len(member.unused_data)


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, compressed by member or not: headers under lower-case names, and block.

    At most one record and one part are held. A record with a broken length, or cut short, is left out; reading goes on at the next one that starts with WARC/.
    """
    held = bytearray()
    for part in inflated(data):
        if part is None:
            held.clear()
            continue
        held += part
        at = 0
        while (at := held.find(b"WARC/", at)) >= 0:
            end = held.find(b"\r\n\r\n", at)
            if end - at > HEADER or end < 0 and len(held) - at > HEADER:  # no header is this long: the next that can end here
                at = max(at + 5, (end if end >= 0 else len(held)) - HEADER)
                continue
            if end < 0:
                break
            lines = bytes(held[at:end]).decode("utf-8", "replace").split("\r\n")[1:]
            head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            size = head.get("content-length", "")
            if not re.fullmatch(r"[0-9]{1,15}", size):
                at += 5
                continue
            stop = end + 4 + int(size)
            if stop > len(held):
                break
            yield head | {"block": bytes(held[end + 4 : stop])}
            at = stop
        del held[: at if at >= 0 else max(0, len(held) - 4)]  # a part of the mark may stand at the end


def page_number(path: str, ordinal: int) -> int:
    """A page_id from the file's path and the response's place in it: responses of different files have different ones, and reruns the same."""
    return int.from_bytes(sha1(f"{ordinal}\0{path}".encode(), usedforsecurity=False).digest()[:8]) >> 1


def read_responses(files: DataFrame) -> DataFrame:
    """Responses of WARC files, as Spark's binaryFile source gives them (path, content), ready for derivatives(responses, **SOURCE).

    page_id is of path and place; payload holds the bytes as they were, html their text; headers is the HTTP header block; block_digest and payload_digest
    are those that the record states; source is the path and all other WARC headers as JSON. A null content has no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "html", "payload", *(c for c in SOURCE.values() if c != "payload")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), *[pa.string()] * 6]
        known = {"block", "warc-type", "warc-target-uri", "warc-date", "warc-record-id", "warc-block-digest", "warc-payload-digest", "content-length"}
        for batch in sliced(batches, 1):
            path, content = batch.column("path")[0].as_py(), batch.column("content")[0].as_py()
            rows, held = [], 0
            for i, r in enumerate(x for x in parse(content or b"") if x.get("warc-type") == "response"):
                head, split, body = r["block"].partition(b"\r\n\r\n")
                head, body = (head, body) if split and head.startswith(b"HTTP/") else (b"", r["block"])
                headers = head.decode("utf-8", "replace")
                source = json.dumps({"path": path} | {k: v for k, v in r.items() if k not in known}, ensure_ascii=False)
                rows.append((page_number(path, i), r.get("warc-target-uri"), decoded(body, headers), body, r.get("warc-date"), headers, r.get("warc-record-id"), r.get("warc-block-digest"), r.get("warc-payload-digest"), source))
                held += len(body)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, "page_id long, url string, html string, payload binary, date string, headers string, source_id string, block_digest string, payload_digest string, source string")


def write(records: DataFrame, path: str) -> None:
    """Gzip-member WARC payloads as a Parquet table (record_id, member); concatenated members of a partition are a WARC file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array([serialize(r) for r in batch.to_pylist()], pa.binary())], names=["record_id", "member"])

    records.mapInArrow(run, "record_id string, member binary").write.mode("overwrite").parquet(path)
