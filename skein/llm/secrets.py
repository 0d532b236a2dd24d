"""Secret scans: fixed patterns, and strings in sensitive contexts that a zstandard dictionary of their surroundings can't compress."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from math import log2

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import sliced

ASSIGN = re.compile(r"""(?P<kind>(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
#: Words that make a context sensitive, and what may stand between one and its value.
SENSITIVE = re.compile(
    r"""(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|authorization|bearer|credential|signature|session|cookie)[A-Za-z_-]{0,16}["'\x20:=>(,\[]{1,8}(?:(?:is|bearer|basic)[\x20:]+)?([A-Za-z0-9+/_.=~-]{16,})""",
    re.ASCII,
)
HINTS = (b"pass", b"pwd", b"secret", b"token", b"api", b"key", b"auth", b"bearer", b"credential", b"signature", b"session", b"cookie")
#: Identifiers that code around a secret commonly holds; they prime the compressor.
IDENTIFIERS = (
    "import os.environ.get config settings client server request response headers Authorization Bearer Basic username user_id account database connection string "
    "localhost http://www.example.com https://api.example.com/v1/ index.html true false null None return function const let var public static private class self this "
    "access_key_id secret_access_key client_secret refresh_token session_token api_key password example placeholder changeme your_token_here xxxxxxxxxxxxxxxx "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ application/json content-type utf-8 text/html charset version name value default"
).encode()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), each kind leftmost and non-overlapping; matches that are too short are passed over whole."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class Novelty:
    """Marginal compressed bytes of a string after its surroundings, with the identifiers and the surroundings as dictionary."""

    def __init__(self, around: int = 256, level: int = 3):
        self.around, self.level = around, level

    def __call__(self, text: str, start: int, end: int) -> float:
        """Compressed bytes that the candidate adds, by character: near 0 for what the surroundings or identifiers hold, over 0.5 for random strings."""
        before, after = text[max(0, start - self.around) : start].encode(), text[end : end + self.around].encode()
        own = text[start:end].encode()
        primed = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + after + b"\n" + before, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        return (len(primed.compress(before + own)) - len(primed.compress(before))) / len(own)


def incompressible(own: str) -> float:
    """Bytes by character that a random string of as many different symbols adds at least: their entropy, and 4 bytes in all for the coder's table."""
    return log2(len(set(own))) / 8 + 4 / len(own)


def novel_spans(text: str, taken: list[tuple[int, int, str]], novelty: Novelty, least: float, symbols: int) -> list[tuple[int, int, str]]:
    """Strings of 16 or more in a sensitive context that base spans don't overlap and that add at least `least` bytes by character, or what random ones of their length and symbols add."""
    out = []
    # both in the order of their starts: base spans that begin before a candidate's end, and how far those reach, are swept along
    at, reach = 0, -1
    for m in SENSITIVE.finditer(text):
        start, end = m.span(1)
        own = m.group(1)
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        if reach > start or len(set(own)) < symbols:
            continue
        if novelty(text, start, end) >= min(least, incompressible(own)):
            out.append((start, end, "novel"))
    return out


def spans_of(text: str, novelty: Novelty, least: float = 0.65, symbols: int = 8) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, each in the order of their starts."""
    data = text.encode()
    lowered = data.lower()
    base = base_spans(text) if any(h in lowered for h in HINTS) else [s for s in base_spans_plain(text, data)]
    extra = novel_spans(text, base, novelty, least, symbols) if any(h in lowered for h in HINTS) else []
    return base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2]))) if extra else base


def base_spans_plain(text: str, data: bytes) -> list[tuple[int, int, str]]:
    """Base spans of a text without any hint word, which can't hold an assignment."""
    out = [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if b"AKIA" in data else []
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, least: float = 0.65, symbols: int = 8, around: int = 256) -> DataFrame:
    """doc_id and its spans: array of (kind, start, end), code points, end exclusive, base spans (assign, access, hex) and novel ones.

    Null text counts as empty: no spans. Null doc_id stays null; repeated rows are scanned each; an empty table gives no rows; other columns are
    ignored. Every text is scanned whole; candidates in a text are judged against its own surroundings, so results don't depend on other rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(around)
        for batch in sliced(batches):
            found = [spans_of(t or "", novelty, least, symbols)[1] for t in batch.column("text").to_pylist()]
            spans = pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), spans], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(scanned: DataFrame) -> DataFrame:
    """The counts by kind, the hash of the base spans and all spans as text."""
    from pyspark.sql import functions as F

    def text(kind):
        return F.array_join(F.transform(kind, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return scanned.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), n("novel"))


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """docs with every span of its text replaced by `mark` (spans that overlap: by one) and n_chars, if there is one, brought up to date.

    All rows and columns stay; null and empty texts stay as they are.
    """
    names = [f.name for f in docs.schema.fields]
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None
    least, symbols, around = options.get("least", 0.65), options.get("symbols", 8), options.get("around", 256)

    def clean(text: str | None, novelty: Novelty) -> str | None:
        spans = spans_of(text, novelty, least, symbols)[1] if text else []
        if not spans:
            return text
        out, done = [], 0
        for a, b, _ in spans:
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(around)
        for batch in sliced(batches):
            old = batch.column(at).to_pylist()
            new = [clean(t, novelty) for t in old]
            if new == old:
                yield batch
                continue
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if chars is not None:
                counts = batch.column(chars).to_pylist()
                columns[chars] = pa.array([len(n) if n != o else c for n, o, c in zip(new, old, counts, strict=True)], batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
