"""Benchmark decontamination with an FM-index over each shard of the training texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, raw, sliced
from .fmindex import FMIndex

#: Bytes that part words become blanks, capitals become small; all from 0x80 on belongs to words.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Documents of a shard.
SHARD_ROWS = 2000
#: Symbols of one index; more of a shard's words go to a further index.
INDEX_SYMBOLS = 400_000
#: Benchmark bytes that one pass over the documents looks for; a larger benchmark takes several passes. A pass holds some 50 bytes of windows a byte.
PASS_BYTES = 2 << 20
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
BREAK = 1


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Phrases:
    """Distinct windows of the benchmark items of one pass, by length, over the symbols 2 .. of their words, with the items that hold each."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.symbols: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            own = [self.symbols.setdefault(w, len(self.symbols) + 2) for w in words_of(text)]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[i : i + window]), set()).update([item] if item is not None else [])
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for w in sorted(found):
            by_length.setdefault(len(w), []).append(w)
        self.groups = [(n, np.array(ws, dtype=np.int64), [sorted(found[w]) for w in ws]) for n, ws in sorted(by_length.items())]
        self.least = min(by_length, default=0)


class Shard:
    """Texts whose runs of benchmark words are indexed together. Words outside the benchmark break runs, and runs too short for any window are left out."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.clear()

    def clear(self) -> None:
        self.parts, self.docs, self.places, self.size = [], [], [], 0

    def add(self, doc: int, words: list[bytes]) -> None:
        get = self.phrases.symbols.get
        ids = np.array([get(w, BREAK) for w in words], dtype=np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids != BREAK).astype(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= self.phrases.least:
                self.parts += [ids[a:b], np.array([BREAK])]
                self.docs += [np.full(b - a + 1, doc)]
                self.places += [np.arange(a, b + 1)]
                self.size += b - a + 1

    def search(self) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """Merged hit spans and items by document."""
        out: dict[int, tuple[list, set]] = {}
        if not self.size:
            return out
        docs, places = np.concatenate(self.docs), np.concatenate(self.places)
        index = FMIndex(np.concatenate(self.parts), len(self.phrases.symbols) + 2)
        self.clear()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length, patterns, items in self.phrases.groups:
            low, high = index.ranges(patterns)
            which = np.flatnonzero(high > low)
            counts = (high - low)[which]
            rows = np.repeat(low[which] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            at = index.locate(rows)
            owner, start = docs[at], places[at]
            found.append((owner, start, start + length))
            pairs = np.unique(owner * len(items) + np.repeat(which, counts))
            for doc, w in zip((pairs // len(items)).tolist(), (pairs % len(items)).tolist(), strict=True):
                out.setdefault(doc, ([], set()))[1].update(items[w])
        owner, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((start, owner))
        owner, start, end = owner[order], start[order], end[order]
        # places of all documents on one line, apart, so that a running maximum of the ends stays within a document
        line = owner * (int(end.max(initial=0)) + 2)
        reach = np.maximum.accumulate(line + end)
        fresh = np.flatnonzero(np.append(True, (line + start)[1:] > reach[:-1])) if len(owner) else owner
        last = np.append(fresh[1:], len(owner)) - 1 if len(owner) else owner
        for doc, a, b in zip(owner[fresh].tolist(), start[fresh].tolist(), (reach - line)[last].tolist(), strict=True):
            out[doc][0].append((a, b))
        return out


def find(docs: DataFrame, benchmark: DataFrame, window: int = 13, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """All columns of docs, with __n_words, __spans (merged spans of hit words, end exclusive) and __items (ids of the items that hit, as strings, sorted).

    A window is `window` consecutive words of an item, or all words of a shorter one; words are runs of letters and digits, A-Z lower-cased. Each
    batch of SHARD_ROWS texts is a shard: its words are indexed, the windows searched backwards through wavelet ranks, and occurrences located by sampled positions.
    Texts are not shuffled while the benchmark fits one pass. A larger one goes out in passes of bounded bytes, one at a time: each is searched for in all
    texts, and what it hits (by the text's md5, one row for each different text) is written before the next is sent; last, all hits of a text are united and joined to its rows.

    Null or empty text: no words, no hits. Items without words, or with null text, match nothing; an item with a null id hits but isn't named. Repeated
    rows are treated each alike; very long texts go to an index of their own, whole; with an empty benchmark nothing hits; an empty table gives no rows. Columns
    of docs that have these three names are an error.
    """
    if clash := {c.lower() for c in docs.columns} & {"__n_words", "__spans", "__items"}:
        raise ValueError(f"columns of the documents are named as the result's: {sorted(clash)}")
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("b")).first()["b"]
    passes = max(1, -(-int(total) // pass_bytes))

    def sent(p: int):
        got = (items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p)).toArrow()
        return spark.sparkContext.broadcast(Phrases(sorted(zip(got["item_id"].to_pylist(), raw(got["text"]), strict=True), key=lambda x: (x[0] is None, x[0] or "", x[1])), window))

    if passes == 1:
        made = [T.StructField("__n_words", T.LongType()), T.StructField("__spans", SPANS), T.StructField("__items", T.ArrayType(T.StringType()))]
        return docs.mapInArrow(_finder(sent(0), docs.columns, docs.columns), T.StructType([*docs.schema.fields, *made]))
    md, own = fresh(docs.columns, "__md", "__own")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.md5(text.cast("binary")).alias("md"), text.alias("text"))
    hits = None
    for p in range(passes):
        shared = sent(p)
        found = keyed.mapInArrow(_finder(shared, ["md", "text"], ["md"]), "md string, __n_words long, __spans array<struct<start:long,end:long>>, __items array<string>")
        found = materialize(found.where(F.size("__spans") > 0).groupBy("md").agg(F.first("__spans").alias("spans"), F.first("__items").alias("items")))
        shared.destroy()
        hits = found if hits is None else hits.unionByName(found)
    sorted_spans = F.array_sort(F.flatten(F.collect_list("spans")))
    empty = F.array().cast(SPANS)
    # spans in the order of their starts, each united with the last one so far where they overlap or touch
    united = F.aggregate(
        sorted_spans,
        empty,
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["start"] <= F.element_at(done, -1)["end"]),
            F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    each = hits.groupBy("md").agg(united.alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items")).withColumnRenamed("md", own)
    joined = docs.withColumn(md, F.md5(text.cast("binary"))).join(each, F.col(md) == F.col(own), "left")
    words = F.regexp_count(text, F.lit(WORD.pattern)).cast("long")
    return joined.select(*docs.columns, words.alias("__n_words"), F.coalesce("__spans", empty).alias("__spans"), F.coalesce("__items", F.array().cast("array<string>")).alias("__items"))


def _finder(shared, columns: list[str], keep: list[str]):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch in sliced(batches, SHARD_ROWS):
            shard, found, counts = Shard(phrases), {}, []
            for i, text in enumerate(raw(batch.column(columns.index("text")))):
                words = words_of(text)
                counts.append(len(words))
                shard.add(i, words)
                if shard.size >= INDEX_SYMBOLS:
                    found |= shard.search()
            found |= shard.search()
            spans, names = [found.get(i, ([], set()))[0] for i in range(len(counts))], [found.get(i, ([], set()))[1] for i in range(len(counts))]
            made = [pa.array(counts, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span), pa.array([sorted(n) for n in names], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in keep), *made], names=[*keep, "__n_words", "__spans", "__items"])

    return run


def hit_words() -> F.Column:
    return F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated() -> F.Column:
    return (hit_words() > 0) & (20 * hit_words() >= F.col("__n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    return find(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated documents; the others lose their hit words, each span with what stands between its words, and keep all else.

    Null and empty texts stay as they are; n_chars, if there is one, is brought up to date where a text was cut; else as find() says.
    """
    columns = docs.columns
    marked = find(docs, benchmark).where(~contaminated()).select(*columns, "__spans")
    at, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SHARD_ROWS):
            arrays = list(batch.columns[:-1])
            spans = batch.column(len(columns)).to_pylist()
            if any(spans):
                texts = arrays[at].to_pylist()
                counts = arrays[chars].to_pylist() if chars is not None else []
                for i, own in enumerate(spans):
                    if own:
                        texts[i] = cut(texts[i], [(s["start"], s["end"]) for s in own])
                        if chars is not None:
                            counts[i] = len(texts[i])
                arrays[at] = pa.array(texts, batch.schema.field(at).type)
                if chars is not None:
                    arrays[chars] = pa.array(counts, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return marked.mapInArrow(run, T.StructType(docs.schema.fields))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, given by word index."""
    places = [m.span() for m in WORD.finditer(text)]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : places[a][0]])
        done = places[b - 1][1]
    return "".join([*out, text[done:]])


REPORT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bl AS (SELECT item_id, w, CAST(least(13, len(w)) AS BIGINT) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM bl)),
dn AS (SELECT d.doc_id, d.w, x.n FROM d, (SELECT DISTINCT n FROM bl) x WHERE len(d.w) >= x.n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dn)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
