"""Exact substring deduplication with fixed-block anchors.

Every window of `window` words holds a whole block of the grid of its document, of half the window's length. So a window that starts twice
has a grid block that recurs at some rolling place. Three keyed exchanges, all of packed sorted hashes and none of texts:

1. blocks and rolling probes meet by hash; a block is live if it is held twice or any rolling probe hits it;
2. windows whose own blocks are all live are candidates; runs of them are the hits extended to both sides; they meet by their full hash;
3. documents learn which of their candidates start twice, and lose the words that those cover.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE2, BASE2_INV, U64, Rolling, distinct, pack, raw, unpack, word_hashes

#: Text characters that are hashed together, and entries that one reducing group gets on average.
CHUNK_CHARS = 8 << 20
BUCKET_ENTRIES = 1 << 21
MESSAGE = "bucket long, chunk long, kind int, first binary, second binary"


def chunked(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> tuple[DataFrame, int]:
    """doc_id and text with a chunk by hash, and the number of characters. Hashing the row keeps copies of a text apart."""
    chars = int(docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"])
    chunks = max(1, -(-chars // chunk_chars))
    return docs.select("doc_id", "text").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))), chars


def bucket_bits(entries: int) -> int:
    return max(0, (max(1, entries // BUCKET_ENTRIES) - 1).bit_length())


def split(values: np.ndarray, bits: int, width: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted values below 2**width, by their highest bits; buckets without values are left out, however many there are."""
    if not len(values):
        return []
    bucket = values >> U64(width - bits) if bits else np.zeros(len(values), dtype=U64)
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return [(int(bucket[a]), int(a), int(e)) for a, e in zip(cuts, np.append(cuts[1:], len(values)), strict=True)]


class Words:
    """The words of a chunk as hashes, one document after the other."""

    def __init__(self, texts: list[bytes]):
        parts = [word_hashes(t.split()) for t in texts]
        self.lengths = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.h = np.concatenate([*parts, np.zeros(0, dtype=U64)])

    def inside(self, width: int) -> np.ndarray:
        """Whether the window of this width at each place stays in its document."""
        n = len(self.h) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=bool)
        ends = np.repeat(self.starts + self.lengths, self.lengths)[:n]
        return np.arange(n) + width <= ends

    def offsets(self) -> np.ndarray:
        """Each word's place in its document."""
        return np.arange(len(self.h)) - np.repeat(self.starts, self.lengths)


class Anchors:
    """What the three exchanges derive from a chunk, each time anew and alike."""

    def __init__(self, texts: list[bytes], window: int, width: int, rolling: Rolling, probes: bool = True):
        self.window, self.block, self.width = window, (window + 1) // 2, width
        self.words = Words(texts)
        inside = self.words.inside(self.block)
        rolled = rolling(self.words.h, self.block) >> U64(64 - width)
        grid = inside & (self.words.offsets()[: len(inside)] % self.block == 0) if len(inside) else inside
        self.at = np.flatnonzero(grid)
        self.blocks, self.block_of, counts = np.unique(rolled[self.at], return_inverse=True, return_counts=True)
        self.twice = counts > 1
        self.probes = distinct(rolled[inside & ~grid]) if probes and len(inside) else np.zeros(0, dtype=U64)

    def candidates(self, live: np.ndarray, rolling: Rolling, second: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the candidate windows, their distinct (64-bit, 64-bit) hashes in order, and which of these each place has."""
        ok = self.words.inside(self.window)
        dead = np.zeros(len(self.words.h) + 1, dtype=np.int64)
        dead[1 + self.at[~live[self.block_of]]] = 1  # prefix counts of dead blocks by starting place
        dead = np.cumsum(dead)
        n = len(ok)
        if n:
            ok &= dead[np.arange(n) + self.window - self.block + 1] == dead[np.arange(n)]
        places = np.flatnonzero(ok)
        a = rolling(self.words.h, self.window)[places] if n else np.zeros(0, dtype=U64)
        b = second(self.words.h, self.window)[places] if n else np.zeros(0, dtype=U64)
        order = np.argsort(a)
        if np.any((a[order][1:] == a[order][:-1]) & (b[order][1:] != b[order][:-1])):  # equal in 64 bits, told apart by the other 64
            order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = np.ones(len(a), dtype=bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        which = np.empty(len(a), dtype=np.int64)
        which[order] = np.cumsum(fresh) - 1
        return places, a[fresh], b[fresh], which


def messages(rows: list[tuple]) -> pa.Table:
    kinds = (("bucket", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("first", pa.binary()), ("second", pa.binary()))
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds, columns, strict=True)})


def bits_of(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags_of(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, dtype=np.uint8), count=n).astype(bool)




def reduce_blocks(table: pa.Table) -> pa.Table:
    """One hash range of all blocks (kind 0, second: which are held twice in their chunk) and probes (kind 1); answers which blocks are live."""
    rows = table.to_pylist()
    held = [(r["chunk"], unpack(r["first"]), r["second"], r["bucket"]) for r in rows if r["kind"] == 0]
    if not held:
        return messages([])
    index, counts = np.unique(np.concatenate([x for _, x, _, _ in held]), return_counts=True)
    live = counts > 1
    for _, x, twice, _ in held:
        live[np.searchsorted(index, x[flags_of(twice, len(x))])] = True
    for r in rows:
        if r["kind"] == 1:
            probes = unpack(r["first"])
            at = np.searchsorted(index, probes)
            at[at == len(index)] = 0
            live[at[index[at] == probes]] = True
    return messages([(bucket, chunk, 0, bits_of(live[np.searchsorted(index, x)]), None) for chunk, x, _, bucket in held])


def reduce_windows(table: pa.Table) -> pa.Table:
    """One hash range of all candidates (first: 64-bit hashes; second: as many of another function, then which start twice in their chunk); answers which start twice anywhere."""
    rows = table.to_pylist()
    a = [unpack(r["first"]) for r in rows]
    n = [len(x) for x in a]
    b = [np.frombuffer(r["second"], dtype="<u8", count=k) for r, k in zip(rows, n, strict=True)]
    twice = [flags_of(r["second"][8 * k :], k) for r, k in zip(rows, n, strict=True)]
    first, second, many = np.concatenate(a), np.concatenate(b), np.concatenate(twice)
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
    group = np.concatenate([[0], np.cumsum(~same)])
    repeated = (np.bincount(group) > 1) | (np.bincount(group, weights=many[order]) > 0)
    found = np.empty(len(first), dtype=bool)
    found[order] = repeated[group]
    parts = np.split(found, np.cumsum(n)[:-1])
    return messages([(r["bucket"], r["chunk"], 1, bits_of(p), None) for r, p in zip(rows, parts, strict=True)])


def answers(table: pa.Table, kind: int, sizes: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """The flags that came back for a chunk's sorted values, in their order."""
    out = np.zeros(n, dtype=bool)
    got = {r["bucket"]: r["first"] for r in table.to_pylist() if r["kind"] == kind}
    for bucket, a, b in sizes:
        out[a:b] = flags_of(got[bucket], b - a)
    return out


def repeats(docs: DataFrame, window: int = 35, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_words, spans (merged word spans to remove, end exclusive) and kept (the other words, joined by one space) of each document.

    A word goes if a window of `window` words covers it whose word sequence starts anywhere else, in this or another document. Windows are judged on
    the input. Words are runs without ASCII blanks, unchanged. Null and empty texts have no words; shorter texts than a window lose none; a null doc_id stays null; repeated
    rows are documents of their own and so lose what is as long as a window; a very long text makes a chunk of its own size; an empty table gives no rows; other columns are
    ignored. spans are the maximal runs of words that such windows cover. Candidates meet by two hashes of 64 bits each; an accidental agreement
    of two of n candidates has a chance of n**2 / 2**129, about 1.5e-13 for 10**13 of them.
    """
    keyed, chars = chunked(docs, chunk_chars)
    entries = max(1, chars // 6)
    width = min(60, max(24, (entries // 18).bit_length() + 13))
    block_bits, window_bits = bucket_bits(entries), bucket_bits(entries // 2)
    block_bits = min(block_bits, width - 8)

    def send_blocks(table: pa.Table) -> pa.Table:
        own = Anchors(raw(table["text"]), window, width, Rolling())
        chunk, rows = table["chunk"][0].as_py(), []
        for bucket, a, b in split(own.blocks, block_bits, width):
            rows.append((bucket, chunk, 0, pack(own.blocks[a:b] - U64(bucket << (width - block_bits))), bits_of(own.twice[a:b])))
        for bucket, a, b in split(own.probes, block_bits, width):
            rows.append((bucket, chunk, 1, pack(own.probes[a:b] - U64(bucket << (width - block_bits))), None))
        return messages(rows)

    def candidates_of(texts: list[bytes], replies: pa.Table):
        rolling = Rolling()
        own = Anchors(texts, window, width, rolling, probes=False)
        live = answers(replies, 0, split(own.blocks, block_bits, width), len(own.blocks))
        return own, own.candidates(live, rolling, Rolling(BASE2, BASE2_INV))

    def send_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return messages([])
        _, (_, a, b, which) = candidates_of(raw(table["text"]), replies)
        twice = np.bincount(which, minlength=len(a)) > 1
        chunk = table["chunk"][0].as_py()
        return messages([(k, chunk, 1, pack(a[i:j] - U64(k << (64 - window_bits) if window_bits else 0)), b[i:j].tobytes() + bits_of(twice[i:j])) for k, i, j in split64(a, window_bits)])

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        texts = raw(table["text"]) if table.num_rows else []
        out = []
        if texts:
            own, (places, a, _, which) = candidates_of(texts, replies)
            again = answers(replies, 1, split64(a, window_bits), len(a))
            starts = places[again[which]]
            cover = np.zeros(len(own.words.h) + 1, dtype=np.int32)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            for doc, text, at, n in zip(table["doc_id"].to_pylist(), texts, own.words.starts.tolist(), own.words.lengths.tolist(), strict=True):
                mask = gone[at : at + n]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).tolist()
                words = text.split()
                kept = words if not edge else [w for w, g in zip(words, mask.tolist(), strict=True) if not g]
                out.append((doc, n, [{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2], strict=True)], b" ".join(kept).decode()))
        kinds = (("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string()))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds, columns, strict=True)})

    groups = keyed.groupBy("chunk")
    live = groups.applyInArrow(send_blocks, MESSAGE).groupBy("bucket").applyInArrow(reduce_blocks, MESSAGE)
    twice = groups.cogroup(live.groupBy("chunk")).applyInArrow(send_windows, MESSAGE).groupBy("bucket").applyInArrow(reduce_windows, MESSAGE)
    return groups.cogroup(live.unionByName(twice).groupBy("chunk")).applyInArrow(finish, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string")


def split64(values: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    return split(values, bits, 64) if bits else ([(0, 0, len(values))] if len(values) else [])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return repeats(docs).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


REPORT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
h AS (SELECT r, i FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
c AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS p FROM h),
k AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT r, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d) ANTI JOIN c USING (r, p) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""
