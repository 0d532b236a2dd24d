"""Language-model scores: stupid backoff with n-gram count tables partitioned by hash.

The model is a set of relations: words with their numbers, and for each n the counts of the n-grams, as tuples of word numbers, partitioned by a hash of the tuple.
Each document's n-grams are exploded, joined to these tables, and the words' scores are summed per document. Rows of the relations travel packed, one
message for each chunk of documents and hash range; the tuples themselves are compared, never hashes, so no two n-grams are taken for one:

1. a chunk's distinct words meet by hash; those that two documents hold get a number, the frequent ones small numbers;
2. level by level, n-grams whose first and last n-1 words are shared so far meet as tuples of numbers; their counts add up to the corpus's table, and each chunk
   gets the counts of its own n-grams back. An n-gram with a part that only one document holds is found nowhere else, so it isn't asked for;
3. a document's scores follow from these counts less its own.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, pack_counts, raw, unpack_counts
from .substring import bucket_bits, chunked

#: What a score is multiplied by for each step back to a shorter context.
BACKOFF = 0.4
#: Texts that are counted together, in characters: many of their n-grams coincide.
CHUNK_CHARS = 8 << 20
MESSAGE = "bucket long, chunk long, level int, first binary, second binary, third binary"
WORDS = r"[^\x20\x09-\x0D]+"


def messages(rows: list[tuple]) -> pa.Table:
    """bucket, chunk, level and up to three blobs a row, which zstandard compresses: planes of small numbers shrink to about a third."""
    kinds = (("bucket", pa.int64()), ("chunk", pa.int64()), ("level", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("third", pa.binary()))
    squeeze = zstandard.ZstdCompressor(level=1).compress
    packed = [(*r[:3], *(x if x is None else squeeze(x) for x in r[3:])) for r in rows]
    columns = list(zip(*packed, strict=True)) or [[]] * len(kinds)
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds, columns, strict=True)})


def rows_of(table: pa.Table) -> list[dict]:
    restore = zstandard.ZstdDecompressor().decompress
    return [{k: restore(v) if isinstance(v, bytes) else v for k, v in r.items()} for r in table.to_pylist()]


def words_array(blobs: list[bytes]) -> pa.Array:
    """The words of blobs in which they are joined by line ends."""
    return pa.array([w for b in blobs for w in b.split(b"\n")], pa.binary())


def planes(values: np.ndarray) -> bytes:
    """Unsigned values in any order, cut to as many bytes as the largest needs, lowest bytes of all first."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.astype(U64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(blob: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """n values that begin at a place of the blob, and the place after them."""
    width = blob[at]
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(blob, dtype=np.uint8, offset=at + 1, count=width * n).reshape(width, n).T
    return out.view(U64).reshape(-1), at + 1 + width * n


def pack_tuples(parts: np.ndarray) -> bytes:
    """Tuples (rows) in lexicographic order: their first parts as steps, the others as they are."""
    first = np.diff(parts[:, 0], prepend=U64(0))
    return len(parts).to_bytes(8, "little") + b"".join(planes(c) for c in (first, *parts.T[1:]))


def unpack_tuples(blob: bytes, order: int) -> np.ndarray:
    n, at, columns = int.from_bytes(blob[:8], "little"), 8, []
    for _ in range(order):
        values, at = from_planes(blob, at, n)
        columns.append(values)
    columns[0] = np.cumsum(columns[0], dtype=U64)
    return np.stack(columns, axis=1)


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Pairs of numbers below 2**32 as one number each."""
    return first.astype(U64) << U64(32) | second.astype(U64)


def ranges(parts: np.ndarray, bits: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the tuples by hash range, the same within each range as before, and (range, from, to) of those that have any."""
    h = np.zeros(len(parts), dtype=U64)
    for column in parts.T:
        h = mix(h * U64(0x9E3779B97F4A7C15) + column)
    bucket = (h >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(parts), dtype=np.int64)
    order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
    sorted_ = bucket[order]
    if not len(order):
        return order, []
    cuts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    return order, [(int(sorted_[a]), int(a), int(b)) for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True)]


class Chunk:
    """The words of a chunk's documents in a row, and by level the places whose n-grams other documents may hold.

    at[n]: 1 + the number of the n-gram that starts at each place among the chunk's live ones, 0 for none; parts[n], elsewhere[n], here[n]: the word numbers of each
    live n-gram, and its counts in the other chunks and in this one.
    """

    def __init__(self, texts: list[bytes]):
        docs = [t.lower().split() for t in texts]
        self.lengths = np.array([len(d) for d in docs], dtype=np.int64)
        self.doc = np.repeat(np.arange(len(docs)), self.lengths)
        coded = pa.array(list(chain.from_iterable(docs)), pa.large_binary()).dictionary_encode()
        self.words, self.ids = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int64)
        self.at, self.parts, self.elsewhere, self.here = {}, {}, {}, {}

    def word_rows(self, number: int, bits: int) -> list[tuple]:
        """Messages with the distinct words, their counts and whether two documents here hold them; the empty word stands for the number of all words."""
        n = len(self.words)
        first, last = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        last[self.ids], first[self.ids[::-1]] = self.doc, self.doc[::-1]
        names = [*self.words.to_pylist(), b""]
        many, counts = np.append(first != last, True), np.append(np.bincount(self.ids, minlength=n), len(self.doc))
        bucket = np.fromiter(map(crc32, names), dtype=np.int64, count=n + 1) >> (32 - bits)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0))
        out = []
        for a, b in zip(cuts, np.append(cuts[1:], n + 1), strict=True):
            own = order[a:b]
            out.append((int(bucket[own[0]]), number, 1, b"\n".join([names[i] for i in own.tolist()]), np.packbits(many[own]).tobytes(), planes(counts[own])))
        return out

    def take_words(self, replies: list[dict]) -> None:
        names = words_array([r["first"] for r in replies])
        sizes = [r["first"].count(b"\n") + 1 for r in replies]
        numbers, elsewhere = (np.concatenate([*(from_planes(r[c], 0, n)[0] for r, n in zip(replies, sizes, strict=True)), np.zeros(0, dtype=U64)]) for c in ("second", "third"))
        order = np.argsort(numbers)
        # places among the live words follow the words' numbers, so tuples in the order of places are in the order of numbers
        place = np.zeros(len(order) + 1, dtype=np.int64)
        place[order] = np.arange(1, len(order) + 1)
        found = pc.index_in(pa.concat_arrays([self.words, pa.array([b""], pa.binary())]), names).fill_null(len(order)).to_numpy().astype(np.int64)
        self.total = len(self.doc) + (int(elsewhere[found[-1]]) if found[-1] < len(order) else 0)
        at = place[found[:-1]][self.ids]
        self.at[1], self.parts[1], self.elsewhere[1] = at, numbers[order][:, None], elsewhere[order].astype(np.int64)
        self.here[1] = np.bincount(at, minlength=len(order) + 1)[1:]

    def explode(self, n: int) -> None:
        """The n-grams whose first and last n-1 words are live: distinct tuples, the place of each start among them, and which two documents here hold."""
        before, size = self.at[n - 1], len(self.doc)
        ok = np.zeros(size, dtype=bool)
        if size >= n:
            ok[: size - n + 1] = (before[: size - n + 1] > 0) & (before[1 : size - n + 2] > 0) & (self.doc[: size - n + 1] == self.doc[n - 1 :])
        self.starts = np.flatnonzero(ok)
        last = self.at[1][self.starts + n - 1]
        self.keys, self.which, self.counts = np.unique(joined(before[self.starts], last), return_inverse=True, return_counts=True)
        self.tuples = np.concatenate([self.parts[n - 1][(self.keys >> U64(32)).astype(np.int64) - 1], self.parts[1][(self.keys & U64(0xFFFFFFFF)).astype(np.int64) - 1]], axis=1)
        first, final = np.empty(len(self.keys), dtype=np.int64), np.empty(len(self.keys), dtype=np.int64)
        doc = self.doc[self.starts]
        final[self.which], first[self.which[::-1]] = doc, doc[::-1]
        self.shared = first != final

    def gram_rows(self, n: int, number: int, bits: int) -> list[tuple]:
        self.explode(n)
        order, cuts = ranges(self.tuples, bits)
        return [(k, number, n, pack_tuples(self.tuples[order[a:b]]), pack_counts(self.counts[order[a:b]]), None) for k, a, b in cuts]

    def take_grams(self, n: int, replies: list[dict], bits: int) -> None:
        """Counts in other chunks, as they came back; n-grams that this document alone holds are dropped."""
        self.explode(n)
        order, cuts = ranges(self.tuples, bits)
        got, elsewhere = {r["bucket"]: r["first"] for r in replies}, np.zeros(len(self.keys), dtype=np.int64)
        for k, a, b in cuts:
            elsewhere[order[a:b]] = unpack_counts(got[k])
        live = self.shared | (elsewhere > 0)
        place = np.where(live, np.cumsum(live), 0)
        self.at[n] = np.zeros(len(self.doc), dtype=np.int64)
        self.at[n][self.starts] = place[self.which]
        self.parts[n], self.elsewhere[n], self.here[n] = self.tuples[live], elsewhere[live], self.counts[live]

    def rest(self, n: int) -> np.ndarray:
        """How often the n-gram that starts at each place occurs in all other documents."""
        live = np.flatnonzero(self.at[n])
        at, out = self.at[n][live], np.zeros(len(self.doc), dtype=np.int64)
        _, back, own = np.unique(joined(self.doc[live], at), return_inverse=True, return_counts=True)
        out[live] = (self.elsewhere[n] + self.here[n])[at - 1] - own[back]
        return out

    def sums(self, order: int) -> np.ndarray:
        """Sum of log10 of the words' scores for each document."""
        rest = [self.rest(n) for n in range(1, order + 1)]
        others = np.maximum(self.total - self.lengths, 1)
        s = np.where(rest[0] > 0, rest[0], BACKOFF) / others[self.doc]
        for n in range(2, order + 1):
            if len(s) < n:
                break
            whole = self.doc[: len(s) - n + 1] == self.doc[n - 1 :]
            own, given = rest[n - 1][: len(s) - n + 1], rest[n - 2][: len(s) - n + 1]
            found = (own > 0) & (given > 0)
            s[n - 1 :] = np.where(whole, np.where(found, own / np.maximum(given, 1), BACKOFF * s[n - 1 :]), s[n - 1 :])
        return np.bincount(self.doc, weights=np.log10(s), minlength=len(self.lengths))


def number_words(bits: int) -> Callable[[pa.Table], pa.Table]:
    """One hash range of all words: those that two documents hold get numbers, 1 and up by falling count and then by the word, that differ over all ranges."""

    def run(table: pa.Table) -> pa.Table:
        rows = rows_of(table)
        coded = words_array([r["first"] for r in rows]).dictionary_encode()
        names, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        sizes = [r["first"].count(b"\n") + 1 for r in rows]
        counts = np.concatenate([from_planes(r["third"], 0, n)[0] for r, n in zip(rows, sizes, strict=True)]).astype(np.int64)
        many = np.concatenate([np.unpackbits(np.frombuffer(r["second"], dtype=np.uint8), count=n) for r, n in zip(rows, sizes, strict=True)])
        total = np.zeros(len(names), dtype=np.int64)
        np.add.at(total, ids, counts)
        shared = np.flatnonzero(np.bincount(ids, weights=1 + many, minlength=len(names)) > 1)
        order = pc.sort_indices(pa.table({"n": total[shared], "w": names.take(pa.array(shared))}), sort_keys=[("n", "descending"), ("w", "ascending")]).to_numpy()
        number = np.zeros(len(names), dtype=np.int64)
        number[shared[order]] = 1 + (np.arange(len(shared)) << bits | rows[0]["bucket"])
        if number.max(initial=0) >= 1 << 32:
            raise ValueError("more than 2**32 words that two documents share")
        out, a = [], 0
        for r, n in zip(rows, sizes, strict=True):
            own = ids[a : a + n]
            kept = number[own] > 0
            if kept.any():
                out.append((r["bucket"], r["chunk"], 1, b"\n".join(names.take(pa.array(own[kept])).to_pylist()), planes(number[own[kept]]), planes((total[own] - counts[a : a + n])[kept])))
            a += n
        return messages(out)

    return run


def add_up(n: int) -> Callable[[pa.Table], pa.Table]:
    """One hash range of the n-grams' count table over all chunks; answers each chunk's n-grams with their counts in the other chunks."""

    def run(table: pa.Table) -> pa.Table:
        rows = rows_of(table)
        tuples = [unpack_tuples(r["first"], n) for r in rows]
        counts = np.concatenate([unpack_counts(r["second"]) for r in rows])
        flat = np.concatenate(tuples)
        index = flat[:, 0]
        for k in range(1, n):
            index = np.unique(joined(index, flat[:, k]), return_inverse=True)[1]
        sums = np.bincount(index, weights=counts).astype(np.int64)
        elsewhere = np.split(sums[index] - counts, np.cumsum([len(t) for t in tuples])[:-1])
        return messages([(r["bucket"], r["chunk"], n, pack_counts(e), None, None) for r, e in zip(rows, elsewhere, strict=True)])

    return run


def scores(docs: DataFrame, order: int = 3, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_words, log_prob (sum of log10 of the words' scores), mean_log_prob (null without words) and perplexity of each document.

    The model is the corpus without the document itself: counts less its own. A word scores count(n-gram) / count(context) for the longest n-gram
    up to `order` that the rest of the corpus holds, times BACKOFF for each shorter step; a word found nowhere else counts BACKOFF times one occurrence. Words are
    runs without ASCII blanks, A-Z lower-cased; every word of every document is counted and scored.

    Null or empty text: 0 words, log_prob 0, mean and perplexity null. A null doc_id stays null; repeated rows are documents of their own; a corpus of one document
    backs off everywhere; a very long text makes a chunk of its own size; an empty table gives no rows; other columns are ignored. Counts are exact; more than 2**32 words
    that two documents share are an error.
    """
    keyed, chars = chunked(docs, chunk_chars)
    tokens = max(1, chars // 6)
    bits, word_bits = bucket_bits(tokens), min(31, bucket_bits(tokens // 2))

    def replied(texts: pa.Table, replies: pa.Table, upto: int) -> Chunk:
        own, by = Chunk(raw(texts["text"])), {}
        for r in rows_of(replies):
            by.setdefault(r["level"], []).append(r)
        own.take_words(by.get(1, []))
        for n in range(2, upto + 1):
            own.take_grams(n, by.get(n, []), bits)
        return own

    def send_words(table: pa.Table) -> pa.Table:
        return messages(Chunk(raw(table["text"])).word_rows(table["chunk"][0].as_py(), word_bits))

    def send_grams(n: int):
        def run(table: pa.Table, replies: pa.Table) -> pa.Table:
            return messages(replied(table, replies, n - 1).gram_rows(n, table["chunk"][0].as_py(), bits) if table.num_rows else [])

        return run

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        words, total = np.zeros(0, dtype=np.int64), np.zeros(0)
        if table.num_rows:
            own = replied(table, replies, order)
            words, total = own.lengths, own.sums(order)
        mean = np.divide(total, words, out=np.zeros(len(words)), where=words > 0)
        none = words == 0
        return pa.table({"doc_id": table["doc_id"].cast(pa.int64()), "n_words": pa.array(words, pa.int64()), "log_prob": pa.array(total, pa.float64()), "mean_log_prob": pa.array(mean, pa.float64(), mask=none), "perplexity": pa.array(10.0**-mean, pa.float64(), mask=none)})

    groups = keyed.groupBy("chunk")
    replies = groups.applyInArrow(send_words, MESSAGE).groupBy("bucket").applyInArrow(number_words(word_bits), MESSAGE)
    for n in range(2, order + 1):
        asked = groups.cogroup(replies.groupBy("chunk")).applyInArrow(send_grams(n), MESSAGE)
        replies = replies.unionByName(asked.groupBy("bucket").applyInArrow(add_up(n), MESSAGE))
    return groups.cogroup(replies.groupBy("chunk")).applyInArrow(finish, "doc_id long, n_words long, log_prob double, mean_log_prob double, perplexity double")


def count_table(docs: DataFrame, order: int = 3) -> DataFrame:
    """n, gram (its words, joined by one space) and count of all n-grams of the corpus up to `order`: the model as a plain table, partitioned by hash.

    Words as scores() takes them. Null and empty texts have none; repeated rows count each; an empty table gives no rows; other columns are ignored.
    """
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(F.regexp_extract_all(lowered, F.lit(f"({WORDS})"), F.lit(1)).alias("w")).where(F.size("w") > 0)
    each = words.select("w", F.posexplode("w").alias("i", "word")).select("w", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(order), F.size("w") - F.col("i")))).alias("n"))
    return each.select("n", F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").alias("gram")).groupBy("n", "gram").agg(F.count("*").alias("count"))


SCORES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT sum(len(w)) AS total FROM d),
p AS (SELECT r, w, unnest(generate_series(1, len(w))) AS i, CAST(len(w) AS BIGINT) AS n FROM d),
g AS (SELECT r, i, n, w[i] AS g1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS g2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3 FROM p),
e AS (SELECT r, g1 AS g FROM g UNION ALL SELECT r, g2 FROM g WHERE g2 IS NOT NULL UNION ALL SELECT r, g3 FROM g WHERE g3 IS NOT NULL),
own AS (SELECT r, g, count(*) AS c FROM e GROUP BY r, g),
everywhere AS (SELECT g, sum(c) AS c FROM own GROUP BY g),
rest AS (SELECT own.r, own.g, everywhere.c - own.c AS c FROM own JOIN everywhere USING (g)),
j AS (
  SELECT g.r, g.i, greatest(t.total - g.n, 1) AS others, a.c AS c1, b.c AS c2, c.c AS c3,
         lag(a.c) OVER o AS before1, lag(b.c) OVER o AS before2, g.g2 IS NOT NULL AS two, g.g3 IS NOT NULL AS three
  FROM g CROSS JOIN t JOIN rest a ON g.r = a.r AND g.g1 = a.g LEFT JOIN rest b ON g.r = b.r AND g.g2 = b.g LEFT JOIN rest c ON g.r = c.r AND g.g3 = c.g
  WINDOW o AS (PARTITION BY g.r ORDER BY g.i)),
s1 AS (SELECT *, (CASE WHEN c1 > 0 THEN c1 ELSE 0.4::DOUBLE END)::DOUBLE / others::DOUBLE AS s FROM j),
s2 AS (SELECT * EXCLUDE (s), CASE WHEN NOT two THEN s WHEN c2 > 0 AND before1 > 0 THEN c2::DOUBLE / before1::DOUBLE ELSE 0.4::DOUBLE * s END AS s FROM s1),
s3 AS (SELECT r, CASE WHEN NOT three THEN s WHEN c3 > 0 AND before2 > 0 THEN c3::DOUBLE / before2::DOUBLE ELSE 0.4::DOUBLE * s END AS s FROM s2),
x AS (SELECT r, sum(log10(s)) AS log_prob FROM s3 GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(x.log_prob, 0), 4) AS log_prob, round(x.log_prob / len(w), 6) AS mean_log_prob
FROM d LEFT JOIN x USING (r)
"""
