"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

TERM = re.compile(r"[^\W\d_]+")
#: Hash space of the terms, and lengths of the word prefixes that count as terms beside whole words.
SPACE = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)
#: Slots after the terms for the text's length, by powers of two of its distinct words, so that pairs of a term and a length can be learned.
LENGTHS = 16
SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def hashed(word: str) -> set[int]:
    return {crc32(b"w" + word.encode()) % SPACE, *(crc32(b"p" + word[:k].encode()) % SPACE for k in PREFIXES if len(word) > k)}


def words_of(text: str) -> set[str]:
    return set(TERM.findall(text.lower()))


def length_slot(n: int) -> int:
    return min(LENGTHS - 1, n.bit_length())


@dataclass
class Machine:
    """ids: the kept hashed terms, sorted; w, v: a weight and a factor row for each of them, then for each length slot."""

    ids: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Each row's w0 + sum w + sum of <v_i, v_j> over pairs; every row has at least its length slot."""
        v = self.v[flat]
        total = np.add.reduceat(v, starts, axis=0)
        return self.w0 + np.add.reduceat(self.w[flat], starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((v**2).sum(1), starts))


def choose(rows: list[np.ndarray], y: np.ndarray, terms: int, least: int, block: int = 512) -> np.ndarray:
    """The terms, in at least `least` documents, with the largest chi-square between term and label, sorted. Documents are counted block by block."""
    n, pos = len(y), int(y.sum())
    df, hits = np.zeros(SPACE), np.zeros(SPACE)
    for a in range(0, n, block):
        part = rows[a : a + block]
        df += np.bincount(np.concatenate(part), minlength=SPACE)
        toxic = [r for r, t in zip(part, y[a : a + block], strict=True) if t]
        if toxic:
            hits += np.bincount(np.concatenate(toxic), minlength=SPACE)
    expected = df * pos / max(n, 1)
    spread = expected * (1 - pos / max(n, 1)) * (1 - df / max(n, 1)) + 0.5
    chi = np.where(df >= least, (hits - expected) ** 2 / spread, 0)
    kept = np.argsort(-chi, kind="stable")[:terms]
    return np.sort(kept[chi[kept] > 3.8])


def fit(rows: list[np.ndarray], y: np.ndarray, terms: int = 4096, rank: int = 8, epochs: int = 30, steps: int = 600, least: int = 3, rate: float = 0.02, decay: float = 0.15, seed: int = 5) -> Machine:
    """Logistic loss, Adam, `epochs` passes and `steps` steps at least; weights decay by `decay` over the number of rows. rows: each document's distinct hashed terms with its number of words last. Without both labels the score is the base rate."""
    y = y.astype(float)
    ids = choose([r[:-1] for r in rows], y, terms, least) if len(rows) else np.zeros(0, np.int64)
    size = len(ids) + LENGTHS
    rng = np.random.default_rng(seed)
    base = float(np.clip((y.sum() + 0.5) / (len(y) + 1), 0.01, 0.99)) if len(y) else 0.05
    m = Machine(ids, float(np.log(base / (1 - base))), np.zeros(size), rng.normal(0, 0.02, (size, rank)))
    if not len(ids):
        return m

    def kept(row: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(ids, row[:-1]), len(ids) - 1)
        return np.append(at[ids[at] == row[:-1]], len(ids) + length_slot(int(row[-1])))

    own = [kept(r) for r in rows]
    decay /= max(1, len(rows))
    mw, vw, mv, vv, step = np.zeros(size), np.zeros(size), np.zeros_like(m.v), np.zeros_like(m.v), 0
    m0 = v0 = 0.0
    parts = max(1, len(rows) // 256)
    for _ in range(max(epochs, -(-steps // parts))):
        for part in np.array_split(rng.permutation(len(rows)), parts):
            lens = np.array([len(own[i]) for i in part])
            f = np.concatenate([own[i] for i in part])
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            v = m.v[f]
            total = np.add.reduceat(v, starts, axis=0)
            z = m.w0 + np.add.reduceat(m.w[f], starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((v**2).sum(1), starts))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            gr = np.repeat(g, lens)
            gw, gv = np.bincount(f, weights=gr, minlength=size) + decay * m.w, np.zeros_like(m.v)
            np.add.at(gv, f, gr[:, None] * (np.repeat(total, lens, axis=0) - v))
            gv += decay * m.v
            step += 1
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2
            mv, vv = 0.9 * mv + 0.1 * gv, 0.999 * vv + 0.001 * gv**2
            m0, v0 = 0.9 * m0 + 0.1 * g.sum(), 0.999 * v0 + 0.001 * g.sum() ** 2
            m.w -= rate * (mw / fix1) / (np.sqrt(vw / fix2) + 1e-8)
            m.v -= rate * (mv / fix1) / (np.sqrt(vv / fix2) + 1e-8)
            m.w0 -= rate * (m0 / fix1) / (np.sqrt(v0 / fix2) + 1e-8)
    return m


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 16_000, **options) -> Machine:
    """Fits on the labelled rows outside the held-out quarter: all of them up to about `sample`, beyond that a hash-chosen part of that size.

    A doc_id with several labels counts as toxic if any says so; rows with a null label or doc_id are left out. Only labels learned here and the texts enter. `sample`
    bounds the rows that come to the driver (each row's distinct hashed terms, at most SPACE of them); `terms` of fit() bounds the terms that get weights.
    """
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y")).where(~held_out())
    n = y.count()
    if n > sample:
        y = y.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) < int(1_000_003 * sample / n))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for text in batch.column("text").to_pylist():
                words = words_of(text or "")
                out.append(np.array([*sorted(set().union(*map(hashed, words))), len(words)], dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.int32()), pa.array(out, pa.binary())], names=["y", "terms"])

    got = docs.select("doc_id", "text").join(y, "doc_id").select("doc_id", "text", F.col("y").cast("int").alias("y")).mapInArrow(terms, "y int, terms binary").toArrow()
    rows = sorted(zip(got["terms"].to_pylist(), got["y"].to_pylist(), strict=True))  # the same order in every run
    del got
    return fit([np.frombuffer(r, dtype=np.int32) for r, _ in rows], np.array([l > 0 for _, l in rows], dtype=bool), **options)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3, column: str | None = None, cache: int = 100_000) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from threshold on) of each whole text.

    Null and empty text: the score of a text without words. Null doc_id: held_out is false. Repeated rows get the same score each; very long texts are scored
    whole; a score equal to the threshold counts as toxic; an empty table gives no rows. Other columns are ignored; with a column name, all columns stay
    and only the score is added under that name, which must be new.
    """
    if column and column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have a column {column}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {int(x): i for i, x in enumerate(machine.ids)}
        known: dict[str, tuple[int, ...]] = {}
        for batch in sliced(batches):
            flat, starts = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text or "")
                own: set[int] = set()
                for w in words:
                    hit = known.get(w)
                    if hit is None:
                        if len(known) >= cache:
                            known.clear()
                        hit = known[w] = tuple(i for t in hashed(w) if (i := index.get(t)) is not None)
                    if hit:
                        own.update(hit)
                starts.append(len(flat))
                flat += sorted(own)
                flat.append(len(index) + length_slot(len(words)))
            z = machine.raw(np.array(flat, dtype=np.int64), np.array(starts, dtype=np.int64)) if starts else np.zeros(0)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            if column:
                yield batch.append_column(column, pa.array(p, pa.float64()))
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], schema=SCHEMA)

    if column:
        from pyspark.sql import types as T

        return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
