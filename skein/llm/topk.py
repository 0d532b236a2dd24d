"""Exact top-k by inner product with multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Query vectors of one pass take at most this many bytes; more queries are more passes.
QUERY_BYTES = 32 << 20
#: Vectors from which the basis and the first floors are taken, at most. They only steer the pruning: results are the same whatever the sample is.
SAMPLE = 4096
#: Numbers of segments, coarse to fine.
LEVELS = (4, 16, 32)
TILE = 2048
#: Share of a tile's pairs up to which the next figure is computed pair by pair; above, for the whole tile by one matrix product.
SPARSE = 1 / 24
#: Products of whole components are exact in doubles below this sum.
EXACT = 2**52
LEAST, NONE = -(2**63), 2**63 - 1


def whole(column: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the vectors that take part, and floor(scale * x) of their components as doubles."""
    offsets, flat = column.offsets.to_numpy().astype(np.int64), column.values
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    ok = np.isfinite(values)
    if flat.null_count:
        ok &= ~np.array(flat.is_null())
    bad = np.concatenate([[0], np.cumsum(~ok)])
    good = np.array(column.is_valid()) & (bad[offsets[1:]] == bad[offsets[:-1]])
    lengths = np.diff(offsets)
    out = {}
    for n in np.unique(lengths[good]).tolist():
        at = np.flatnonzero(good & (lengths == n))
        out[n] = at, np.floor(scale * values[offsets[at][:, None] + np.arange(n)])
    return out


@dataclass
class Basis:
    """Orthonormal directions, strongest first, and the segments that each level cuts them into. Inner products are the same in any such basis."""

    directions: np.ndarray
    cuts: list[np.ndarray]

    def statistics(self, x: np.ndarray) -> list[np.ndarray]:
        """For each level, rows (sqrt(n) * mean, sqrt(n) * deviation by segment) of each vector: the product of two such rows bounds the inner product from above.

        Within a segment of n components, sum a b = n mean(a) mean(b) + sum of products of deviations, and the latter is at most n dev(a) dev(b). Distances
        |a|^2 + |b|^2 - 2 a b are bounded from below by the same figure. A segment of one component has no deviation: its product is exact.
        """
        turned = x @ self.directions
        square = turned**2
        out = []
        for cut in self.cuts:
            widths = np.diff(np.append(cut, turned.shape[1]))
            sums = np.add.reduceat(turned, cut, axis=1) / np.sqrt(widths)
            out.append(np.concatenate([sums, np.sqrt(np.maximum(np.add.reduceat(square, cut, axis=1) - sums**2, 0))[:, widths > 1]], axis=1))
        return out


def fitted(sample: np.ndarray, levels: tuple[int, ...] = LEVELS) -> Basis:
    """Principal directions of the sample, and segments of about equal shares of its energy: short where it is dense, long in the tail."""
    n = sample.shape[1]
    sample = sample[np.abs(sample).max(axis=1, initial=0) < 1e100]
    energy, directions = np.linalg.eigh(sample.T @ sample) if len(sample) and n else (np.ones(n), np.eye(n))
    energy, directions = np.maximum(energy[::-1], 0), directions[:, ::-1]
    # half by energy, half by count, so that no level puts a long tail into one segment
    share = np.cumsum(energy) / max(energy.sum(), 1e-300) + np.arange(1, n + 1) / max(n, 1)
    cuts = [np.unique(np.append(0, np.searchsorted(share, 2 * np.arange(1, s) / s))) for s in levels]
    return Basis(np.ascontiguousarray(directions), [c[c < n] for c in cuts] if n else [])


@dataclass
class Block:
    """Queries of one pass and one length with their statistics; floor: scores that each one's k-th result reaches at least."""

    ids: np.ndarray
    x: np.ndarray
    basis: Basis
    floor: np.ndarray
    levels: list[np.ndarray] = field(default_factory=list)
    norm: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        if not len(self.norm):
            self.levels, self.norm = self.basis.statistics(self.x), np.sqrt((self.x**2).sum(1))

    def part(self, a: int, b: int) -> Block:
        return Block(self.ids[a:b], self.x[a:b], self.basis, self.floor[a:b], [s[a:b] for s in self.levels], self.norm[a:b])


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows; in doubles while every sum is exact, else in Python integers (beyond 64 bits: the nearest that has 64)."""
    if not len(q) or np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < EXACT:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    return np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(r, s, strict=True)))) for r, s in zip(q, c, strict=True)], dtype=np.int64)


def survivors(block: Block, x: np.ndarray, floor: np.ndarray, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no level rules out, coarse to fine. seen: where given, how many pairs each level is asked and how many stay at last."""
    norm = np.sqrt((x**2).sum(1))
    slack = 1e-5 * block.norm.max(initial=1) * norm.max(initial=1)  # far above the rounding of the statistics
    least = floor.astype(np.float64) - slack
    alive = np.ones((len(block.ids), len(x)), dtype=bool)
    pairs, left = None, alive.size
    for mine, theirs in zip(block.levels, block.basis.statistics(x), strict=True):
        if seen is not None:
            seen.append(left)
        if pairs is None:
            alive &= ~(mine @ theirs.T < least[:, None])  # not a number, from an overflow, rules nothing out
            left = int(np.count_nonzero(alive))
            if left <= SPARSE * alive.size:
                pairs = np.nonzero(alive)
        else:
            q, c = pairs
            near = ~(np.einsum("ij,ij->i", mine[q], theirs[c]) < least[q])
            pairs, left = (q[near], c[near]), int(near.sum())
    if seen is not None:
        seen.append(left)
    return pairs if pairs is not None else np.nonzero(alive)


def search(block: Block, ids: np.ndarray, x: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int, seen: list[int] | None = None) -> None:
    """best: each query's k highest scores so far and their ids (least score and largest id if there are fewer); updated with the candidates."""
    scores, names = best
    floor = np.maximum(scores[:, -1], block.floor)
    qi, ci = survivors(block, x, floor, seen)
    if len(qi) > SPARSE * len(block.ids) * len(x) and np.abs(block.x).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] < EXACT:
        si = (block.x @ x.T)[qi, ci].astype(np.int64)
        fit = (si >= floor[qi]) & (block.ids[qi] != ids[ci])
        qi, ci, si = qi[fit], ci[fit], si[fit]
    else:
        si = None
    step = 1 << 16
    for a in range(0, len(qi), step):
        q, c = qi[a : a + step], ci[a : a + step]
        s = exact(block.x[q], x[c]) if si is None else si[a : a + step]
        worth = (s >= np.maximum(scores[q, -1], block.floor[q])) & (block.ids[q] != ids[c])
        q, c, s = q[worth], c[worth], s[worth]
        if not len(q):
            continue
        touched = np.unique(q)
        allq = np.concatenate([q, np.repeat(touched, k)])
        alls = np.concatenate([s, scores[touched].ravel()])
        alln = np.concatenate([ids[c], names[touched].ravel()])
        order = np.lexsort((alln, ~alls, allq))
        allq, alls, alln = allq[order], alls[order], alln[order]
        at = np.searchsorted(allq, touched)[:, None] + np.arange(k)
        scores[touched], names[touched] = alls[at], alln[at]


def floors(ids: np.ndarray, x: np.ndarray, own: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query within the sample, which its k-th best among all candidates reaches at least; LEAST where the sample has fewer."""
    out = np.full(len(ids), LEAST, dtype=np.int64)
    if len(sample) <= k or np.abs(x).max(initial=0) * np.abs(sample).max(initial=0) * x.shape[1] >= EXACT:
        return out
    for a in range(0, len(ids), TILE):
        s = x[a : a + TILE] @ sample.T
        s[ids[a : a + TILE, None] == own] = -np.inf
        kth = np.partition(s, -k, axis=1)[:, -k]
        out[a : a + TILE] = np.where(np.isfinite(kth), kth, LEAST).astype(np.int64)
    return out


def vectors_of(table: pa.Table, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: vec_id and whole components of the vectors that take part."""
    if not table.num_rows:
        return {}
    column = table["embedding"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    names = table["vec_id"].to_numpy().astype(np.int64)
    return {n: (names[at], x) for n, (at, x) in whole(column, scale).items()}


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, query_bytes: int = QUERY_BYTES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by `every`, the k rows with the highest integer inner product.

    Components become floor(scale * x). Vectors that are null or hold null or non-finite components, and rows with a null vec_id, take no part; vectors of
    different lengths aren't compared. A row is never its query's own result (by vec_id); equal scores go to the smaller vec_id; repeated rows of
    one vec_id are each a candidate and, as queries, one (the first in order of components). Fewer candidates give fewer rows. Other columns are ignored;
    an empty table gives no rows.

    Queries go out in passes of bounded bytes; each pass reads the candidates once, prunes with bounds from segment means and deviations, coarse to fine,
    scores the survivors exactly and keeps k a task and query. Segments lie along the principal directions of at most `sample` vectors, which also give
    every query a floor to start from; how many pairs survive depends on the data (vectors with no direction of their own can't be pruned), the result doesn't.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    asked = rows.where(F.col("vec_id") % every == 0)
    figures = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("vec_id") % every == 0, (F.size("embedding") + 4) * 8)), F.lit(0)).alias("b")).first()
    passes = max(1, -(-int(figures["b"]) // query_bytes))
    some = rows if figures["n"] <= sample else rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * sample / figures["n"]))
    seeds = vectors_of(some.limit(sample).toArrow(), scale)
    bases = {n: fitted(x) for n, (_, x) in seeds.items()}
    out = None
    for p in range(passes):
        chosen = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p)
        blocks = {}
        for n, (names, x) in vectors_of(chosen.toArrow(), scale).items():
            order = np.lexsort((*(x[:, j] for j in range(n - 1, -1, -1)), names))
            names, x = names[order], x[order]
            first = np.append(True, names[1:] != names[:-1])
            names, x = names[first], x[first]
            own, others = seeds.get(n, (np.zeros(0, dtype=np.int64), np.zeros((0, n))))
            blocks[n] = Block(names, x, bases.get(n) or fitted(others), floors(names, x, own, others, k))
        shared = spark.sparkContext.broadcast(blocks)
        part = rows.mapInArrow(_searcher(shared, k, scale), "query_id long, vec_id long, score long")
        if passes > 1:  # the queries of one pass at a time are held on the driver and the executors
            part = materialize(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(shared, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        best = {n: (np.full((len(b.ids), k), LEAST, dtype=np.int64), np.full((len(b.ids), k), NONE, dtype=np.int64)) for n, b in blocks.items()}
        for batch in batches:
            names = batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for n, (at, x) in whole(batch.column("embedding"), scale).items():
                if n not in blocks:
                    continue
                scores, found = best[n]
                for a in range(0, len(at), TILE):
                    for b in range(0, len(blocks[n].ids), TILE):
                        search(blocks[n].part(b, b + TILE), names[at[a : a + TILE]], x[a : a + TILE], (scores[b : b + TILE], found[b : b + TILE]), k)
        for n, (scores, found) in best.items():
            q, j = np.nonzero(found != NONE)
            for a in range(0, len(q), 50_000):
                r, s = q[a : a + 50_000], j[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(blocks[n].ids[r]), pa.array(found[r, s]), pa.array(scores[r, s])], names=["query_id", "vec_id", "score"])

    return run


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
