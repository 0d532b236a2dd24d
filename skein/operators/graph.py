"""Normalisation, balancing and layout of contact graphs; connected components; greedy and iterative clustering."""

from __future__ import annotations

import itertools
import os
import tempfile
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, sized, written


def both_ways(edges: DataFrame, diagonal: bool = False) -> DataFrame:
    """Edges in both directions; the diagonal once, or not at all."""
    off = edges.where("src <> dst")
    out = off.select("src", "dst", "w").unionByName(off.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return out.unionByName(edges.where("src = dst").select("src", "dst", "w")) if diagonal else out


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("contig")).agg(F.sum("w").alias("degree"))


def scale(edges: DataFrame, factors: DataFrame) -> DataFrame:
    """Edge weights times the factors (contig, nw) of both ends, which are found once."""
    factors = sized(cut_lineage(factors))
    one, two = factors.select(F.col("contig").alias("src"), F.col("nw").alias("x")), factors.select(F.col("contig").alias("dst"), F.col("nw").alias("y"))
    return edges.join(one, "src").join(two, "dst").select("src", "dst", (F.col("w") * F.col("x") * F.col("y")).alias("w"))


def vertex_weights(vertices: DataFrame, method: str = "svc", alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """(contig, nw): the factor by which a contig scales its edges. vertices: contig, length, degree (its counts in the incidence); both count as 1 where they aren't positive.

    none, geom 1/sqrt(length), density 1/length, log 1/sqrt(ln(1 + length / median)), len_deg length**(-alpha/2) * degree**(-beta/2), vc 1/sqrt(degree),
    svc 1/sqrt(degree + half of what its length would get at the overall density), hybrid with both relative to their medians; any other name: geom.
    """
    tiny = 1e-9
    v = vertices.select("contig", F.when(F.col("length") > 0, F.col("length")).otherwise(1).cast("double").alias("a"), F.when(F.col("degree") > 0, F.col("degree")).otherwise(1).cast("double").alias("d"))
    if method in ("log", "svc", "hybrid"):
        v = v.join(F.broadcast(v.agg(F.percentile("a", F.lit(0.5)).alias("ma"), F.percentile("d", F.lit(0.5)).alias("md"), (F.sum("d") / F.sum("a")).alias("overall"))), F.lit(True))
    a, d = F.col("a"), F.col("d")
    if method == "none":
        nw = F.lit(1.0)
    elif method == "density":
        nw = 1 / a
    elif method == "log":
        nw = 1 / F.sqrt(F.greatest(F.log1p(a / F.greatest("ma", F.lit(1.0))), F.lit(tiny)))
    elif method == "len_deg":
        nw = 1 / (F.pow(a, F.lit(alpha / 2)) * F.pow(d, F.lit(beta / 2)))
    elif method == "vc":
        nw = 1 / F.sqrt(d)
    elif method == "svc":
        nw = 1 / F.sqrt(d + 0.5 * a * F.col("overall"))
    elif method == "hybrid":
        nw = 1 / F.sqrt(F.pow(F.greatest(a / F.greatest("ma", F.lit(1.0)), F.lit(tiny)), F.lit(alpha)) * F.pow(F.greatest(d / F.greatest("md", F.lit(1.0)), F.lit(tiny)), F.lit(beta)))
    else:
        nw = 1 / F.sqrt(a)
    return v.select("contig", nw.alias("nw"))


def vertices(incidence: DataFrame, contigs: DataFrame) -> DataFrame:
    """contig, length and degree: the sum of its counts in the incidence."""
    return incidence.groupBy("contig").agg(F.sum("cnt").alias("degree")).join(contigs, "contig")


def normalize(edges: DataFrame, vertices_: DataFrame, method: str = "svc") -> DataFrame:
    return edges.select("src", "dst", "w") if method == "none" else scale(edges, vertex_weights(vertices_, method))


def reweight(edges: DataFrame, prune: DataFrame, allelic: float | str = 0.0, weak: float = 0.0) -> DataFrame:
    """Edges with pruned pairs changed. prune: c1 < c2 and type, 0 allelic or 1 weak; pairs without an edge count as weight 0 and may get one.

    Weak pairs: times `weak`. Allelic pairs: 0 sets 0; a negative factor multiplies; a positive one gives (w + half the 90th percentile) * factor; 'power'
    2 w + mean / 2; 'maximum' the larger of 10 w and 2 mean; 'dynamic' 2 w ** 1.2; 'auto' a twentieth of the root of both row sums' product. Mean and
    percentile are those of the symmetric matrix's entries. Pairs whose weight becomes 0 are left out.
    """
    p = prune.select(F.col("c1").alias("src"), F.col("c2").alias("dst"), "type")
    e = edges.select("src", "dst", "w").join(p, ["src", "dst"], "full").withColumn("w", F.coalesce("w", F.lit(0.0)))
    w = F.col("w")
    if isinstance(allelic, str) or allelic > 0:
        data = both_ways(edges, diagonal=True)
        e = e.join(F.broadcast(data.agg(F.coalesce(F.avg("w"), F.lit(1.0)).alias("mean"), F.coalesce(F.percentile("w", F.lit(0.9)), F.lit(1.0)).alias("p90"))), F.lit(True))
    if allelic == "auto":
        sums = data.groupBy("src").agg(F.sum("w").alias("r"))
        e = e.join(sums.select("src", F.col("r").alias("r1")), "src", "left").join(sums.select(F.col("src").alias("dst"), F.col("r").alias("r2")), "dst", "left")
        new = F.sqrt(F.coalesce("r1", F.lit(1.0)) * F.coalesce("r2", F.lit(1.0))) * 0.05
    elif allelic == "power":
        new = w * 2 + F.col("mean") * 0.5
    elif allelic == "maximum":
        new = F.greatest(w * 10, F.col("mean") * 2)
    elif allelic == "dynamic":
        new = F.pow(w, F.lit(1.2)) * 2
    elif isinstance(allelic, str):
        raise ValueError(f"no such mode: {allelic}")
    elif allelic > 0:
        new = (w + F.col("p90") * 0.5) * allelic
    else:
        new = w * allelic
    return e.select("src", "dst", F.when(F.col("type") == 0, new).when(F.col("type") == 1, w * weak).otherwise(w).alias("w")).where("w <> 0")


def vc_balance(edges: DataFrame) -> DataFrame:
    """Both directions of w_ij / (r_i r_j) with row sums r."""
    s = both_ways(edges, diagonal=True)
    r = s.groupBy("src").agg(F.sum("w").alias("r"))
    return s.join(r, "src").join(r.select(F.col("src").alias("dst"), F.col("r").alias("q")), "dst").select("src", "dst", (F.col("w") / (F.col("r") * F.col("q"))).alias("w"))


def ice(edges: DataFrame, tolerance: float = 1e-5, rounds: int = 200) -> DataFrame:
    """Scales rows and columns by root row sums until every row sum is 1 within the tolerance. Only the factors are carried from round to round, checkpointed each time."""
    s = cut_lineage(both_ways(edges, diagonal=True))
    bias = s.select(F.col("src").alias("contig")).distinct().withColumn("b", F.lit(1.0))
    for _ in range(rounds):
        x, y = bias.select(F.col("contig").alias("src"), F.col("b").alias("bx")), bias.select(F.col("contig").alias("dst"), F.col("b").alias("by"))
        sums = s.join(y, "dst").groupBy("src").agg(F.sum(F.col("w") * F.col("by")).alias("t")).join(x, "src").withColumn("r", F.col("t") * F.col("bx"))
        bias = cut_lineage(sums.select(F.col("src").alias("contig"), (F.col("bx") / F.sqrt("r")).alias("b"), F.abs(1 - F.col("r")).alias("off")))
        if (bias.agg(F.max("off")).first()[0] or 0.0) < tolerance:
            break
    x, y = bias.select(F.col("contig").alias("src"), F.col("b").alias("bx")), bias.select(F.col("contig").alias("dst"), F.col("b").alias("by"))
    return s.join(x, "src").join(y, "dst").select("src", "dst", F.round(F.col("w") * F.col("bx") * F.col("by"), 6).alias("w"))


def layout_bins(tour: DataFrame, offsets: DataFrame) -> DataFrame:
    """Old bin (bin_id) to new bin (target) when contigs are laid out by path and position, reversed where their strand is -."""
    t = tour.join(offsets, "contig")
    first = F.sum("bins").over(Window.partitionBy("grp").orderBy("pos")) - F.col("bins")
    sizes = t.groupBy("grp").agg(F.sum("bins").alias("nb"))
    starts = sizes.select("grp", F.coalesce(F.sum("nb").over(Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("goff"))
    t = t.withColumn("first", first).join(starts, "grp").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)))
    place = F.when(F.col("strand") == "+", F.col("k")).otherwise(F.col("bins") - 1 - F.col("k"))
    return t.select((F.col("offset") + F.col("k")).alias("bin_id"), (F.col("goff") + F.col("first") + place).alias("target"))


#: Edges that a task holds at once while components are found, and nodes that it names before it hands on what it has.
EDGES, NODES = 1 << 20, 1 << 22


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, in order, each with the least node that it hangs together with."""
    names, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = back[: len(a)], back[len(a) :], np.arange(len(names))
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, lo, hi = a[apart], b[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(label, hi, lo)
        while (label[label] != label).any():
            label = label[label]
    return names, names[label]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) that join the same nodes as those given, at most one for each node of a partition: from the least one that hangs together with it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, least, held, size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(tuple(np.array(batch.column(c)) for c in ("src", "dst")))
                size += batch.num_rows
            if size >= EDGES or batch is None:
                node, least = stars(np.concatenate([node, *(x for x, _ in held)]), np.concatenate([least, *(y for _, y in held)]))
                held, size = [], 0
            if len(node) > NODES or batch is None:
                for lo in range(0, len(node), EDGES):
                    yield pa.RecordBatch.from_arrays([pa.array(least[lo : lo + EDGES]), pa.array(node[lo : lo + EDGES])], names=["src", "dst"])
                node, least = node[:0], least[:0]

    return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).mapInArrow(run, "src long, dst long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(contig, component): the least contig reachable. Each partition's edges become those of a forest, and these again in fewer partitions, as long as that makes them clearly fewer.

    When they fit one partition, it has the result. Otherwise labels spread over the edges left and jump to their label's label; each round is checkpointed.
    """
    left = cut_lineage(contracted(edges))
    n = left.count()
    while n:
        parts = -(-n // EDGES)
        left = cut_lineage(contracted(left.repartition(parts)))
        if parts == 1:
            return left.select(F.col("dst").alias("contig"), F.col("src").alias("component"))
        before, n = n, left.count()
        if n > before // 2:
            break
    pairs = cut_lineage(both_ways(left.withColumn("w", F.lit(1.0))).select("src", "dst").distinct())
    labels = cut_lineage(left.select(F.explode(F.array("src", "dst")).alias("contig")).distinct().withColumn("label", F.col("contig")))
    for _ in range(rounds):
        near = pairs.join(labels.select(F.col("contig").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("contig")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "contig", "left").select("contig", "label", F.least("label", F.coalesce("near", "label")).alias("mid"))
        jump = spread.select(F.col("contig").alias("mid"), F.col("mid").alias("far"))
        fresh = cut_lineage(spread.join(jump, "mid", "left").select("contig", F.least("mid", F.coalesce("far", "mid")).alias("label"), (F.least("mid", F.coalesce("far", "mid")) != F.col("label")).alias("moved")))
        labels = fresh.select("contig", "label")
        if fresh.where("moved").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return labels.select("contig", F.col("label").alias("component"))


#: Edges that are held at once while a graph is read or built.
CHUNK = 1 << 20


def stored(folder: str | None, size: int, kind: type) -> np.ndarray:
    """An array, in a new file of the folder if there is one, so that the system can take its memory back."""
    if folder is None or not size:
        return np.empty(size, dtype=kind)
    handle, path = tempfile.mkstemp(dir=folder)
    os.close(handle)
    return np.memmap(path, dtype=kind, mode="w+", shape=(size,))


def ordered(keys: np.ndarray, most: int) -> np.ndarray:
    """Where whole numbers below `most` stand in order, equal ones as they come."""
    n = len(keys)
    return np.sort(keys * n + np.arange(n)) % n if most * n < 2**62 else np.argsort(keys, kind="stable")


def places(names: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The place of each of some of the names (in order): by a table, where they lie close together."""
    if not len(names) or int(names[-1]) - int(names[0]) > 8 * len(names) + CHUNK:
        return lambda x: np.searchsorted(names, x)
    table = np.zeros(int(names[-1] - names[0]) + 1, dtype=np.int64)
    table[names - names[0]] = np.arange(len(names))
    return lambda x: table[x - names[0]]


class Spool:
    """Edges as they arrive, written to a folder; names: their nodes in order."""

    def __init__(self, folder: str):
        self.paths = [tempfile.mkstemp(dir=folder) for _ in range(3)]
        self.files = [os.fdopen(h, "wb") for h, _ in self.paths]
        self.names, self.held, self.size, self.total = np.zeros(0, dtype=np.int64), [], 0, 0

    def add(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> None:
        self.held.append((src.astype(np.int64), dst.astype(np.int64), w.astype(np.float64)))
        self.size += len(src)
        if self.size >= CHUNK:
            self.flush()

    def flush(self) -> None:
        if self.held:
            parts = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            self.names = np.unique(np.concatenate([self.names, parts[0], parts[1]]))
            for f, x in zip(self.files, parts, strict=True):
                x.tofile(f)
                f.flush()
            self.total, self.held, self.size = self.total + self.size, [], 0

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for lo in range(0, self.total, CHUNK):
            n = min(CHUNK, self.total - lo)
            yield tuple(np.fromfile(path, dtype=t, count=n, offset=8 * lo) for (_, path), t in zip(self.paths, (np.int64, np.int64, np.float64), strict=True))

    def chunks(self, names: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        place = places(names)
        for src, dst, w in self.parts():
            yield place(src), place(dst), w

    def network(self, folder: str, names: np.ndarray | None = None) -> Network:
        """The graph of the edges, which go."""
        self.flush()
        names = self.names if names is None else names
        out = Network.of(len(names), lambda: self.chunks(names), folder)
        for f, (_, path) in zip(self.files, self.paths, strict=True):
            f.close()
            os.remove(path)
        return out


class Parts(Spool):
    """Edges of several components as they arrive in any order, written to a folder."""

    def __init__(self, folder: str):
        super().__init__(folder)
        self.folder, self.keys, self.counts, self.of = folder, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []
        handle, self.path = tempfile.mkstemp(dir=folder)
        self.file = os.fdopen(handle, "wb")

    def put(self, component: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> None:
        self.of.append(component.astype(np.int64))
        self.add(src, dst, w)

    def flush(self) -> None:
        if self.of:
            of = np.concatenate(self.of)
            fresh, counts = np.unique(of, return_counts=True)
            keys, back = np.unique(np.concatenate([self.keys, fresh]), return_inverse=True)
            self.keys, self.counts, self.of = keys, np.bincount(back, weights=np.concatenate([self.counts, counts])).astype(np.int64), []
            of.tofile(self.file)
            self.file.flush()
        super().flush()

    def networks(self) -> Iterator[tuple[int, np.ndarray, Network]]:
        """Each component with its nodes in order and its graph, in files if it is large."""
        self.flush()
        self.file.close()
        if len(self.keys) == 1:
            yield int(self.keys[0]), self.names, self.network(self.folder)
        if len(self.keys) < 2:
            return
        src, dst, w = (stored(self.folder, self.total, t) for t in (np.int64, np.int64, np.float64))
        ends = np.cumsum(self.counts)
        free = ends - self.counts
        for k, part in enumerate(self.parts()):
            of = np.searchsorted(self.keys, np.fromfile(self.path, dtype=np.int64, count=len(part[0]), offset=8 * k * CHUNK))
            order, here = np.argsort(of, kind="stable"), np.bincount(of, minlength=len(self.keys))
            to = free[of[order]] + np.arange(len(of)) - (np.cumsum(here) - here)[of[order]]
            for all_, x in zip((src, dst, w), part, strict=True):
                all_[to] = x[order]
            free += here
        for key, hi, n in zip(self.keys.tolist(), ends.tolist(), self.counts.tolist(), strict=True):
            own = Spool(self.folder) if n > CHUNK else None
            if own is None:
                a, b, x = (np.array(v[hi - n : hi]) for v in (src, dst, w))
                names, back = np.unique(np.concatenate([a, b]), return_inverse=True)
                yield key, names, Network.of(len(names), lambda x=x, back=back, n=n: [(back[:n], back[n:], x)])
                continue
            for lo in range(hi - n, hi, CHUNK):
                own.add(*(v[lo : min(lo + CHUNK, hi)] for v in (src, dst, w)))
            graph = own.network(self.folder)
            yield key, own.names, graph


class Network:
    """A weighted graph as adjacency lists, in files if there is a folder for them; loops count twice in a node's degree."""

    def __init__(self, n: int, at: np.ndarray, heads: np.ndarray, weights: np.ndarray, loops: np.ndarray, folder: str | None = None):
        self.n, self.at, self.heads, self.weights, self.loops, self.folder = n, at, heads, weights, loops, folder
        self.degree = 2.0 * loops
        for lo, hi, owner in self.spans():
            self.degree += np.bincount(owner, weights=self.weights[lo:hi], minlength=n)
        self.total = float(self.degree.sum())

    @classmethod
    def of(cls, n: int, chunks: Callable[[], Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]], folder: str | None = None) -> Network:
        """chunks: gives the edges (src, dst, w) part by part, twice."""
        counts = np.zeros(n, dtype=np.int64)
        for src, dst, _ in chunks():
            counts += np.bincount(src, minlength=n) + np.bincount(dst, minlength=n)
        at = np.concatenate([[0], np.cumsum(counts)])
        heads, weights, free = stored(folder, int(at[-1]), np.int32 if n < 2**31 else np.int64), stored(folder, int(at[-1]), np.float64), at[:-1].copy()
        for src, dst, w in chunks():
            ends = np.concatenate([src, dst]).astype(np.int64)
            order = ordered(ends, n)
            here = np.bincount(ends, minlength=n)
            ends = ends[order]
            to = free[ends] + np.arange(len(ends)) - (np.cumsum(here) - here)[ends]
            heads[to], weights[to] = np.concatenate([dst, src])[order], np.concatenate([w, w])[order]
            free += here
        out = cls(n, at, heads, weights, np.zeros(n), folder)
        for lo, hi, owner in out.spans():
            if hi > lo:
                first = int(owner[0])
                order = ordered((owner - first) * n + heads[lo:hi], (int(owner[-1]) - first + 1) * n)
                heads[lo:hi], weights[lo:hi] = heads[lo:hi][order], weights[lo:hi][order]
        return out

    def spans(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Stretches of whole adjacency lists of about CHUNK entries, with each entry's node."""
        v = 0
        while v < self.n:
            u = max(v + 1, int(np.searchsorted(self.at, self.at[v] + CHUNK, side="right")) - 1)
            yield int(self.at[v]), int(self.at[u]), np.repeat(np.arange(v, u), np.diff(self.at[v : u + 1]))
            v = u

    def near(self, v: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Communities around a node, in order, and the weight between it and each."""
        lo, hi = self.at[v], self.at[v + 1]
        c, w = own[self.heads[lo:hi]], self.weights[lo:hi]
        if 16 * len(c) < self.n:
            names, back = np.unique(c, return_inverse=True)
            return names, np.bincount(back, weights=w, minlength=len(names))
        sums, seen = np.bincount(c, weights=w, minlength=self.n), np.zeros(self.n, dtype=bool)
        seen[c] = True
        names = np.flatnonzero(seen)
        return names, sums[names]

    @staticmethod
    def first_best(gains: np.ndarray, least: float) -> int:
        """Where gains are best, taken in order: the next is taken if it is clearly more than the one before; -1 if none is more than the least."""
        found, left = -1, np.flatnonzero(gains > least)
        while len(left):
            found = int(left[0])
            left = left[1:][gains[left[1:]] > gains[found] + 1e-12]
        return found

    def move(self, own: np.ndarray, resolution: float) -> np.ndarray:
        """Nodes go to the neighbouring community with the largest gain; neighbours of those that moved are looked at again. Ties stay, then go to the lower community."""
        own = own.copy()
        mass = np.bincount(own, weights=self.degree, minlength=self.n)
        queue, waiting = deque(range(self.n)), np.ones(self.n, dtype=bool)
        for _ in range(200 * self.n + 1000):
            if not queue:
                break
            v = queue.popleft()
            waiting[v] = False
            mine, (names, sums) = int(own[v]), self.near(v, own)
            mass[mine] -= self.degree[v]
            gains = sums - resolution * mass[names] * self.degree[v] / self.total
            here = np.searchsorted(names, mine)
            stay = gains[here] if here < len(names) and names[here] == mine else -resolution * mass[mine] * self.degree[v] / self.total
            k = self.first_best(gains, stay + 1e-12)
            best = mine if k < 0 else int(names[k])
            mass[best] += self.degree[v]
            if best != mine:
                own[v] = best
                around = self.heads[self.at[v] : self.at[v + 1]]
                around = around[(own[around] != best) & ~waiting[around]]
                waiting[around] = True
                queue.extend(around.tolist())
        return own

    def refine(self, own: np.ndarray, resolution: float) -> np.ndarray:
        """Splits every community into parts that hang together: each node alone, then single nodes that are well connected within their community join the best part of it."""
        part = np.arange(self.n)
        mass, size = self.degree.copy(), np.ones(self.n, dtype=int)
        whole = np.bincount(own, weights=self.degree, minlength=self.n)
        inside = np.zeros(self.n)  # weight between a part and the rest of its community
        for lo, hi, owner in self.spans():
            inside += np.bincount(owner, weights=np.where(own[owner] == own[self.heads[lo:hi]], self.weights[lo:hi], 0.0), minlength=self.n)
        for v in range(self.n):
            rest = whole[own[v]] - self.degree[v]
            if size[part[v]] > 1 or inside[v] < resolution * self.degree[v] * rest / self.total:
                continue
            names, sums = self.near(v, part)
            ok = (names != part[v]) & (own[names] == own[v])
            ok &= inside[names] >= resolution * mass[names] * (whole[own[v]] - mass[names]) / self.total
            k = self.first_best(np.where(ok, sums - resolution * mass[names] * self.degree[v] / self.total, -np.inf), 1e-12)
            if k >= 0:
                best = int(names[k])
                inside[best] += inside[v] - 2 * sums[k]
                mass[best] += mass[v]
                size[best] += 1
                part[v] = best
        return part

    def folded(self, part: np.ndarray, k: int) -> Network:
        """The graph whose nodes are the parts 0 .. k-1, made part by part."""
        loops, order = np.bincount(part, weights=self.loops, minlength=k), np.argsort(part, kind="stable")
        starts, sizes = np.searchsorted(part[order], np.arange(k + 1)), np.zeros(k, dtype=np.int64)
        most = np.minimum(np.bincount(part, weights=np.diff(self.at), minlength=k).astype(np.int64), k)
        heads, weights, used = stored(self.folder, int(most.sum()), np.int32 if k < 2**31 else np.int64), stored(self.folder, int(most.sum()), np.float64), 0
        for p in range(k):
            members = order[starts[p] : starts[p + 1]].tolist()
            if len(members) == 1:
                names, sums = self.near(members[0], part)
            else:
                whole = np.zeros(k)
                for v in members:
                    at, x = self.near(v, part)
                    whole[at] += x
                names = np.flatnonzero(whole)
                sums = whole[names]
            inner = names == p
            loops[p] += sums[inner].sum() / 2
            names, sums = names[~inner], sums[~inner]
            heads[used : used + len(names)], weights[used : used + len(names)] = names, sums
            sizes[p], used = len(names), used + len(names)
        return Network(k, np.concatenate([[0], np.cumsum(sizes)]), heads[:used], weights[:used], loops, self.folder)


def leiden(nodes: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, resolution: float = 1.0) -> np.ndarray:
    """Community of each node by modularity: local moves, refinement into parts that hang together, the same on the graph of the parts, until nothing moves.

    Nodes are visited in order and ties go to the lower community, so reruns agree.
    """
    return clustered(Network.of(nodes, lambda: [(src, dst, w)]), resolution)


def clustered(graph: Network, resolution: float = 1.0) -> np.ndarray:
    """leiden() of a graph that is there."""
    own, label = np.arange(graph.n), np.arange(graph.n)
    while graph.total > 0:
        own = graph.move(own, resolution)
        part = graph.refine(own, resolution)
        names, part = np.unique(part, return_inverse=True)
        if len(names) == graph.n:  # no two nodes belong together more closely than their communities
            names, part = np.unique(own, return_inverse=True)
            if len(names) == graph.n:
                break
        member = np.empty(len(names), dtype=np.int64)
        member[part] = own
        label, graph = part[label], graph.folded(part, len(names))
        own = np.unique(member, return_inverse=True)[1]
    return own[label]


def communities(edges: DataFrame, resolution: float = 1.0, group: str | None = None) -> DataFrame:
    """(component, contig, community): Leiden inside every connected component, or every given group, each in one task; communities are named by their least contig.

    A component's contigs fit a worker (10^3 to 10^5 whatever the number of reads behind the weights); its edges needn't: they arrive in batches and lie in files of the task's
    temporary folder, as do those of the graphs of parts.
    """
    labelled = joined(edges) if group is None else edges.where("src <> dst").withColumnRenamed(group, "component")
    return found_within(labelled, lambda graph: clustered(graph, resolution))


def joined(edges: DataFrame) -> DataFrame:
    """Edges (component, src, dst, w) off the diagonal with the component that each lies in, written once."""
    edges = written(edges.where("src <> dst").select("src", "dst", "w"))
    return edges.join(sized(components(edges)).select(F.col("contig").alias("src"), "component"), "src")


def found_within(labelled: DataFrame, find: Callable[[Network], np.ndarray]) -> DataFrame:
    """(component, contig, community): what is found in each component's graph. A component goes to one task, in any order of its edges, so nothing is sorted on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            parts = Parts(folder)
            for batch in batches:
                parts.put(*(np.array(batch.column(c)) for c in ("component", "src", "dst", "w")))
            for component, names, graph in parts.networks():
                least = pd.Series(names).groupby(find(graph)).transform("min")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), component)), pa.array(names), pa.array(least.to_numpy())], names=["component", "contig", "community"])

    rows = labelled.select(F.col("component").cast("long").alias("component"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w"))
    return rows.repartition("component").mapInArrow(run, "component long, contig long, community long")


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Modularity of a partition (contig, grp)."""
    off = edges.where("src <> dst")
    one, two = membership.select(F.col("contig").alias("src"), F.col("grp").alias("g1")), membership.select(F.col("contig").alias("dst"), F.col("grp").alias("g2"))
    inner = off.join(one, "src").join(two, "dst").agg(F.sum(F.when(F.col("g1") == F.col("g2"), F.col("w")).otherwise(0.0)).alias("inner"), F.sum("w").alias("total"))
    mass = degrees(off).join(membership, "contig").groupBy("grp").agg(F.sum("degree").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("mm"))
    return inner.join(F.broadcast(mass), F.lit(True)).select(F.round(F.col("inner") / F.col("total") - F.col("mm") / (4 * F.col("total") * F.col("total")), 6).alias("modularity"))


def merge_groups(blocks: pd.DataFrame, sizes: dict[int, float], k: int, conflicts: set[tuple[int, int]] = frozenset()) -> dict[int, int]:
    """Greedy merge of groups to k by the largest v_ij - v_i v_j / sum(V); pairs in conflict never merge. Returns group -> merged group (its least member).

    Each group keeps its best partner after it, so a merge looks again only at the rows that it touches.
    """
    names = np.array(sorted(sizes))
    n = len(names)
    v, bad = np.zeros((n, n)), np.zeros((n, n), dtype=bool)
    a, b, w = np.searchsorted(names, blocks["grp1"].to_numpy(dtype=np.int64)), np.searchsorted(names, blocks["grp2"].to_numpy(dtype=np.int64)), blocks["w"].to_numpy(dtype=float)
    np.add.at(v, (a, b), w)
    np.add.at(v, (b[a != b], a[a != b]), w[a != b])
    for x, y in np.searchsorted(names, np.array(sorted(conflicts), dtype=np.int64).reshape(-1, 2)):
        bad[x, y] = bad[y, x] = True
    total, row, alive = v.sum(), v.sum(1), np.ones(n, dtype=bool)
    held, best, with_ = {i: [i] for i in range(n)}, np.full(n, -np.inf), np.zeros(n, dtype=int)

    def scan(i: int) -> None:
        gains = np.where(alive[i + 1 :] & ~bad[i, i + 1 :], v[i, i + 1 :] - row[i] * row[i + 1 :] / total if total else 0.0, -np.inf)
        with_[i] = i + 1 + int(gains.argmax()) if len(gains) else i
        best[i] = gains.max(initial=-np.inf)

    for i in range(n):
        scan(i)
    while len(held) > k:
        i = int(best.argmax())
        if best[i] == -np.inf:
            break
        j = int(with_[i])
        v[i] += v[j]
        v[:, i] += v[:, j]
        v[j], v[:, j] = 0, 0
        row[i], row[j], alive[j], best[j] = row[i] + row[j], 0, False, -np.inf
        bad[i] |= bad[j]
        bad[:, i] = bad[i]
        held[i] += held.pop(j)
        scan(i)
        for x in np.flatnonzero(alive[:j] & ((with_[:j] == j) | (with_[:j] == i))).tolist():
            scan(x)
        left = np.flatnonzero(alive[:i] & ~bad[:i, i])
        gains = v[left, i] - row[left] * row[i] / total if total else np.zeros(len(left))
        more = (gains > best[left]) | (gains == best[left]) & (i < with_[left])
        best[left[more]], with_[left[more]] = gains[more], i
    return {int(names[m]): int(names[min(ms)]) for ms in held.values() for m in ms}


def merged_within(blocks: DataFrame, sizes: DataFrame, k: int, conflicts: DataFrame | None = None) -> DataFrame:
    """(grp, merged): merge_groups() of each parent's groups, one parent a task. blocks: grp1, grp2, w; sizes: parent, grp; conflicts: grp1, grp2. Rows across parents don't count."""
    one, two = sizes.select(F.col("grp").alias("grp1"), F.col("parent").cast("long").alias("parent")), sizes.select(F.col("grp").alias("grp2"), F.col("parent").cast("long").alias("p2"))
    own = sizes.select(F.col("parent").cast("long").alias("parent"), F.col("grp").alias("grp1"), F.col("grp").alias("grp2"), F.lit(0.0).alias("w"), F.lit(0).alias("kind"))
    rows = blocks.select("grp1", "grp2", "w", F.lit(1).alias("kind"))
    rows = rows if conflicts is None else rows.unionByName(conflicts.select("grp1", "grp2", F.lit(0.0).alias("w"), F.lit(2).alias("kind")))
    rows = rows.join(one, "grp1").join(two, "grp2").where("parent = p2").select("parent", "grp1", "grp2", "w", "kind")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        kinds = {x: part[part["kind"] == x] for x in range(3)}
        bad = set(zip(kinds[2]["grp1"].tolist(), kinds[2]["grp2"].tolist(), strict=True))
        to = merge_groups(kinds[1].sort_values(["grp1", "grp2"]), dict.fromkeys(kinds[0]["grp1"].tolist(), 1), k, bad)
        return pd.DataFrame({"grp": list(to), "merged": list(to.values())}, dtype="int64")

    return own.unionByName(rows).groupBy("parent").applyInPandas(run, "grp long, merged long")


def half_densities(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """Links between contig halves (H: first, T: second), their density by both contigs' lengths, and confidence.

    Confidence is the density over the largest density that either half has with any other half, 2 if neither has another. Pairs count alike whichever contig
    comes first. Links are counted over numbers; names are made for the counts only.
    """
    lengths = sized(contigs.select("contig", "length"))
    one, two = lengths.select(F.col("contig").alias("chrom1"), F.col("length").alias("l1")), lengths.select(F.col("contig").alias("chrom2"), F.col("length").alias("l2"))
    one, two = (sized(x) for x in (one, two))
    tail1, tail2 = F.col("pos1") * 2 > F.col("l1"), F.col("pos2") * 2 > F.col("l2")
    ends = F.sort_array(F.array(F.struct(F.col("chrom1").alias("contig"), tail1.alias("tail"), F.col("l1").alias("length")), F.struct(F.col("chrom2").alias("contig"), tail2.alias("tail"), F.col("l2").alias("length"))))
    counted = pairs.where("chrom1 <> chrom2").join(one, "chrom1").join(two, "chrom2").select(ends[0].alias("a"), ends[1].alias("b")).groupBy("a", "b").agg(F.count("*").alias("links"))

    def name(end: str) -> F.Column:
        return F.concat(F.col(f"{end}.contig").cast("string"), F.when(F.col(f"{end}.tail"), "T").otherwise("H"))

    e = counted.select(F.least(name("a"), name("b")).alias("x"), F.greatest(name("a"), name("b")).alias("y"), "links", (F.col("links") * 4e8 / (F.col("a.length").cast("double") * F.col("b.length"))).alias("density"))
    sides = e.select("x", "y", "density").unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"), "density"))
    rn = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("density"), "y"))
    ranked = sides.withColumn("rn", rn).where("rn <= 2")
    tops = ranked.groupBy("x").agg(F.max(F.when(F.col("rn") == 1, F.col("y"))).alias("first"), F.max("density").alias("best"), F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("density"))), F.lit(0.0)).alias("second"))
    here, there = tops.select("x", F.col("first").alias("x_first"), F.col("best").alias("x_best"), F.col("second").alias("x_second")), tops.select(F.col("x").alias("y"), F.col("first").alias("y_first"), F.col("best").alias("y_best"), F.col("second").alias("y_second"))
    other = F.greatest(F.when(F.col("x_first") == F.col("y"), F.col("x_second")).otherwise(F.col("x_best")), F.when(F.col("y_first") == F.col("x"), F.col("y_second")).otherwise(F.col("y_best")))
    return e.join(here, "x").join(there, "y").select("x", "y", "links", "density", F.when(other > 0, F.col("density") / other).otherwise(2.0).alias("confidence"))


class Growth:
    """Paths of one group's contigs, grown round by round from the links between their ends.

    A path's end is the contig halves from that end inwards that begin within the flank, half of the path's halves at most. In each round the links between all ends become
    densities; a link surer than the cutoff (denser than any other of both ends by that factor) joins its two paths. When none is, the shortest path steps aside
    and the others try again, until two are left. Links are kept as lists, so a round is linear in them.
    """

    def __init__(self, lengths: dict[int, int], flank: int, cutoff: float):
        self.lengths, self.flank, self.cutoff = lengths, flank, cutoff
        # a path is its halves in order: (contig, 0) and (contig, 1) are first and second half
        self.paths: list[list[tuple[int, int]]] = [[(c, 0), (c, 1)] for c in sorted(lengths)]

    def size(self, path: list[tuple[int, int]]) -> float:
        return sum(self.lengths[c] / 2 for c, _ in path)

    def end(self, path: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], float]:
        taken, held = [], 0.0
        for half in path[: len(path) // 2]:
            if taken and held >= self.flank:
                break
            taken.append(half)
            held += self.lengths[half[0]] / 2
        return taken, held

    def links(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, at: dict[tuple[int, int], int]) -> list[tuple[float, int, int]]:
        """(confidence, end, end) of the ends 2 p and 2 p + 1 of path p, surest first, those at most at the cutoff left out."""
        owner, width = np.full(len(at), -1), np.zeros(2 * len(self.paths))
        for p, path in enumerate(self.paths):
            for side, part in ((0, path), (1, path[::-1])):
                halves, width[2 * p + side] = self.end(part)
                owner[[at[h] for h in halves]] = 2 * p + side
        x, y = owner[a], owner[b]
        ok = (x >= 0) & (y >= 0) & (x // 2 != y // 2)
        lo, hi = np.minimum(x, y)[ok], np.maximum(x, y)[ok]
        keys, back = np.unique(lo * (2 * len(self.paths)) + hi, return_inverse=True)
        x, y = keys // (2 * len(self.paths)), keys % (2 * len(self.paths))
        density = np.bincount(back, weights=n[ok], minlength=len(keys)) / (width[x] * width[y])
        ends, others, d = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([density, density])
        order = np.lexsort((others, -d, ends))
        first, second, partner = np.zeros(len(width)), np.zeros(len(width)), np.full(len(width), -1)
        for e, o, v in zip(ends[order].tolist(), others[order].tolist(), d[order].tolist(), strict=True):
            if partner[e] < 0:
                partner[e], first[e] = o, v
            elif not second[e]:
                second[e] = v
        rest = np.maximum(np.where(partner[x] == y, second[x], first[x]), np.where(partner[y] == x, second[y], first[y])) if len(x) else np.zeros(0)
        sure = np.where(rest > 0, density / np.where(rest > 0, rest, 1), 2.0)
        order = np.lexsort((y, x, -density, -sure))  # of links as sure as each other, the denser first
        return [(float(sure[k]), int(x[k]), int(y[k])) for k in order.tolist() if sure[k] > self.cutoff]

    def join(self, found: list[tuple[float, int, int]]) -> None:
        held = {p: [p] for p in range(len(self.paths))}
        of = {p: p for p in held}
        made = {p: list(path) for p, path in enumerate(self.paths)}
        for _, i, j in found:
            a, b = of[i // 2], of[j // 2]
            if a == b:
                continue
            # the first path ends, and the second begins, with the two halves that meet
            one = self.paths[i // 2][0 if i % 2 == 0 else -1]
            two = self.paths[j // 2][0 if j % 2 == 0 else -1]
            left, right = made[a], made[b]
            left = left[::-1] if left[0] == one else left
            right = right[::-1] if right[-1] == two else right
            if left[-1] != one or right[0] != two:
                continue
            made[a] = left + right
            held[a] += held.pop(b)
            del made[b]
            for p in held[a]:
                of[p] = a
        self.paths = sorted(made.values(), key=lambda p: (-self.size(p), min(c for c, _ in p)))

    def run(self, rows: pd.DataFrame) -> list[list[tuple[int, str]]]:
        """rows: x, y (names of halves) and links. Paths of (contig, strand), the longest first, then those that stepped aside, the last first."""
        at = {(c, h): 2 * i + h for i, c in enumerate(sorted(self.lengths)) for h in (0, 1)}
        place = lambda names: np.array([at[int(v[:-1]), int(v[-1] == "T")] for v in names], dtype=np.int64)
        a, b, n = place(rows["x"]), place(rows["y"]), rows["links"].to_numpy(dtype=float)
        aside = []
        while len(self.paths) > 1:
            if found := self.links(a, b, n, at):
                self.join(found)
            elif len(self.paths) > 2:
                aside.append(self.paths.pop())
            else:
                break
        out = []
        for path in [*self.paths, *aside[::-1]]:
            path = path[::-1] if path[0][0] > path[-1][0] or path[0][0] == path[-1][0] and path[0][1] else path
            out.append([(c, "+" if h == 0 else "-") for c, h in path[::2]])
        return out


def ordered_groups(pairs: DataFrame, contigs: DataFrame, membership: DataFrame, flank: int = 500_000, cutoff: float = 1.0) -> DataFrame:
    """(grp, path, pos, contig, strand): contigs of each group ordered and oriented by growing paths over the links of their halves, one group a task."""
    m = membership.select("contig", "grp")
    halves = m.select(F.explode(F.array(*(F.concat(F.col("contig").cast("string"), F.lit(h)) for h in "HT"))).alias("x"), "grp")
    d = half_densities(pairs, contigs).select("x", "y", "links")
    none = F.lit(0).cast("long")  # not null: pandas would turn the numbers beside it into doubles
    inner = d.join(halves, "x").join(halves.select(F.col("x").alias("y"), F.col("grp").alias("g2")), "y").where("grp = g2").select("grp", "x", "y", "links", none.alias("contig"), none.alias("length"))
    alone = m.join(contigs, "contig").select("grp", F.lit(None).cast("string").alias("x"), F.lit(None).cast("string").alias("y"), none.alias("links"), "contig", "length")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["x"].isna()]
        paths = Growth({int(c): int(n) for c, n in zip(own["contig"], own["length"], strict=True)}, flank, cutoff).run(rows[rows["x"].notna()])
        flat = [(i, *x) for i, p in enumerate(paths, 1) for x in p]
        return pd.DataFrame({"grp": rows["grp"].iloc[0], "path": [i for i, _, _ in flat], "pos": np.arange(1, len(flat) + 1), "contig": [c for _, c, _ in flat], "strand": [s for _, _, s in flat]})

    return inner.unionByName(alone).groupBy("grp").applyInPandas(run, "grp long, path long, pos long, contig long, strand string")


def longest_increasing(values: list[int]) -> int:
    """Length of the longest strictly increasing subsequence."""
    from bisect import bisect_left

    tails: list[int] = []
    for v in values:
        i = bisect_left(tails, v)
        tails[i : i + 1] = [v]
    return len(tails)


def longest_common(a: list, b: list, weights: list | None = None) -> int:
    """Length, or with a weight for each element of a weight, of the heaviest common subsequence."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    other = np.array(b, dtype=object)
    for x, w in zip(a, weights or [1] * len(a), strict=True):
        hit = np.concatenate([[0], row[:-1] + w * (other == x).astype(np.int64)]) if len(b) else row
        row = np.maximum.accumulate(np.maximum(row, hit))
    return int(row[-1])


def hungarian(cost: np.ndarray) -> np.ndarray:
    """For each row its column in an assignment of least total cost (rows <= columns): shortest augmenting paths with potentials."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            slack = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = np.zeros(n, dtype=int)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


