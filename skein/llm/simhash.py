"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming links, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import distinct, fresh, mix, raw, sliced

#: The steps here are many, so what one has shuffled goes before the next one begins.
materialize = partial(common.materialize, release=True)
LANES = np.uint64(0x0101010101010101)
#: Buckets of at most this many fingerprints are compared pair by pair; larger ones go the exact way without pairs.
PAIRS_UP_TO = 24
#: Graphs of at most this many edges are united on the driver, some 2 MB; larger ones in rounds of joins.
UNITED = 100_000


def hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included; of the whole sequence if it is shorter; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, 42)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, ends, strict=True)], dtype=np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first. Eight bits at a time are summed in byte lanes over at most 255 rows."""
    out = np.zeros(64, dtype=np.int64)
    if not len(h):
        return out
    cuts = np.arange(0, len(h), 255)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & LANES, cuts)
        out[k::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 without hashes."""
    if not len(h):
        return 0
    return int(np.packbits(bit_counts(h) * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    return majority(hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """All columns of docs but text, with fp (the 64 bits as a signed long)."""
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = np.array([fingerprint(t, shingle) for t in raw(batch.column("text"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(own, pa.int64())], names=[*keep, "fp"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*(f for f in docs.schema.fields if f.name != "text"), T.StructField("fp", T.LongType())]))


def block_masks(distance: int, blocks: int | None = None) -> list[int]:
    """Bit masks such that fingerprints at most `distance` bits apart agree under one of them: of `blocks` blocks, all but `distance` agree."""
    blocks = blocks or distance + 3
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])
    return fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.table", "k.key")


def apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b), a < b as signed, between distinct fingerprints at most `distance` bits apart: enough of them to connect all that do.

    fps: distinct fp. Fingerprints meet in buckets (one of the pigeonhole masks, the bits under it). Small buckets: each pair, verified. Of
    larger ones no pairs are made: each member is keyed by its bits with every choice of `distance` free bits cleared; members that
    share such a key are within the distance of each other, so each gets one link to their least, and every close pair shares one.
    """
    masks = block_masks(distance)
    keys = keyed(fps, masks)
    counted = keys.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(keys.join(counted, ["table", "key"]))
    small = members.where(F.col("n") <= PAIRS_UP_TO).groupBy("table", "key").agg(F.collect_list("fp").alias("fps"))
    pairs = small.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b")).where((F.col("a") < F.col("b")) & (apart(F.col("a"), F.col("b")) <= distance))
    choices = []
    for m in masks:
        free = [b for b in range(64) if not m >> b & 1]
        choices.append(F.array(*[F.lit(signed(sum(1 << b for b in chosen) ^ (2**64 - 1))) for chosen in combinations(free, distance)]))
    own = F.get(F.array(*choices), F.col("table"))
    cleared = members.where(F.col("n") > PAIRS_UP_TO).select("fp", "table", F.posexplode(own).alias("choice", "mask"))
    cleared = cleared.select("fp", "table", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    # at most 2 ** distance fingerprints have a key in common, so no window is large
    least = F.min("fp").over(Window.partitionBy("table", "choice", "key"))
    stars = cleared.select(least.alias("a"), F.col("fp").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def united(edges: DataFrame) -> DataFrame:
    """components() of few edges (u, v), found on the driver: each node under the least one that it reaches."""
    table = edges.toArrow()
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for u, v in zip(table.column("u").to_pylist(), table.column("v").to_pylist(), strict=True):
        u, v = top(u), top(v)
        root[max(u, v)] = min(u, v)
    nodes = sorted(root)
    found = pa.table([pa.array(nodes, pa.int64()), pa.array(map(top, nodes), pa.int64())], names=["node", "root"])
    return F.broadcast(edges.sparkSession.createDataFrame(found))


def components(edges: DataFrame, rounds: int = 60, few: int = UNITED) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the least node that it reaches. Alternates large and small stars until nothing changes.

    Every round is joins and minima keyed by node, and its result goes to the checkpoint folder, so no component is gathered in one place. Rounds grow with the
    logarithm of the longest path; should `rounds` not do, this is an error, never an unfinished result. Up to `few` edges need no rounds: they are united on the
    driver, with the same result.
    """
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if current.count() <= few:
        return united(current)
    before = None
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("of", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), "m")
        joined = large.join(lowest, F.col("u") == F.col("of"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lowest.select(F.col("of").alias("u"), F.col("m").alias("v"))).distinct()
        current = materialize(small)
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return current.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id reachable over links of at most `distance` differing bits.

    Fingerprints over shingles of `shingle` words, A-Z lower-cased. Null and empty texts have fingerprint zero and link like any other. Texts are
    read once; copies collapse to one fingerprint before anything is compared. A null doc_id gets its component's smallest non-null doc_id, null if there is none;
    repeated rows come back each; an empty table gives no rows; other columns are ignored.
    """
    own = materialize(fingerprints(docs.select("doc_id", "text"), shingle))
    classes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(classes.select("fp"), distance))
    rooted = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = rooted.join(roots, "root").select(F.col("fp").alias("of"), "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(placed, F.col("fp") == F.col("of")).select("doc_id", hexed.alias("fingerprint"), "component_id")


#: A sketch has BANDS * ROWS smallest hashes; texts meet where all ROWS of a band agree. At a similarity of 0.8, 5 pairs in a million don't meet, at every size of table.
BANDS, ROWS = 40, 6
FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
#: How many deviations of a sketch's agreement lie between the similarity and the agreement under which a pair's shingles aren't looked at.
DEVIATIONS = 5
#: Members of one side of a tile: no two groups larger than this meet in one task.
SIDE = 128
#: Nodes whose texts are looked for by a broadcast of their md5 and node, some 100 bytes each; more are joined.
LOOKED_FOR = 200_000


def sketch(h: np.ndarray) -> np.ndarray:
    """The least of the shingle hashes under each of the FACTORS, mixed and cut to 32 bits: the share in which two sketches agree is about the sets' Jaccard similarity."""
    out = np.full(len(FACTORS), 2**64 - 1, dtype=np.uint64)
    for a in range(0, len(h), 512):
        np.minimum(out, (h[a : a + 512] * FACTORS[:, None]).min(axis=1), out=out)
    return (mix(out) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """Of sketches (rows), BANDS keys each: a hash of the band's values over the band's number in the lowest six bits."""
    parts = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    number = np.arange(BANDS, dtype=np.uint64)
    out = np.zeros(parts.shape[:2], dtype=np.uint64) + number
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return (out & np.uint64(2**64 - 64) | number).view(np.int64)


def pieces(n: Column) -> Column:
    """Into how many groups of about SIDE n members go."""
    return F.greatest(F.ceil(n / SIDE), F.lit(1))


def shingle_sets(wanted: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, held): the distinct shingle hashes, sorted, of the wanted nodes' texts. texts: md, text; nodes: md, node."""
    wanted = materialize(nodes.join(wanted.select("node").distinct(), "node"))
    wanted = F.broadcast(wanted) if wanted.count() <= LOOKED_FOR else wanted

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = [distinct(hashes(t, shingle)).tobytes() for t in raw(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.binary())], names=["node", "held"])

    return texts.join(wanted, "md").select("node", "text").mapInArrow(sets, "node long, held binary").groupBy("node").agg(F.min("held").alias("held"))


class Sets:
    """Shingle sets by row, over small numbers, and which of some rows reach a similarity with one."""

    def __init__(self, held: list[bytes]):
        own = [np.frombuffer(x, dtype=np.uint64) for x in held]
        numbers = distinct(np.concatenate([*own, np.zeros(0, dtype=np.uint64)]))
        self.own = [np.searchsorted(numbers, x) for x in own]
        self.marks = np.zeros(len(numbers), dtype=np.int64)

    def near(self, one: int, others: np.ndarray, similarity: float) -> np.ndarray:
        x, out = self.own[one], np.zeros(len(others), dtype=bool)
        self.marks[x] = 1
        for at in range(0, len(others), SIDE):
            ys = [self.own[int(y)] for y in others[at : at + SIDE]]
            sizes = np.array([len(y) for y in ys])
            ends = np.cumsum(sizes)
            sums = np.r_[0, np.cumsum(self.marks[np.concatenate(ys)])]
            both = sums[ends] - sums[ends - sizes]
            out[at : at + len(ys)] = both >= similarity * (len(x) + sizes - both)
        self.marks[x] = 0
        return out


def settled(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b, tile) of nodes whose sets of shingle hashes have the similarity.

    Only the pairs' own texts are fetched, and each set goes once to every tile that one of its pairs is in; small tiles share a group.
    """
    pairs = materialize(pairs)
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node"), "tile").distinct())
    groups = F.lit(max(1, asked.count() // (2 * SIDE)))
    grouped = F.pmod(F.xxhash64("tile"), groups).alias("group")
    held = shingle_sets(asked, texts, nodes, shingle)

    def compare(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("held").is_null())
        node, other = np.array(table.column("node")), np.array(table.column("other"))
        sets = Sets([x for x in table.column("held").to_pylist() if x is not None])
        at = {k: i for i, k in enumerate(node[~asks].tolist())}
        a, b = node[asks], other[asks]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        keep = np.zeros(len(a), dtype=bool)
        cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]).tolist() if len(a) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(a)], strict=True):
            keep[lo:hi] = sets.near(at[int(a[lo])], np.array([at[int(y)] for y in b[lo:hi]]), similarity)
        return pa.table([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], names=["a", "b"])

    sent = asked.select(grouped, "node").distinct().join(held, "node").select("group", "node", F.lit(0).cast("long").alias("other"), "held")
    asks = pairs.select(grouped, F.col("a").alias("node"), F.col("b").alias("other"), F.lit(None).cast("binary").alias("held"))
    return sent.unionByName(asks).groupBy("group").applyInArrow(compare, "a long, b long").distinct()


class Tiles:
    """Members of some tiles, sorted by tile, and whom each may be similar to."""

    def __init__(self, table: pa.Table, least: float):
        self.table = table.sort_by([("tile", "ascending"), ("node", "ascending")])
        self.node, self.root, self.cell, self.tile, self.band = (np.array(self.table.column(c)) for c in ("node", "root", "cell", "tile", "slot"))
        self.band = self.band & 63
        self.sketch = np.frombuffer(b"".join(self.table.column("sketch").to_pylist()), dtype=np.uint32).reshape(len(self.node), -1)
        self.least = least * len(FACTORS)
        self.cuts = np.flatnonzero(np.r_[True, self.tile[1:] != self.tile[:-1]]).tolist() if len(self.node) else []

    def each(self) -> Iterator[tuple[int, int]]:
        yield from zip(self.cuts, [*self.cuts[1:], len(self.node)], strict=True)

    def partners(self, i: int, lo: int, hi: int, root: np.ndarray) -> np.ndarray:
        """Rows after i in its tile, of another root, whose sketch doesn't rule the similarity out and first shares this tile's band with it.

        A tile of two cells compares only across them, so a pair meets once, in the first band that it shares.
        """
        rest = slice(i + 1, hi)
        here = root[rest] != root[i]
        if (self.cell[lo:hi] != self.cell[lo]).any():
            here &= self.cell[rest] != self.cell[i]
        found = np.flatnonzero(here) + i + 1
        if not len(found):
            return found
        same = self.sketch[found] == self.sketch[i]
        bands = same.reshape(len(found), BANDS, ROWS).all(axis=2)
        return found[bands[:, self.band[i]] & (bands.argmax(axis=1) == self.band[i]) & (same.sum(axis=1) >= self.least)]


MEMBER = "slot long, node long, root long, cell long, tile long"


def unmet(met: DataFrame, roots: DataFrame, sketches: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect all nodes with the similarity that share a bucket and have different roots.

    met: slot, node; roots: node, root; sketches: node, sketch. All members of a bucket with different roots are compared, in tiles of two groups of about
    SIDE, so that a crowded bucket is many tasks; members with a common root make no tiles with each other. First by sketch: a tile tells which of its members have a
    partner that the sketches don't rule out. Only these get their shingles, and the tile's pairs are settled by them on the spot, but for
    pairs that links found in the tile have connected already. So no pairs are written, only members and links.
    """
    spread = met.select("slot", "node").join(roots, "node")
    per = spread.groupBy("slot", "root").agg(F.count("*").alias("n"))
    mixed = per.groupBy("slot").agg(F.count("*").alias("k"), F.sum(F.when(F.col("n") < SIDE, F.col("n")).otherwise(0)).alias("small")).where("k > 1").drop("k")
    at = F.xxhash64("node", F.lit(1))
    cell = F.when(F.col("n") < SIDE, F.pmod(at, pieces(F.col("small")))).otherwise(F.xxhash64("root", F.pmod(at, pieces(F.col("n")))))
    placed = materialize(spread.join(per.join(mixed, "slot"), ["slot", "root"]).select("slot", "node", "root", cell.alias("cell"), F.when(F.col("n") >= SIDE, F.col("root")).alias("whole")))
    cells = placed.select("slot", "cell", "whole").distinct()
    other = cells.select("slot", F.col("cell").alias("cell2"), F.col("whole").alias("whole2"))
    tiles = cells.join(other, "slot").where("cell <= cell2 AND (whole IS NULL OR whole2 IS NULL OR whole <> whole2)")
    tiles = tiles.select("slot", "cell", "cell2", F.xxhash64("slot", "cell", "cell2").alias("tile"))
    sides = tiles.select("slot", "cell", "tile").unionByName(tiles.where("cell < cell2").select("slot", F.col("cell2").alias("cell"), "tile"))
    copies = materialize(placed.join(sides, ["slot", "cell"]).select("slot", "node", "root", "cell", "tile"))
    least = similarity - DEVIATIONS * (similarity * (1 - similarity) / len(FACTORS)) ** 0.5

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.join(sketches, "node").withColumn("group", F.pmod(F.xxhash64("tile"), F.lit(max(1, rows.count() // (2 * SIDE)))))

    def look(table: pa.Table) -> pa.Table:
        own = Tiles(table, least)
        flagged = np.zeros(len(own.node), dtype=bool)
        for lo, hi in own.each():
            for i in range(lo, hi - 1):
                found = own.partners(i, lo, hi, own.root)
                flagged[found] = True
                flagged[i] |= len(found) > 0
        return own.table.select(["slot", "node", "root", "cell", "tile"]).filter(pa.array(flagged))

    def settle(table: pa.Table) -> pa.Table:
        own = Tiles(table, least)
        held = own.table.column("held").to_pylist()
        a, b = [], []
        for lo, hi in own.each():
            sets, root = Sets(held[lo:hi]), own.root.copy()
            for i in range(lo, hi - 1):
                found = own.partners(i, lo, hi, root)
                for j in found[sets.near(i - lo, found - lo, similarity)].tolist() if len(found) else []:
                    if root[i] != root[j]:
                        a.append(own.node[i])
                        b.append(own.node[j])
                        root[lo:hi][root[lo:hi] == root[j]] = root[i]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    flagged = materialize(grouped(copies).groupBy("group").applyInArrow(look, MEMBER))
    held = shingle_sets(flagged, texts, nodes, shingle)
    return grouped(flagged).join(held, "node").groupBy("group").applyInArrow(settle, "a long, b long").distinct()


def starred(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with a tile each, in which many a meet few b; only b of more than one tile's side are looked up: few, so that no b's pairs have to meet for it."""
    many = pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > SIDE).withColumnRenamed("b", "of")
    return pairs.join(many, F.col("b") == F.col("of"), "left").select("a", "b", F.xxhash64("b", F.pmod(F.xxhash64("a"), pieces(F.coalesce("n", F.lit(1))))).alias("tile"))


def close(classes: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are linked: nodes of one fingerprint with their least, and the least nodes of linked fingerprints. classes: node, fp."""
    heads = materialize(classes.groupBy("fp").agg(F.min("node").alias("head")))
    same = classes.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    one, two = heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), heads.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    return same.unionByName(links(heads.select("fp"), distance).join(one, "a").join(two, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))


def rooted(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, root) for every class, its own root where none was found."""
    return classes.select("node").join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 2) -> DataFrame:
    """docs without all but one of each group of near copies: the one with the smallest doc_id (null last) stays.

    Word shingles, A-Z lower-cased; a text of fewer words is one shingle, empty and null texts are copies of each other. Exact copies are one class
    from the start. SimHash comes first: fingerprints of the shingles that differ in at most `distance` bits are linked (links(), as in near_duplicates()), and
    linked texts meet. What fingerprints can't tell (at a similarity of 0.8 they differ in up to 14 bits) is looked for among texts whose components still differ, which
    meet where they agree in one of the bands of a MinHash sketch, whose form doesn't depend on the table: each bucket's members with one leader, then
    all members of a bucket whose components still differ with each other. Links are settled by the shingles. Groups are connected components, so which one stays depends neither on
    the order of rows nor on the leaders. Repeated rows (equal doc_id and text) are copies, of which one comes back (rows that differ in other columns
    only: any). Very long texts are hashed whole. An empty table gives no rows; all columns stay, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))

    def sketch_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own, fps = [], []
            for t in raw(batch.column("text")):
                h = hashes(t, shingle)
                own.append(sketch(h).tobytes())
                fps.append(majority(h))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("md"), pa.array(own, pa.binary()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "md", "sketch", "fp"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("md"), text.alias("text")).mapInArrow(sketch_all, "doc_id long, md string, sketch binary, fp long")
    classes = materialize(own.groupBy("md").agg(F.min("doc_id").alias("first"), F.min("sketch").alias("sketch"), F.min("fp").alias("fp")).withColumn("node", F.xxhash64("md")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            slot = band_keys(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays([pa.array(slot.ravel()), pa.array(np.repeat(np.array(batch.column("node")), BANDS))], names=["slot", "node"])

    # a class becomes 40 rows: dealt out before that, as the table of classes itself has few partitions
    members = classes.select("node", "sketch").repartition("node").mapInArrow(meet, "slot long, node long")
    led = members.groupBy("slot").agg(F.min_by("node", F.xxhash64("node")).alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = materialize(members.join(led, "slot"))
    texts, nodes = docs.select(F.md5(text.cast("binary")).alias("md"), text.alias("text")), classes.select("md", "node")
    near = materialize(close(classes.select("node", "fp"), distance))
    linked = materialize(settled(starred(near), texts, nodes, shingle, similarity))
    roots = materialize(rooted(classes, components(linked)))
    one, two = roots.select(F.col("node").alias("a"), F.col("root").alias("r1")), roots.select(F.col("node").alias("b"), F.col("root").alias("r2"))
    pairs = met.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = materialize(pairs.join(one, "a").join(two, "b").where("r1 <> r2").select("a", "b"))
    linked = materialize(linked.unionByName(settled(starred(pairs), texts, nodes, shingle, similarity)))
    found = components(linked)
    roots = rooted(classes, found)
    rest = materialize(unmet(met, roots, classes.select("node", "sketch"), texts, nodes, shingle, similarity))
    if not rest.isEmpty():
        found = components(linked.unionByName(rest))
    placed = classes.select("md", "first", F.col("node").alias("own")).join(found, F.col("own") == F.col("node"), "left").select("md", "first", F.coalesce("root", "own").alias("root"))
    md, first, own_md, n = fresh(docs.columns, "__md", "__first", "__own", "__n")
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "md")).alias("best")).select(F.col("best.md").alias(md), F.col("best.first").alias(first))
    once = Window.partitionBy(md, first).orderBy(F.lit(0))
    kept = docs.withColumn(own_md, F.md5(text.cast("binary"))).join(best, (F.col(own_md) == F.col(md)) & F.col("doc_id").eqNullSafe(F.col(first)))
    return kept.withColumn(n, F.row_number().over(once)).where(F.col(n) == 1).select(*docs.columns)
