"""Contact tables: expansion of reads, depth, binned matrices, orientation distances, hyperedges and their clique expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import r9
from .filters import midpoint
from .intervals import overlap_join, windows


def expand_pairs(porec: DataFrame, most: int | None = None) -> DataFrame:
    """All pairs of fragments of each read (read_idx, frag ordinal), the earlier one first, with midpoints as positions.

    One exchange by read. A read of n fragments makes n (n - 1) / 2 pairs; `most` drops reads of more fragments before they are expanded.
    """
    f = porec.select("read_idx", "frag", F.col("contig").alias("chrom"), midpoint().alias("pos"), "strand")
    if most is not None:
        f = f.withColumn("__n", F.count("*").over(Window.partitionBy("read_idx"))).where(F.col("__n") <= most).drop("__n")
    a = f.select("read_idx", F.col("frag").alias("f1"), F.col("chrom").alias("chrom1"), F.col("pos").alias("pos1"), F.col("strand").alias("strand1"))
    b = f.select("read_idx", F.col("frag").alias("f2"), F.col("chrom").alias("chrom2"), F.col("pos").alias("pos2"), F.col("strand").alias("strand2"))
    return a.join(b, "read_idx").where("f1 < f2").select("read_idx", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2")


def reindex_pairs(contigs: DataFrame, contacts: DataFrame) -> DataFrame:
    """Counts for every pair of listed contigs, 0 where there are none. The list times itself is the result's own size."""
    ranked = contigs.select("contig")
    a, b = ranked.select(F.col("contig").alias("c1")), ranked.select(F.col("contig").alias("c2"))
    found = contacts.select(F.col("contig1").alias("c1"), F.col("contig2").alias("c2"), "n")
    return a.join(b, F.col("c1") < F.col("c2")).join(found, ["c1", "c2"], "left").select("c1", "c2", F.coalesce("n", F.lit(0)).alias("n"))


def chrom_to_contig(pairs: DataFrame, layout: DataFrame) -> DataFrame:
    """Pairs on chromosomes (0-based positions) as pairs on the contigs laid out there (1-based), the lesser end first."""

    def place(df: DataFrame, chrom: str, pos: str, name: str) -> DataFrame:
        right = layout.select(F.col("chrom").alias("b_chrom"), F.col("chrom_start").alias("b_start"), F.col("chrom_end").alias("b_end"), F.col("contig").alias(f"contig_{name}"))
        put = overlap_join(df.withColumn("__e", F.col(pos) + 1), right, a_key=chrom, a_start=pos, a_end="__e")
        return put.withColumn(f"at_{name}", F.col(pos) - F.col("b_start") + 1).drop("b_chrom", "b_start", "b_end", "__e")

    both = place(place(pairs, "chrom1", "pos1", "x"), "chrom2", "pos2", "y")
    x, y = F.struct(F.col("contig_x").alias("c"), F.col("at_x").alias("p")), F.struct(F.col("contig_y").alias("c"), F.col("at_y").alias("p"))
    both = both.select("read_idx", F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))
    return both.select("read_idx", F.col("lo.c").alias("contig1"), F.col("lo.p").alias("pos1"), F.col("hi.c").alias("contig2"), F.col("hi.p").alias("pos2"))


def split_fragments(fragments: DataFrame, layout: DataFrame) -> DataFrame:
    """Alignments on chromosomes (a_start, a_end) cut at contig boundaries, each part with its share of the read."""
    right = layout.select(F.col("chrom").alias("b_chrom"), F.col("chrom_start").alias("b_start"), F.col("chrom_end").alias("b_end"), "contig")
    lo, hi = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    return overlap_join(fragments, right).select("read_idx", "frag", "contig", (lo - F.col("b_start")).alias("start_pos"), (hi - F.col("b_start")).alias("end_pos"), (F.col("read_start") + lo - F.col("a_start")).alias("read_start"), (F.col("read_start") + hi - F.col("a_start")).alias("read_end"))


def ends(pairs: DataFrame) -> DataFrame:
    """Both ends of every pair as rows (chrom, pos)."""
    return pairs.select(F.explode(F.array(F.struct(F.col("chrom1").alias("chrom"), F.col("pos1").alias("pos")), F.struct(F.col("chrom2").alias("chrom"), F.col("pos2").alias("pos")))).alias("e")).select("e.chrom", "e.pos")


def depth(pairs: DataFrame, contigs: DataFrame, size: int) -> DataFrame:
    """Ends by bin of each contig, with zeros; the last bin ends with the contig. Ends are summed map-side before anything moves."""
    counts = ends(pairs).groupBy("chrom", (F.floor(F.col("pos") / size) * size).alias("start_pos")).agg(F.count("*").alias("n"))
    bins = windows(contigs.select(F.col("contig").alias("chrom"), "length"), size, size)
    return bins.join(counts, ["chrom", "start_pos"], "left").select("chrom", "start_pos", "end_pos", F.coalesce("n", F.lit(0)).alias("n"))


def bin_offsets(contigs: DataFrame, size: int) -> DataFrame:
    """contig, length, bins and offset: the number of bins of the contigs before it."""
    before = Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)
    return contigs.withColumn("bins", F.ceil(F.col("length") / size).cast("long")).withColumn("offset", F.coalesce(F.sum("bins").over(before), F.lit(0)).cast("long"))


def pixels(pairs: DataFrame, contigs: DataFrame, size: int) -> DataFrame:
    """Upper-triangular bin pair counts; lower ones are swapped, not dropped."""
    o = bin_offsets(contigs, size)
    one, two = o.select(F.col("contig").alias("chrom1"), F.col("offset").alias("o1")), o.select(F.col("contig").alias("chrom2"), F.col("offset").alias("o2"))
    a, b = F.col("o1") + F.floor(F.col("pos1") / size), F.col("o2") + F.floor(F.col("pos2") / size)
    return pairs.join(one, "chrom1").join(two, "chrom2").groupBy(F.least(a, b).alias("bin1_id"), F.greatest(a, b).alias("bin2_id")).agg(F.count("*").alias("n"))


def symmetric(pixels_: DataFrame) -> DataFrame:
    """Pixels with the swapped ones off the diagonal."""
    return pixels_.unionByName(pixels_.where("bin1_id <> bin2_id").select(F.col("bin2_id").alias("bin1_id"), F.col("bin1_id").alias("bin2_id"), "n"))


def contacts(pairs: DataFrame, least: int = 1) -> DataFrame:
    return pairs.groupBy(F.col("chrom1").alias("contig1"), F.col("chrom2").alias("contig2")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def split_contacts(pairs: DataFrame, contigs: DataFrame, parts: int = 2) -> DataFrame:
    """Counts between parts of contigs, named contig_part."""

    def name(chrom, pos, length):
        return F.concat_ws("_", F.col(chrom).cast("string"), F.least(F.floor((F.col(pos) - 1) * parts / F.col(length)), F.lit(parts - 1)).cast("string"))

    one, two = contigs.select(F.col("contig").alias("chrom1"), F.col("length").alias("l1")), contigs.select(F.col("contig").alias("chrom2"), F.col("length").alias("l2"))
    return pairs.join(one, "chrom1").join(two, "chrom2").groupBy(name("chrom1", "pos1", "l1").alias("contig1"), name("chrom2", "pos2", "l2").alias("contig2")).agg(F.count("*").alias("n"))


def unsplit_contacts(split: DataFrame) -> DataFrame:
    """The parts' suffixes go; counts add up."""

    def strip(c):
        return F.regexp_replace(c, r"_\d+$", "")

    return split.groupBy(strip("contig1").alias("contig1"), strip("contig2").alias("contig2")).agg(F.sum("n").alias("n"))


#: Orientations of two contigs, first + or -, second + or -.
ORIENTATIONS = ("++", "+-", "-+", "--")


def distances(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """Trans pairs with their distance in each of the four orientations of the two contigs: contig1, contig2, orientation, d."""
    one, two = contigs.select(F.col("contig").alias("chrom1"), F.col("length").alias("l1")), contigs.select(F.col("contig").alias("chrom2"), F.col("length").alias("l2"))
    p1, p2, l1, l2 = (F.col(c) for c in ("pos1", "pos2", "l1", "l2"))
    by = F.array(*[F.struct(F.lit(o).alias("orientation"), d.alias("d")) for o, d in zip(ORIENTATIONS, (l1 - p1 + p2, l1 - p1 + l2 - p2, p1 + p2, p1 + l2 - p2), strict=True)])
    return pairs.where("chrom1 <> chrom2").join(one, "chrom1").join(two, "chrom2").select(F.col("chrom1").alias("contig1"), F.col("chrom2").alias("contig2"), F.explode(by).alias("x")).select("contig1", "contig2", "x.orientation", "x.d")


#: Links of one contig pair whose distances go into one row at most.
LINKS_PER_ROW = 100_000


def clm(pairs: DataFrame, contigs: DataFrame, least: int = 1, most: int = LINKS_PER_ROW) -> DataFrame:
    """Per contig pair and orientation the number of links and their distances, sorted: contig1, contig2, orientation, n, part, distances.

    Each pair's two positions are shuffled once; the four orientations follow from them. Contig pairs with more than `most` links are dealt out over several rows
    of about that size (part 0, 1, ..., each sorted, n is that of the whole pair), so that no row grows with a hot pair.
    """
    one, two = contigs.select(F.col("contig").alias("chrom1"), F.col("length").alias("l1")), contigs.select(F.col("contig").alias("chrom2"), F.col("length").alias("l2"))
    trans = pairs.where("chrom1 <> chrom2")
    counted = trans.groupBy("chrom1", "chrom2").agg(F.count("*").alias("n")).where(F.col("n") >= least).join(one, "chrom1").join(two, "chrom2")
    parts = F.floor((F.col("n") - 1) / most).cast("int") + 1
    dealt = trans.select("chrom1", "chrom2", "pos1", "pos2").join(counted, ["chrom1", "chrom2"]).withColumn("part", F.when(parts > 1, F.pmod(F.xxhash64("pos1", "pos2"), parts)).otherwise(0))
    held = dealt.groupBy("chrom1", "chrom2", "part").agg(F.first("n").alias("n"), F.first("l1").alias("l1"), F.first("l2").alias("l2"), F.collect_list(F.struct("pos1", "pos2")).alias("at"))

    def by(d) -> F.Column:
        return F.array_sort(F.transform("at", lambda x: d(x["pos1"], x["pos2"])))

    l1, l2 = F.col("l1"), F.col("l2")
    forms = (lambda p, q: l1 - p + q, lambda p, q: l1 - p + l2 - q, lambda p, q: p + q, lambda p, q: p + l2 - q)
    rows = F.explode(F.array(*[F.struct(F.lit(o).alias("orientation"), by(f).alias("distances")) for o, f in zip(ORIENTATIONS, forms, strict=True)])).alias("x")
    return held.select(F.col("chrom1").alias("contig1"), F.col("chrom2").alias("contig2"), "n", "part", rows).select("contig1", "contig2", "x.orientation", "n", "part", "x.distances")


def clm_scores(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """Sum of 1 / ln(d) by orientation, one column each. Sums need no lists."""
    d = distances(pairs, contigs).where("d > 1").withColumn("s", 1 / F.log(F.col("d").cast("double")))
    return d.groupBy("contig1", "contig2").agg(*[F.sum(F.when(F.col("orientation") == o, F.col("s")).otherwise(0.0)).alias(n) for o, n in zip(ORIENTATIONS, ("pp", "pm", "mp", "mm"), strict=True)])


def cis_coverage(pairs: DataFrame, contigs: DataFrame, size: int) -> DataFrame:
    """Cis pairs that span each window of (pos - 1) // size, both end windows included: a running sum over a difference array."""
    a, b = F.floor((F.least("pos1", "pos2") - 1) / size), F.floor((F.greatest("pos1", "pos2") - 1) / size)
    steps = F.explode(F.array(F.struct(a.alias("w"), F.lit(1).alias("s")), F.struct((b + 1).alias("w"), F.lit(-1).alias("s"))))
    change = pairs.where("chrom1 = chrom2").select(F.col("chrom1").alias("contig"), steps.alias("x")).groupBy("contig", F.col("x.w").alias("w")).agg(F.sum("x.s").alias("s"))
    grid = contigs.select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("w"))
    run = F.sum(F.coalesce("s", F.lit(0))).over(Window.partitionBy("contig").orderBy("w").rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(change, ["contig", "w"], "left").select("contig", "w", run.alias("n"))


def row_sums(pixels_: DataFrame, bins: DataFrame | None = None) -> DataFrame:
    """Row sums of the symmetric matrix less half the diagonal; with bins (bin_id, chrom) cis pixels are left out."""
    if bins is not None:
        one, two = bins.select(F.col("bin_id").alias("bin1_id"), F.col("chrom").alias("k1")), bins.select(F.col("bin_id").alias("bin2_id"), F.col("chrom").alias("k2"))
        pixels_ = pixels_.join(one, "bin1_id").join(two, "bin2_id").where("k1 <> k2").select("bin1_id", "bin2_id", "n")
    ends_ = F.explode(F.when(F.col("bin1_id") == F.col("bin2_id"), F.array("bin1_id")).otherwise(F.array("bin1_id", "bin2_id"))).alias("bin_id")
    weight = F.when(F.col("bin1_id") == F.col("bin2_id"), F.col("n") / 2).otherwise(F.col("n").cast("double"))
    return pixels_.select(ends_, weight.alias("n")).groupBy("bin_id").agg(F.sum("n").alias("n"))


def merge_bins(pixels_: DataFrame, mapping: DataFrame, least: int = 1, cis: bool = True) -> DataFrame:
    """Counts between the targets of bins (bin_id, target), the lesser target first."""
    one, two = mapping.select(F.col("bin_id").alias("bin1_id"), F.col("target").alias("t1")), mapping.select(F.col("bin_id").alias("bin2_id"), F.col("target").alias("t2"))
    out = pixels_.join(one, "bin1_id").join(two, "bin2_id").groupBy(F.least("t1", "t2").alias("target1"), F.greatest("t1", "t2").alias("target2")).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return out if cis else out.where("target1 <> target2")


def hyperedges(porec: DataFrame) -> DataFrame:
    """Per read and contig the number of fragments and the best mapq. Dealt out by read, so that what follows read by read needs no further exchange."""
    return porec.repartition("read_idx").groupBy("read_idx", "contig").agg(F.count("*").alias("cnt"), F.max("mapq").alias("mapq"))


def pair_hyperedges(pairs: DataFrame) -> DataFrame:
    """Two rows of count 1 for each pair, under an id by row."""
    e = pairs.withColumn("edge", F.monotonically_increasing_id())
    return e.select("edge", F.explode(F.array("chrom1", "chrom2")).alias("contig")).withColumn("cnt", F.lit(1))


def clique(incidence: DataFrame, least: float = 0.0, most: int | None = None, cis: bool = True, by_sum: bool = False, fewest: int = 1) -> DataFrame:
    """Weights between contigs: over the hyperedges that hold both, the product of counts over max(contigs - 1, 1).

    One exchange by read, shared by both sides of the self-join: the order of each read is a window over the same partitioning. `fewest` and `most` bound
    the order, and so the fan-out, before rows are expanded. by_sum divides by the sum of counts less one instead. src <= dst; with cis=False without the diagonal. Weights of exactly `least` stay,
    in whatever order their terms are added.
    """
    w = Window.partitionBy("read_idx")
    e = incidence.select("read_idx", "contig", "cnt").withColumn("k", F.sum("cnt").over(w) if by_sum else F.count("*").over(w))
    if fewest > 1:
        e = e.where(F.col("k") >= fewest)
    if most is not None:
        e = e.where(F.col("k") <= most)
    e = e.withColumn("f", F.greatest(F.col("k") - 1, F.lit(1)).cast("double"))
    a, b = e.select("read_idx", F.col("contig").alias("src"), F.col("cnt").alias("c1"), "f"), e.select("read_idx", F.col("contig").alias("dst"), F.col("cnt").alias("c2"))
    meet = a.join(b, "read_idx").where("src <= dst" if cis else "src < dst")
    return meet.groupBy("src", "dst").agg(F.sum(F.col("c1") * F.col("c2") / F.col("f")).alias("w")).where(r9("w") >= least)


def adjacency_pairwise(incidence: DataFrame) -> DataFrame:
    """Edges of exactly two contigs, weighted with the first one's count, summed by pair."""
    two = incidence.groupBy("read_idx").agg(F.count("*").alias("k"), F.min(F.struct("contig", "cnt")).alias("lo"), F.max("contig").alias("hi")).where("k = 2")
    return two.groupBy(F.col("lo.contig").alias("src"), F.col("hi").alias("dst")).agg(F.sum("lo.cnt").alias("w"))


def top_per_row(edges: DataFrame, k: int) -> DataFrame:
    """The k heaviest edges of each contig in either role; ties to the lesser partner."""
    both = edges.where("src <> dst").select("src", "dst", "w").unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))).where(F.col("rn") <= k)




def break_positions(porec: DataFrame, size: int) -> DataFrame:
    """Fragments on contigs broken every `size` bases: the piece that holds the start, and the start within it."""
    piece = F.floor(F.col("start_pos") / size)
    return porec.select("read_idx", "frag", "contig", piece.alias("piece"), (F.col("start_pos") - piece * size).alias("start_pos"))
