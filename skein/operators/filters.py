"""Filters over contact tables. Each is a predicate on columns, or a semi or anti join with a dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import inside


def mapq_at_least(df: DataFrame, q: int) -> DataFrame:
    """All rows for 0; the stored tier from 1 on is a plain predicate, which reaches the scan."""
    return df if q <= 0 else df.where(F.col("mapq") >= q)


def near_end(pos: str, length: str, edge: int) -> Column:
    return (F.col(pos) < edge) | (F.col(pos) > F.col(length) - edge)


def with_lengths(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """Lengths of both contigs as length1 and length2; pairs of unknown contigs go."""
    one = contigs.select(F.col("contig").alias("chrom1"), F.col("length").alias("length1"))
    two = contigs.select(F.col("contig").alias("chrom2"), F.col("length").alias("length2"))
    return pairs.join(one, "chrom1").join(two, "chrom2")


def pairs_near_ends(pairs: DataFrame, contigs: DataFrame, edge: int) -> DataFrame:
    """Pairs whose both ends lie within `edge` of an end of their contig."""
    both = with_lengths(pairs, contigs)
    return both.where(near_end("pos1", "length1", edge) & near_end("pos2", "length2", edge)).select(*pairs.columns)


def midpoint(start: str = "start_pos", end: str = "end_pos") -> Column:
    return F.col(start) + F.floor((F.col(end) - F.col(start)) / 2).cast("long")


def fragments_near_ends(porec: DataFrame, edge: int) -> DataFrame:
    """Fragments whose midpoint lies within `edge` of an end of their contig."""
    mid = midpoint()
    return porec.where((mid < edge) | (F.col("contig_length") - mid < edge))


def split_contigs(contigs: DataFrame, size: int) -> DataFrame:
    """contig, length and the first of its ids once all contigs are split in pieces of this size, in contig order."""
    pieces = F.ceil(F.col("length") / size).cast("long")
    before = Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)
    return contigs.withColumn("pieces", pieces).withColumn("first_id", F.coalesce(F.sum("pieces").over(before), F.lit(0)).cast("long"))


def pairs_in_region_any(pairs: DataFrame, bed: DataFrame, invert: bool = False) -> DataFrame:
    """Pairs with either end in an interval; inverted: with neither."""
    marked = inside(inside(pairs, bed, "chrom1", "pos1", "in1"), bed, "chrom2", "pos2", "in2")
    either = F.col("in1") | F.col("in2")
    return marked.where(~either if invert else either).select(*pairs.columns)


def pairs_in_region_both(pairs: DataFrame, bed: DataFrame, invert: bool = False) -> DataFrame:
    """Pairs with both ends in intervals; inverted: all others."""
    marked = inside(inside(pairs, bed, "chrom1", "pos1", "in1"), bed, "chrom2", "pos2", "in2")
    both = F.col("in1") & F.col("in2")
    return marked.where(~both if invert else both).select(*pairs.columns)


def fragments_in_region(porec: DataFrame, bed: DataFrame, invert: bool = False) -> DataFrame:
    """Fragments whose midpoint lies in an interval; inverted: outside all."""
    marked = inside(porec.withColumn("mid", midpoint()), bed, "contig", "mid", "in1")
    return marked.where(~F.col("in1") if invert else F.col("in1")).select(*porec.columns)


def low_quality_flag(df: DataFrame, mapq: int, identity: float, length: int) -> DataFrame:
    """Adds pass_filter and filter_reason ('pass' or 'low_mq')."""
    low = (F.col("mapq") < mapq) | (F.col("identity") < identity) | (F.col("end_pos") - F.col("start_pos") < length)
    return df.withColumn("pass_filter", ~low).withColumn("filter_reason", F.when(low, "low_mq").otherwise("pass"))


def singleton_flag(df: DataFrame, read: str = "read_idx") -> DataFrame:
    """Passing rows that are the only passing ones of their read fail as 'singleton'."""
    n = F.sum(F.col("pass_filter").cast("int")).over(Window.partitionBy(read))
    single = F.col("pass_filter") & (n == 1)
    return df.withColumn("__single", single).withColumn("filter_reason", F.when(F.col("__single"), "singleton").otherwise(F.col("filter_reason"))).withColumn("pass_filter", F.col("pass_filter") & ~F.col("__single")).drop("__single")


def order_between(df: DataFrame, least: int, most: int, read: str = "read_idx", contig: str = "contig") -> DataFrame:
    """Rows of reads that touch `least` to `most` distinct contigs. One exchange by read: contigs are told apart in sorted order, so no sets are gathered."""
    w = Window.partitionBy(read)
    fresh = F.when(F.lag(contig).over(w.orderBy(contig)) == F.col(contig), 0).otherwise(1)
    marked = df.withColumn("__fresh", fresh).withColumn("__order", F.sum("__fresh").over(w))
    return marked.where(F.col("__order").between(least, most)).drop("__fresh", "__order")


def without_contigs(df: DataFrame, contigs: DataFrame, *columns: str) -> DataFrame:
    """Anti join of each named column with the list."""
    for c in columns:
        df = df.join(contigs.select(F.col("contig").alias(c)).distinct(), c, "left_anti")
    return df


def only_contigs(df: DataFrame, contigs: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.join(contigs.select(F.col("contig").alias(c)).distinct(), c, "left_semi")
    return df


def min_contacts(incidence: DataFrame, least: int) -> DataFrame:
    """Contigs with enough counts in all, then hyperedges that still have a count sum of two or more; in this order."""
    rows = incidence.groupBy("contig").agg(F.sum("cnt").alias("__n")).where(F.col("__n") >= least).select("contig")
    left = incidence.join(rows, "contig", "left_semi")
    return left.withColumn("__n", F.sum("cnt").over(Window.partitionBy("read_idx"))).where("__n >= 2").drop("__n")


def degrees_in_range(degrees: DataFrame, high: float = 0.999, low: float = 0.0) -> DataFrame:
    """Contigs whose degree per 10 kb lies within two exact percentiles of all."""
    d = degrees.withColumn("density", F.col("degree") / F.col("length") * 1e4)
    limits = d.agg(F.percentile("density", F.lit(low)).alias("lo"), F.percentile("density", F.lit(high)).alias("hi"))
    return d.join(F.broadcast(limits), (F.col("density") >= F.col("lo")) & (F.col("density") <= F.col("hi"))).drop("lo", "hi")


def degrees_by_mad(degrees: DataFrame, z: float = 3.0) -> DataFrame:
    """Contigs whose robust z score of degree per 10 kb, by median absolute deviation, is at most z."""
    d = degrees.withColumn("density", F.col("degree") / F.col("length") * 1e4)
    d = d.join(F.broadcast(d.agg(F.percentile("density", F.lit(0.5)).alias("med"))), F.lit(True))
    d = d.withColumn("dev", F.abs(F.col("density") - F.col("med")))
    d = d.join(F.broadcast(d.agg(F.percentile("dev", F.lit(0.5)).alias("mad"))), F.lit(True))
    return d.where(F.col("dev") * 0.6745 <= F.col("mad") * z).drop("med", "dev", "mad")


def long_groups(membership: DataFrame, contigs: DataFrame, least: int) -> DataFrame:
    """Members of groups whose contigs add up to `least` bases."""
    sizes = membership.join(contigs, "contig").groupBy("grp").agg(F.sum("length").alias("size")).where(F.col("size") >= least)
    return membership.join(sizes.select("grp"), "grp", "left_semi")


def similar_pairs(alleles: DataFrame, contigs: DataFrame, similarity: float, tolerance: float = 0.2) -> DataFrame:
    """Allelic pairs above a similarity whose lengths, or whose minimizer counts, are within the relative tolerance."""
    one = contigs.select(F.col("contig").alias("c1"), F.col("length").alias("length1"))
    two = contigs.select(F.col("contig").alias("c2"), F.col("length").alias("length2"))

    def close(a, b):
        return F.abs(F.col(a) - F.col(b)) <= tolerance * F.greatest(a, b)

    return alleles.join(one, "c1").join(two, "c2").where((F.col("similarity") > similarity) & (close("length1", "length2") | close("mz1", "mz2"))).select(*alleles.columns)


def homolog_noise(alleles: DataFrame, contacts: DataFrame, least: float) -> DataFrame:
    """Allelic pairs with trans / sqrt(cis1 * cis2) of at least `least`."""
    cis = contacts.where("contig1 = contig2").select(F.col("contig1").alias("c"), F.col("n").alias("cis"))
    trans = contacts.select(F.col("contig1").alias("c1"), F.col("contig2").alias("c2"), F.col("n").alias("trans"))
    one, two = cis.select(F.col("c").alias("c1"), F.col("cis").alias("cis1")), cis.select(F.col("c").alias("c2"), F.col("cis").alias("cis2"))
    score = F.col("trans") / F.sqrt(F.col("cis1") * F.col("cis2"))
    return alleles.select("c1", "c2").join(trans, ["c1", "c2"]).join(one, "c1").join(two, "c2").withColumn("score", score).where(F.col("score") >= least)


def above_nx(contigs: DataFrame, x: int) -> DataFrame:
    """Contigs not shorter than Nx: the length at which contigs, longest first, reach x percent of the sum."""
    order = Window.orderBy(F.desc("length"), "contig").rowsBetween(Window.unboundedPreceding, 0)
    run = contigs.withColumn("run", F.sum("length").over(order)).join(F.broadcast(contigs.agg(F.sum("length").alias("total"))), F.lit(True))
    limit = run.where(F.col("run") >= F.floor(F.col("total") * x / 100)).agg(F.max("length").alias("nx"))
    return contigs.join(F.broadcast(limit), F.col("length") >= F.col("nx")).drop("nx")


def terminal_overlaps(paf: DataFrame, edge: int) -> DataFrame:
    """Alignments that touch an end, within `edge`, of both sequences, with those ends snapped to it."""

    def touches(start, end, length):
        return (F.col(start) < edge) | (F.col(length) - F.col(end) < edge)

    def snap(start, end, length):
        return F.when(F.col(start) < edge, F.lit(0)).otherwise(F.col(start)), F.when(F.col(length) - F.col(end) < edge, F.col(length)).otherwise(F.col(end))

    kept = paf.where(touches("read_start", "read_end", "read_length") & touches("start_pos", "end_pos", "chrom_length"))
    rs, re = snap("read_start", "read_end", "read_length")
    ts, te = snap("start_pos", "end_pos", "chrom_length")
    return kept.select(*[c for c in paf.columns if c not in ("read_start", "read_end", "start_pos", "end_pos")], rs.cast("long").alias("read_start"), re.cast("long").alias("read_end"), ts.cast("long").alias("start_pos"), te.cast("long").alias("end_pos"))
