"""As-of, overlap, merge and subtract operators over half-open intervals (chrom, start_pos, end_pos).

Overlap joins bucket both sides by position, so they are equi-joins on (chrom, bucket) that shuffle and split; a pair that meets in several buckets is
kept in the bucket of the later start only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 14


def merge(bed: DataFrame, slack: int = 0, key: str = "chrom") -> DataFrame:
    """Union of intervals that overlap, touch, or lie at most `slack` apart."""
    ordered = Window.partitionBy(key).orderBy("start_pos", "end_pos")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.when(F.col("start_pos") > F.max("end_pos").over(before) + slack, 1).when(F.max("end_pos").over(before).isNull(), 1).otherwise(0)
    island = F.sum("fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    marked = bed.select(key, "start_pos", "end_pos").withColumn("fresh", fresh).withColumn("island", island)
    return marked.groupBy(key, "island").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("island")


def buckets(start: Column, end: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(start / size).cast("long"), F.floor(F.greatest(end - 1, start) / size).cast("long")))


def overlap_join(a: DataFrame, b: DataFrame, a_key: str = "chrom", a_start: str = "a_start", a_end: str = "a_end", b_key: str = "b_chrom", b_start: str = "b_start", b_end: str = "b_end", size: int = BUCKET) -> DataFrame:
    """Rows of both sides that share a key and overlap. Column names of the sides must differ."""
    left = a.withColumn("__k", buckets(F.col(a_start), F.col(a_end), size))
    right = b.withColumn("__l", buckets(F.col(b_start), F.col(b_end), size))
    meet = (F.col(a_key) == F.col(b_key)) & (F.col("__k") == F.col("__l")) & (F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end))
    once = F.floor(F.greatest(a_start, b_start) / size) == F.col("__k")
    return left.join(right, meet & once).drop("__k", "__l")


def covering(points: DataFrame, bed: DataFrame, key: str, pos: str, size: int = BUCKET) -> DataFrame:
    """Points, each bucketed once, left-joined with the merged interval that holds them (iv_start, iv_end, null if none)."""
    whole = merge(bed).withColumn("__l", buckets(F.col("start_pos"), F.col("end_pos"), size))
    whole = whole.select(F.col("chrom").alias("__c"), F.col("start_pos").alias("iv_start"), F.col("end_pos").alias("iv_end"), "__l")
    left = points.withColumn("__k", F.floor(F.col(pos) / size).cast("long"))
    return left.join(whole, (F.col(key) == F.col("__c")) & (F.col("__k") == F.col("__l")) & (F.col(pos) >= F.col("iv_start")) & (F.col(pos) < F.col("iv_end")), "left").drop("__k", "__l", "__c")


def inside(points: DataFrame, bed: DataFrame, key: str, pos: str, name: str) -> DataFrame:
    """Adds whether start <= pos < end for an interval of the same key."""
    return covering(points, bed, key, pos).withColumn(name, F.col("iv_start").isNotNull()).drop("iv_start", "iv_end")


def asof_backward(points: DataFrame, starts: DataFrame, key: str, pos: str, start: str, carry: list[str]) -> DataFrame:
    """For each point the row of `starts` with the greatest start at or before it, by key. Both sides go through one sort: last non-null over the union.

    starts has the columns key, start and those of carry, which the points don't have.
    """
    p = points.withColumn("__at", F.col(pos)).withColumn("__kind", F.lit(1))
    s = starts.select(F.col(key), F.col(start).alias("__at"), F.struct(start, *carry).alias("__row")).withColumn("__kind", F.lit(0))
    order = Window.partitionBy(key).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(s, allowMissingColumns=True).withColumn("__hit", F.last("__row", ignorenulls=True).over(order))
    return both.where("__kind = 1").select(*points.columns, *[F.col(f"__hit.{c}").alias(c) for c in (start, *carry)])


def intersections(a: DataFrame, b: DataFrame) -> DataFrame:
    """Common parts of overlapping intervals of two lists (chrom, start_pos, end_pos)."""
    x = a.select("chrom", F.col("start_pos").alias("a_start"), F.col("end_pos").alias("a_end"))
    y = b.select(F.col("chrom").alias("b_chrom"), F.col("start_pos").alias("b_start"), F.col("end_pos").alias("b_end"))
    return overlap_join(x, y).select("chrom", F.greatest("a_start", "b_start").alias("start_pos"), F.least("a_end", "b_end").alias("end_pos"))


def anti(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intervals of a that overlap none of b."""
    x = a.select("chrom", F.col("start_pos").alias("a_start"), F.col("end_pos").alias("a_end")).distinct()
    y = b.select(F.col("chrom").alias("b_chrom"), F.col("start_pos").alias("b_start"), F.col("end_pos").alias("b_end"))
    hit = overlap_join(x, y).select("chrom", F.col("a_start").alias("start_pos"), F.col("a_end").alias("end_pos")).distinct()
    return a.join(hit, ["chrom", "start_pos", "end_pos"], "left_anti")


def subtract(lengths: DataFrame, bed: DataFrame) -> DataFrame:
    """What the intervals leave of each contig (chrom, length): gaps between merged islands."""
    islands = merge(bed)
    order = Window.partitionBy("chrom").orderBy("start_pos")
    gaps = islands.select("chrom", F.coalesce(F.lag("end_pos").over(order), F.lit(0)).alias("gap_start"), F.col("start_pos").alias("gap_end"))
    tails = lengths.join(islands.groupBy("chrom").agg(F.max("end_pos").alias("gap_start")), "chrom", "left").select("chrom", F.coalesce("gap_start", F.lit(0)).alias("gap_start"), F.col("length").alias("gap_end"))
    return gaps.unionByName(tails).where("gap_start < gap_end").select("chrom", F.col("gap_start").alias("start_pos"), F.col("gap_end").alias("end_pos"))


def covered(bed: DataFrame) -> DataFrame:
    """Bases under the union of the intervals, by chrom."""
    return merge(bed).groupBy("chrom").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("covered"))


def windows(lengths: DataFrame, size: int, step: int) -> DataFrame:
    """Sliding windows of each contig (chrom, length), the last ones cut at its end."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long")))
    return lengths.select("chrom", "length", starts.alias("start_pos")).select("chrom", "start_pos", F.least(F.col("start_pos") + size, F.col("length")).alias("end_pos"))


def overlap_fraction(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Overlapping pairs in which the overlap is at least this share of b's interval: chrom, a_start, a_end, b_start, b_end, overlap."""
    x = a.select("chrom", F.col("start_pos").alias("a_start"), F.col("end_pos").alias("a_end"))
    y = b.select(F.col("chrom").alias("b_chrom"), F.col("start_pos").alias("b_start"), F.col("end_pos").alias("b_end"))
    both = overlap_join(x, y).withColumn("overlap", F.least("a_end", "b_end") - F.greatest("a_start", "b_start"))
    return both.where(F.col("overlap") >= least * (F.col("b_end") - F.col("b_start"))).drop("b_chrom")


def window_counts(wins: DataFrame, alignments: DataFrame, least: float = 0.5) -> DataFrame:
    """Alignments that cover at least this share of each window; windows without any count 0.

    Windows are made from few contigs, so the planner takes them for few and would broadcast them through the driver: they are joined by sorts.
    """
    wins = wins.hint("merge")
    hits = overlap_fraction(alignments, wins, least).groupBy("chrom", F.col("b_start").alias("start_pos"), F.col("b_end").alias("end_pos")).agg(F.count("*").alias("n"))
    return wins.join(hits, ["chrom", "start_pos", "end_pos"], "left").select("chrom", "start_pos", "end_pos", F.coalesce("n", F.lit(0)).alias("n"))
