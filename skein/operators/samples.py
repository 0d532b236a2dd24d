"""Deterministic sampling by hash keys, and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_key(seed: int) -> Column:
    """A hash-random key of a pair; equal pairs share it."""
    parts = ["read_idx", "chrom1", "pos1", "chrom2", "pos2"]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in parts]))


def downsample_pairs(pairs: DataFrame, n: int, seed: int) -> DataFrame:
    """n pairs without replacement, the same in every run: those with the least keys. A top-n: each task passes on n rows at most."""
    columns = ["read_idx", "chrom1", "pos1", "chrom2", "pos2"]
    return pairs.withColumn("k", pair_key(seed)).orderBy("k", *columns).limit(n).drop("k")


def downsample_reads(porec: DataFrame, pairs: int, seed: int, ranges: int = 256) -> DataFrame:
    """Reads in hash order while their pairs, n (n - 1) / 2 each, add up to at most `pairs`.

    The running sum is made by hash range: sums of the ranges run up first, then each range's rows, so no task sees all reads.
    """
    n = porec.groupBy("read_idx").agg(F.count("*").alias("n")).select("read_idx", F.floor(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.md5(F.concat(F.lit(f"{seed}:"), F.col("read_idx").cast("string"))).alias("k"))
    n = n.withColumn("range", (F.conv(F.substring("k", 1, 8), 16, 10).cast("long") * ranges / (1 << 32)).cast("int"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = n.groupBy("range").agg(F.sum("pairs").alias("s")).select("range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("range").orderBy("k", "read_idx").rowsBetween(Window.unboundedPreceding, 0)
    return n.join(F.broadcast(offsets), "range").withColumn("run", F.col("offset") + F.sum("pairs").over(inside)).where(F.col("run") <= pairs).select("read_idx", "pairs")


def sample_low_mapq(pairs: DataFrame, share: float, seed: int) -> DataFrame:
    """All pairs of mapq 1 or more, and of the others those whose key falls in the given share of the key space."""
    at = F.conv(F.substring(pair_key(seed), 1, 8), 16, 10).cast("long")
    return pairs.where((F.col("mapq") >= 1) | (at < (1 << 32) * share))


def weighted_union(df: DataFrame, extra: DataFrame, times: int) -> DataFrame:
    """df with the extra rows added so many times."""
    return df.unionByName(extra.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("__i"))


def merged_prune(*tables: DataFrame) -> DataFrame:
    """Prune tables (c1, c2, type) as one; a pair in several keeps the stronger type, the lesser number."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("c1", "c2").agg(F.min("type").alias("type"))


def subset_rows(rows: DataFrame) -> DataFrame:
    """Rows (read_name, member, a set each) whose set lies within another's; of equal sets all but the first.

    A set that lies within another shares its rarest member with it, so each set is compared only with the sets that hold that member, the larger or
    equal ones: it lies within one if they share as many as it has. Frequent members are nobody's rarest unless all of a set's are.
    """
    sets = rows.select("read_name", "member").distinct()
    held = sets.groupBy("member").agg(F.count("*").alias("sets"))
    named = sets.join(held, "member").groupBy("read_name").agg(F.min(F.struct("sets", "member")).alias("rarest"), F.count("*").alias("n"))
    asks = named.select("read_name", "n", F.col("rarest.member").alias("member"))
    others = sets.select(F.col("read_name").alias("other"), "member").join(named.select(F.col("read_name").alias("other"), F.col("n").alias("m")), "other")
    near = asks.join(others, "member").where("read_name <> other AND (m > n OR m = n AND other < read_name)").select("read_name", "other", "n")
    shared = near.join(sets, "read_name").join(sets.withColumnRenamed("read_name", "other"), ["other", "member"]).groupBy("read_name", "other", "n").agg(F.count("*").alias("k"))
    return shared.where("k = n").select("read_name").distinct()
