"""Layout conversions: assembly files, paths, duplicates, haplotype splits, sequence windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import agp, motif_starts


def assembly_to_tour(heads: DataFrame, paths: DataFrame) -> DataFrame:
    """(grp, pos, contig, strand) from assembly heads (name, idx, length) and paths (grp, signed: 'i -j ...')."""
    e = paths.select("grp", F.posexplode(F.split(F.trim("signed"), r"\s+")).alias("i", "s")).withColumn("v", F.col("s").try_cast("bigint"))
    return e.join(heads.select(F.col("idx").alias("k"), F.col("name").alias("contig")), F.abs("v") == F.col("k")).select("grp", (F.col("i") + 1).cast("long").alias("pos"), "contig", F.when(F.col("v") < 0, "-").otherwise("+").alias("strand"))


def pseudo_agp(contigs: DataFrame, of: DataFrame, gap: int = 100) -> DataFrame:
    """A layout of contigs by their group (contig, grp), in contig order, all forward."""
    t = of.withColumn("pos", F.row_number().over(Window.partitionBy("grp").orderBy("contig")).cast("long")).withColumn("strand", F.lit("+"))
    return agp(t, contigs, gap)


def numbered_duplicates(layout: DataFrame) -> DataFrame:
    """Contig rows (W) whose id occurs again get _d2, _d3 .. in layout order."""
    n = F.row_number().over(Window.partitionBy("kind", "id").orderBy("grp", "number"))
    return layout.withColumn("n", n).withColumn("id", F.when((F.col("kind") == "W") & (F.col("n") > 1), F.concat("id", F.lit("_d"), F.col("n").cast("string"))).otherwise(F.col("id"))).drop("n")


def split_by_haplotype(layout: DataFrame, pattern: str) -> DataFrame:
    """The haplotype that the pattern's first group finds in a path's name; 'unplaced' where it doesn't match."""
    h = F.regexp_extract(F.col("grp").cast("string"), pattern, 1)
    return layout.withColumn("haplotype", F.when(h == "", "unplaced").otherwise(h))


def layout_bins(layout: DataFrame, size: int) -> DataFrame:
    """Bins of each path with the contigs that lie in them: grp, start_pos, end_pos, id, orientation; a contig is in every bin it overlaps."""
    last = layout.groupBy("grp").agg(F.max("end_pos").alias("length"))
    w = layout.where("kind = 'W'").join(last, "grp")
    k = F.explode(F.sequence(F.floor((F.col("start_pos") - 1) / size), F.floor((F.col("end_pos") - 1) / size)))
    return w.select("grp", "id", "orientation", "length", k.alias("k")).select("grp", (F.col("k") * size).alias("start_pos"), F.least((F.col("k") + 1) * size, F.col("length")).alias("end_pos"), "id", "orientation")


def count_table(membership: DataFrame, counts: DataFrame) -> DataFrame:
    """Restriction site counts (contig, sites, length) of each group's contigs."""
    return membership.select("contig", "grp").join(counts, "contig")


def sequence_windows(seqs: DataFrame, size: int, step: int) -> DataFrame:
    """Windows of sequences: contig, start_pos and the piece."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(step)))
    return seqs.where(F.length("seq") > 0).select("contig", "seq", starts.alias("start_pos")).select("contig", F.col("start_pos").cast("long"), F.substr("seq", F.col("start_pos") + 1, F.lit(size)).alias("piece"))


def site_bins(seqs: DataFrame, motif: str, size: int) -> DataFrame:
    """Motif starts by bin of each sequence."""
    return motif_starts(seqs, motif).groupBy("contig", (F.floor(F.col("pos") / size) * size).alias("start_pos")).agg(F.count("*").alias("sites"))


def methylation_lift(segments: DataFrame, sites: DataFrame) -> DataFrame:
    """Target positions of query sites that fall into aligned match segments: (query, pos) to (target, pos), the strand turning them round."""
    from .intervals import overlap_join

    s = sites.select("query", F.col("pos").alias("a_start"), (F.col("pos") + 1).alias("a_end"))
    g = segments.select(F.col("query").alias("b_chrom"), F.col("q_start").alias("b_start"), F.col("q_end").alias("b_end"), "target", "t_start", "t_end", "strand")
    hit = overlap_join(s, g, a_key="query")
    to = F.when(F.col("strand") == "+", F.col("t_start") + F.col("a_start") - F.col("b_start")).otherwise(F.col("t_end") - 1 - (F.col("a_start") - F.col("b_start")))
    return hit.select("query", F.col("a_start").alias("pos"), "target", to.alias("target_pos"))


def methylation_scores(calls: DataFrame, sites: DataFrame, seqs: DataFrame, penalty: float) -> DataFrame:
    """Alignment scores less `penalty` for each CpG call that the reference sites contradict: align_id, inconsistent, score.

    calls: align_id, score, contig, pos (of the reference base), forward, methylated; sites: contig, pos of methylated C. A call counts only on a CpG of the reference;
    on the reverse strand it stands on the G, so its site is one to the left. CpGs are found once for each sequence.
    """
    cpg = motif_starts(seqs.select("contig", F.lower("seq").alias("seq")), "cg").select("contig", F.col("pos").alias("site"))
    c = calls.withColumn("site", F.when(F.col("forward"), F.col("pos")).otherwise(F.col("pos") - 1))
    known = sites.select("contig", F.col("pos").alias("site")).distinct().withColumn("hit", F.lit(True))
    bad = c.join(cpg, ["contig", "site"], "left_semi").join(known, ["contig", "site"], "left").where(F.coalesce("hit", F.lit(False)) != F.col("methylated")).groupBy("align_id").agg(F.count("*").alias("inconsistent"))
    return calls.select("align_id", "score").distinct().join(bad, "align_id", "left").select("align_id", F.coalesce("inconsistent", F.lit(0)).alias("inconsistent"), (F.col("score") - penalty * F.coalesce("inconsistent", F.lit(0))).alias("score"))
