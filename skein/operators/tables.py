"""Aggregates over alignments, alleles, layouts and assemblies; window metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import merge

#: Upper ends of the concatemer order classes, and their names.
ORDER_CLASSES = ((2, "2"), (3, "3"), (4, "4"), (6, "5-6"), (11, "7-11"), (21, "12-21"), (50, "22-50"), (1_000_000_000, ">50"))


def alignment_stats(flagged: DataFrame) -> DataFrame:
    """One row: alignments, passing, low-quality and singleton ones, and reads with any passing one."""
    ok = F.col("pass_filter")
    return flagged.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("n_pass"),
        F.count_if(F.col("filter_reason") == "low_mq").alias("n_low_mq"),
        F.count_if(F.col("filter_reason") == "singleton").alias("n_singleton"),
        F.count_distinct("read_idx").alias("reads"),
        F.count_distinct(F.when(ok, F.col("read_idx"))).alias("reads_pass"),
    )


def order_class(n: str) -> Column:
    out = None
    for top, name in ORDER_CLASSES:
        out = F.when(F.col(n) <= top, name) if out is None else out.when(F.col(n) <= top, name)
    return out


def order_histogram(porec: DataFrame) -> DataFrame:
    """Reads by class of their number of fragments, two or more, and percent of these reads."""
    n = porec.groupBy("read_idx").agg(F.count("*").alias("n")).where("n >= 2").groupBy(order_class("n").alias("order_class")).agg(F.count("*").alias("reads"))
    return n.join(F.broadcast(n.agg(F.sum("reads").alias("total"))), F.lit(True)).select("order_class", "reads", F.round(F.col("reads") * 100 / F.col("total"), 6).alias("percent"))


def read_stats(porec: DataFrame) -> DataFrame:
    per = porec.groupBy("read_idx").agg(F.count("*").alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))
    return per.agg(F.count("*").alias("reads"), F.round(F.avg("n"), 6).alias("mean_order"), F.percentile("n", F.lit(0.5)).alias("median_order"), F.sum("bases").alias("bases"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairwise"))


def copy_numbers(depth: DataFrame, peak: float) -> DataFrame:
    """Per contig: median bin count, copy number, share of bins above 1.5 peaks."""
    high = F.avg((F.col("n") > 1.5 * peak).cast("double"))
    return depth.groupBy("chrom").agg(F.percentile("n", F.lit(0.5)).alias("median"), high.alias("high")).withColumn("copies", F.col("median") / peak)


def depth_mode(depth: DataFrame) -> DataFrame:
    """The most frequent positive depth, the least of ties."""
    return depth.where("n > 0").groupBy("n").agg(F.count("*").alias("bins")).orderBy(F.desc("bins"), "n").limit(1)


def high_confidence(depth: DataFrame, low: float, high: float) -> DataFrame:
    """Merged bins whose count lies in the range."""
    return merge(depth.where(F.col("n").between(low, high)).select("chrom", "start_pos", "end_pos"))


def copy_classes(depth: DataFrame, peak: float) -> DataFrame:
    """Windows by copy class (< 0.1 peaks error, < 0.5 duplicated, < 1.5 haploid, else collapsed), with bases and share."""
    k = F.col("n") / peak
    c = F.when(k < 0.1, "error").when(k < 0.5, "duplicated").when(k < 1.5, "haploid").otherwise("collapsed")
    s = depth.groupBy(c.alias("class")).agg(F.count("*").alias("windows"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))
    return s.join(F.broadcast(s.agg(F.sum("bases").alias("total"))), F.lit(True)).select("class", "windows", "bases", F.round(F.col("bases") / F.col("total"), 6).alias("share"))


def dominant_class(depth: DataFrame, peak: float) -> DataFrame:
    """Per contig the class with most bases (thresholds 0.25, 0.75 and 1.5 peaks); ties to the name."""
    k = F.col("n") / peak
    c = F.when(k < 0.25, "junk").when(k < 0.75, "duplicated").when(k < 1.5, "haploid").otherwise("collapsed")
    s = depth.groupBy("chrom", c.alias("class")).agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))
    rn = F.row_number().over(Window.partitionBy("chrom").orderBy(F.desc("bases"), "class"))
    return s.withColumn("rn", rn).where("rn = 1").select("chrom", "class", "bases")


def nx(contigs: DataFrame, xs: tuple[int, ...] = (10, 50, 90)) -> DataFrame:
    """Nx and Lx: length and rank at which contigs, longest first, reach floor(total * x / 100)."""
    order = Window.orderBy(F.desc("length"), "contig")
    run = contigs.withColumn("rank", F.row_number().over(order)).withColumn("run", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.join(F.broadcast(contigs.agg(F.sum("length").alias("total"))), F.lit(True)).withColumn("x", F.explode(F.array(*map(F.lit, xs))))
    at = run.where(F.col("run") >= F.floor(F.col("total") * F.col("x") / 100))
    return at.groupBy("x").agg(F.max("length").alias("nx"), F.min("rank").cast("long").alias("lx"))


def assembly_stats(contigs: DataFrame) -> DataFrame:
    return contigs.agg(F.count("*").alias("contigs"), F.sum("length").alias("total"), F.min("length").alias("shortest"), F.max("length").alias("longest"), F.round(F.avg("length"), 6).alias("mean"), F.percentile("length", F.lit(0.5)).alias("median"))


def group_stats(membership: DataFrame, contigs: DataFrame) -> DataFrame:
    """Per group: contigs, bases and N50."""
    m = membership.join(contigs, "contig")
    order = Window.partitionBy("grp").orderBy(F.desc("length"), "contig")
    run = m.withColumn("run", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("length").over(Window.partitionBy("grp")))
    return run.groupBy("grp").agg(F.count("*").alias("contigs"), F.max("total").alias("bases"), F.max(F.when(F.col("run") >= F.floor(F.col("total") / 2), F.col("length"))).alias("n50"))


def clusters(membership: DataFrame) -> DataFrame:
    """group, number and space-joined contigs in order."""
    return membership.groupBy("grp").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("contig")), lambda c: c.cast("string")), " ").alias("contigs"))


def merged_alleles(alleles: DataFrame) -> DataFrame:
    """Allele rows of one pair added up: minimizers summed, similarity averaged and topped, strand with most shared minimizers (+ on ties)."""
    s = alleles.groupBy("c1", "c2", "strand").agg(F.sum("mz1").alias("mz1"), F.sum("mz2").alias("mz2"), F.sum("mz_shared").alias("mz_shared"), F.sum("similarity").alias("s"), F.count("*").alias("k"), F.max("similarity").alias("top"))
    best = F.max_by("strand", F.struct("mz_shared", "strand"))
    return s.groupBy("c1", "c2").agg(F.sum("mz1").alias("mz1"), F.sum("mz2").alias("mz2"), F.sum("mz_shared").alias("mz_shared"), F.round(F.sum("s") / F.sum("k"), 6).alias("mean_similarity"), F.round(F.max("top"), 6).alias("max_similarity"), best.alias("strand"))


def merged_alignments(paf: DataFrame) -> DataFrame:
    """Per read and target: best matches, sums, hull, identity 1 - mean(dv), and the strand with most matches (+ on ties)."""
    s = paf.groupBy("read_name", "chrom").agg(
        F.count("*").alias("k"), F.sum("matches").alias("matches"), F.max("matches").alias("best"), F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.round(1 - F.avg("dv"), 6).alias("identity"),
        F.sum(F.when(F.col("strand") == "+", F.col("matches")).otherwise(-F.col("matches"))).alias("vote"),
    )
    return s.withColumn("strand", F.when(F.col("vote") >= 0, "+").otherwise("-")).drop("vote")


def best_alignment(paf: DataFrame, key: str = "read_name") -> DataFrame:
    """The alignment with most matches of each read; ties to the lower target and start."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("matches"), "chrom", "start_pos", "line_id"))
    return paf.withColumn("rn", rn).where("rn = 1").drop("rn")


def block_sums(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Sum of edge weights between groups, each edge once, the lesser group first, and the mean over member pairs."""
    one, two = membership.select(F.col("contig").alias("src"), F.col("grp").alias("g1")), membership.select(F.col("contig").alias("dst"), F.col("grp").alias("g2"))
    sums = edges.join(one, "src").join(two, "dst").groupBy(F.least("g1", "g2").alias("grp1"), F.greatest("g1", "g2").alias("grp2")).agg(F.sum("w").alias("w"))
    n1, n2 = (membership.groupBy(F.col("grp").alias(g)).agg(F.count("*").alias(n)) for g, n in (("grp1", "n1"), ("grp2", "n2")))
    return sums.join(n1, "grp1").join(n2, "grp2").select("grp1", "grp2", "w", (F.col("w") / (F.col("n1") * F.col("n2"))).alias("mean_w"))


def group_scores(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Each contig's summed weight to each group, from both ends of the edges."""
    both = edges.where("src <> dst").select("src", "dst", "w").unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.join(membership.select(F.col("contig").alias("dst"), "grp"), "dst").groupBy(F.col("src").alias("contig"), "grp").agg(F.sum("w").alias("score"))


def best_two_groups(scores: DataFrame) -> DataFrame:
    """Best and second score of each contig, total, and specificity best / total."""
    rn = F.row_number().over(Window.partitionBy("contig").orderBy(F.desc(F.round("score", 6)), "grp"))
    r = scores.withColumn("rn", rn)
    return r.groupBy("contig").agg(F.max(F.when(F.col("rn") == 1, F.col("grp"))).alias("best_grp"), F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("best"), F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("score"))), F.lit(0.0)).alias("second"), F.sum("score").alias("total")).withColumn("specificity", F.col("best") / F.col("total"))


def allelic_error(alleles: DataFrame, membership: DataFrame, contigs: DataFrame) -> DataFrame:
    """Bases of contigs with an allele in their own group, over all bases of grouped contigs."""
    one, two = membership.select(F.col("contig").alias("c1"), F.col("grp").alias("g1")), membership.select(F.col("contig").alias("c2"), F.col("grp").alias("g2"))
    bad = alleles.join(one, "c1").join(two, "c2").where("g1 = g2").select(F.explode(F.array("c1", "c2")).alias("contig")).distinct()
    flagged = membership.join(contigs, "contig").join(bad.withColumn("bad", F.lit(1)), "contig", "left")
    return flagged.agg(F.sum(F.when(F.col("bad") == 1, F.col("length")).otherwise(0)).alias("error_bases"), F.sum("length").alias("bases")).withColumn("rate", F.round(F.col("error_bases") / F.col("bases"), 6))


def motif_counts(seqs: DataFrame, motif: str) -> DataFrame:
    """Occurrences that don't overlap, and length, by sequence."""
    return seqs.select("contig", F.regexp_count("seq", F.lit(motif)).cast("long").alias("sites"), F.length("seq").cast("long").alias("length"))


def motif_starts(seqs: DataFrame, motif: str) -> DataFrame:
    """(contig, i, pos): starts (0-based) of a motif's occurrences, which don't overlap, by a running sum over the pieces between them; sequences themselves stay where they are."""
    pieces = seqs.select("contig", F.posexplode(F.transform(F.split("seq", motif), lambda p: F.length(p).cast("long"))).alias("i", "n"))
    w = Window.partitionBy("contig").orderBy("i")
    run = pieces.withColumn("pos", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("i") * len(motif)).withColumn("last", F.lead("i").over(w).isNull())
    return run.where("NOT last").select("contig", "i", "pos")


def digest(seqs: DataFrame, motif: str, shift: int = 2) -> DataFrame:
    """Fragments between the cut sites of a motif, in order. A fragment ends `shift` bases past a motif's start (0-based), as the reader's cut position does; the last with the sequence."""
    cuts = motif_starts(seqs, motif).select("contig", "i", (F.col("pos") + shift).alias("end_pos"))
    tails = seqs.select("contig", F.length("seq").cast("long").alias("end_pos")).withColumn("i", F.lit(None).cast("int"))
    w = Window.partitionBy("contig").orderBy(F.col("i").isNull(), "i")
    both = cuts.unionByName(tails).withColumn("start_pos", F.coalesce(F.lag("end_pos").over(w), F.lit(0).cast("long"))).withColumn("i", F.row_number().over(w) - 1)
    return both.select("contig", "i", "start_pos", "end_pos")


def telomeres(seqs: DataFrame, motif: str, hits: int, reach: int = 2000) -> DataFrame:
    """Whether each end holds more than `hits` motifs within `reach` bases; the right one in reverse complement."""
    back = motif.upper().translate(str.maketrans("ACGT", "TGCA"))[::-1].lower()
    left = F.regexp_count(F.substring("seq", 1, reach), F.lit(motif)) > hits
    right = F.regexp_count(F.expr(f"right(seq, {reach})"), F.lit(back)) > hits
    return seqs.select("contig", left.alias("left_end"), right.alias("right_end"))


def split_rule(contigs: DataFrame, factor: float = 5, least: int = 20_000_000) -> DataFrame:
    """Whether the longest contig is so long against the 95th percentile that contigs are split, and to what length."""
    s = contigs.agg(F.max("length").alias("longest"), F.percentile("length", F.lit(0.95)).alias("p95"))
    yes = (F.col("longest") > factor * F.col("p95")) & (F.col("longest") > least)
    return s.select("longest", "p95", yes.alias("split"), F.when(yes, (F.ceil(F.col("p95") / 1e6) * 1e6).cast("long")).alias("split_length"))


def edges_lead(tour: DataFrame) -> DataFrame:
    """Consecutive contigs on each path: grp, a, a_strand, b, b_strand."""
    w = Window.partitionBy("grp").orderBy("pos")
    return tour.select("grp", F.col("contig").alias("a"), F.col("strand").alias("a_strand"), F.lead("contig").over(w).alias("b"), F.lead("strand").over(w).alias("b_strand")).where("b is not null")


def end_adjacency(tour: DataFrame) -> DataFrame:
    """Adjacent contig ends, unordered: the end left (5 or 3 by strand) and the end entered, the lesser first."""
    e = edges_lead(tour)
    x = F.concat(F.col("a").cast("string"), F.when(F.col("a_strand") == "+", ":3").otherwise(":5"))
    y = F.concat(F.col("b").cast("string"), F.when(F.col("b_strand") == "+", ":5").otherwise(":3"))
    return e.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct()


def precision_recall(truth: DataFrame, test: DataFrame, *keys: str) -> DataFrame:
    """TP, FP, FN, precision, recall and F1 of two sets of rows."""
    both = truth.select(*keys).withColumn("t", F.lit(1)).join(test.select(*keys).withColumn("p", F.lit(1)), list(keys), "full")
    s = both.agg(F.count_if(F.expr("t = 1 AND p = 1")).alias("tp"), F.count_if(F.expr("t IS NULL")).alias("fp"), F.count_if(F.expr("p IS NULL")).alias("fn"))
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return s.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def weighted_adjacency(truth: DataFrame, test: DataFrame, contigs: DataFrame) -> DataFrame:
    """Precision and recall of unordered neighbours weighted by the sum of both lengths."""

    def weighted(tour: DataFrame) -> DataFrame:
        e = edges_lead(tour).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
        one, two = contigs.select(F.col("contig").alias("x"), F.col("length").alias("lx")), contigs.select(F.col("contig").alias("y"), F.col("length").alias("ly"))
        return e.join(one, "x").join(two, "y").select("x", "y", (F.col("lx") + F.col("ly")).alias("w"))

    both = weighted(truth).withColumnRenamed("w", "wt").join(weighted(test).withColumnRenamed("w", "wp"), ["x", "y"], "full")
    s = both.agg(F.sum(F.when(F.col("wt").isNotNull() & F.col("wp").isNotNull(), F.col("wt")).otherwise(0)).alias("tp"), F.sum("wp").alias("p"), F.sum("wt").alias("t"))
    return s.select("tp", F.round(F.col("tp") / F.col("p"), 6).alias("precision"), F.round(F.col("tp") / F.col("t"), 6).alias("recall"))


def group_alias(truth: DataFrame, test: DataFrame) -> DataFrame:
    """For each test group the truth group with most common contigs; ties to the lesser."""
    n = test.select("contig", F.col("grp").alias("test_grp")).join(truth.select("contig", F.col("grp").alias("truth_grp")), "contig").groupBy("test_grp", "truth_grp").agg(F.count("*").alias("n"))
    rn = F.row_number().over(Window.partitionBy("test_grp").orderBy(F.desc("n"), "truth_grp"))
    return n.withColumn("rn", rn).where("rn = 1").select("test_grp", "truth_grp", "n")


def grouping_errors(truth: DataFrame, test: DataFrame, contigs: DataFrame) -> DataFrame:
    """Contigs outside the truth group that stands for their test group, by number and bases."""
    alias = group_alias(truth, test).select("test_grp", F.col("truth_grp").alias("alias"))
    j = test.select("contig", F.col("grp").alias("test_grp")).join(truth.select("contig", F.col("grp").alias("truth_grp")), "contig").join(alias, "test_grp").join(contigs, "contig")
    wrong = F.col("alias") != F.col("truth_grp")
    return j.agg(F.count("*").alias("contigs"), F.count_if(wrong).alias("errors"), F.sum(F.when(wrong, F.col("length")).otherwise(0)).alias("error_bases"), F.sum("length").alias("bases"))


def orientation_errors(truth: DataFrame, test: DataFrame) -> DataFrame:
    """Per test group the contigs whose strand differs, after a flip of the whole group where most differ (not on ties)."""
    j = test.select("contig", F.col("grp").alias("grp"), F.col("strand").alias("s")).join(truth.select("contig", F.col("strand").alias("t")), "contig")
    n = j.groupBy("grp").agg(F.count("*").alias("contigs"), F.count_if(F.expr("s <> t")).alias("differ"))
    flip = F.col("differ") * 2 > F.col("contigs")
    return n.select("grp", "contigs", flip.alias("flipped"), F.when(flip, F.col("contigs") - F.col("differ")).otherwise(F.col("differ")).alias("errors"))


def agp(tour: DataFrame, contigs: DataFrame, gap: int = 100) -> DataFrame:
    """Layout rows of each path: contigs (W) with a gap row (U) between neighbours; 1-based, end inclusive."""
    w = Window.partitionBy("grp").orderBy("pos")
    placed = tour.join(contigs, "contig").withColumn("before", F.coalesce(F.sum(F.col("length") + gap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("rank", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("grp")))
    tig = F.struct((F.col("before") + 1).alias("start_pos"), (F.col("before") + F.col("length")).alias("end_pos"), (2 * F.col("rank") - 1).cast("long").alias("number"), F.lit("W").alias("kind"), F.col("contig").cast("string").alias("id"), F.lit(1).cast("long").alias("tig_start"), F.col("length").alias("tig_end"), F.col("strand").alias("orientation"))
    hole = F.struct((F.col("before") + F.col("length") + 1).alias("start_pos"), (F.col("before") + F.col("length") + gap).alias("end_pos"), (2 * F.col("rank")).cast("long").alias("number"), F.lit("U").alias("kind"), F.lit(str(gap)).alias("id"), F.lit(None).cast("long").alias("tig_start"), F.lit(None).cast("long").alias("tig_end"), F.lit("+").alias("orientation"))
    return placed.select("grp", F.explode(F.when(F.col("rank") < F.col("n"), F.array(tig, hole)).otherwise(F.array(tig))).alias("r")).select("grp", "r.*")


def reverse_complement(c: str | Column) -> Column:
    return F.reverse(F.translate(F.col(c) if isinstance(c, str) else c, "acgtACGT", "tgcaTGCA"))
