"""Evaluation of layouts against a truth: subsequences, homolog ratios, switch errors, coverage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables as tb
from .graph import longest_common, longest_increasing
from .intervals import merge


def order_agreement(truth: DataFrame, test: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per test group: contigs, how its order agrees with the truth, and what the two still need to be alike.

    lcs: longest common subsequence of oriented contigs with the truth path that shares most with it, forward or reversed; in_order: the longest run in order of any truth
    path, whatever the strands. Against its alias, the truth path with most of its contigs (ties: the lesser), over the contigs both have: edits, the contigs
    outside the longest common oriented subsequence, and weighted_edits, the bases outside the heaviest one; misplaced, the contigs outside the longest common subsequence without strands, read forward.
    A path has as many elements as a chromosome has contigs, and each test path is one group. lengths: contig, length.
    """
    a = test.select(F.col("grp").alias("test_grp"), "contig", F.col("pos").alias("p"), F.col("strand").alias("s"))
    b = truth.select(F.col("grp").alias("truth_grp"), "contig", F.col("pos").alias("q"), F.col("strand").alias("u"))
    j = a.join(b, "contig", "left").join(lengths.select("contig", "length"), "contig", "left")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("p")
        known = rows[rows["truth_grp"].notna()]
        best, inc, top, edits, weighted, misplaced = 0, 0, 0, 0, 0, 0
        for _, part in known.groupby("truth_grp"):  # in the order of their names, so that ties go to the lesser
            t = part.sort_values("q")
            mine = list(zip(part["contig"], part["s"], strict=True))
            theirs = list(zip(t["contig"], t["u"], strict=True))
            flipped = [(c, "-" if s == "+" else "+") for c, s in reversed(theirs)]
            ids = {x: i for i, x in enumerate(dict.fromkeys([*mine, *theirs, *flipped]))}
            codes = [[ids[x] for x in side] for side in (mine, theirs, flipped)]
            weights = part["length"].fillna(0).astype("int64").tolist()
            plain = max(longest_common(codes[0], codes[1]), longest_common(codes[0], codes[2]))
            best = max(best, plain)
            order = part["q"].tolist()
            inc = max(inc, longest_increasing(order), longest_increasing([-x for x in order]))
            if len(part) > top:
                top, edits = len(part), len(part) - plain
                weighted = sum(weights) - max(longest_common(codes[0], codes[1], weights), longest_common(codes[0], codes[2], weights))
                misplaced = len(part) - longest_increasing(order)
        return pd.DataFrame({"grp": [rows["test_grp"].iloc[0]], "contigs": [len(rows)], "lcs": [best], "in_order": [inc], "edits": [edits], "weighted_edits": [weighted], "misplaced": [misplaced]})

    return j.groupBy("test_grp").applyInPandas(run, "grp long, contigs long, lcs long, in_order long, edits long, weighted_edits long, misplaced long")


def report(truth: DataFrame, test: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: adjacencies (tp, fp, fn, precision, recall, f1), grouping and orientation errors, signed edit distance and the share of bases it touches.

    Only truth contigs that the test has placed count; those it hasn't are unanchored and add to the edit distance, with their bases.
    """
    placed = truth.join(test.select("contig"), "contig", "left_semi")
    left = truth.join(test.select("contig"), "contig", "left_anti").join(lengths, "contig").agg(F.count("*").alias("unanchored"), F.coalesce(F.sum("length"), F.lit(0)).alias("unanchored_bases"))
    ends = tb.precision_recall(tb.end_adjacency(placed), tb.end_adjacency(test), "x", "y")
    groups = tb.grouping_errors(placed, test, lengths).select("contigs", F.col("errors").alias("grouping_errors"), "error_bases", "bases")
    turned = tb.orientation_errors(placed, test).agg(F.sum("errors").alias("orientation_errors"))
    edits = order_agreement(placed, test, lengths).agg(F.sum("edits").alias("edits"), F.sum("weighted_edits").alias("weighted"), F.sum("misplaced").alias("misplaced"))
    total = truth.join(lengths, "contig").agg(F.sum("length").alias("total"))
    j = ends.join(groups, F.lit(True)).join(turned, F.lit(True)).join(edits, F.lit(True)).join(left, F.lit(True)).join(total, F.lit(True))
    return j.select("tp", "fp", "fn", "precision", "recall", "f1", "contigs", "grouping_errors", F.round(F.col("error_bases") / F.col("bases"), 6).alias("grouping_rate"), "orientation_errors", "misplaced", "unanchored", (F.col("edits") + F.col("unanchored")).alias("edit_distance"), F.round((F.col("weighted") + F.col("unanchored_bases")) / F.col("total"), 6).alias("edit_rate"))


def homolog_ratio(alleles: DataFrame, contacts: DataFrame) -> DataFrame:
    """trans / (trans + cis1 + cis2) of allelic pairs with contacts."""
    cis = contacts.where("contig1 = contig2")
    one, two = cis.select(F.col("contig1").alias("c1"), F.col("n").alias("cis1")), cis.select(F.col("contig1").alias("c2"), F.col("n").alias("cis2"))
    trans = contacts.select(F.col("contig1").alias("c1"), F.col("contig2").alias("c2"), F.col("n").alias("trans"))
    return alleles.select("c1", "c2").join(trans, ["c1", "c2"]).join(one, "c1").join(two, "c2").withColumn("ratio", F.col("trans") / (F.col("trans") + F.col("cis1") + F.col("cis2")))


def switch_errors(windows: DataFrame) -> DataFrame:
    """Per read, over its windows in order: changes of group (switches), and windows outside the read's main group (Hamming): one exchange by read."""
    order = Window.partitionBy("read_idx").orderBy("frag")
    marked = windows.select("read_idx", F.coalesce(F.lag("grp").over(order) != F.col("grp"), F.lit(False)).alias("changed"), F.count("*").over(Window.partitionBy("read_idx", "grp")).alias("alike"))
    return marked.groupBy("read_idx").agg(F.count("*").alias("windows"), F.count_if("changed").alias("switches"), (F.count("*") - F.max("alike")).alias("hamming"))


def chain_switches(windows: DataFrame, least_mapq: int = 2) -> DataFrame:
    """Per read: windows of its main chain, how many of them another chain aligns better, and the mean rate of mismatches that this saves.

    windows: read_name, chain, win (the window's number in the read), mapq, nm, length. The main chain is that with most windows of mapq `least_mapq` or more (ties: the lesser
    number). A window counts as switched if another chain holds it with such a mapq and fewer mismatches; the fewest count. rate: the mismatches
    saved over the window's length, null without switches. A window that a chain holds twice counts by its first.
    """
    once = windows.groupBy("read_name", "chain", "win").agg(F.min(F.struct("nm", "length", "mapq")).alias("w")).select("read_name", "chain", "win", "w.nm", "w.length", "w.mapq")
    sure = F.count_if(F.col("mapq") >= least_mapq).over(Window.partitionBy("read_name", "chain"))
    ranked = once.withColumn("sure", sure).withColumn("main", F.dense_rank().over(Window.partitionBy("read_name").orderBy(F.desc("sure"), "chain")) == 1)
    per = ranked.groupBy("read_name", "win").agg(F.max(F.when(F.col("main"), F.struct("nm", "length"))).alias("m"), F.min(F.when(~F.col("main") & (F.col("mapq") >= least_mapq), F.col("nm"))).alias("other")).where("m IS NOT NULL")
    saved = F.when(F.col("other") < F.col("m.nm"), (F.col("m.nm") - F.col("other")) / F.col("m.length"))
    return per.select("read_name", saved.alias("saved")).groupBy("read_name").agg(F.count("*").alias("windows"), F.count("saved").alias("switches"), F.round(F.avg("saved"), 6).alias("rate"))


def coverage_thresholds(bed: DataFrame, contigs: DataFrame) -> DataFrame:
    """How many contigs are covered to at least 0.1, 0.2, .. 1.0 of their length."""
    r = merge(bed).groupBy("chrom").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("covered")).join(contigs.withColumnRenamed("contig", "chrom"), "chrom").select((F.col("covered") / F.col("length")).alias("r"))
    cuts = F.explode(F.array(*[F.lit(i / 10) for i in range(1, 11)])).alias("cut")
    return r.select("r", cuts).groupBy("cut").agg(F.count_if(F.col("r") >= F.col("cut")).alias("contigs"))
