"""Command line: python -m skein VERB INPUT.. -o OUTPUT. Files in, files out; each verb is a composition of the operators."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.units import to_number
from .operators import contacts as c
from .operators import evaluation as ev
from .operators import filters as f
from .operators import graph as g
from .operators import layouts as ly
from .operators import scoring as sc
from .operators import signals as sg
from .operators import tables as tb
from .operators.samples import downsample_pairs, downsample_reads, merged_prune
from .plans import partition
from .session import session
from .sources import sinks, text


class Files:
    """Inputs of a verb, read on demand."""

    def __init__(self, spark, args):
        self.spark, self.args = spark, args

    def read(self, parser, path: str | None = None) -> DataFrame:
        return text.read(self.spark, path or self.args.input, parser)

    def pairs(self) -> DataFrame:
        """Pairs of a text file or a store, from the mapq asked for on."""
        if text.is_pairs_store(self.spark, self.args.input):
            return text.read_pairs_store(self.spark, self.args.input, self.args.mapq)
        return f.mapq_at_least(self.read(text.pairs), self.args.mapq)

    def contigs(self) -> DataFrame:
        return text.fields(text.lines(self.spark, self.args.contigs), "contig string, length bigint")

    def porec(self) -> DataFrame:
        rows = self.read(text.porec).withColumnRenamed("chrom", "contig")
        order = Window.partitionBy("read_idx").orderBy("contig", "start_pos", "end_pos", "read_start")
        return f.mapq_at_least(rows, self.args.mapq).withColumn("frag", F.row_number().over(order))

    def bed(self) -> DataFrame:
        return self.read(text.bed, self.args.bed).select("chrom", "start_pos", "end_pos")

    def membership(self) -> DataFrame:
        return self.read(text.clusters).select("grp", "contig")

    def tour(self) -> DataFrame:
        return self.read(text.tour)

    def layout(self) -> DataFrame:
        t, gaps = self.read(text.agp_tigs), self.read(text.agp_gaps)
        w = t.select(F.col("chrom").alias("grp"), "start_pos", "end_pos", "number", "kind", "id", "tig_start", "tig_end", "orientation")
        return w.unionByName(gaps.select(F.col("chrom").alias("grp"), "start_pos", "end_pos", "number", F.lit("U").alias("kind"), F.col("length").cast("string").alias("id"), F.lit(None).cast("bigint").alias("tig_start"), F.lit(None).cast("bigint").alias("tig_end"), F.lit("+").alias("orientation")))

    def paths(self, path: str) -> DataFrame:
        """grp, pos, contig and strand of an AGP file's contig rows."""
        return self.read(text.agp_tigs, path).select(F.col("chrom").alias("grp"), F.col("number").alias("pos"), F.col("id").alias("contig"), F.when(F.col("orientation") == "-", "-").otherwise("+").alias("strand"))

    def alleles(self) -> DataFrame:
        return self.read(text.alleles, self.args.alleles).select(F.col("contig1").alias("c1"), F.col("contig2").alias("c2"), "mz1", "mz2", "mz_shared", "similarity", "strand").where("c1 <> c2")

    def depth(self) -> DataFrame:
        return self.read(text.depth)

    def sequences(self) -> DataFrame:
        return text.fasta(self.spark, self.args.fasta or self.args.input).withColumnRenamed("name", "contig")


def flagged(x: Files) -> DataFrame:
    paf = x.read(text.paf).withColumn("identity", F.col("matches") / F.col("align_length")).withColumnRenamed("read_name", "read_idx")
    return f.singleton_flag(f.low_quality_flag(paf, x.args.mapq, x.args.identity, x.args.length))


def paf_to_porec(x: Files) -> DataFrame:
    kept = flagged(x).where("pass_filter")
    return kept.select(sinks.tsv("read_idx", "read_length", "read_start", "read_end", "strand", "chrom", "start_pos", "end_pos", "mapq", "identity", "filter_reason"))


def porec_to_pairs(x: Files) -> DataFrame:
    pairs = c.expand_pairs(f.order_between(x.porec(), 2, x.args.order), x.args.order)
    return sinks.pairs_lines(pairs.withColumn("mapq", F.lit(x.args.mapq)))


class Graph:
    """The contact graph of a read table over numbered contigs: operators that run in Python take numbers, files have names."""

    def __init__(self, x: Files):
        self.x = x
        he = f.min_contacts(f.order_between(c.hyperedges(x.porec()), 2, x.args.order), x.args.contacts)
        self.ids = x.contigs().select("contig", F.xxhash64("contig").alias("id"), "length")
        self.incidence = he.join(self.ids.select("contig", "id"), "contig").drop("contig").withColumnRenamed("id", "contig")
        self.contigs = self.ids.select(F.col("id").alias("contig"), "length")
        self.edges = c.clique(self.incidence, x.args.weight)
        self.vertices = g.vertices(self.incidence, self.contigs)

    def normalized(self) -> DataFrame:
        return g.normalize(self.edges.where("src <> dst"), self.vertices)

    def numbers(self, df: DataFrame, *columns: str) -> DataFrame:
        """The table with contig names in these columns as their numbers."""
        for col in columns:
            df = df.join(self.ids.select(F.col("contig").alias("__name"), "id"), F.col(col) == F.col("__name")).drop(col, "__name").withColumnRenamed("id", col)
        return df

    def names(self, df: DataFrame, column: str = "contig") -> DataFrame:
        return df.join(self.ids.select(F.col("contig").alias("__name"), "id"), F.col(column) == F.col("id")).drop(column, "id").withColumnRenamed("__name", column)

    def alleles(self) -> DataFrame:
        own = self.x.alleles() if self.x.args.alleles else self.x.spark.createDataFrame([], "c1 string, c2 string, mz_shared long, similarity double")
        own = self.numbers(own.select("c1", "c2", "mz_shared", "similarity"), "c1", "c2")
        return own.select(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2"), "mz_shared", "similarity")


def clusters_of(x: Files) -> DataFrame:
    gr = Graph(x)
    found = g.communities(gr.normalized(), x.args.resolution)
    return sinks.cluster_lines(gr.names(found.select(F.col("community").alias("grp"), "contig")))


def partition_of(x: Files) -> DataFrame:
    gr = Graph(x)
    found = partition.single_partition(gr.edges, gr.normalized(), gr.contigs, gr.alleles(), x.args.groups, shortest=x.args.length, least_cis=0.0)
    return sinks.cluster_lines(gr.names(found.select(F.col("name").alias("grp"), "contig")))


def two_round_partition_of(x: Files) -> DataFrame:
    gr = Graph(x)
    found = partition.incremental_partition(gr.edges, gr.vertices, gr.contigs, gr.alleles(), x.args.groups, x.args.per, least_cis=0.0)
    return sinks.cluster_lines(gr.names(found.select(F.col("name").alias("grp"), "contig")))


def rescue_of(x: Files) -> DataFrame:
    """Clusters of --clusters with the contigs that the read table's contacts put there."""
    gr = Graph(x)
    held = x.read(text.clusters, x.args.clusters).select("grp", "contig").withColumn("g", F.xxhash64("grp"))
    named = held.select("g", "grp").distinct()
    found = sc.rescued(gr.edges, gr.numbers(held, "contig").select("contig", F.col("g").alias("grp")), gr.contigs, gr.alleles(), x.args.weight, 0.0)
    return sinks.cluster_lines(gr.names(found.select("contig", F.col("grp").alias("g"))).join(named, "g").select("grp", "contig"))


def recluster_of(x: Files) -> DataFrame:
    gr = Graph(x)
    held = x.read(text.clusters, x.args.clusters).select("grp", "contig")
    moved = partition.reclustered(gr.edges, gr.numbers(held, "contig").select("contig", "grp"))
    return sinks.cluster_lines(gr.names(moved))


def scaffolding_of(x: Files) -> DataFrame:
    """Paths of each cluster of --clusters, from the pairs."""
    ids = x.contigs().select("contig", F.abs(F.xxhash64("contig")).alias("id"), "length")
    one, two = ids.select(F.col("contig").alias("chrom1"), F.col("id").alias("i1")), ids.select(F.col("contig").alias("chrom2"), F.col("id").alias("i2"))
    pairs = x.pairs().join(one, "chrom1").join(two, "chrom2").select(F.col("i1").alias("chrom1"), "pos1", F.col("i2").alias("chrom2"), "pos2")
    held = x.read(text.clusters, x.args.clusters).select(F.xxhash64("grp").alias("g"), "grp", "contig")
    member = held.join(ids, "contig").select(F.col("id").alias("contig"), F.col("g").alias("grp"))
    found = g.ordered_groups(pairs, ids.select(F.col("id").alias("contig"), "length"), member)
    named = found.withColumnRenamed("contig", "id").join(ids.select("id", "contig"), "id").withColumnRenamed("grp", "g").join(held.select("g", "grp").distinct(), "g")
    return sinks.tour_lines(named.select("grp", "pos", "contig", "strand"))


def chimeric_of(x: Files) -> DataFrame:
    ids = x.contigs().select("contig", F.xxhash64("contig").alias("id"), "length")
    one, two = ids.select(F.col("contig").alias("chrom1"), F.col("id").alias("i1")), ids.select(F.col("contig").alias("chrom2"), F.col("id").alias("i2"))
    pairs = x.pairs().join(one, "chrom1").join(two, "chrom2").select(F.col("i1").alias("chrom1"), "pos1", F.col("i2").alias("chrom2"), "pos2")
    found = sg.coverage_breaks(c.cis_coverage(pairs, ids.select(F.col("id").alias("contig"), "length"), x.args.binsize))
    return found.withColumnRenamed("contig", "id").join(ids.select("id", "contig"), "id").select(sinks.tsv("contig", F.col("w") * x.args.binsize, (F.col("w") + 1) * x.args.binsize, "n", "ratio"))


def kprune_of(x: Files) -> DataFrame:
    """Prune rows: type 0, contacts of alleles; type 1, contacts that are weaker than the crossing of both contigs' alleles."""
    contacts = x.read(text.contacts)
    pairs = x.alleles().select(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2")).distinct()
    upper = contacts.groupBy(F.least("contig1", "contig2").alias("contig1"), F.greatest("contig1", "contig2").alias("contig2")).agg(F.sum("n").alias("n"))
    allelic = pairs.select("c1", "c2", F.lit(0).alias("type"))
    weak = sc.weak_2x2(upper, pairs).select("c1", "c2", F.lit(1).alias("type"))
    return merged_prune(allelic, weak).select(sinks.tsv("c1", "c2", "type"))


def evaluation_of(x: Files) -> DataFrame:
    """The layout against that of --truth (both AGP)."""
    test, truth = (x.paths(p) for p in (x.args.input, x.args.truth))
    names = truth.select("grp").unionByName(test.select("grp")).distinct().withColumn("g", F.xxhash64("grp"))
    number = lambda t: t.join(names, "grp").drop("grp").withColumnRenamed("g", "grp")
    lengths = x.read(text.agp_tigs, x.args.truth).groupBy(F.col("id").alias("contig")).agg(F.max("tig_end").alias("length"))
    return ev.report(number(truth), number(test), lengths).select(F.to_json(F.struct("*")).alias("value"))


def assembly_paths(x: Files) -> DataFrame:
    """Paths of an assembly file: its lines of signed numbers are its groups, in the file's order."""
    lines = text.lines(x.spark, x.args.input)
    rows = lines.withColumn("at", F.monotonically_increasing_id()).where(~F.col("value").startswith(">") & (F.length(F.trim("value")) > 0))
    signed = rows.select(F.concat(F.lit("group"), F.row_number().over(Window.orderBy("at")).cast("string")).alias("grp"), F.col("value").alias("signed"))
    return ly.assembly_to_tour(text.assembly_contigs(lines), signed)


def placed(x: Files) -> DataFrame:
    """Where the contigs of --agp lie: chrom, contig, chrom_start and chrom_end, 0-based."""
    return x.read(text.agp_tigs, x.args.agp).select("chrom", F.col("id").alias("contig"), (F.col("start_pos") - 1).alias("chrom_start"), F.col("end_pos").alias("chrom_end"))


def pairs_on_contigs(x: Files) -> DataFrame:
    rows = c.chrom_to_contig(x.pairs().withColumn("pos1", F.col("pos1") - 1).withColumn("pos2", F.col("pos2") - 1), placed(x))
    return rows.select(sinks.tsv("read_idx", "contig1", "pos1", "contig2", "pos2"))


def agp_from_tour(x: Files) -> DataFrame:
    return sinks.agp_lines(tb.agp(x.tour(), x.contigs(), x.args.gap))


VERBS = {
    "chromsizes": lambda x: x.sequences().select(sinks.tsv("contig", F.length("seq"))),
    "paf2porec": paf_to_porec,
    "paf-stats": lambda x: tb.alignment_stats(flagged(x)).select(F.to_json(F.struct("*")).alias("value")),
    "porec2pairs": porec_to_pairs,
    "porec-intersect": lambda x: x.porec().join(f.fragments_in_region(x.porec(), x.bed()).select("read_idx", "frag"), ["read_idx", "frag"], "left_semi").select(sinks.tsv("read_idx", "read_length", "read_start", "read_end", "strand", "contig", "start_pos", "end_pos", "mapq", "identity", "filter_reason")),
    "pairs-filter": lambda x: sinks.pairs_lines(x.pairs()),
    "pairs-intersect": lambda x: sinks.pairs_lines(f.pairs_in_region_both(x.pairs(), x.bed(), x.args.invert)),
    "pairs-downsample": lambda x: sinks.pairs_lines(_downsample(x)),
    "pairs2contacts": lambda x: sinks.contact_lines(c.contacts(x.pairs(), x.args.contacts)),
    "pairs2depth": lambda x: sinks.depth_lines(c.depth(x.pairs(), x.contigs(), x.args.binsize)),
    "pairs2clm": lambda x: sinks.clm_lines(c.clm(x.pairs(), x.contigs(), x.args.contacts)),
    "pairs2mnd": lambda x: sinks.mnd_lines(x.pairs()),
    "pairs2pixels": lambda x: c.pixels(x.pairs(), x.contigs(), x.args.binsize).select(sinks.tsv("bin1_id", "bin2_id", "n")),
    "mnd2pairs": lambda x: x.read(text.mnd).select(sinks.tsv(F.lit("."), "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2")),
    "count-re": lambda x: tb.motif_counts(x.sequences(), x.args.motif).select(sinks.tsv("contig", "sites", "length")),
    "digest": lambda x: tb.digest(x.sequences(), x.args.motif).select(sinks.tsv("contig", "start_pos", "end_pos")),
    "hyperpartition": clusters_of,
    "cluster-stats": lambda x: tb.group_stats(x.membership(), x.contigs()).select(sinks.tsv("grp", "contigs", "bases", "n50")),
    "tour2agp": agp_from_tour,
    "cluster2agp": lambda x: sinks.agp_lines(ly.pseudo_agp(x.contigs(), x.membership(), x.args.gap)),
    "agp2cluster": lambda x: sinks.cluster_lines(x.layout().where("kind = 'W'").select("grp", F.col("id").alias("contig"))),
    "agp2tour": lambda x: sinks.tour_lines(x.layout().where("kind = 'W'").select("grp", F.col("number").alias("pos"), F.col("id").alias("contig"), F.col("orientation").alias("strand"))),
    "agp-dup": lambda x: sinks.agp_lines(ly.numbered_duplicates(x.layout())),
    "split-agp": lambda x: ly.split_by_haplotype(x.layout(), x.args.pattern).select(sinks.tsv("haplotype", "grp", "start_pos", "end_pos", "number", "kind", "id")),
    "contig-stats": lambda x: tb.assembly_stats(text.fields(text.lines(x.spark, x.args.input), "contig string, length bigint")).select(F.to_json(F.struct("*")).alias("value")),
    "gfa-contigs": lambda x: x.read(text.gfa_segments).select(sinks.tsv("name", "length")),
    "gfa2depth": lambda x: x.read(text.gfa_segments).select(sinks.tsv("name", F.lit(0), "length", "rd")),
    "clm2distance": lambda x: x.read(text.clm).select(sinks.tsv("contig1", "strand1", "contig2", "strand2", F.round(F.aggregate("distances", F.lit(0.0), lambda a, d: a + F.when(d > 1, 1 / F.log(d.cast("double"))).otherwise(0.0)), 6))),
}


VERBS |= {
    # clusters and layouts
    "partition": partition_of,
    "partition2": two_round_partition_of,
    "rescue": rescue_of,
    "recluster": recluster_of,
    "scaffolding": scaffolding_of,
    "evaluator": evaluation_of,
    "build": lambda x: sinks.fasta_lines(sinks.scaffold_sequences(x.tour(), x.sequences(), x.args.gap).withColumnRenamed("grp", "name")),
    "agp2fasta": lambda x: sinks.fasta_lines(sinks.scaffold_sequences(x.paths(x.args.input), x.sequences(), x.args.gap).withColumnRenamed("grp", "name")),
    "agp2assembly": lambda x: sinks.assembly_lines(x.paths(x.args.input), x.contigs()),
    "assembly2agp": lambda x: sinks.agp_lines(tb.agp(assembly_paths(x), text.assembly_contigs(text.lines(x.spark, x.args.input)).select(F.col("name").alias("contig"), "length"), x.args.gap)),
    "cluster2tour": lambda x: sinks.tour_lines(x.read(text.clusters).select("grp", (F.col("ordinal") + 1).alias("pos"), "contig", F.lit("+").alias("strand"))),
    "cluster2assembly": lambda x: sinks.assembly_lines(x.read(text.clusters).select("grp", (F.col("ordinal") + 1).alias("pos"), "contig", F.lit("+").alias("strand")), x.contigs()),
    "cluster2count": lambda x: ly.count_table(x.membership(), text.count_re(text.lines(x.spark, x.args.counts), 0)).select(sinks.tsv("grp", "contig", "sites", "length")),
    "cluster2fasta": lambda x: sinks.fasta_lines(x.membership().join(x.sequences(), "contig").select(F.concat_ws(" ", "contig", "grp").alias("name"), "seq")),
    "fasta2cluster": lambda x: sinks.cluster_lines(x.sequences().select(F.regexp_replace("contig", r"[._|:-].*$", "").alias("grp"), "contig")),
    "agp-stats": lambda x: x.layout().groupBy("grp").agg(F.count_if(F.col("kind") == "W").alias("contigs"), F.count_if(F.col("kind") != "W").alias("gaps"), F.max("end_pos").alias("length")).select(sinks.tsv("grp", "contigs", "gaps", "length")),
    "agp-bins": lambda x: ly.layout_bins(x.layout(), x.args.binsize).select(sinks.tsv("grp", "start_pos", "end_pos", "id", "orientation")),
    "rename": lambda x: sc.reference_votes(x.read(text.paf).withColumnRenamed("read_name", "r").withColumnRenamed("chrom", "read_name").withColumnRenamed("r", "chrom"), x.read(text.clusters, x.args.clusters).select("grp", "contig")).select(sinks.tsv("grp", "reference", "matches", "reverse")),
    # reads, pairs and contacts
    "paf2pairs": lambda x: sinks.pairs_lines(c.expand_pairs(f.order_between(flagged(x).where("pass_filter").withColumnRenamed("chrom", "contig").withColumn("frag", F.row_number().over(Window.partitionBy("read_idx").orderBy("contig", "start_pos", "end_pos", "read_start"))), 2, x.args.order), x.args.order).withColumn("mapq", F.lit(x.args.mapq))),
    "paf2depth": lambda x: c.depth(_starts(x), x.contigs(), x.args.binsize).select(sinks.tsv("chrom", "start_pos", "end_pos", "n")),
    "overlaps": lambda x: f.terminal_overlaps(x.read(text.paf), x.args.edge).select(sinks.tsv("read_name", "chrom", "strand", "matches", "align_length")),
    "porec-downsample": lambda x: _porec_lines(x.porec().join(downsample_reads(x.porec(), x.args.number, x.args.seed).select("read_idx"), "read_idx", "left_semi")),
    "porec-stats": lambda x: tb.read_stats(x.porec()).select(F.to_json(F.struct("*")).alias("value")),
    "porec2rows": lambda x: sinks.hyperedge_rows(x.porec()).select(sinks.tsv("edge_id", "node_name", "time_slot", "edge_name", "group")),
    "porec2incidence": lambda x: sinks.incidence_export(c.hyperedges(x.porec())).select(sinks.tsv("read_idx", "contig", "cnt", "mapq")),
    "hypergraph": lambda x: f.min_contacts(f.order_between(c.hyperedges(x.porec()), 2, x.args.order), x.args.contacts).select(sinks.tsv("read_idx", "contig", "cnt", "mapq")),
    "hypergraph2contacts": lambda x: c.clique(f.order_between(c.hyperedges(x.porec()), 2, x.args.order), x.args.weight).select(sinks.tsv("src", "dst", F.round("w", 6))),
    "pairs-chrom2contig": pairs_on_contigs,
    "pairs2split-contacts": lambda x: sinks.contact_lines(c.split_contacts(x.pairs(), x.contigs())),
    "split-contacts": lambda x: _inner(x, x.read(text.contacts)).select(sinks.tsv("grp", "contig1", "contig2", "n")),
    "split-clm": lambda x: _inner(x, x.read(text.clm)).select(sinks.tsv("grp", F.concat("contig1", "strand1", F.lit(" "), "contig2", "strand2"), F.size("distances"), F.array_join(F.transform("distances", lambda d: d.cast("string")), " "))),
    "extract": lambda x: sinks.pairs_lines(f.only_contigs(x.pairs(), x.contigs(), "chrom1", "chrom2")),
    "remove": lambda x: sinks.pairs_lines(f.without_contigs(x.pairs(), x.contigs(), "chrom1", "chrom2")),
    "chimeric": chimeric_of,
    # pruning, depth, sequences, graphs
    "alleles": lambda x: tb.merged_alleles(_kmers(x)).select(sinks.tsv(*tb.merged_alleles(_kmers(x)).columns)),
    "kprune": kprune_of,
    "hcr": lambda x: tb.high_confidence(x.depth(), x.args.low, x.args.high).select(sinks.tsv("chrom", "start_pos", "end_pos")),
    "copies": lambda x: tb.copy_numbers(x.depth(), x.args.peak or sg.depth_peak(x.depth())).select(sinks.tsv("chrom", "median", F.round("high", 6), F.round("copies", 6))),
    "copy-classes": lambda x: tb.copy_classes(x.depth(), x.args.peak or sg.depth_peak(x.depth())).select(sinks.tsv("class", "windows", "bases", "share")),
    "sequence-windows": lambda x: sinks.fasta_lines(ly.sequence_windows(x.sequences(), x.args.binsize, x.args.step or x.args.binsize).select(F.concat_ws("_", "contig", F.col("start_pos").cast("string")).alias("name"), F.col("piece").alias("seq"))),
    "site-bins": lambda x: ly.site_bins(x.sequences(), x.args.motif, x.args.binsize).select(sinks.tsv("contig", "start_pos", "sites")),
    "telomeres": lambda x: (lambda d: d.select(sinks.tsv(*d.columns)))(tb.telomeres(x.sequences(), x.args.motif, x.args.contacts)),
    "gfa-links": lambda x: (lambda d: d.select(sinks.tsv(*d.columns)))(x.read(text.gfa_links)),
    "gfa-topology": lambda x: (lambda d: d.select(sinks.tsv(*d.columns)))(sc.topology(x.read(text.gfa_links), x.read(text.gfa_segments).select(F.col("name").alias("contig"), "length"))),
}


def _porec_lines(rows: DataFrame) -> DataFrame:
    return rows.select(sinks.tsv("read_idx", "read_length", "read_start", "read_end", "strand", "contig", "start_pos", "end_pos", "mapq", "identity", "filter_reason"))


def _kmers(x: Files) -> DataFrame:
    """Allele rows of k-mer similarities from the share asked for on."""
    k = x.read(text.kmer_similarity).where(F.col("similarity") >= x.args.identity)
    return k.select(F.col("contig1").alias("c1"), F.col("contig2").alias("c2"), "mz1", "mz2", "mz_shared", "similarity", F.when(F.col("strand") == "-", -1).otherwise(1).alias("strand"))


def _inner(x: Files, rows: DataFrame) -> DataFrame:
    """Rows of two contigs that lie in one cluster of --clusters, with it."""
    m = x.read(text.clusters, x.args.clusters).select("grp", "contig")
    one, two = m.select(F.col("contig").alias("contig1"), "grp"), m.select(F.col("contig").alias("contig2"), F.col("grp").alias("g2"))
    return rows.join(one, "contig1").join(two, "contig2").where("grp = g2").drop("g2")


def _starts(x: Files) -> DataFrame:
    """Both ends of every alignment, as pairs."""
    return x.read(text.paf).select(F.col("chrom").alias("chrom1"), F.col("start_pos").alias("pos1"), F.col("chrom").alias("chrom2"), (F.col("end_pos") - 1).alias("pos2"))


def _downsample(x: Files) -> DataFrame:
    return downsample_pairs(x.pairs(), x.args.number, x.args.seed)


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="skein", description=__doc__)
    p.add_argument("verb", choices=[*sorted(VERBS), "pairs2store"])
    p.add_argument("input")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--contigs", help="contig sizes: name and length")
    p.add_argument("--bed")
    p.add_argument("--invert", action="store_true")
    p.add_argument("--mapq", type=int, default=0)
    p.add_argument("--identity", type=float, default=0.0)
    p.add_argument("--length", type=to_number, default=0)
    p.add_argument("--binsize", type=to_number, default=10_000)
    p.add_argument("--contacts", type=int, default=1, help="least contacts")
    p.add_argument("--weight", type=float, default=2.0, help="least edge weight")
    p.add_argument("--order", type=int, default=50, help="most contigs of a read")
    p.add_argument("--resolution", type=float, default=1.0)
    p.add_argument("--motif", default="GATC")
    p.add_argument("--gap", type=int, default=100)
    p.add_argument("--number", type=to_number, default=1_000_000)
    p.add_argument("--seed", type=int, default=7)
    p.add_argument("--pattern", default=r"g(\d+)$")
    p.add_argument("--compression", default="gzip")
    for name, what in (("clusters", "clusters: name, number, contigs"), ("alleles", "allele table"), ("fasta", "sequences"), ("truth", "the true layout, AGP"), ("agp", "a layout, AGP"), ("counts", "restriction site counts")):
        p.add_argument(f"--{name}", help=what)
    p.add_argument("--groups", type=int, default=8)
    p.add_argument("--per", type=int, default=2, help="haplotypes of a group")
    p.add_argument("--low", type=float, default=1.0, help="least depth")
    p.add_argument("--high", type=float, default=1e9, help="most depth")
    p.add_argument("--peak", type=float, default=0.0, help="depth of one copy; 0: the histogram's peak")
    p.add_argument("--edge", type=to_number, default=1_000)
    p.add_argument("--step", type=to_number, default=0)
    args = p.parse_args(argv)
    x = Files(session("skein"), args)
    if args.verb == "pairs2store":
        sinks.write_pairs_store(x.pairs(), args.output)
    else:
        sinks.write_lines(VERBS[args.verb](x), args.output, args.compression)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
