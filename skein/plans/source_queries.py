"""Queries of the sources and sinks: lines made from the fixtures go to compressed files and through the parsers, and rows through the writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contacts as c
from ..operators import tables as tb
from ..operators.common import r6, shared_folder
from ..sources import sinks, text
from .aggregate_queries import BINMAP, DISTANCES, OFFSETS
from .filter_queries import HE, incidence
from .graph_queries import AGP
from .registry import query


def written(t, lines: DataFrame) -> str:
    """The folder of gzip files that hold the lines."""
    path = f"{shared_folder(t.spark)}/lines-{uuid.uuid4().hex}"
    sinks.write_lines(lines, path)
    return path


def filed(t, lines: DataFrame) -> DataFrame:
    """The lines as read again from files."""
    return text.lines(t.spark, written(t, lines))


@query("SELECT CAST(read_idx AS VARCHAR) AS read_idx, 'c' || chrom1 AS chrom1, pos1, 'c' || chrom2 AS chrom2, pos2, strand1, strand2, CAST(mapq AS SMALLINT) AS mapq FROM pairs")
def s1_scan_pairs(t):
    named = t.pairs.withColumn("chrom1", F.concat(F.lit("c"), "chrom1")).withColumn("chrom2", F.concat(F.lit("c"), "chrom2"))
    return text.pairs(filed(t, sinks.pairs_lines(named)))


@query("SELECT 'c' || chrom1 AS chrom1, pos1, 'c' || chrom2 AS chrom2, pos2 FROM pairs WHERE mapq >= 5")
def s2_scan_pairs_pruned(t):
    named = t.pairs.withColumn("chrom1", F.concat(F.lit("c"), "chrom1")).withColumn("chrom2", F.concat(F.lit("c"), "chrom2"))
    return text.pairs(filed(t, sinks.pairs_lines(named))).where("mapq >= 5").select("chrom1", "pos1", "chrom2", "pos2")


@query("SELECT CAST(contig AS VARCHAR) AS contig, length FROM contigs")
def s3_pairs_header(t):
    return text.pairs_header(filed(t, t.contigs.select(F.concat_ws(" ", F.lit("#chromsize:"), F.col("contig").cast("string"), F.col("length").cast("string")).alias("value"))))


@query("SELECT chrom1, pos1, chrom2, pos2, mapq FROM pairs WHERE mapq >= 10")
def s4_scan_store(t):
    path = f"{shared_folder(t.spark)}/pairs-store-{uuid.uuid4().hex}"
    sinks.write_pairs_store(t.pairs, path)
    return text.read_pairs_store(t.spark, path, 10, ["chrom1", "pos1", "chrom2", "pos2", "mapq"])


@query("SELECT read_idx, CAST(contig AS VARCHAR) AS chrom, start_pos, end_pos, CAST(mapq AS SMALLINT) AS mapq, round(identity, 6) AS identity FROM porec")
def s6_scan_porec(t):
    zero = F.lit(0)
    return text.porec(filed(t, t.porec.select(sinks.tsv("read_idx", zero, zero, zero, "strand", "contig", "start_pos", "end_pos", "mapq", "identity", F.lit("pass"))))).select("read_idx", "chrom", "start_pos", "end_pos", "mapq", r6("identity").alias("identity"))


def paf_lines(t):
    cells = ["read_name", "read_length", "read_start", "read_end", "strand", "chrom", "chrom_length", "start_pos", "end_pos", "matches", "align_length", "mapq"]
    tags = [F.concat(F.lit("NM:i:"), F.col("nm").cast("string")), F.concat(F.lit("dv:f:"), F.col("dv").cast("string")), F.concat(F.lit("cg:Z:"), F.col("align_length").cast("string"), F.lit("M"))]
    return t.paf.select(sinks.tsv(*cells, *tags))


@query("SELECT CAST(read_name AS VARCHAR) AS read_name, read_length, read_start, read_end, strand, CAST(chrom AS VARCHAR) AS chrom, chrom_length, start_pos, end_pos, matches, align_length, CAST(mapq AS SMALLINT) AS mapq FROM paf")
def s7_scan_paf(t):
    return text.paf(filed(t, paf_lines(t))).drop("nm", "score", "dv", "id", "cigar")


@query("SELECT CAST(read_name AS VARCHAR) AS read_name, CAST(chrom AS VARCHAR) AS chrom, nm, round(dv, 6) AS dv, align_length || 'M' AS cigar FROM paf")
def s8_scan_paf_tags(t):
    return text.paf(filed(t, paf_lines(t))).select("read_name", "chrom", "nm", r6("dv").alias("dv"), "cigar")


@query("SELECT CAST(chrom AS VARCHAR) AS chrom, start_pos, end_pos FROM hcr")
def s9_scan_bed(t):
    return text.bed(filed(t, t.hcr.select(sinks.tsv("chrom", "start_pos", "end_pos")))).drop("name")


@query("SELECT CAST(contig1 AS VARCHAR) AS contig1, CAST(contig2 AS VARCHAR) AS contig2, n FROM contacts")
def s10_scan_contacts(t):
    return text.contacts(filed(t, sinks.contact_lines(t.contacts)))


@query(f"WITH {DISTANCES} SELECT CAST(contig1 AS VARCHAR) AS contig1, orientation[1] AS strand1, CAST(contig2 AS VARCHAR) AS contig2, orientation[2] AS strand2, count(*) AS n, CAST(sum(d) AS BIGINT) AS total FROM d GROUP BY contig1, contig2, orientation")
def s11_scan_clm(t):
    return text.clm(filed(t, sinks.clm_lines(c.clm(t.pairs, t.contigs)))).select("contig1", "strand1", "contig2", "strand2", "n", F.aggregate("distances", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT CAST(c1 AS VARCHAR) AS contig1, CAST(c2 AS VARCHAR) AS contig2, mz1, mz2, mz_shared, round(similarity, 6) AS similarity, strand FROM alleles UNION ALL SELECT CAST(contig AS VARCHAR), CAST(contig AS VARCHAR), 500, 500, 500, 1.0, 1 FROM contigs")
def s12_scan_alleles(t):
    rows = t.alleles.select(sinks.tsv(F.lit(0), F.lit(0), "c1", "c2", "mz1", "mz2", "mz_shared", "similarity", "strand"))
    heads = t.contigs.select(F.concat_ws(" ", F.concat(F.lit("#"), F.col("contig").cast("string")), F.col("length").cast("string"), F.lit("500"), F.lit("400")).alias("value"))
    both = filed(t, rows.unionByName(heads))
    return text.with_self(text.alleles(both), text.allele_contigs(both)).select("contig1", "contig2", "mz1", "mz2", "mz_shared", r6("similarity").alias("similarity"), "strand")


@query("SELECT CAST(contig AS VARCHAR) AS contig, contig % 10 AS sites, length FROM contigs WHERE contig % 10 >= 3")
def s13_scan_count_re(t):
    return text.count_re(filed(t, t.contigs.select(sinks.tsv("contig", F.col("contig") % 10, "length"))))


@query("SELECT CAST(c1 AS VARCHAR) AS contig1, CAST(c2 AS VARCHAR) AS contig2, mz1, mz2, mz_shared, round(similarity, 6) AS similarity, CASE WHEN similarity >= 0.8 THEN 0 ELSE 1 END AS type FROM alleles")
def s14_scan_prune(t):
    rows = t.alleles.select(sinks.tsv("c1", "c2", "mz1", "mz2", "mz_shared", "similarity", F.when(F.col("similarity") >= 0.8, 0).otherwise(1)))
    return text.prune(filed(t, rows)).withColumn("similarity", r6("similarity"))


@query("SELECT CAST(grp AS VARCHAR) AS grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY contig) - 1 AS INTEGER) AS ordinal, CAST(contig AS VARCHAR) AS contig FROM membership")
def s15_scan_clusters(t):
    return text.clusters(filed(t, sinks.cluster_lines(t.membership)))


@query(f"WITH {AGP} SELECT CAST(grp AS VARCHAR) AS chrom, start_pos, end_pos, number, id, tig_start, tig_end, orientation FROM ag WHERE kind = 'W'")
def s16_scan_agp_tigs(t):
    return text.agp_tigs(filed(t, sinks.agp_lines(tb.agp(t.tour_test, t.contigs)))).drop("kind")


@query(f"WITH {AGP} SELECT CAST(grp AS VARCHAR) AS chrom, start_pos, end_pos, number, CAST(100 AS BIGINT) AS length FROM ag WHERE kind = 'U'")
def s16_scan_agp_gaps(t):
    return text.agp_gaps(filed(t, sinks.agp_lines(tb.agp(t.tour_test, t.contigs)))).select("chrom", "start_pos", "end_pos", "number", "length")


def gfa_lines(t):
    s = t.contigs.select(F.concat_ws("\t", F.lit("S"), F.concat(F.lit("u"), F.col("contig").cast("string")), F.lit("ACGTAC"), F.concat(F.lit("LN:i:"), F.col("length").cast("string")), F.concat(F.lit("rd:i:"), (F.col("contig") % 90).cast("string"))).alias("value"))
    links = t.gfa_links.select(F.concat_ws("\t", F.lit("L"), F.concat(F.lit("u"), F.col("src").cast("string")), "src_strand", F.concat(F.lit("u"), F.col("dst").cast("string")), "dst_strand", F.concat(F.col("overlap").cast("string"), F.lit("M"))).alias("value"))
    return s.unionByName(links)


@query("SELECT 'u' || contig AS name, length, contig % 90 AS rd FROM contigs")
def s17_scan_gfa_segments(t):
    return text.gfa_segments(filed(t, gfa_lines(t))).select("name", "length", "rd")


@query("SELECT 'u' || src AS src, src_strand, 'u' || dst AS dst, dst_strand, overlap FROM gfa_links")
def s17_scan_gfa_links(t):
    return text.gfa_links(filed(t, gfa_lines(t)))


@query("SELECT CAST(contig AS VARCHAR) AS name, CAST(length(seq) AS BIGINT) AS length FROM seqs")
def s19_scan_fasta(t):
    records = t.seqs.select(F.concat(F.lit(">"), F.col("contig").cast("string"), F.lit(" description\n"), F.expr("substr(seq, 1, 60)"), F.lit("\n"), F.expr("substr(seq, 61)")).alias("value"))
    return text.fasta(t.spark, written(t, records)).select("name", F.length("seq").cast("long").alias("length"))


@query("SELECT CAST(contig AS VARCHAR) AS chrom, start_pos + 1 AS start_pos, end_pos, strand, 'g' || read_idx || '_' || frag AS id FROM porec WHERE mapq >= 5")
def s20_scan_gff(t):
    kind = F.when(F.col("mapq") >= 5, "gene").otherwise("mRNA")
    attributes = F.concat(F.lit("ID=g"), F.col("read_idx").cast("string"), F.lit("_"), F.col("frag").cast("string"), F.lit(";Name=x"))
    return text.gff_genes(filed(t, t.porec.select(sinks.tsv("contig", F.lit("src"), kind, F.col("start_pos") + 1, "end_pos", F.lit("."), "strand", F.lit("."), attributes))))


@query("SELECT CAST(contig AS VARCHAR) AS contig, count(DISTINCT start_pos) AS n, min(start_pos) AS first FROM porec WHERE identity >= 0.85 GROUP BY contig")
def s21_scan_methylation(t):
    return text.methylation(filed(t, t.porec.select(sinks.tsv("contig", "start_pos", "end_pos", "identity"))), 0.85).select("contig", F.size("starts").cast("long").alias("n"), F.element_at("starts", 1).alias("first"))


@query("SELECT CAST(grp AS VARCHAR) AS grp, pos, CAST(contig AS VARCHAR) AS contig, strand FROM tour_test")
def s22_scan_tour(t):
    return text.tour(filed(t, sinks.tour_lines(t.tour_test)))


@query("SELECT CAST(contig AS VARCHAR) AS name, row_number() OVER (ORDER BY contig) AS idx, length FROM contigs")
def s22_scan_assembly(t):
    return text.assembly_contigs(filed(t, sinks.assembly_lines(t.tour_test, t.contigs)))


@query("SELECT CAST(c1 AS VARCHAR) AS contig1, CAST(c2 AS VARCHAR) AS contig2, mz1, mz2, mz_shared, round(similarity, 6) AS similarity, CASE WHEN strand > 0 THEN '+' ELSE '-' END AS strand FROM alleles")
def s23_scan_similarity(t):
    v = F.concat_ws("\t", F.lit("S"), *[F.col(x).cast("string") for x in ("c1", "c2", "mz1", "mz2", "mz_shared", "similarity")], F.when(F.col("strand") > 0, "+").otherwise("-"))
    heads = t.contigs.select(F.concat_ws("\t", F.lit("C"), F.col("contig").cast("string")).alias("value"))
    return text.kmer_similarity(filed(t, t.alleles.select(v.alias("value")).unionByName(heads))).withColumn("similarity", r6("similarity"))


@query("WITH a AS (SELECT CAST(c1 AS VARCHAR) AS a, CAST(c2 AS VARCHAR) AS b, similarity FROM alleles WHERE mz1 / 500.0 > 1.0 AND mz2 / 500.0 > 1.0) SELECT a AS contig1, b AS contig2, round(similarity, 6) AS identity FROM a UNION SELECT b, a, round(similarity, 6) FROM a")
def s24_scan_ani(t):
    return text.ani(filed(t, t.alleles.select(sinks.tsv("c1", "c2", "similarity", F.col("mz1") / 500, F.col("mz2") / 500)))).select("contig1", "contig2", r6("identity").alias("identity"))


@query("SELECT (CASE WHEN strand1 = '+' THEN '0' ELSE '-1' END) || ' ' || chrom1 || ' ' || pos1 || ' 0 ' || (CASE WHEN strand2 = '+' THEN '0' ELSE '-1' END) || ' ' || chrom2 || ' ' || pos2 || ' 1 ' || mapq || ' - - ' || mapq || ' - - ' || read_idx || ' -' AS value FROM pairs")
def k8_write_mnd(t):
    return sinks.mnd_lines(t.pairs)


@query("SELECT CAST(chrom1 AS VARCHAR) AS chrom1, pos1 + 1 AS pos1, CAST(chrom2 AS VARCHAR) AS chrom2, pos2 + 1 AS pos2, strand1, strand2 FROM pairs")
def k9_mnd_to_pairs(t):
    return text.mnd(sinks.mnd_lines(t.pairs))


@query(f"WITH {DISTANCES} SELECT contig1 || orientation[1] || ' ' || contig2 || orientation[2] || chr(9) || count(*) || chr(9) || string_agg(CAST(d AS VARCHAR), ' ' ORDER BY d) AS value FROM d GROUP BY contig1, contig2, orientation")
def k4_write_clm(t):
    return sinks.clm_lines(c.clm(t.pairs, t.contigs))


@query("SELECT contig1 || chr(9) || contig2 || chr(9) || n AS value FROM contacts WHERE contig1 <= contig2")
def k5_write_contacts(t):
    return sinks.contact_lines(t.contacts)


@query("SELECT grp || chr(9) || count(*) || chr(9) || string_agg(CAST(contig AS VARCHAR), ' ' ORDER BY contig) AS value FROM membership GROUP BY grp")
def k10_write_clusters(t):
    return sinks.cluster_lines(t.membership)


@query("SELECT grp || chr(9) || string_agg(contig || strand, ' ' ORDER BY pos) AS value FROM tour_test GROUP BY grp")
def k10_write_tours(t):
    return sinks.tour_lines(t.tour_test)


@query("SELECT grp, CAST(sum(length(seq)) + 100 * (count(*) - 1) AS BIGINT) AS length FROM tour_test JOIN seqs USING (contig) GROUP BY grp")
def k10_scaffold_sequences(t):
    return sinks.scaffold_sequences(t.tour_test, t.seqs).select("grp", F.length("seq").cast("long").alias("length"))


@query("SELECT read_idx AS edge_id, contig || ':' || start_pos || '-' || end_pos AS node_name, 1 AS time_slot, 'read' || read_idx AS edge_name, contig AS \"group\" FROM porec")
def k11_hyperedge_rows(t):
    return sinks.hyperedge_rows(t.porec)


@query(f"WITH {HE} SELECT * FROM he WHERE read_idx IN (SELECT read_idx FROM he GROUP BY read_idx HAVING sum(cnt) >= 2)")
def k12_incidence_export(t):
    return sinks.incidence_export(incidence(t))


@query(f"WITH {OFFSETS}, {BINMAP} SELECT bin_id, target AS chrom FROM bm")
def k2_matrix_bins(t):
    from .aggregate_queries import bin_map

    return bin_map(t).select("bin_id", F.col("target").alias("chrom"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def x_event_windows(t):
    from ..streaming.pixels import event_windows

    return event_windows(t.events).withColumn("total", r6("total"))
