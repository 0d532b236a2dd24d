"""Writers: Parquet layouts, and the lines of the text formats as a column `value`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tsv(*columns: str | Column) -> Column:
    """Columns joined by tabs; nulls empty."""
    return F.array_join(F.array(*[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]), "\t").alias("value")


def write_pairs_store(pairs: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Pairs by mapq tier (0: mapq 0, 1: more), sorted by mapq within files so that higher cut-offs skip row groups."""
    tiered = pairs.withColumn("tier", (F.col("mapq") >= 1).cast("int"))
    tiered.sortWithinPartitions("tier", "mapq").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("tier").parquet(path)


def write_matrix(bins: DataFrame, pixels: DataFrame, path: str) -> None:
    """A binned matrix as two Parquet tables, pixels sorted by both bins."""
    bins.write.mode("overwrite").parquet(f"{path}/bins")
    pixels.sortWithinPartitions("bin1_id", "bin2_id").write.mode("overwrite").parquet(f"{path}/pixels")


def write_lines(lines: DataFrame, path: str, compression: str = "gzip") -> None:
    lines.write.mode("overwrite").option("compression", compression).text(path)


def depth_lines(depth: DataFrame) -> DataFrame:
    return depth.select(tsv("chrom", "start_pos", "end_pos", "n"))


def clm_lines(clm: DataFrame) -> DataFrame:
    """'ctg1+ ctg2-', count and space-joined distances; a pair in several parts gives a line each, with the part's own count."""
    ends = F.concat(F.col("contig1").cast("string"), F.substring("orientation", 1, 1), F.lit(" "), F.col("contig2").cast("string"), F.substring("orientation", 2, 1))
    return clm.select(tsv(ends, F.size("distances"), F.array_join(F.transform("distances", lambda d: d.cast("string")), " ")))


def contact_lines(contacts: DataFrame) -> DataFrame:
    """The upper triangle."""
    return contacts.where("contig1 <= contig2").select(tsv("contig1", "contig2", "n"))


def pairs_lines(pairs: DataFrame) -> DataFrame:
    return pairs.select(tsv("read_idx", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2", "mapq"))


def mnd_lines(pairs: DataFrame) -> DataFrame:
    """Sixteen columns, + as 0 and - as -1."""

    def flag(c):
        return F.when(F.col(c) == "+", "0").otherwise("-1")

    cells = [flag("strand1"), "chrom1", "pos1", F.lit("0"), flag("strand2"), "chrom2", "pos2", F.lit("1"), "mapq", F.lit("-"), F.lit("-"), "mapq", F.lit("-"), F.lit("-"), "read_idx", F.lit("-")]
    return pairs.select(F.array_join(F.array(*[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cells]), " ").alias("value"))


def cluster_lines(membership: DataFrame) -> DataFrame:
    m = membership.groupBy("grp").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("contig")), lambda c: c.cast("string")), " ").alias("contigs"))
    return m.select(tsv("grp", "n", "contigs"))


def tour_lines(tour: DataFrame) -> DataFrame:
    t = tour.groupBy("grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "contig", "strand"))), lambda x: F.concat(x["contig"].cast("string"), x["strand"])), " ").alias("path"))
    return t.select(tsv("grp", "path"))


def agp_lines(agp: DataFrame) -> DataFrame:
    """Contig rows with their span, gap rows with type, linkage and evidence."""
    last = F.when(F.col("kind") == "W", F.array_join(F.array(F.col("tig_start").cast("string"), F.col("tig_end").cast("string"), "orientation"), "\t")).otherwise("scaffold\tyes\tproximity_ligation")
    return agp.select(tsv("grp", "start_pos", "end_pos", "number", "kind", "id", last))


def assembly_lines(tour: DataFrame, contigs: DataFrame) -> DataFrame:
    """'>name index length' for every contig, then a line of signed indexes for each path, in order."""
    i = contigs.withColumn("idx", F.row_number().over(Window.orderBy("contig")))
    heads = i.select(F.lit(0).alias("part"), F.col("idx").cast("long").alias("k"), F.concat_ws(" ", F.concat(F.lit(">"), F.col("contig").cast("string")), F.col("idx").cast("string"), F.col("length").cast("string")).alias("value"))
    signed = F.when(F.col("strand") == "-", -F.col("idx")).otherwise(F.col("idx"))
    paths = tour.join(i, "contig").groupBy("grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", signed.alias("s")))), lambda x: x["s"].cast("string")), " ").alias("value"))
    return heads.unionByName(paths.select(F.lit(1).alias("part"), F.row_number().over(Window.orderBy("grp")).cast("long").alias("k"), "value")).orderBy("part", "k").select("value")


def fasta_lines(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq")).alias("value"))


def scaffold_sequences(tour: DataFrame, seqs: DataFrame, gap: int = 100) -> DataFrame:
    """Sequence of each path: contigs in order, reverse-complemented where the strand is -, with runs of N between."""
    comp = F.reverse(F.translate("seq", "acgtACGT", "tgcaTGCA"))
    own = tour.join(seqs, "contig").withColumn("s", F.when(F.col("strand") == "-", comp).otherwise(F.col("seq")))
    return own.groupBy("grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "N" * gap).alias("seq"))


def hyperedge_rows(porec: DataFrame, slot: int = 1) -> DataFrame:
    """edge_id, node_name (chrom:start-end), time_slot, edge_name, group."""
    node = F.concat(F.col("contig").cast("string"), F.lit(":"), F.col("start_pos").cast("string"), F.lit("-"), F.col("end_pos").cast("string"))
    return porec.select(F.col("read_idx").alias("edge_id"), node.alias("node_name"), F.lit(slot).alias("time_slot"), F.concat(F.lit("read"), F.col("read_idx").cast("string")).alias("edge_name"), F.col("contig").alias("group"))


def incidence_export(incidence: DataFrame) -> DataFrame:
    """Rows of hyperedges whose counts add up to two or more."""
    n = incidence.groupBy("read_idx").agg(F.sum("cnt").alias("n")).where("n >= 2").select("read_idx")
    return incidence.join(n, "read_idx", "left_semi")
