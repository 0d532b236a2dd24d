"""Readers of the text formats. Each parser takes lines (a DataFrame with a column `value`) and gives typed columns; read() puts it on files.

Splitting and casting are native expressions, so columns that aren't asked for are not cast, and files are read in splits. Damaged fields become null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of plain or gzip files."""
    return spark.read.text(path)


def fields(df: DataFrame, spec: str, sep: str = "\t", comment: str | None = "#") -> DataFrame:
    """Separated fields by spec 'name type, name type ...', in order; missing ones null, comment and empty lines left out."""
    kept = df.where(F.length(F.trim("value")) > 0)
    if comment:
        kept = kept.where(~F.col("value").startswith(comment))
    parts = kept.select(F.split("value", sep).alias("p"))
    named = [x.split() for x in spec.split(",")]
    return parts.select(*[F.try_element_at("p", F.lit(i + 1)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(named)])


PAIRS = "read_idx string, chrom1 string, pos1 bigint, chrom2 string, pos2 bigint, strand1 string, strand2 string, mapq smallint"


def pairs(df: DataFrame) -> DataFrame:
    """4DN pairs; mapq null where there is no eighth column."""
    return fields(df, PAIRS)


def pairs_header(df: DataFrame) -> DataFrame:
    """Contig sizes from #chromsize lines, as (contig, length)."""
    p = F.split(F.regexp_replace("value", r"^#chromsize:\s*", ""), r"\s+")
    return df.where(F.col("value").startswith("#chromsize:")).select(p[0].alias("contig"), p[1].try_cast("bigint").alias("length"))


def pairs_columns(df: DataFrame) -> DataFrame:
    """Names in the #columns line, with their ordinals."""
    names = F.split(F.regexp_replace("value", r"^#columns:\s*", ""), r"\s+")
    return df.where(F.col("value").startswith("#columns:")).select(F.posexplode(names).alias("ordinal", "name"))


POREC = "read_idx bigint, read_length bigint, read_start bigint, read_end bigint, strand string, chrom string, start_pos bigint, end_pos bigint, mapq smallint, identity double, filter_reason string"


def porec(df: DataFrame) -> DataFrame:
    return fields(df, POREC)


PAF = "read_name string, read_length bigint, read_start bigint, read_end bigint, strand string, chrom string, chrom_length bigint, start_pos bigint, end_pos bigint, matches bigint, align_length bigint, mapq smallint"


def tag(name: str, kind: str) -> Column:
    """A SAM-like tag of the line, null if absent."""
    return F.nullif(F.regexp_extract("value", rf"\t{name}:[A-Za-z]:([^\t]*)", 1), F.lit("")).try_cast(kind)


def paf(df: DataFrame) -> DataFrame:
    """Twelve columns and the tags NM, AS, dv, id and cg, null if absent. A line is split once, and its tags are picked from the cells by name."""
    named = [x.split() for x in PAF.split(",")]
    kept = df.where(F.length(F.trim("value")) > 0).select(F.split("value", "\t").alias("p")).withColumn("tags", F.slice("p", len(named) + 1, 1 << 30))

    def own(name: str, kind: str) -> Column:
        cell = F.get(F.filter("tags", lambda x: x.startswith(f"{name}:")), F.lit(0))
        return F.nullif(F.substr(cell, F.lit(len(name) + 4)), F.lit("")).try_cast(kind)

    tags = [own("NM", "bigint").alias("nm"), own("AS", "bigint").alias("score"), own("dv", "double").alias("dv"), own("id", "double").alias("id"), own("cg", "string").alias("cigar")]
    return kept.select(*[F.try_element_at("p", F.lit(i + 1)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(named)], *tags)


def depth(df: DataFrame) -> DataFrame:
    return fields(df, "chrom string, start_pos bigint, end_pos bigint, n double")


def bed(df: DataFrame) -> DataFrame:
    """Three or four columns; track and browser lines left out."""
    return fields(df.where(~F.col("value").rlike("^(track|browser)")), "chrom string, start_pos bigint, end_pos bigint, name string")


def contacts(df: DataFrame) -> DataFrame:
    return fields(df, "contig1 string, contig2 string, n bigint")


def clm(df: DataFrame) -> DataFrame:
    """'ctg1+ ctg2-', count, distances."""
    c = fields(df, "ends string, n bigint, d string")
    e = F.split("ends", " ")

    def body(x):
        return F.regexp_replace(x, "[+-]$", "")

    def sign(x):
        return F.right(x, F.lit(1))

    return c.select(body(e[0]).alias("contig1"), sign(e[0]).alias("strand1"), body(e[1]).alias("contig2"), sign(e[1]).alias("strand2"), "n", F.transform(F.split(F.trim("d"), r"\s+"), lambda x: x.try_cast("bigint")).alias("distances"))


ALLELES = "idx1 bigint, idx2 bigint, contig1 string, contig2 string, mz1 bigint, mz2 bigint, mz_shared bigint, similarity double, strand int"


def alleles(df: DataFrame) -> DataFrame:
    return fields(df, ALLELES)


def allele_contigs(df: DataFrame) -> DataFrame:
    """The header rows '#contig length minimizers unique' of an allele table."""
    p = F.split(F.substring("value", 2, 1_000_000), r"\s+")
    return df.where(F.col("value").startswith("#") & (F.size(p) >= 4)).select(p[0].alias("contig"), p[1].try_cast("bigint").alias("length"), p[2].try_cast("bigint").alias("mz"), p[3].try_cast("bigint").alias("mz_unique"))


def with_self(a: DataFrame, contigs: DataFrame) -> DataFrame:
    """Allele rows with each contig's row to itself, similarity 1."""
    own = contigs.select(F.lit(None).cast("bigint").alias("idx1"), F.lit(None).cast("bigint").alias("idx2"), F.col("contig").alias("contig1"), F.col("contig").alias("contig2"), F.col("mz").alias("mz1"), F.col("mz").alias("mz2"), F.col("mz").alias("mz_shared"), F.lit(1.0).alias("similarity"), F.lit(1).alias("strand"))
    return a.unionByName(own)


def ragged_alleles(df: DataFrame) -> DataFrame:
    """chrom, gene and as many contigs as a line has, as an array."""
    p = F.split("value", r"\t")
    return df.where(F.length(F.trim("value")) > 0).select(p[0].alias("chrom"), p[1].alias("gene"), F.filter(F.slice(p, 3, 1_000_000), lambda x: F.length(x) > 0).alias("contigs"))


def count_re(df: DataFrame, least: int = 3) -> DataFrame:
    return fields(df, "contig string, sites bigint, length bigint").where(F.col("sites") >= least)


def prune(df: DataFrame) -> DataFrame:
    return fields(df, "contig1 string, contig2 string, mz1 bigint, mz2 bigint, mz_shared bigint, similarity double, type int")


def pair_table(df: DataFrame) -> DataFrame:
    """Pair rows without those of a contig with itself."""
    return fields(df, "x bigint, y bigint, contig1 string, contig2 string, sites1 bigint, sites2 bigint, observed double, expected double, label string").where("contig1 <> contig2")


def clusters(df: DataFrame) -> DataFrame:
    """group and member rows, with the member's ordinal."""
    c = fields(df, "grp string, n bigint, contigs string")
    return c.select("grp", F.posexplode(F.split("contigs", " ")).alias("ordinal", "contig"))


def tour(df: DataFrame) -> DataFrame:
    """One line a path of 'c1+ c2- ...': position, contig and strand; the path's name is the line before, if that starts with '>'. Lines hold 'name<TAB>path' here."""
    c = fields(df, "grp string, path string")
    return c.select("grp", F.posexplode(F.split(F.trim("path"), r"\s+")).alias("i", "e")).select("grp", (F.col("i") + 1).cast("bigint").alias("pos"), F.regexp_replace("e", "[+-]$", "").alias("contig"), F.right("e", F.lit(1)).alias("strand"))


def agp_tigs(df: DataFrame) -> DataFrame:
    return fields(df, "chrom string, start_pos bigint, end_pos bigint, number bigint, kind string, id string, tig_start bigint, tig_end bigint, orientation string").where("kind = 'W'")


def agp_gaps(df: DataFrame) -> DataFrame:
    return fields(df, "chrom string, start_pos bigint, end_pos bigint, number bigint, kind string, length bigint, gap_type string, linkage string, evidence string").where("kind IN ('U', 'N')")


def gfa_segments(df: DataFrame) -> DataFrame:
    """Name, length (the LN tag, else of the sequence), read depth (rd tag) and sequence."""
    p = F.split("value", "\t")
    return df.where(F.col("value").startswith("S\t")).select(p[1].alias("name"), F.coalesce(tag("LN", "bigint"), F.length(p[2]).cast("bigint")).alias("length"), tag("rd", "bigint").alias("rd"), p[2].alias("seq"))


def gfa_links(df: DataFrame) -> DataFrame:
    p = F.split("value", "\t")
    return df.where(F.col("value").startswith("L\t")).select(p[1].alias("src"), p[2].alias("src_strand"), p[3].alias("dst"), p[4].alias("dst_strand"), F.regexp_extract(p[5], r"(\d+)", 1).try_cast("bigint").alias("overlap"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA files: name (up to the first blank) and sequence. Files are split at '>' after a line end, so records of one file spread over tasks."""
    chunks = spark.read.option("lineSep", "\n>").text(path)
    return fasta_records(chunks)


def fasta_records(chunks: DataFrame) -> DataFrame:
    """Records from text between '>' signs, in `value`."""
    body = F.regexp_replace("value", r"^>", "")
    head = F.substring_index(body, "\n", 1)
    rest = F.when(F.instr(body, "\n") > 0, F.regexp_replace(F.substr(body, F.instr(body, "\n") + 1), r"\s", "")).otherwise("")
    return chunks.where(F.length(F.trim("value")) > 0).select(F.regexp_extract(head, r"^(\S+)", 1).alias("name"), rest.alias("seq"))


def gff_genes(df: DataFrame, kind: str = "gene") -> DataFrame:
    """Features of a type with the value of their first attribute as id."""
    g = fields(df, "chrom string, source string, type string, start_pos bigint, end_pos bigint, score string, strand string, phase string, attributes string").where(F.col("type") == kind)
    return g.select("chrom", "start_pos", "end_pos", "strand", F.substring_index(F.split("attributes", ";")[0], "=", -1).alias("id"))


def methylation(df: DataFrame, cutoff: float) -> DataFrame:
    """Per contig the distinct starts of bedgraph rows whose value reaches the cutoff, sorted."""
    m = fields(df, "contig string, start_pos bigint, end_pos bigint, value double").where(F.col("value") >= cutoff)
    return m.groupBy("contig").agg(F.sort_array(F.collect_set("start_pos")).alias("starts"))


def assembly_contigs(df: DataFrame) -> DataFrame:
    """'>name index length' lines of an assembly file."""
    p = F.split(F.substring("value", 2, 1_000_000), r"\s+")
    return df.where(F.col("value").startswith(">")).select(p[0].alias("name"), p[1].try_cast("bigint").alias("idx"), p[2].try_cast("bigint").alias("length"))


def kmer_similarity(df: DataFrame) -> DataFrame:
    """'S' records of k-mer similarity output: two contigs, three minimizer counts, similarity and strand."""
    p = F.split("value", r"\s+")
    return df.where(F.col("value").startswith("S")).select(p[1].alias("contig1"), p[2].alias("contig2"), *[p[i + 3].try_cast("bigint").alias(n) for i, n in enumerate(("mz1", "mz2", "mz_shared"))], p[6].try_cast("double").alias("similarity"), p[7].alias("strand"))


def ani(df: DataFrame, least: float = 1.0) -> DataFrame:
    """Identity pairs whose aligned fractions both exceed the limit, in both directions."""
    a = fields(df, "contig1 string, contig2 string, identity double, frac1 double, frac2 double").where((F.col("frac1") > least) & (F.col("frac2") > least) & (F.col("contig1") != F.col("contig2")))
    return a.unionByName(a.select(F.col("contig2").alias("contig1"), F.col("contig1").alias("contig2"), "identity", F.col("frac2").alias("frac1"), F.col("frac1").alias("frac2"))).distinct()


def mnd(df: DataFrame) -> DataFrame:
    """Nine-column merged-nodups rows as pairs: positions 1-based, '0' is +, each end by its own strand."""
    m = fields(df, "str1 string, chrom1 string, pos1 bigint, frag1 int, str2 string, chrom2 string, pos2 bigint, frag2 int, score double", sep=" ", comment=None)

    def sign(c):
        return F.when(F.col(c) == "0", "+").otherwise("-")

    return m.select("chrom1", (F.col("pos1") + 1).alias("pos1"), "chrom2", (F.col("pos2") + 1).alias("pos2"), sign("str1").alias("strand1"), sign("str2").alias("strand2"))


def read(spark: SparkSession, path: str, parser: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A parser on files."""
    return parser(lines(spark, path))


def read_pairs_store(spark: SparkSession, path: str, mapq: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Pairs of a Parquet store partitioned by mapq tier: from mapq 1 on the zero tier isn't read at all."""
    df = spark.read.parquet(path)
    if mapq >= 1:
        df = df.where(F.col("tier") >= 1)
    if mapq > 1:
        df = df.where(F.col("mapq") >= mapq)
    return df.select(*columns) if columns else df.drop("tier")


def is_pairs_store(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds pairs by tier, by its schema."""
    try:
        return {"chrom1", "pos1", "chrom2", "pos2", "tier"} <= set(spark.read.parquet(path).columns)
    except Exception as error:
        if any(x in str(error) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE", "is not a Parquet file")):
            return False
        raise


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a folder's files; it changes when they do, and no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return files.agg(F.md5(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string")))), "\n")).alias("d")).first()["d"]
