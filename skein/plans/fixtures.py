"""Virtual genomics tables over the driver's star schema.

The texts below are SQL that Spark and DuckDB both run, so an operator and its oracle start from the same rows. Coordinates are BIGINT.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FIXTURES: dict[str, str] = {
    "contigs": "SELECT s_suppkey AS contig, CAST(100000 + ((s_suppkey * 37) % 50) * 1000 AS BIGINT) AS length FROM supplier",
    "porec": """
        SELECT l_orderkey AS read_idx,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey, l_extendedprice, l_linenumber) AS BIGINT) AS frag,
               l_suppkey AS contig, length AS contig_length, (CAST(floor(l_extendedprice) AS BIGINT) * 7) % length AS start_pos,
               least((CAST(floor(l_extendedprice) AS BIGINT) * 7) % length + 100 + CAST(l_quantity AS BIGINT) * 2, length) AS end_pos,
               greatest(CAST(l_quantity AS BIGINT) - 10, 0) AS mapq, CASE l_linestatus WHEN 'O' THEN '+' ELSE '-' END AS strand,
               CAST(0.8 AS DOUBLE) + l_discount AS identity
        FROM lineitem JOIN contigs ON l_suppkey = contig""",
    "pairs": """
        SELECT a.read_idx, a.contig AS chrom1, a.start_pos + 1 AS pos1, b.contig AS chrom2, b.start_pos + 1 AS pos2,
               a.strand AS strand1, b.strand AS strand2, least(a.mapq, b.mapq) AS mapq
        FROM porec a JOIN porec b ON a.read_idx = b.read_idx AND a.frag < b.frag""",
    "hcr": """
        SELECT contig AS chrom, k * 25000 + (contig % 7) * 500 AS start_pos, k * 25000 + (contig % 7) * 500 + 9000 AS end_pos
        FROM contigs CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(k)""",
    "chroms": """
        SELECT s_suppkey AS contig, s_nationkey AS chrom, length,
               CAST(sum(length) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - length AS BIGINT) AS chrom_start,
               CAST(sum(length) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS BIGINT) AS chrom_end
        FROM supplier JOIN contigs ON s_suppkey = contig""",
    "alleles": """
        SELECT c1, c2, mz1, mz2, CAST(floor(least(mz1, mz2) * share / 100) AS BIGINT) AS mz_shared,
               CAST(floor(least(mz1, mz2) * share / 100) AS DOUBLE) / least(mz1, mz2) AS similarity, strand
        FROM (SELECT a.s_suppkey AS c1, b.s_suppkey AS c2, 500 + (a.s_suppkey * 13) % 400 AS mz1, 500 + (b.s_suppkey * 13) % 400 AS mz2,
                     60 + (a.s_suppkey + b.s_suppkey) % 40 AS share, CASE WHEN (a.s_suppkey + b.s_suppkey) % 2 = 0 THEN 1 ELSE -1 END AS strand
              FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey) t""",
    "membership": "SELECT s_suppkey AS contig, CAST(s_nationkey AS BIGINT) AS grp, CAST(n_regionkey AS BIGINT) AS parent FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "tour_truth": """
        SELECT s_suppkey AS contig, CAST(s_nationkey AS BIGINT) AS grp,
               CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS BIGINT) AS pos,
               CASE WHEN s_suppkey % 3 = 0 THEN '-' ELSE '+' END AS strand FROM supplier""",
    "tour_test": """
        SELECT contig, grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY k, contig) AS BIGINT) AS pos, CASE WHEN contig % 4 = 0 THEN '-' ELSE '+' END AS strand
        FROM (SELECT s_suppkey AS contig, CAST(CASE WHEN s_suppkey % 11 = 0 THEN (s_nationkey + 1) % 25 ELSE s_nationkey END AS BIGINT) AS grp,
                     CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal ELSE s_suppkey END AS k FROM supplier) t""",
    "paf": """
        SELECT l_partkey AS read_name, CAST(20000 + p_size * 100 AS BIGINT) AS read_length, CAST(l_linenumber * 1000 AS BIGINT) AS read_start,
               CAST(l_linenumber * 1000 + 100 + l_quantity * 40 AS BIGINT) AS read_end, CASE l_linestatus WHEN 'O' THEN '+' ELSE '-' END AS strand,
               l_suppkey AS chrom, length AS chrom_length, (CAST(floor(l_extendedprice) AS BIGINT) * 7) % length AS start_pos,
               least((CAST(floor(l_extendedprice) AS BIGINT) * 7) % length + 100 + CAST(l_quantity AS BIGINT) * 40, length) AS end_pos,
               CAST(80 + l_quantity * 36 AS BIGINT) AS matches, CAST(100 + l_quantity * 40 AS BIGINT) AS align_length,
               greatest(CAST(l_quantity AS BIGINT) - 10, 0) AS mapq, CAST(round(l_tax * 1000) AS BIGINT) AS nm, l_discount AS dv, l_orderkey AS line_id
        FROM lineitem JOIN contigs ON l_suppkey = contig JOIN part ON l_partkey = p_partkey""",
    "contacts": "SELECT chrom1 AS contig1, chrom2 AS contig2, count(*) AS n FROM pairs GROUP BY chrom1, chrom2",
    "gfa_links": """
        SELECT a.s_suppkey AS src, CASE WHEN a.s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS src_strand, b.s_suppkey AS dst,
               CASE WHEN b.s_suppkey % 3 = 0 THEN '+' ELSE '-' END AS dst_strand, CAST(1000 + (a.s_suppkey * b.s_suppkey) % 5000 AS BIGINT) AS overlap
        FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND (a.s_suppkey + b.s_suppkey) % 3 = 0""",
    "seqs": """
        SELECT doc_id AS contig, regexp_replace(translate(lower(text), 'bdefhijklmnopqrsuvwxyz', 'acgtacgtacgtacgtacgtac'), '[^acgt]', '', 'g') AS seq FROM documents""",
}


def needed(sql: str) -> list[str]:
    """The fixtures that a statement names, with those that they name, in the order in which they can be defined."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in FIXTURES:
            if name not in found and re.search(rf"\b{name}\b", text):
                visit(FIXTURES[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def oracle(sql: str) -> str:
    """The statement with its fixtures as common table expressions, for DuckDB."""
    sql = sql.strip()
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n]})" for n in needed(sql))
    if not ctes:
        return sql
    if m := re.match(r"WITH( RECURSIVE)?\b", sql):
        return f"{m[0]} {ctes},\n{sql[m.end():].lstrip()}"
    return f"WITH {ctes}\n{sql}"


class Tables:
    """The driver's tables and the fixtures of one folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.known = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.known:
            if name in TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in FIXTURES:
                sql = FIXTURES[name].replace(", 'g')", ")")  # Spark replaces all matches without a flag
                for other in (*TABLES, *needed(sql)):
                    if other != name and re.search(rf"\b{other}\b", sql):
                        getattr(self, other).createOrReplaceTempView(other)
                df = self.spark.sql(sql)
            else:
                raise AttributeError(name)
            self.known[name] = df
        return self.known[name]
