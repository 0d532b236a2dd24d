"""Queries of the aggregates and window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contacts as c
from ..operators import filters as f
from ..operators import intervals as iv
from ..operators import tables as tb
from ..operators.common import r6, r9
from .filter_queries import BINS, FRAGMENTS, HE, LOW, fragments, incidence, island_sql
from .registry import query

ENDS = "e AS (SELECT chrom1 AS chrom, pos1 AS pos FROM pairs UNION ALL SELECT chrom2, pos2 FROM pairs)"
DEPTH = f"{ENDS}, {BINS}, dc AS (SELECT chrom, pos // 10000 * 10000 AS start_pos, count(*) AS n FROM e GROUP BY ALL), depth AS (SELECT w.chrom, w.start_pos, w.end_pos, coalesce(n, 0) AS n FROM w LEFT JOIN dc USING (chrom, start_pos))"
OFFSETS = "o AS (SELECT contig, length, CAST(ceil(length / 10000) AS BIGINT) AS bins, CAST(coalesce(sum(CAST(ceil(length / 10000) AS BIGINT)) OVER (ORDER BY contig ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM contigs)"
PIXELS = f"{OFFSETS}, px AS (SELECT least(a.off + pos1 // 10000, b.off + pos2 // 10000) AS bin1_id, greatest(a.off + pos1 // 10000, b.off + pos2 // 10000) AS bin2_id, count(*) AS n FROM pairs JOIN o a ON chrom1 = a.contig JOIN o b ON chrom2 = b.contig GROUP BY ALL)"
BINMAP = "bm AS (SELECT off + k AS bin_id, contig AS target FROM (SELECT *, unnest(generate_series(0, bins - 1)) AS k FROM o))"


def depth(t):
    return c.depth(t.pairs, t.contigs, 10_000)


def pixels(t):
    return c.pixels(t.pairs, t.contigs, 10_000)


def bin_map(t):
    o = c.bin_offsets(t.contigs, 10_000)
    return o.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("k"), "offset", "contig").select((F.col("offset") + F.col("k")).alias("bin_id"), F.col("contig").alias("target"))


@query(f"WITH {DEPTH} SELECT * FROM depth")
def a1_depth_by_bin(t):
    return depth(t)


@query(f"WITH {PIXELS} SELECT * FROM px")
def a2_pixel_counts(t):
    return pixels(t)


@query("SELECT contig1, contig2, n FROM contacts WHERE n >= 5")
def a3_contacts(t):
    return c.contacts(t.pairs, 5)


HALVES = (
    "h AS (SELECT chrom1 || '_' || least(CAST(floor((pos1 - 1) * 2 / a.length) AS BIGINT), 1) AS contig1, chrom2 || '_' || least(CAST(floor((pos2 - 1) * 2 / b.length) AS BIGINT), 1) AS contig2, count(*) AS n "
    "FROM pairs JOIN contigs a ON chrom1 = a.contig JOIN contigs b ON chrom2 = b.contig GROUP BY ALL)"
)


@query(f"WITH {HALVES} SELECT * FROM h")
def a3_split_contacts(t):
    return c.split_contacts(t.pairs, t.contigs)


@query(f"WITH {HALVES} SELECT regexp_replace(contig1, '_[0-9]+$', '') AS contig1, regexp_replace(contig2, '_[0-9]+$', '') AS contig2, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1, 2")
def a4_unsplit_contacts(t):
    return c.unsplit_contacts(c.split_contacts(t.pairs, t.contigs))


ENDS_OF_PAIRS = "pq AS (SELECT chrom1 AS contig1, chrom2 AS contig2, pos1, pos2, a.length AS l1, b.length AS l2 FROM pairs JOIN contigs a ON chrom1 = a.contig JOIN contigs b ON chrom2 = b.contig WHERE chrom1 <> chrom2)"
DISTANCES = (
    f"{ENDS_OF_PAIRS}, d AS (SELECT contig1, contig2, '++' AS orientation, l1 - pos1 + pos2 AS d FROM pq UNION ALL SELECT contig1, contig2, '+-', l1 - pos1 + l2 - pos2 FROM pq "
    "UNION ALL SELECT contig1, contig2, '-+', pos1 + pos2 FROM pq UNION ALL SELECT contig1, contig2, '--', pos1 + l2 - pos2 FROM pq)"
)


@query(f"WITH {DISTANCES} SELECT contig1, contig2, orientation, count(*) AS n, string_agg(CAST(d AS VARCHAR), ' ' ORDER BY d) AS distances FROM d GROUP BY ALL HAVING count(*) >= 3")
def a5_clm(t):
    return c.clm(t.pairs, t.contigs, 3).drop("part").withColumn("distances", F.array_join(F.transform("distances", lambda d: d.cast("string")), " "))


@query(
    f"WITH {DISTANCES} SELECT contig1, contig2, "
    + ", ".join(f"round(sum(CASE WHEN orientation = '{o}' THEN 1 / ln(d) ELSE 0 END), 6) AS {n}" for o, n in zip(("++", "+-", "-+", "--"), ("pp", "pm", "mp", "mm"), strict=True))
    + " FROM d WHERE d > 1 GROUP BY ALL"
)
def a6_clm_score(t):
    return c.clm_scores(t.pairs, t.contigs).select("contig1", "contig2", *[r6(n).alias(n) for n in ("pp", "pm", "mp", "mm")])


@query(f"WITH {DISTANCES} SELECT contig1, contig2, count(*) AS n, round(count(*) / ((x.length + y.length) / 2), 12) AS density FROM d JOIN contigs x ON contig1 = x.contig JOIN contigs y ON contig2 = y.contig WHERE orientation = '++' GROUP BY contig1, contig2, x.length, y.length")
def a7_clm_count(t):
    x, y = t.contigs.select(F.col("contig").alias("contig1"), F.col("length").alias("lx")), t.contigs.select(F.col("contig").alias("contig2"), F.col("length").alias("ly"))
    n = c.distances(t.pairs, t.contigs).where("orientation = '++'").groupBy("contig1", "contig2").agg(F.count("*").alias("n"))
    return n.join(x, "contig1").join(y, "contig2").select("contig1", "contig2", "n", F.round(F.col("n") / ((F.col("lx") + F.col("ly")) / 2), 12).alias("density"))


@query("SELECT read_idx, contig, count(*) AS cnt, max(mapq) AS mapq FROM porec GROUP BY ALL")
def a8_hyperedges_porec(t):
    return c.hyperedges(t.porec)


@query("SELECT contig, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT chrom1 AS contig, 1 AS cnt FROM pairs UNION ALL SELECT chrom2, 1 FROM pairs) GROUP BY contig")
def a9_hyperedges_pairs(t):
    return c.pair_hyperedges(t.pairs).groupBy("contig").agg(F.sum("cnt").alias("cnt"))


ORDERED = "he AS (SELECT read_idx, contig, count(*) AS cnt FROM porec WHERE mapq >= 1 GROUP BY read_idx, contig), n AS (SELECT read_idx, count(*) AS n FROM he GROUP BY read_idx HAVING count(*) BETWEEN 2 AND 50)"
CLIQUE_SUM = "sum(a.cnt * b.cnt * CAST(1.0 AS DOUBLE) / greatest(n.n - 1, 1))"
CLIQUE_FROM = "FROM he a JOIN he b ON a.read_idx = b.read_idx JOIN n ON n.read_idx = a.read_idx WHERE a.contig <= b.contig GROUP BY a.contig, b.contig"


@query(f"WITH {ORDERED} SELECT a.contig AS src, b.contig AS dst, round({CLIQUE_SUM}, 6) AS w {CLIQUE_FROM} HAVING {CLIQUE_SUM} >= 2.0")
def a11_clique_expansion(t):
    return c.clique(incidence(t), 2.0, fewest=2, most=50).select("src", "dst", r6("w").alias("w"))


PRUNED = (
    f"{HE}, p1 AS (SELECT * FROM he WHERE contig IN (SELECT contig FROM he GROUP BY contig HAVING sum(cnt) >= 25)), "
    "p2 AS (SELECT * FROM p1 WHERE read_idx IN (SELECT read_idx FROM p1 GROUP BY read_idx HAVING sum(cnt) >= 2)), pn AS (SELECT read_idx, count(*) AS n FROM p2 GROUP BY read_idx)"
)
PRUNED_CLIQUE = f"{PRUNED}, cq AS (SELECT a.contig AS src, b.contig AS dst, sum(a.cnt * b.cnt * CAST(1.0 AS DOUBLE) / greatest(pn.n - 1, 1)) AS w FROM p2 a JOIN p2 b ON a.read_idx = b.read_idx JOIN pn ON pn.read_idx = a.read_idx WHERE a.contig <= b.contig GROUP BY 1, 2)"


def pruned_clique(t):
    return c.clique(f.min_contacts(incidence(t), 25))


@query(f"WITH {PRUNED_CLIQUE} SELECT src, dst, round(w, 6) AS w FROM cq WHERE w >= 2.0")
def a11_clique_pruned(t):
    return pruned_clique(t).where(r9("w") >= 2.0).select("src", "dst", r6("w").alias("w"))


@query(f"WITH {PRUNED} SELECT p2.read_idx, p2.contig, p2.cnt, n AS k FROM p2 JOIN pn USING (read_idx)")
def a10_incidence(t):
    from pyspark.sql import Window

    return f.min_contacts(incidence(t), 25).withColumn("k", F.count("*").over(Window.partitionBy("read_idx"))).select("read_idx", "contig", "cnt", "k")


@query(f"WITH {HE}, k AS (SELECT read_idx, min(contig) AS src, max(contig) AS dst, arg_min(cnt, contig) AS cnt FROM he GROUP BY read_idx HAVING count(*) = 2) SELECT src, dst, CAST(sum(cnt) AS BIGINT) AS w FROM k GROUP BY src, dst")
def a12_adjacency_pairwise(t):
    return c.adjacency_pairwise(incidence(t))


@query(
    f"WITH {HE}, k AS (SELECT read_idx, sum(cnt) AS k FROM he GROUP BY read_idx HAVING sum(cnt) <= 15) SELECT a.contig AS src, b.contig AS dst, round(sum(a.cnt * b.cnt / CAST(greatest(k - 1, 1) AS DOUBLE)), 6) AS w "
    "FROM he a JOIN he b ON a.read_idx = b.read_idx AND a.contig < b.contig JOIN k ON k.read_idx = a.read_idx GROUP BY 1, 2"
)
def a13_star_projection(t):
    return c.clique(incidence(t), most=15, cis=False, by_sum=True).select("src", "dst", r6("w").alias("w"))


VERTICES = "vx AS (SELECT contig, CAST(length AS DOUBLE) AS a, CAST(sum(cnt) AS DOUBLE) AS d FROM p2 JOIN contigs USING (contig) GROUP BY contig, length), vm AS (SELECT median(a) AS ma, median(d) AS md, sum(d) / sum(a) AS overall FROM vx)"
#: The factor of a contig by method, as SQL.
NW = {
    "geom": "1 / sqrt(a)",
    "density": "1 / a",
    "log": "1 / sqrt(ln(1 + a / ma))",
    "len_deg": "1 / (sqrt(a) * sqrt(d))",
    "vc": "1 / sqrt(d)",
    "svc": "1 / sqrt(d + 0.5 * a * overall)",
    "hybrid": "1 / sqrt((a / ma) * (d / md))",
}


def normalize_sql(method: str, factor: str = "1e6") -> str:
    return f"WITH {PRUNED_CLIQUE}, {VERTICES}, nw AS (SELECT contig, {NW[method]} AS x FROM vx, vm) SELECT src, dst, round(w * p.x * q.x * {factor}, 6) AS w FROM cq JOIN nw p ON src = p.contig JOIN nw q ON dst = q.contig WHERE src <> dst"


def normalized(t, method):
    from ..operators import graph as g

    v = g.vertices(f.min_contacts(incidence(t), 25), t.contigs)
    return g.normalize(pruned_clique(t).where("src <> dst"), v, method)


def normalized_e6(t, method):
    return normalized(t, method).select("src", "dst", r6(F.col("w") * 1e6).alias("w"))


@query(normalize_sql("geom"))
def a14_normalize_geom(t):
    return normalized_e6(t, "geom")


@query(normalize_sql("density"))
def a14_normalize_density(t):
    return normalized_e6(t, "density")


@query(normalize_sql("log", "1"))
def a14_normalize_log(t):
    return normalized(t, "log").select("src", "dst", r6("w").alias("w"))


@query(normalize_sql("len_deg"))
def a14_normalize_len_deg(t):
    return normalized_e6(t, "len_deg")


@query(normalize_sql("vc", "1"))
def a14_normalize_vc(t):
    return normalized(t, "vc").select("src", "dst", r6("w").alias("w"))


@query(normalize_sql("svc", "1"))
def a14_normalize_svc(t):
    return normalized(t, "svc").select("src", "dst", r6("w").alias("w"))


@query(normalize_sql("hybrid", "1"))
def a14_normalize_hybrid(t):
    return normalized(t, "hybrid").select("src", "dst", r6("w").alias("w"))


@query(f"WITH {PRUNED_CLIQUE} SELECT src, dst, round(w * (CASE WHEN src % 7 = 0 THEN 0.5 ELSE 1 END) * (CASE WHEN dst % 7 = 0 THEN 0.5 ELSE 1 END), 6) AS w FROM cq")
def a15_normalize_adjacency(t):
    from ..operators.graph import scale

    weights = t.contigs.select("contig", F.when(F.col("contig") % 7 == 0, 0.5).otherwise(1.0).alias("nw"))
    return scale(pruned_clique(t), weights).select("src", "dst", r6("w").alias("w"))


def reweight_sql(new: str) -> str:
    return (
        f"WITH {PRUNED_CLIQUE}, bw AS (SELECT src, dst, w FROM cq UNION ALL SELECT dst, src, w FROM cq WHERE src <> dst), st AS (SELECT avg(w) AS mean, quantile_cont(w, 0.9) AS p90 FROM bw), rs AS (SELECT src, sum(w) AS r FROM bw GROUP BY src), "
        "pt AS (SELECT c1, c2, CASE WHEN similarity >= 0.8 THEN 0 ELSE 1 END AS type FROM alleles), e AS (SELECT coalesce(src, c1) AS src, coalesce(dst, c2) AS dst, coalesce(w, 0) AS w, type FROM cq FULL JOIN pt ON src = c1 AND dst = c2), "
        f"x AS (SELECT e.src, e.dst, CASE WHEN type = 0 THEN {new} WHEN type = 1 THEN w * 0.25 ELSE w END AS v FROM e LEFT JOIN (SELECT src, r AS r1 FROM rs) p ON p.src = e.src LEFT JOIN (SELECT src, r AS r2 FROM rs) q ON q.src = e.dst, st) SELECT src, dst, round(v, 6) AS w FROM x WHERE v <> 0"
    )


def reweighted(t, allelic):
    from ..operators import graph as g

    prune = t.alleles.select("c1", "c2", F.when(F.col("similarity") >= 0.8, 0).otherwise(1).alias("type"))
    return g.reweight(pruned_clique(t), prune, allelic=allelic, weak=0.25).select("src", "dst", r6("w").alias("w"))


@query(reweight_sql("0"))
def a16_reweight_zero(t):
    return reweighted(t, 0.0)


@query(reweight_sql("w * -0.5"))
def a16_reweight_negative(t):
    return reweighted(t, -0.5)


@query(reweight_sql("(w + p90 * 0.5) * 3"))
def a16_reweight_factor(t):
    return reweighted(t, 3.0)


@query(reweight_sql("w * 2 + mean * 0.5"))
def a16_reweight_power(t):
    return reweighted(t, "power")


@query(reweight_sql("greatest(w * 10, mean * 2)"))
def a16_reweight_maximum(t):
    return reweighted(t, "maximum")


@query(reweight_sql("pow(w, 1.2) * 2"))
def a16_reweight_dynamic(t):
    return reweighted(t, "dynamic")


@query(reweight_sql("sqrt(coalesce(r1, 1) * coalesce(r2, 1)) * 0.05"))
def a16_reweight_auto(t):
    return reweighted(t, "auto")


@query(f"WITH {PRUNED_CLIQUE}, s AS (SELECT src, dst, w FROM cq UNION ALL SELECT dst, src, w FROM cq WHERE src <> dst), r AS (SELECT src, sum(w) AS r FROM s GROUP BY src) SELECT s.src, s.dst, round(s.w / (a.r * b.r), 12) AS w FROM s JOIN r a ON s.src = a.src JOIN r b ON s.dst = b.src")
def a17_vc_balance(t):
    from ..operators.graph import vc_balance

    return vc_balance(pruned_clique(t)).select("src", "dst", F.round("w", 12).alias("w"))


def balancing_sql(rounds: int) -> str:
    """So many rounds of balancing, one after the other: bias over the root of bias times weighted row sum."""
    steps = ["sy AS (SELECT src, dst, w FROM cq UNION ALL SELECT dst, src, w FROM cq WHERE src <> dst)", "b0 AS (SELECT DISTINCT src AS contig, CAST(1 AS DOUBLE) AS b FROM sy)"]
    for i in range(rounds):
        steps.append(f"b{i + 1} AS (SELECT x.contig, any_value(x.b) / sqrt(sum(sy.w * y.b) * any_value(x.b)) AS b FROM sy JOIN b{i} x ON sy.src = x.contig JOIN b{i} y ON sy.dst = y.contig GROUP BY x.contig)")
    return ", ".join(steps) + f" SELECT sy.src, sy.dst, round(sy.w * x.b * y.b, 6) AS w FROM sy JOIN b{rounds} x ON sy.src = x.contig JOIN b{rounds} y ON sy.dst = y.contig"


@query(f"WITH {PRUNED_CLIQUE}, {balancing_sql(4)}")
def a17_ice_rounds(t):
    from ..operators.graph import ice

    return ice(pruned_clique(t), tolerance=0.0, rounds=4)


@query(None)
def a17_ice_balance(t):
    from ..operators.graph import ice

    return ice(pruned_clique(t), tolerance=1e-5)


@query(
    "WITH cis AS (SELECT chrom1 AS contig, (least(pos1, pos2) - 1) // 5000 AS a, (greatest(pos1, pos2) - 1) // 5000 AS b FROM pairs WHERE chrom1 = chrom2), g AS (SELECT contig, unnest(generate_series(0, (length - 1) // 5000)) AS w FROM contigs) "
    "SELECT g.contig, g.w, count(cis.a) AS n FROM g LEFT JOIN cis ON cis.contig = g.contig AND g.w BETWEEN a AND b GROUP BY ALL"
)
def a20_cis_coverage(t):
    return c.cis_coverage(t.pairs, t.contigs, 5000)


@query(f"WITH {PIXELS} SELECT bin_id, sum(n) AS n FROM (SELECT bin1_id AS bin_id, CASE WHEN bin1_id = bin2_id THEN n / 2 ELSE n END AS n FROM px UNION ALL SELECT bin2_id, n FROM px WHERE bin1_id <> bin2_id) GROUP BY bin_id")
def a21_matrix_depth(t):
    return c.row_sums(pixels(t))


@query(
    f"WITH {PIXELS}, {BINMAP} SELECT bin_id, CAST(sum(n) AS DOUBLE) AS n FROM (SELECT bin1_id AS bin_id, n FROM px JOIN bm a ON bin1_id = a.bin_id JOIN bm b ON bin2_id = b.bin_id WHERE a.target <> b.target UNION ALL "
    "SELECT bin2_id, n FROM px JOIN bm a ON bin1_id = a.bin_id JOIN bm b ON bin2_id = b.bin_id WHERE a.target <> b.target) GROUP BY bin_id"
)
def a21_matrix_depth_trans(t):
    return c.row_sums(pixels(t), bin_map(t).withColumnRenamed("target", "chrom"))


@query(f"WITH {PIXELS}, {BINMAP} SELECT least(a.target, b.target) AS target1, greatest(a.target, b.target) AS target2, CAST(sum(n) AS BIGINT) AS n FROM px JOIN bm a ON bin1_id = a.bin_id JOIN bm b ON bin2_id = b.bin_id GROUP BY 1, 2 HAVING sum(n) >= 3 AND target1 <> target2")
def a22_merge_matrix(t):
    return c.merge_bins(pixels(t), bin_map(t), 3, cis=False)


@query(f"WITH {PIXELS} SELECT bin1_id // 4 AS bin1_id, bin2_id // 4 AS bin2_id, CAST(sum(n) AS BIGINT) AS n FROM px GROUP BY 1, 2")
def a23_coarsen(t):
    return pixels(t).groupBy(F.floor(F.col("bin1_id") / 4).alias("bin1_id"), F.floor(F.col("bin2_id") / 4).alias("bin2_id")).agg(F.sum("n").alias("n"))


LAYOUT = (
    "lay AS (SELECT contig, grp, pos, strand, CAST(sum(b) OVER (PARTITION BY grp ORDER BY pos) - b AS BIGINT) AS first, b FROM (SELECT t.*, bins AS b FROM tour_test t JOIN o USING (contig))), "
    "go AS (SELECT grp, CAST(coalesce(sum(nb) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS goff FROM (SELECT grp, sum(b) AS nb FROM lay GROUP BY grp)), "
    "nm AS (SELECT off + k AS bin_id, goff + first + CASE WHEN strand = '+' THEN k ELSE b - 1 - k END AS target FROM (SELECT *, unnest(generate_series(0, bins - 1)) AS k FROM o) JOIN lay USING (contig) JOIN go USING (grp))"
)


@query(f"WITH {PIXELS}, {LAYOUT} SELECT least(a.target, b.target) AS target1, greatest(a.target, b.target) AS target2, CAST(sum(n) AS BIGINT) AS n FROM px JOIN nm a ON bin1_id = a.bin_id JOIN nm b ON bin2_id = b.bin_id GROUP BY 1, 2")
def a24_adjust_matrix(t):
    from ..operators.graph import layout_bins

    return c.merge_bins(pixels(t), layout_bins(t.tour_test, c.bin_offsets(t.contigs, 10_000)))


@query(f"WITH {PIXELS}, {BINMAP}, g AS (SELECT bin_id, grp FROM bm JOIN membership ON target = contig) SELECT least(a.grp, b.grp) AS target1, greatest(a.grp, b.grp) AS target2, CAST(sum(n) AS BIGINT) AS n FROM px JOIN g a ON bin1_id = a.bin_id JOIN g b ON bin2_id = b.bin_id WHERE a.grp <> b.grp GROUP BY 1, 2")
def a25_chrom_matrix(t):
    g = bin_map(t).join(t.membership.select(F.col("contig").alias("target"), "grp"), "target").select("bin_id", F.col("grp").alias("target"))
    return c.merge_bins(pixels(t), g, cis=False)


@query("SELECT contig, n, round(n / length * 1e4, 6) AS density FROM (SELECT contig, CAST(sum(n) AS BIGINT) AS n FROM (SELECT contig1 AS contig, n FROM contacts WHERE contig1 <> contig2 UNION ALL SELECT contig2, n FROM contacts WHERE contig1 <> contig2) GROUP BY contig) JOIN contigs USING (contig)")
def a26_contig_contacts(t):
    trans = t.contacts.where("contig1 <> contig2").select(F.explode(F.array("contig1", "contig2")).alias("contig"), "n").groupBy("contig").agg(F.sum("n").alias("n"))
    return trans.join(t.contigs, "contig").select("contig", "n", r6(F.col("n") / F.col("length") * 1e4).alias("density"))


@query("SELECT contig1, contig2, round(n * 1000 / CAST((10 + contig1 % 50) * (10 + contig2 % 50) AS DOUBLE), 6) AS score FROM contacts WHERE contig1 <> contig2")
def a27_contact_by_sites(t):
    sites = lambda k: F.lit(10) + F.col(k) % 50
    return t.contacts.where("contig1 <> contig2").select("contig1", "contig2", r6(F.col("n") * 1000 / (sites("contig1") * sites("contig2"))).alias("score"))


@query(
    f"WITH q AS (SELECT read_idx, NOT {LOW} AS ok FROM porec), k AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY read_idx) AS k FROM q), s AS (SELECT read_idx, ok AND k <> 1 AS pass, CASE WHEN NOT ok THEN 'low_mq' WHEN k = 1 THEN 'singleton' ELSE 'pass' END AS reason FROM k) "
    "SELECT count(*) AS total, count(*) FILTER (pass) AS n_pass, count(*) FILTER (reason = 'low_mq') AS n_low_mq, count(*) FILTER (reason = 'singleton') AS n_singleton, count(DISTINCT read_idx) AS reads, count(DISTINCT read_idx) FILTER (pass) AS reads_pass FROM s"
)
def a28_alignment_stats(t):
    return tb.alignment_stats(f.singleton_flag(f.low_quality_flag(t.porec, 5, 0.82, 120)))


@query(
    "WITH n AS (SELECT count(*) AS n FROM porec GROUP BY read_idx HAVING count(*) >= 2), h AS (SELECT CASE WHEN n <= 2 THEN '2' WHEN n <= 3 THEN '3' WHEN n <= 4 THEN '4' WHEN n <= 6 THEN '5-6' WHEN n <= 11 THEN '7-11' WHEN n <= 21 THEN '12-21' WHEN n <= 50 THEN '22-50' ELSE '>50' END AS order_class, count(*) AS reads FROM n GROUP BY 1) "
    "SELECT order_class, reads, round(reads * 100 / CAST(sum(reads) OVER () AS DOUBLE), 6) AS percent FROM h"
)
def a29_order_histogram(t):
    return tb.order_histogram(t.porec)


@query("SELECT count(*) AS reads, round(avg(n), 6) AS mean_order, median(n) AS median_order, CAST(sum(bases) AS BIGINT) AS bases, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS pairwise FROM (SELECT count(*) AS n, sum(end_pos - start_pos) AS bases FROM porec GROUP BY read_idx)")
def a30_porec_stats(t):
    return tb.read_stats(t.porec)


@query(f"WITH {DEPTH} SELECT chrom, median(n) AS median, round(avg(CASE WHEN n > 300 THEN 1 ELSE 0 END), 6) AS high, round(median(n) / 200, 6) AS copies FROM depth GROUP BY chrom")
def a31_copy_numbers(t):
    return tb.copy_numbers(depth(t), 200.0).select("chrom", "median", r6("high").alias("high"), r6("copies").alias("copies"))


@query(f"WITH {DEPTH} SELECT chrom, median(n) AS depth, round(median(n) / 200, 6) AS copies FROM depth GROUP BY chrom HAVING median(n) >= 210")
def a32_collapsed(t):
    return tb.copy_numbers(depth(t), 200.0).where("median >= 210").select("chrom", F.col("median").alias("depth"), r6("copies").alias("copies"))


@query(f"WITH {DEPTH}, bed AS (SELECT chrom, start_pos, end_pos FROM depth WHERE n BETWEEN 100 AND 230), {island_sql('bed')} SELECT * FROM islands")
def a34_high_confidence(t):
    return tb.high_confidence(depth(t), 100, 230)


@query(f"WITH {DEPTH} SELECT n, count(*) AS bins FROM depth WHERE n > 0 GROUP BY n ORDER BY bins DESC, n LIMIT 1")
def a35_depth_mode(t):
    return tb.depth_mode(depth(t))


@query(
    f"WITH {DEPTH}, k AS (SELECT CASE WHEN n < 20 THEN 'error' WHEN n < 100 THEN 'duplicated' WHEN n < 300 THEN 'haploid' ELSE 'collapsed' END AS class, count(*) AS windows, CAST(sum(end_pos - start_pos) AS BIGINT) AS bases FROM depth GROUP BY 1) "
    "SELECT class, windows, bases, round(bases / CAST(sum(bases) OVER () AS DOUBLE), 6) AS share FROM k"
)
def a36_copy_classes(t):
    return tb.copy_classes(depth(t), 200.0)


@query(
    f"WITH {DEPTH}, k AS (SELECT chrom, CASE WHEN n < 50 THEN 'junk' WHEN n < 150 THEN 'duplicated' WHEN n < 300 THEN 'haploid' ELSE 'collapsed' END AS class, CAST(sum(end_pos - start_pos) AS BIGINT) AS bases FROM depth GROUP BY 1, 2) "
    "SELECT chrom, class, bases FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY bases DESC, class) AS rn FROM k) WHERE rn = 1"
)
def a36_dominant_class(t):
    return tb.dominant_class(depth(t), 200.0)


@query("SELECT count(*) AS contigs, CAST(sum(length) AS BIGINT) AS total, min(length) AS shortest, max(length) AS longest, round(avg(length), 6) AS mean, median(length) AS median FROM contigs")
def a37_assembly_stats(t):
    return tb.assembly_stats(t.contigs)


@query(
    "WITH r AS (SELECT grp, length, sum(length) OVER (PARTITION BY grp ORDER BY length DESC, contig ROWS UNBOUNDED PRECEDING) AS run, sum(length) OVER (PARTITION BY grp) AS total FROM membership JOIN contigs USING (contig)) "
    "SELECT grp, count(*) AS contigs, CAST(max(total) AS BIGINT) AS bases, max(CASE WHEN run >= total // 2 THEN length END) AS n50 FROM r GROUP BY grp"
)
def a37_group_stats(t):
    return tb.group_stats(t.membership, t.contigs)


@query("SELECT grp, count(*) AS n, string_agg(CAST(contig AS VARCHAR), ' ' ORDER BY contig) AS contigs FROM membership GROUP BY grp")
def a38_cluster_lists(t):
    return tb.clusters(t.membership)


@query("SELECT a.contig AS c1, b.contig AS c2, count(*) AS shared FROM (SELECT DISTINCT read_name, chrom AS contig FROM paf) a JOIN (SELECT DISTINCT read_name, chrom AS contig FROM paf) b ON a.read_name = b.read_name AND a.contig < b.contig GROUP BY 1, 2")
def a39_shared_counts(t):
    d = t.paf.select("read_name", F.col("chrom").alias("contig")).distinct()
    return d.select("read_name", F.col("contig").alias("c1")).join(d.select("read_name", F.col("contig").alias("c2")), "read_name").where("c1 < c2").groupBy("c1", "c2").agg(F.count("*").alias("shared"))


PIECES = "ap AS (SELECT c1 // 2 AS c1, c2 // 2 AS c2, mz1, mz2, mz_shared, similarity, strand FROM alleles)"


@query(
    f"WITH {PIECES}, s AS (SELECT c1, c2, strand, sum(mz_shared) AS v FROM ap GROUP BY ALL), b AS (SELECT c1, c2, arg_max(strand, v * 2 + CASE WHEN strand > 0 THEN 1 ELSE 0 END) AS strand FROM s GROUP BY c1, c2) "
    "SELECT c1, c2, CAST(sum(mz1) AS BIGINT) AS mz1, CAST(sum(mz2) AS BIGINT) AS mz2, CAST(sum(mz_shared) AS BIGINT) AS mz_shared, round(avg(similarity), 6) AS mean_similarity, round(max(similarity), 6) AS max_similarity, any_value(b.strand) AS strand FROM ap JOIN b USING (c1, c2) GROUP BY c1, c2"
)
def a40_merge_alleles(t):
    return tb.merged_alleles(t.alleles.withColumn("c1", F.floor(F.col("c1") / 2)).withColumn("c2", F.floor(F.col("c2") / 2)))


@query(
    "SELECT read_name, chrom, count(*) AS k, CAST(sum(matches) AS BIGINT) AS matches, max(matches) AS best, min(start_pos) AS start_pos, max(end_pos) AS end_pos, round(1 - avg(dv), 6) AS identity, CASE WHEN sum(CASE WHEN strand = '+' THEN matches ELSE -matches END) >= 0 THEN '+' ELSE '-' END AS strand FROM paf GROUP BY read_name, chrom"
)
def a41_merge_alignments(t):
    return tb.merged_alignments(t.paf)


@query(f"WITH {FRAGMENTS}, {island_sql('fr')} SELECT chrom, CAST(sum(end_pos - start_pos) AS BIGINT) AS covered, round(sum(end_pos - start_pos) / CAST(any_value(length) AS DOUBLE), 6) AS fraction FROM islands JOIN contigs ON chrom = contig GROUP BY chrom")
def a42_homologous_coverage(t):
    return iv.covered(fragments(t)).join(t.contigs.select(F.col("contig").alias("chrom"), "length"), "chrom").select("chrom", "covered", r6(F.col("covered") / F.col("length")).alias("fraction"))


@query("SELECT contig, round(least(100, 100 * covered / CAST(length AS DOUBLE)), 6) AS percent FROM (SELECT contig, sum(o) AS covered FROM (SELECT src AS contig, max(overlap) AS o FROM gfa_links GROUP BY src UNION ALL SELECT dst, max(overlap) FROM gfa_links GROUP BY dst) GROUP BY contig) JOIN contigs USING (contig)")
def a43_overlap_percent(t):
    one = t.gfa_links.groupBy(F.col("src").alias("contig")).agg(F.max("overlap").alias("o")).unionAll(t.gfa_links.groupBy(F.col("dst").alias("contig")).agg(F.max("overlap").alias("o")))
    return one.groupBy("contig").agg(F.sum("o").alias("covered")).join(t.contigs, "contig").select("contig", r6(F.least(F.lit(100.0), 100 * F.col("covered") / F.col("length"))).alias("percent"))


MEMBERS = "m AS (SELECT contig, grp FROM membership), gs AS (SELECT grp, count(*) AS k FROM membership GROUP BY grp)"


@query(
    f"WITH {PRUNED_CLIQUE}, {MEMBERS} SELECT least(a.grp, b.grp) AS grp1, greatest(a.grp, b.grp) AS grp2, round(sum(w), 6) AS w, round(sum(w) / (any_value(x.k) * any_value(y.k)), 6) AS mean_w FROM cq JOIN m a ON src = a.contig JOIN m b ON dst = b.contig JOIN gs x ON x.grp = least(a.grp, b.grp) JOIN gs y ON y.grp = greatest(a.grp, b.grp) GROUP BY 1, 2"
)
def a44_block_sums(t):
    return tb.block_sums(pruned_clique(t), t.membership.select("contig", "grp")).select("grp1", "grp2", r6("w").alias("w"), r6("mean_w").alias("mean_w"))


SCORES = "sc AS (SELECT contig, grp, sum(w) AS score FROM (SELECT src AS contig, dst AS other, w FROM cq WHERE src <> dst UNION ALL SELECT dst, src, w FROM cq WHERE src <> dst) s JOIN (SELECT contig AS other, grp FROM membership) USING (other) GROUP BY contig, grp)"
BEST = "rk AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY round(score, 6) DESC, grp) AS rn FROM sc), bt AS (SELECT contig, max(CASE WHEN rn = 1 THEN grp END) AS best_grp, max(CASE WHEN rn = 1 THEN score END) AS best, coalesce(max(CASE WHEN rn = 2 THEN score END), 0) AS second, sum(score) AS total FROM rk GROUP BY contig)"


def best_two(t):
    return tb.best_two_groups(tb.group_scores(pruned_clique(t), t.membership.select("contig", "grp")))


@query(f"WITH {PRUNED_CLIQUE}, {SCORES}, {BEST} SELECT contig, best_grp, round(best, 6) AS best, round(second, 6) AS second, round(total, 6) AS total, round(best / total, 6) AS specificity FROM bt")
def a45_contig_group_scores(t):
    return best_two(t).select("contig", "best_grp", *[r6(x).alias(x) for x in ("best", "second", "total", "specificity")])


@query(
    "WITH g AS (SELECT contig, grp FROM tour_test), b AS (SELECT unnest([c1, c2]) AS contig FROM alleles JOIN g x ON c1 = x.contig JOIN g y ON c2 = y.contig WHERE x.grp = y.grp) "
    "SELECT CAST(sum(CASE WHEN contig IN (SELECT contig FROM b) THEN length ELSE 0 END) AS BIGINT) AS error_bases, CAST(sum(length) AS BIGINT) AS bases, round(sum(CASE WHEN contig IN (SELECT contig FROM b) THEN length ELSE 0 END) / CAST(sum(length) AS DOUBLE), 6) AS rate FROM g JOIN contigs USING (contig)"
)
def a46_allelic_error(t):
    return tb.allelic_error(t.alleles, t.tour_test.select("contig", "grp"), t.contigs)


@query("SELECT contig, CAST(len(regexp_extract_all(seq, 'gatc')) AS BIGINT) AS sites, CAST(length(seq) AS BIGINT) AS length FROM seqs")
def a47_site_counts(t):
    return tb.motif_counts(t.seqs, "gatc")


@query(
    "WITH p AS (SELECT contig, length(seq) AS n, string_split(seq, 'gatc') AS parts FROM seqs), x AS (SELECT contig, n, len(parts) AS k, unnest(generate_series(0, len(parts) - 1)) AS i, parts FROM p), "
    "e AS (SELECT contig, CAST(i AS INTEGER) AS i, CAST(CASE WHEN i = k - 1 THEN n ELSE list_sum(list_transform(parts[1:i + 1], lambda q: length(q))) + i * 4 + 2 END AS BIGINT) AS end_pos FROM x) "
    "SELECT contig, i, coalesce(lag(end_pos) OVER (PARTITION BY contig ORDER BY i), 0) AS start_pos, end_pos FROM e"
)
def a47_digest(t):
    return tb.digest(t.seqs, "gatc").withColumn("i", F.col("i").cast("int"))


@query("SELECT contig, len(regexp_extract_all(seq[1:2000], 'acg')) > 5 AS left_end, len(regexp_extract_all(right(seq, 2000), 'cgt')) > 5 AS right_end FROM seqs")
def a50_telomeres(t):
    return tb.telomeres(t.seqs, "acg", 5)


@query("WITH s AS (SELECT max(length) AS longest, quantile_cont(length, 0.95) AS p95 FROM contigs) SELECT longest, p95, longest > 1.02 * p95 AND longest > 20000 AS split, CASE WHEN longest > 1.02 * p95 AND longest > 20000 THEN CAST(ceil(p95 / 1e6) * 1e6 AS BIGINT) END AS split_length FROM s")
def a51_split_rule(t):
    return tb.split_rule(t.contigs, 1.02, 20_000)


# --- windows -----------------------------------------------------------------------------------------------------------------------------------


@query("SELECT p.read_idx, p.frag, o.n AS n_contigs FROM porec p JOIN (SELECT read_idx, count(DISTINCT contig) AS n FROM porec GROUP BY read_idx) o USING (read_idx)")
def w1_nunique_over_read(t):
    from pyspark.sql import Window

    w = Window.partitionBy("read_idx")
    fresh = F.when(F.lag("contig").over(w.orderBy("contig", "frag")) == F.col("contig"), 0).otherwise(1)
    return t.porec.withColumn("fresh", fresh).select("read_idx", "frag", F.sum("fresh").over(w).cast("long").alias("n_contigs"))


@query(
    "WITH r AS (SELECT length, row_number() OVER (ORDER BY length DESC, contig) AS rk, sum(length) OVER (ORDER BY length DESC, contig ROWS UNBOUNDED PRECEDING) AS run, sum(length) OVER () AS total FROM contigs), x AS (SELECT unnest([10, 50, 90]) AS x) "
    "SELECT x, max(length) AS nx, min(rk) AS lx FROM r, x WHERE run >= floor(total * x / 100) GROUP BY x"
)
def w2_nx_lx(t):
    return tb.nx(t.contigs)


@query(f"WITH {OFFSETS} SELECT contig, length, bins, off AS \"offset\" FROM o")
def w3_bin_offsets(t):
    return c.bin_offsets(t.contigs, 10_000)


@query(f"WITH {DEPTH}, l AS (SELECT chrom, n - lag(n) OVER (PARTITION BY chrom ORDER BY start_pos) AS d FROM depth) SELECT chrom, round(sqrt(avg(d * d)), 6) AS rmse FROM l WHERE d IS NOT NULL GROUP BY chrom")
def w4_lag_rmse(t):
    from pyspark.sql import Window

    d = F.col("n") - F.lag("n").over(Window.partitionBy("chrom").orderBy("start_pos"))
    return depth(t).withColumn("d", d).where("d is not null").groupBy("chrom").agg(r6(F.sqrt(F.avg(F.col("d") * F.col("d")))).alias("rmse"))


@query(f"WITH {DEPTH} SELECT chrom, start_pos, CAST(sum(n) OVER (PARTITION BY chrom ORDER BY start_pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM depth")
def w5_running_sum(t):
    from pyspark.sql import Window

    w = Window.partitionBy("chrom").orderBy("start_pos").rowsBetween(Window.unboundedPreceding, 0)
    return depth(t).select("chrom", "start_pos", F.sum("n").over(w).alias("run"))


@query(f"WITH {DEPTH}, r AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start_pos) AS a, row_number() OVER (PARTITION BY chrom ORDER BY start_pos DESC) AS b FROM depth) SELECT chrom, start_pos, n FROM r WHERE a > 1 AND b > 2")
def w6_trim_windows(t):
    from pyspark.sql import Window

    w = Window.partitionBy("chrom")
    return depth(t).withColumn("a", F.row_number().over(w.orderBy("start_pos"))).withColumn("b", F.row_number().over(w.orderBy(F.desc("start_pos")))).where("a > 1 AND b > 2").select("chrom", "start_pos", "n")


ALLELES_BOTH = "ab AS (SELECT c1, c2, mz_shared, similarity FROM alleles UNION ALL SELECT c2, c1, mz_shared, similarity FROM alleles)"


@query(f"WITH {ALLELES_BOTH} SELECT c1, c2, mz_shared, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY c1 ORDER BY mz_shared DESC, similarity DESC, c2) AS rn FROM ab) WHERE rn <= 5")
def w7_top_per_key(t):
    from pyspark.sql import Window

    both = t.alleles.select("c1", "c2", "mz_shared", "similarity").unionAll(t.alleles.select("c2", "c1", "mz_shared", "similarity"))
    return both.withColumn("rn", F.row_number().over(Window.partitionBy("c1").orderBy(F.desc("mz_shared"), F.desc("similarity"), "c2"))).where("rn <= 5").select("c1", "c2", "mz_shared", "rn")


@query("SELECT read_name, chrom, start_pos, matches FROM (SELECT *, row_number() OVER (PARTITION BY read_name ORDER BY matches DESC, chrom, start_pos, line_id) AS rn FROM paf) WHERE rn = 1")
def w8_best_alignment(t):
    return tb.best_alignment(t.paf).select("read_name", "chrom", "start_pos", "matches")


@query(
    "WITH j AS (SELECT a.grp, a.pos AS x, b.pos AS y FROM tour_truth a JOIN tour_test b USING (contig, grp)), r AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY x) AS rx, rank() OVER (PARTITION BY grp ORDER BY y) AS ry FROM j) "
    "SELECT grp, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY grp HAVING count(*) > 1"
)
def w9_rank_correlation(t):
    from pyspark.sql import Window

    j = t.tour_truth.select("contig", "grp", F.col("pos").alias("x")).join(t.tour_test.select("contig", "grp", F.col("pos").alias("y")), ["contig", "grp"])
    w = Window.partitionBy("grp")
    r = j.withColumn("rx", F.rank().over(w.orderBy("x"))).withColumn("ry", F.rank().over(w.orderBy("y")))
    return r.groupBy("grp").agg(F.count("*").alias("n"), r6(F.corr("rx", "ry")).alias("rho")).where("n > 1")


@query("SELECT grp, contig AS a, strand AS a_strand, b, b_strand FROM (SELECT *, lead(contig) OVER w AS b, lead(strand) OVER w AS b_strand FROM tour_test WINDOW w AS (PARTITION BY grp ORDER BY pos)) WHERE b IS NOT NULL")
def w11_adjacent(t):
    return tb.edges_lead(t.tour_test)


@query(f"WITH {FRAGMENTS}, {island_sql('fr')} SELECT chrom, count(*) AS islands, max(end_pos - start_pos) AS longest FROM islands GROUP BY chrom")
def w12_gaps_islands(t):
    return iv.merge(fragments(t)).groupBy("chrom").agg(F.count("*").alias("islands"), F.max(F.col("end_pos") - F.col("start_pos")).alias("longest"))


@query("SELECT read_idx, contig, frag, CASE WHEN rn = 1 THEN CAST(contig AS VARCHAR) ELSE contig || '_d' || rn END AS name FROM (SELECT *, row_number() OVER (PARTITION BY read_idx, contig ORDER BY frag) AS rn FROM porec)")
def w14_duplicate_names(t):
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("read_idx", "contig").orderBy("frag"))
    name = F.when(F.col("rn") == 1, F.col("contig").cast("string")).otherwise(F.concat(F.col("contig").cast("string"), F.lit("_d"), F.col("rn").cast("string")))
    return t.porec.withColumn("rn", rn).select("read_idx", "contig", "frag", name.alias("name"))


@query(f"WITH {DEPTH} SELECT round(quantile_cont(n, 0.1), 6) AS p10, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.75), 6) AS p75, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.999), 6) AS p999 FROM depth")
def w15_percentiles(t):
    return depth(t).agg(*[r6(F.percentile("n", F.lit(q))).alias(n) for n, q in (("p10", 0.1), ("p25", 0.25), ("p75", 0.75), ("p90", 0.9), ("p999", 0.999))])
