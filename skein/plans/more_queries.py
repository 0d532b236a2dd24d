"""Queries of layouts, chains, assembly graphs, signals and reports."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chains as ch
from ..operators import contacts as c
from ..operators import graph as g
from ..operators import layouts as ly
from ..operators import scoring as s
from ..operators import signals as sg
from ..operators import tables as tb
from ..operators.common import collected, r6, shared_folder
from ..sources import sinks, text
from .aggregate_queries import BINMAP, DEPTH, PIXELS, PRUNED_CLIQUE, bin_map, depth, normalized, pixels, pruned_clique
from .filter_queries import HE, incidence
from .graph_queries import AGP, AGREE, ALIAS, PR, adjacency_sql
from .registry import query, troughs_sql

def scratch(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {PIXELS} SELECT bin1_id, bin2_id, n FROM px UNION ALL SELECT bin2_id, bin1_id, n FROM px WHERE bin1_id <> bin2_id")
def s18_scan_matrix(t):
    path = scratch(t, "matrix")
    sinks.write_matrix(bin_map(t).withColumnRenamed("target", "chrom"), pixels(t), path)
    return c.symmetric(t.spark.read.parquet(f"{path}/pixels"))


@query("SELECT chrom1, chrom2, mapq, count(*) AS n FROM pairs GROUP BY ALL")
def k1_write_store(t):
    path = scratch(t, "store")
    sinks.write_pairs_store(t.pairs, path, 20_000)
    return text.read_pairs_store(t.spark, path).groupBy("chrom1", "chrom2", "mapq").agg(F.count("*").alias("n"))


@query(f"WITH {DEPTH} SELECT CAST(chrom AS VARCHAR) AS chrom, start_pos, end_pos, CAST(n AS DOUBLE) AS n FROM depth")
def k3_write_depth(t):
    path = scratch(t, "depth")
    sinks.write_lines(sinks.depth_lines(depth(t)), path)
    return text.read(t.spark, path, text.depth)


@query(f"WITH {HE} SELECT * FROM he")
def k6_write_hypergraph(t):
    path = scratch(t, "hypergraph")
    incidence(t).write.parquet(path)
    return t.spark.read.parquet(path)


@query("SELECT read_idx, frag, contig, start_pos, end_pos, mapq, strand FROM porec")
def k7_write_porec(t):
    path = scratch(t, "porec")
    t.porec.select("read_idx", "frag", "contig", "start_pos", "end_pos", "mapq", "strand").write.parquet(path)
    return t.spark.read.parquet(path)


@query(f"WITH {PIXELS} SELECT bin2_id - bin1_id AS distance, CAST(sum(n) AS BIGINT) AS n, count(*) AS pixels FROM px GROUP BY 1")
def k13_distance_decay(t):
    return pixels(t).groupBy((F.col("bin2_id") - F.col("bin1_id")).alias("distance")).agg(F.sum("n").alias("n"), F.count("*").alias("pixels"))


REMAP = "rm AS (SELECT bin_id, bin_id // 3 AS target FROM bm UNION ALL SELECT bin_id, 100000 + bin_id // 5 FROM bm WHERE bin_id % 10 = 0)"


@query(f"WITH {PIXELS}, {BINMAP}, {REMAP} SELECT least(a.target, b.target) AS target1, greatest(a.target, b.target) AS target2, CAST(sum(n) AS BIGINT) AS n FROM px JOIN rm a ON bin1_id = a.bin_id JOIN rm b ON bin2_id = b.bin_id GROUP BY 1, 2")
def j13_pixel_remap(t):
    b = bin_map(t).select("bin_id")
    m = b.select("bin_id", F.floor(F.col("bin_id") / 3).alias("target")).unionByName(b.where("bin_id % 10 = 0").select("bin_id", (F.floor(F.col("bin_id") / 5) + 100_000).alias("target")))
    return c.merge_bins(pixels(t), m)


def chrom_balance_sql(rounds: int) -> str:
    """So many rounds of balancing each chromosome's own matrix, one after the other, weights brought to a median of 1 each time."""
    steps = [
        "ci AS (SELECT a.target AS chrom, bin1_id, bin2_id, n FROM px JOIN bm a ON bin1_id = a.bin_id JOIN bm b ON bin2_id = b.bin_id WHERE a.target = b.target)",
        "sy AS (SELECT chrom, bin1_id AS i, bin2_id AS j, n FROM ci UNION ALL SELECT chrom, bin2_id, bin1_id, n FROM ci WHERE bin1_id <> bin2_id)",
        "rs AS (SELECT chrom, i, sum(n) AS r FROM sy GROUP BY ALL), ok AS (SELECT chrom, i FROM rs WHERE r <= (SELECT quantile_cont(r, 0.999) FROM rs)), w0 AS (SELECT chrom, i, CAST(1 AS DOUBLE) AS w FROM ok)",
    ]
    for k in range(rounds):
        steps.append(f"r{k} AS (SELECT x.chrom, x.i, any_value(x.w) AS w, coalesce(any_value(x.w) * sum(sy.n * y.w), 0) AS r FROM w{k} x LEFT JOIN sy ON sy.i = x.i LEFT JOIN w{k} y ON y.i = sy.j GROUP BY x.chrom, x.i)")
        steps.append(f"v{k} AS (SELECT chrom, i, w / sqrt(CASE WHEN r > 0 THEN r ELSE 1 END) AS w FROM r{k}), w{k + 1} AS (SELECT chrom, i, w / median(w) OVER (PARTITION BY chrom) AS w FROM v{k})")
    return ", ".join(steps) + f" SELECT bm.bin_id, round(w, 6) AS weight FROM bm LEFT JOIN w{rounds} ON bm.bin_id = w{rounds}.i"


@query(f"WITH {PIXELS}, {BINMAP}, {chrom_balance_sql(3)}")
def a18_balance_rounds(t):
    return ch.balanced(pixels(t), bin_map(t).withColumnRenamed("target", "chrom"), tolerance=0.0, rounds=3)


@query(None)
def a18_balance(t):
    return ch.balanced(pixels(t), bin_map(t).withColumnRenamed("target", "chrom"))


@query(None)
def a33_mixture_collapse(t):
    return sg.collapsed_by_mixture(tb.copy_numbers(depth(t), 140.0).select("chrom", "copies"))


# smoothing by a normal kernel of deviation 2, cut at 8, over 100 bins mirrored at both ends; of the smoothed local maxima the highest, in its middle
PEAK = (
    "tp AS (SELECT quantile_cont(n, 0.99) AS top, median(n) AS med FROM depth), hs AS (SELECT least(CAST(floor(n / (top / 100)) AS BIGINT), 99) AS k, count(*) AS c FROM depth, tp WHERE n > 0 AND n <= top GROUP BY 1), "
    "hb AS (SELECT g.k, coalesce(c, 0) AS c FROM (SELECT unnest(generate_series(0, 99)) AS k) g LEFT JOIN hs USING (k)), kn AS (SELECT o, exp(-0.5 * power(o / 2.0, 2)) AS e FROM (SELECT unnest(generate_series(-8, 8)) AS o)), "
    "sm AS (SELECT a.k, sum(b.c * e) / (SELECT sum(e) FROM kn) AS v FROM hb a, kn JOIN hb b ON b.k = CASE WHEN a.k + o < 0 THEN -1 - a.k - o WHEN a.k + o > 99 THEN 199 - a.k - o ELSE a.k + o END GROUP BY a.k), "
    "lm AS (SELECT k, v, v > lag(v) OVER (ORDER BY k) AND v > lead(v) OVER (ORDER BY k) AS peak FROM sm), bp AS (SELECT k FROM lm ORDER BY coalesce(peak, false) DESC, v DESC, k LIMIT 1)"
)


@query(f"WITH {DEPTH}, {PEAK} SELECT round(greatest((k + 0.5) * top / 100, med), 6)::DOUBLE AS peak FROM bp, tp")
def a35_depth_peak(t):
    return t.spark.createDataFrame([(round(sg.depth_peak(depth(t)), 6),)], "peak double")


@query("SELECT read_idx, contig AS query, start_pos + 20 AS pos, contig + 1 AS target, CASE WHEN strand = '+' THEN start_pos * 2 + 20 ELSE start_pos * 2 + (end_pos - start_pos) - 21 END AS target_pos FROM porec WHERE start_pos + 20 < end_pos")
def a49_methylation_lift(t):
    p = t.porec.withColumn("query", F.concat_ws("/", F.col("read_idx").cast("string"), F.col("frag").cast("string")))
    seg = p.select("query", F.col("start_pos").alias("q_start"), F.col("end_pos").alias("q_end"), (F.col("contig") + 1).alias("target"), (F.col("start_pos") * 2).alias("t_start"), (F.col("start_pos") * 2 + F.col("end_pos") - F.col("start_pos")).alias("t_end"), "strand")
    lifted = ly.methylation_lift(seg, p.select("query", (F.col("start_pos") + 20).alias("pos")))
    return lifted.join(p.select("query", "read_idx", F.col("contig").alias("own")), "query").select("read_idx", F.col("own").alias("query"), "pos", "target", "target_pos")


@query("SELECT parent, contig, CAST(row_number() OVER (PARTITION BY parent ORDER BY contig % 3 = 2, contig % 12, contig % 3 = 1, contig // 12, contig) AS INTEGER) AS rank FROM membership")
def o1_natural_order(t):
    """Names of two numbers, chr9_ctg80; of one and a tail, chr9_ctg80.1; and plain numbers before them."""
    from ..functions.units import natural_key

    chrom, ctg = (F.col("contig") % 12).cast("string"), F.floor(F.col("contig") / 12).cast("string")
    named = t.membership.select("parent", "contig", F.when(F.col("contig") % 3 == 2, F.concat(F.lit("chr"), chrom, F.lit("_ctg"), ctg)).when(F.col("contig") % 3 == 1, F.concat(chrom, F.lit("_"), ctg)).otherwise(F.concat(chrom, F.lit("."), ctg)).alias("name"))
    return named.withColumn("rank", F.row_number().over(Window.partitionBy("parent").orderBy(natural_key("name"), "contig"))).drop("name")


@query(f"WITH RECURSIVE {AGREE} SELECT grp, coalesce(lcs, 0) AS lcs, coalesce(in_order, 0) AS in_order FROM ag")
def w10_subsequences(t):
    from ..operators.evaluation import order_agreement

    return order_agreement(t.tour_truth, t.tour_test, t.contigs).select("grp", "lcs", "in_order")


@query("SELECT read_idx, count(*) AS fragments, CAST(sum(end_pos - start_pos) AS BIGINT) AS bases FROM porec GROUP BY read_idx")
def w13_read_batches(t):
    # a read never straddles two tasks: the exchange by read, and the sums over it, are the batches
    return t.porec.repartition("read_idx").groupBy("read_idx").agg(F.count("*").alias("fragments"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))


@query(None)
def g4_single_partition(t):
    from .partition import single_partition

    return single_partition(pruned_clique(t), normalized(t, "svc"), t.contigs, t.alleles, 6)


@query(None)
def g7_rescue(t):
    return s.rescued(pruned_clique(t), t.membership.where("contig % 6 <> 0"), t.contigs, t.alleles, least=5.0, share=0.01, ambiguity=0.999)


@query(None)
def g17_ring_order(t):
    return ch.ring_order(g.normalize(pruned_clique(t), t.contigs.withColumn("degree", F.lit(1)), "geom"), t.membership.select("contig", "grp"))


@query(None)
def g22_haplotype_clusters(t):
    got = collected(s.group_similarity(t.alleles, t.tour_test.select("contig", "grp")).select("grp1", "grp2", "similarity"))
    names = sorted(r.grp for r in collected(t.tour_test.select("grp").distinct()))
    at = {n: i for i, n in enumerate(names)}
    d = np.ones((len(names), len(names)))
    for a, b, x in got:
        d[at[a], at[b]] = d[at[b], at[a]] = 1 - x
    return t.spark.createDataFrame(sorted(ch.average_linkage(names, d, 0.25).items()), "grp long, cluster long")


@query(
    f"WITH {PIXELS}, {BINMAP}, e AS (SELECT unnest(generate_series(greatest(bin1_id + 1, bin2_id - 4), least(bin2_id, bin1_id + 5))) AS bin_id, n FROM px WHERE bin2_id > bin1_id AND bin2_id - bin1_id < 10), ts AS (SELECT bin_id, CAST(sum(n) AS BIGINT) AS score FROM e GROUP BY bin_id), "
    f"cv AS (SELECT bm.target AS contig, ts.bin_id AS w, score AS n FROM ts JOIN bm USING (bin_id)), {troughs_sql('cv', 1.0, 0.8, 1)} SELECT * FROM tr"
)
def g29_corrector_troughs(t):
    score = s.triangle_score(pixels(t), 5).join(bin_map(t), "bin_id").select(F.col("target").alias("contig"), F.col("bin_id").alias("w"), F.col("score").alias("n"))
    return sg.coverage_breaks(score, sigma=1.0, depth=0.8, edge=1)


@query("WITH v AS (SELECT m.contig, c.read_name % 7 AS chrom, count(*) AS n FROM membership m JOIN paf c ON m.contig = c.chrom GROUP BY 1, 2) SELECT contig, chrom, n FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY n DESC, chrom) AS rn FROM v) WHERE rn = 1")
def g30_pregroup(t):
    v = t.membership.select("contig").join(t.paf.select(F.col("chrom").alias("contig"), (F.col("read_name") % 7).alias("chrom")), "contig").groupBy("contig", "chrom").agg(F.count("*").alias("n"))
    return v.withColumn("rn", F.row_number().over(Window.partitionBy("contig").orderBy(F.desc("n"), "chrom"))).where("rn = 1").select("contig", "chrom", "n")


STEPS = (
    "st AS (SELECT *, lag(chrom) OVER w AS c0, lag(strand) OVER w AS s0, CASE WHEN strand = '+' THEN start_pos - lag(start_pos) OVER w ELSE lag(start_pos) OVER w - start_pos END AS step FROM paf WINDOW w AS (PARTITION BY read_name ORDER BY read_start, start_pos, chrom, line_id)), "
    "cn AS (SELECT *, sum(CASE WHEN c0 = chrom AND s0 = strand AND step BETWEEN 0.25 * 20000 AND 1.25 * 20000 THEN 0 ELSE 1 END) OVER (PARTITION BY read_name ORDER BY read_start, start_pos, chrom, line_id ROWS UNBOUNDED PRECEDING) AS chain FROM st), "
    "cs AS (SELECT read_name, CAST(chain AS BIGINT) AS chain, chrom, strand, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS windows FROM cn GROUP BY ALL)"
)


@query(f"WITH {STEPS} SELECT * FROM cs WHERE windows >= 2")
def g31_read_chains(t):
    return ch.read_chains(t.paf, 20_000)


@query(
    f"WITH {STEPS}, nx AS (SELECT read_name, chrom AS a, start_pos AS s1, end_pos AS e1, lead(chrom) OVER w AS b, lead(start_pos) OVER w AS s2, lead(end_pos) OVER w AS e2 FROM cs WINDOW w AS (PARTITION BY read_name ORDER BY chain)), "
    "lk AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(DISTINCT read_name) AS reads FROM nx JOIN contigs x ON a = x.contig JOIN contigs y ON b = y.contig WHERE a <> b AND (s1 < 40000 OR x.length - e1 < 40000) AND (s2 < 40000 OR y.length - e2 < 40000) GROUP BY 1, 2), "
    "bo AS (SELECT a, b, reads FROM lk UNION ALL SELECT b, a, reads FROM lk), be AS (SELECT a, b, reads FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY reads DESC, b) AS rn FROM bo) WHERE rn = 1) SELECT p.a, p.b, p.reads FROM be p JOIN be q ON p.a = q.b AND p.b = q.a WHERE p.a < p.b"
)
def g36_chain_links(t):
    return ch.chain_links(ch.read_chains(t.paf, 20_000, least=1), 40_000, t.contigs)


GRAPH = "(VALUES (0, 1), (0, 2), (1, 2), (2, 1), (3, 1), (4, 1), (5, 1), (5, 3), (6, 1), (7, 2), (8, 1), (9, 1), (9, 8), (10, 1), (11, 1), (11, 2), (12, 1), (13, 2), (14, 1)) v(r, d)"


@query(
    f"WITH RECURSIVE ln AS (SELECT contig AS src, contig + d AS dst FROM contigs JOIN {GRAPH} ON contig % 15 = r), ch AS (SELECT src AS mid, any_value(dst) AS nxt FROM ln GROUP BY src HAVING count(*) = 1 AND src IN (SELECT dst FROM ln GROUP BY dst HAVING count(*) = 1)), "
    "wk AS (SELECT src AS source, dst AS tip, '' AS branch, 0 AS k FROM ln WHERE src IN (SELECT src FROM ln GROUP BY src HAVING count(*) > 1) UNION ALL SELECT source, nxt, CASE WHEN branch = '' THEN CAST(tip AS VARCHAR) ELSE branch || ' ' || tip END, k + 1 FROM wk JOIN ch ON tip = mid WHERE k < 5 AND nxt <> source) "
    "SELECT source, tip AS sink, min(branch) AS branch1, max(branch) AS branch2 FROM wk WHERE source <> tip GROUP BY 1, 2 HAVING count(*) = 2"
)
def g37_bubbles(t):
    """A graph of the contigs in which every fifteen in a row hold bubbles of one, of two and three, and of a direct link and one segment."""
    t.contigs.createOrReplaceTempView("graph_contigs")
    return ch.bubbles(t.spark.sql(f"SELECT contig AS src, contig + d AS dst FROM graph_contigs JOIN {GRAPH} ON contig % 15 = r"), t.contigs)


@query(None)
def g40_chromosome_order(t):
    got = collected(tb.block_sums(pruned_clique(t), t.membership.select("contig", "grp")).where("grp1 <> grp2").select("grp1", "grp2", "w"))
    names = sorted(r.grp for r in collected(t.membership.select("grp").distinct()))
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b, w in got:
        m[at[a], at[b]] = m[at[b], at[a]] = w
    return t.spark.createDataFrame(list(enumerate(ch.ordered_by_similarity(names, m), 1)), "pos long, grp long")


@query("SELECT CAST(contig AS VARCHAR) AS contig, grp, pos, strand FROM tour_test")
def g41_assembly_to_tour(t):
    lines = sinks.assembly_lines(t.tour_test, t.contigs)
    heads = text.assembly_contigs(lines)
    i = t.contigs.withColumn("idx", F.row_number().over(Window.orderBy("contig")))
    signed = t.tour_test.join(i, "contig").withColumn("s", F.when(F.col("strand") == "-", -F.col("idx")).otherwise(F.col("idx"))).groupBy("grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"].cast("string")), " ").alias("signed"))
    return ly.assembly_to_tour(heads, signed)


@query(
    "WITH p AS (SELECT m.contig, m.grp, length, coalesce(sum(length + 100) OVER (PARTITION BY m.grp ORDER BY m.contig ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM membership m JOIN contigs USING (contig)) SELECT grp, CAST(contig AS VARCHAR) AS id, CAST(before + 1 AS BIGINT) AS start_pos, CAST(before + length AS BIGINT) AS end_pos FROM p"
)
def g41_pseudo_agp(t):
    return ly.pseudo_agp(t.contigs, t.membership.select("contig", "grp")).where("kind = 'W'").select("grp", "id", "start_pos", "end_pos")


@query(f"WITH {AGP}, d AS (SELECT * FROM ag UNION ALL SELECT grp + 100, start_pos, end_pos, number, kind, id, tig_start, tig_end, orientation FROM ag WHERE grp % 2 = 0) SELECT grp, number, kind, CASE WHEN kind = 'W' AND rn > 1 THEN id || '_d' || rn ELSE id END AS id FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY grp, number) AS rn FROM d)")
def g41_duplicate_ids(t):
    a = tb.agp(t.tour_test, t.contigs)
    return ly.numbered_duplicates(a.unionByName(a.where("grp % 2 = 0").withColumn("grp", F.col("grp") + 100))).select("grp", "number", "kind", "id")


@query(f"WITH {AGP} SELECT grp, number, CASE WHEN grp % 10 IN (1, 2) THEN CAST(grp % 10 AS VARCHAR) ELSE 'unplaced' END AS haplotype FROM ag")
def g41_split_haplotypes(t):
    return ly.split_by_haplotype(tb.agp(t.tour_test, t.contigs), "([12])$").select("grp", "number", "haplotype")


@query(f"WITH {AGP}, l AS (SELECT grp, max(end_pos) AS length FROM ag GROUP BY grp), k AS (SELECT grp, id, orientation, length, unnest(generate_series((start_pos - 1) // 50000, (end_pos - 1) // 50000)) AS k FROM ag JOIN l USING (grp) WHERE kind = 'W') SELECT grp, k * 50000 AS start_pos, least((k + 1) * 50000, length) AS end_pos, id, orientation FROM k")
def g41_layout_bins(t):
    return ly.layout_bins(tb.agp(t.tour_test, t.contigs), 50_000)


@query(f"WITH {PIXELS}, {BINMAP} SELECT px.* FROM px JOIN bm a ON bin1_id = a.bin_id JOIN bm b ON bin2_id = b.bin_id WHERE a.target % 3 = 0 AND b.target % 3 = 0")
def g42_extract_contigs(t):
    keep = bin_map(t).where("target % 3 = 0").select("bin_id")
    return pixels(t).join(keep.withColumnRenamed("bin_id", "bin1_id"), "bin1_id", "left_semi").join(keep.withColumnRenamed("bin_id", "bin2_id"), "bin2_id", "left_semi").select("bin1_id", "bin2_id", "n")


@query(f"WITH {PIXELS}, {BINMAP} SELECT px.* FROM px JOIN bm a ON bin1_id = a.bin_id JOIN bm b ON bin2_id = b.bin_id WHERE NOT EXISTS (SELECT 1 FROM alleles WHERE c1 = least(a.target, b.target) AND c2 = greatest(a.target, b.target))")
def g42_prune_pairs(t):
    m = bin_map(t)
    j = pixels(t).join(m.select(F.col("bin_id").alias("bin1_id"), F.col("target").alias("t1")), "bin1_id").join(m.select(F.col("bin_id").alias("bin2_id"), F.col("target").alias("t2")), "bin2_id")
    j = j.withColumn("c1", F.least("t1", "t2")).withColumn("c2", F.greatest("t1", "t2"))
    return j.join(t.alleles.select("c1", "c2"), ["c1", "c2"], "left_anti").select("bin1_id", "bin2_id", "n")


@query("SELECT contig, (start_pos // 20000) * 20000 AS start_pos, count(*) AS sites FROM (SELECT contig, unnest(list_filter(generate_series(0, length(seq) - 4), lambda i: seq[i + 1:i + 4] = 'gatc')) AS start_pos FROM seqs) GROUP BY 1, 2")
def a47_site_bins(t):
    return ly.site_bins(t.seqs, "gatc", 20_000)


@query("SELECT contig, CAST(s AS BIGINT) AS start_pos, seq[s + 1:s + 400] AS piece FROM (SELECT contig, seq, unnest(generate_series(0, length(seq) - 1, 200)) AS s FROM seqs WHERE length(seq) > 0)")
def x_sequence_windows(t):
    return ly.sequence_windows(t.seqs, 400, 200)


REPORT = PR.replace("SELECT tp,", "pr AS (SELECT tp,", 1) + ")"


@query(
    f"WITH RECURSIVE {AGREE}, {ALIAS.replace('al AS', 'ga AS', 1)}, tx AS (SELECT * FROM tour_truth WHERE contig IN (SELECT contig FROM tour_test)), {adjacency_sql('tx', 'tr')}, {adjacency_sql('tour_test', 'te')}, {REPORT}, "
    "gj AS (SELECT b.grp, b.strand <> a.strand AS d, ga.truth_grp <> a.grp AS wrong, length FROM tour_test b JOIN tour_truth a USING (contig) JOIN ga ON b.grp = ga.test_grp JOIN contigs USING (contig)), o AS (SELECT grp, count(*) AS n, count(*) FILTER (d) AS d FROM gj GROUP BY grp), "
    "un AS (SELECT count(*) AS unanchored, coalesce(sum(length), 0) AS bases FROM tour_truth JOIN contigs USING (contig) WHERE contig NOT IN (SELECT contig FROM tour_test)) "
    "SELECT pr.*, (SELECT count(*) FROM gj) AS contigs, (SELECT count(*) FROM gj WHERE wrong) AS grouping_errors, (SELECT round(sum(CASE WHEN wrong THEN length ELSE 0 END) / sum(length), 6) FROM gj) AS grouping_rate, (SELECT CAST(sum(CASE WHEN d * 2 > n THEN n - d ELSE d END) AS BIGINT) FROM o) AS orientation_errors, "
    "(SELECT CAST(sum(misplaced) AS BIGINT) FROM ag) AS misplaced, unanchored, CAST((SELECT sum(edits) FROM ag) + unanchored AS BIGINT) AS edit_distance, round(((SELECT sum(weighted_edits) FROM ag) + un.bases) / (SELECT sum(length) FROM tour_truth JOIN contigs USING (contig)), 6) AS edit_rate FROM pr, un"
)
def e8_report(t):
    from ..operators.evaluation import report

    return report(t.tour_truth, t.tour_test, t.contigs)


@query(f"WITH {DEPTH}, m AS (SELECT n AS peak FROM depth WHERE n > 0 GROUP BY n ORDER BY count(*) DESC, n LIMIT 1), k AS (SELECT CASE WHEN n / peak < 0.1 THEN 'error' WHEN n / peak < 0.5 THEN 'duplicated' WHEN n / peak < 1.5 THEN 'haploid' ELSE 'collapsed' END AS class FROM depth, m) SELECT class, count(*) AS windows FROM k GROUP BY class")
def e11_components(t):
    d = depth(t)
    k = d.join(F.broadcast(tb.depth_mode(d).select(F.col("n").alias("peak"))), F.lit(True)).withColumn("k", F.col("n") / F.col("peak"))
    return k.groupBy(F.when(F.col("k") < 0.1, "error").when(F.col("k") < 0.5, "duplicated").when(F.col("k") < 1.5, "haploid").otherwise("collapsed").alias("class")).agg(F.count("*").alias("windows"))


@query("SELECT x.grp AS grp1, y.grp AS grp2, count(*) AS anchors, round(coalesce(corr(x.pos, y.pos), 0), 6) AS r FROM alleles JOIN tour_truth x ON c1 = x.contig JOIN tour_truth y ON c2 = y.contig GROUP BY 1, 2 HAVING count(*) > 2")
def e13_anchor_correlation(t):
    x, y = t.tour_truth.select(F.col("contig").alias("c1"), F.col("grp").alias("grp1"), F.col("pos").alias("p1")), t.tour_truth.select(F.col("contig").alias("c2"), F.col("grp").alias("grp2"), F.col("pos").alias("p2"))
    return t.alleles.select("c1", "c2").join(x, "c1").join(y, "c2").groupBy("grp1", "grp2").agg(F.count("*").alias("anchors"), r6(F.coalesce(F.corr("p1", "p2"), F.lit(0.0))).alias("r")).where("anchors > 2")


@query(f"WITH {PRUNED_CLIQUE} SELECT count(*) AS edges, round(sum(w), 6) AS total, round(sum(CASE WHEN src = dst THEN w ELSE 0 END) / sum(w), 6) AS cis FROM cq")
def x_contact_summary(t):
    return pruned_clique(t).agg(F.count("*").alias("edges"), r6(F.sum("w")).alias("total"), r6(F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("cis"))


@query("SELECT true AS is_store, true AS unchanged, true AS changed")
def s5_sniff_and_change(t):
    path = scratch(t, "sniff")
    sinks.write_pairs_store(t.pairs, path)
    before = text.fingerprint(t.spark, path)
    same = text.fingerprint(t.spark, path) == before
    sinks.write_pairs_store(t.pairs.where("mapq > 3"), path)
    return t.spark.createDataFrame([(text.is_pairs_store(t.spark, path), same, text.fingerprint(t.spark, path) != before)], "is_store boolean, unchanged boolean, changed boolean")


CG = "cg AS (SELECT contig, p AS pos FROM (SELECT contig, seq, unnest(generate_series(0, length(seq) - 2)) AS p FROM seqs) WHERE seq[p + 1:p + 2] = 'cg')"
CALLS = "cl AS (SELECT contig * 1000 + pos % 50 AS align_id, contig, pos + CASE WHEN (contig * 1000 + pos % 50) % 2 = 0 THEN 0 ELSE 1 END AS p, (contig * 1000 + pos % 50) % 2 = 0 AS forward, pos % 3 = 0 AS methylated FROM cg)"


@query(
    f"WITH {CG}, {CALLS}, b AS (SELECT align_id, count(*) AS k FROM cl WHERE ((CASE WHEN forward THEN p ELSE p - 1 END) % 5 = 0) <> methylated GROUP BY align_id) "
    "SELECT a.align_id, coalesce(k, 0) AS inconsistent, round(100 - 2 * coalesce(k, 0), 6)::DOUBLE AS score FROM (SELECT DISTINCT align_id FROM cl) a LEFT JOIN b USING (align_id)"
)
def a48_methylation_scores(t):
    cg = tb.motif_starts(t.seqs, "cg").select("contig", F.col("pos").alias("p"))
    align = F.col("contig") * 1000 + F.col("p") % 50
    calls = cg.select(align.alias("align_id"), F.lit(100.0).alias("score"), "contig", (F.col("p") + F.when(align % 2 == 0, 0).otherwise(1)).alias("pos"), (align % 2 == 0).alias("forward"), (F.col("p") % 3 == 0).alias("methylated"))
    return ly.methylation_scores(calls, cg.where("p % 5 = 0").select("contig", F.col("p").alias("pos")), t.seqs, 2.0)


@query(None)
def g19_searched_orders(t):
    return ch.searched_orders(g.normalize(pruned_clique(t), t.contigs.withColumn("degree", F.lit(1)), "geom"), t.membership.select("contig", "grp"))
