"""Queries of graph scoring, clustering, ordering, evaluation, set and sampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contacts as c
from ..operators import filters as f
from ..operators import graph as g
from ..operators import scoring as s
from ..operators import tables as tb
from ..operators.common import r6
from ..operators.intervals import merge
from .aggregate_queries import BEST, DEPTH, PIXELS, PRUNED_CLIQUE, SCORES, best_two, depth, normalized, pixels, pruned_clique
from .filter_queries import HE, incidence, island_sql
from .registry import query, troughs_sql


@query(f"WITH {PRUNED_CLIQUE} SELECT src, dst, round(w, 6) AS w FROM cq WHERE w >= 100")
def f18_edge_threshold(t):
    return pruned_clique(t).where("w >= 100").select("src", "dst", r6("w").alias("w"))


@query(f"WITH {PRUNED_CLIQUE}, b AS (SELECT src, dst, w FROM cq WHERE src <> dst UNION ALL SELECT dst, src, w FROM cq WHERE src <> dst), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(w, 6) DESC, dst) AS rn FROM b) SELECT src, dst, round(w, 6) AS w FROM r WHERE rn <= 10")
def o4_sparsify_topk(t):
    return c.top_per_row(pruned_clique(t).withColumn("w", r6("w")), 10).select("src", "dst", "w")


@query(
    f"WITH {HE}, k AS (SELECT read_idx, grp, count(*) AS k FROM he JOIN membership USING (contig) GROUP BY ALL) SELECT read_idx, CAST(sum(k) AS BIGINT) AS e, count(*) AS c, round(sum(1.0::DOUBLE / (1 + k)) * (sum(k) + count(*)) / (2 * sum(k)), 6) AS weight FROM k GROUP BY read_idx"
)
def g1_edge_reweight(t):
    return s.edge_reweight(incidence(t), t.membership.select("contig", "grp")).select("read_idx", "e", "c", r6("weight").alias("weight"))


@query(None)
def g1_communities(t):
    return g.communities(normalized(t, "svc"))


@query(None)
def g1_reweighted_communities(t):
    from ..plans.partition import reweighted_communities

    return reweighted_communities(f.min_contacts(incidence(t), 25), rounds=3)


@query(None)
def g2_star_communities(t):
    return g.communities(c.clique(incidence(t), most=15, cis=False, by_sum=True))


@query(None)
def g3_resolution_search(t):
    from ..plans.partition import to_group_count

    return to_group_count(normalized(t, "svc"), 8)


@query(None)
def g5_two_rounds(t):
    from ..plans.partition import two_rounds

    return two_rounds(pruned_clique(t), g.vertices(f.min_contacts(incidence(t), 25), t.contigs), t.alleles)


@query(None)
def g5_incremental_partition(t):
    from ..plans.partition import incremental_partition

    return incremental_partition(pruned_clique(t), g.vertices(f.min_contacts(incidence(t), 25), t.contigs), t.contigs, t.alleles, k=4, per=2)


@query(None)
def g6_merge_groups(t):
    from ..plans.partition import merged_to

    return merged_to(pruned_clique(t), t.membership.select("contig", "grp"), 8)


@query(f"WITH {PRUNED_CLIQUE}, {SCORES}, {BEST} SELECT contig, best_grp, round(best, 6) AS best, round(second, 6) AS second FROM bt WHERE best >= 30 AND best / total >= 0.05 AND second / best <= 0.95")
def g7_rescue_scores(t):
    return s.rescue_scores(best_two(t), 30, 0.05, 0.95).select("contig", "best_grp", r6("best").alias("best"), r6("second").alias("second"))


OWN = "ow AS (SELECT sc.contig, sc.grp, sc.score, m.grp AS own_grp FROM sc JOIN membership m USING (contig))"


@query(
    f"WITH {PRUNED_CLIQUE}, {SCORES}, {OWN}, rr AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY round(score, 6) DESC, grp) AS rn FROM ow), q AS (SELECT contig, own_grp, max(CASE WHEN rn = 1 THEN grp END) AS grp, max(score) AS best, coalesce(max(CASE WHEN grp = own_grp THEN score END), 0) AS own, sum(score) AS total FROM rr GROUP BY contig, own_grp) "
    "SELECT contig, own_grp, grp, round(best, 6) AS best, round(own, 6) AS own FROM q WHERE grp <> own_grp AND best > 1.5 * own AND best / total > 0.05 AND total > 2"
)
def g8_recluster_candidates(t):
    m = t.membership.select("contig", "grp")
    return s.recluster_candidates(tb.group_scores(pruned_clique(t), m), m, 1.5, 2.0, 0.05).select("contig", "own_grp", "grp", r6("best").alias("best"), r6("own").alias("own"))


@query(
    "SELECT x.grp, CASE WHEN a.length >= b.length THEN c1 ELSE c2 END AS longer, CASE WHEN a.length >= b.length THEN c2 ELSE c1 END AS shorter FROM alleles JOIN tour_test x ON c1 = x.contig JOIN tour_test y ON c2 = y.contig AND x.grp = y.grp JOIN contigs a ON c1 = a.contig JOIN contigs b ON c2 = b.contig"
)
def g9_conflicts(t):
    return s.conflicts(t.alleles, t.tour_test.select("contig", "grp"), t.contigs)


@query(f"WITH {PRUNED_CLIQUE}, {SCORES}, cf AS (SELECT DISTINCT unnest([c1, c2]) AS contig FROM alleles JOIN membership x ON c1 = x.contig JOIN membership y ON c2 = y.contig AND x.grp = y.grp), rr AS (SELECT sc.*, row_number() OVER (PARTITION BY contig ORDER BY round(score, 6) DESC, grp) AS rn FROM sc JOIN cf USING (contig)) SELECT contig, grp, round(score, 6) AS score FROM rr WHERE rn = 1")
def g10_move_misplaced(t):
    from pyspark.sql import Window

    m = t.membership.select("contig", "grp")
    cf = s.conflicts(t.alleles, m, t.contigs).select(F.explode(F.array("longer", "shorter")).alias("contig")).distinct()
    rn = F.row_number().over(Window.partitionBy("contig").orderBy(F.desc(F.round("score", 6)), "grp"))
    return tb.group_scores(pruned_clique(t), m).join(cf, "contig").withColumn("rn", rn).where("rn = 1").select("contig", "grp", r6("score").alias("score"))


@query(
    "WITH v AS (SELECT contig // 3 AS contig, grp, CAST(sum(length) AS BIGINT) AS length FROM membership JOIN contigs USING (contig) GROUP BY 1, 2), r AS (SELECT *, sum(length) OVER (PARTITION BY contig) AS total, row_number() OVER (PARTITION BY contig ORDER BY length DESC, grp) AS rn FROM v) SELECT contig, grp, round(length / CAST(total AS DOUBLE), 6) AS support FROM r WHERE rn = 1"
)
def g11_split_votes(t):
    v = t.membership.join(t.contigs, "contig").select(F.floor(F.col("contig") / 3).alias("contig"), "grp", "length")
    return s.split_votes(v).select("contig", "grp", r6("support").alias("support"))


@query("SELECT contig1, contig2, n, 0 AS type FROM contacts JOIN alleles ON contig1 = c1 AND contig2 = c2")
def g12_allelic_contacts(t):
    p = t.alleles.select(F.col("c1").alias("contig1"), F.col("c2").alias("contig2"))
    return t.contacts.join(p, ["contig1", "contig2"], "left_semi").select("contig1", "contig2", "n", F.lit(0).alias("type"))


SINGLE = "al AS (SELECT c1 AS c, c2 AS a FROM alleles WHERE similarity >= 0.93 UNION ALL SELECT c2, c1 FROM alleles WHERE similarity >= 0.93), al1 AS (SELECT c, min(a) AS a FROM al GROUP BY c HAVING count(*) = 1), wb AS (SELECT contig1 AS x, contig2 AS y, n FROM contacts WHERE contig1 <> contig2 UNION ALL SELECT contig2, contig1, n FROM contacts WHERE contig1 <> contig2)"


@query(
    f"WITH {SINGLE}, q AS (SELECT w.x AS c1, w.y AS c2, w.n AS w_cc, coalesce(aa.n, 0) AS w_aa, coalesce(ca.n, 0) AS w_ca, coalesce(ac.n, 0) AS w_ac FROM wb w JOIN al1 p ON w.x = p.c JOIN al1 q ON w.y = q.c "
    "LEFT JOIN wb aa ON aa.x = p.a AND aa.y = q.a LEFT JOIN wb ca ON ca.x = w.x AND ca.y = q.a LEFT JOIN wb ac ON ac.x = p.a AND ac.y = w.y WHERE w.x < w.y AND p.a <> w.y) SELECT * FROM q WHERE w_cc + w_aa <= w_ca + w_ac"
)
def g13_cross_allelic_2x2(t):
    return s.weak_2x2(t.contacts, t.alleles.where("similarity >= 0.93"))


@query(None)
def g13_cross_allelic_matching(t):
    return s.weak_matching(t.contacts, t.alleles)


@query(
    "WITH rw AS (SELECT c1 || '-' || c2 AS row, c1 AS member FROM alleles UNION ALL SELECT c1 || '-' || c2, c2 FROM alleles), wb AS (SELECT contig1 AS contig, contig2 AS member, n FROM contacts WHERE contig1 <> contig2 UNION ALL SELECT contig2, contig1, n FROM contacts WHERE contig1 <> contig2) "
    "SELECT contig, row, member, n FROM (SELECT contig, row, wb.member, n, row_number() OVER (PARTITION BY contig, row ORDER BY n DESC, wb.member) AS rn FROM wb JOIN rw ON wb.member = rw.member) WHERE rn = 1"
)
def g14_strongest_allele(t):
    return s.strongest_allele(t.contacts, t.alleles)


TURNED = "tp AS (SELECT CASE WHEN read_idx % 3 = 0 THEN chrom2 ELSE chrom1 END AS chrom1, CASE WHEN read_idx % 3 = 0 THEN pos2 ELSE pos1 END AS pos1, CASE WHEN read_idx % 3 = 0 THEN chrom1 ELSE chrom2 END AS chrom2, CASE WHEN read_idx % 3 = 0 THEN pos1 ELSE pos2 END AS pos2 FROM pairs WHERE read_idx % 5 <> 1)"
HALF = (
    f"{TURNED}, hn AS (SELECT chrom1 || CASE WHEN pos1 * 2 <= a.length THEN 'H' ELSE 'T' END AS e, chrom2 || CASE WHEN pos2 * 2 <= b.length THEN 'H' ELSE 'T' END AS f, CAST(a.length AS DOUBLE) * b.length AS area FROM tp JOIN contigs a ON chrom1 = a.contig JOIN contigs b ON chrom2 = b.contig WHERE chrom1 <> chrom2), "
    "hf AS (SELECT least(e, f) AS x, greatest(e, f) AS y, count(*) AS links, count(*) * 4e8 / any_value(area) AS density FROM hn GROUP BY 1, 2)"
)


def turned(t):
    """Some of the pairs, a third of them with the ends the other way round."""
    swap = F.col("read_idx") % 3 == 0
    return t.pairs.where("read_idx % 5 <> 1").select(*[F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("chrom1", "chrom2"), ("pos1", "pos2"), ("chrom2", "chrom1"), ("pos2", "pos1"))])


@query(
    f"WITH {HALF}, sd AS (SELECT x, y, density FROM hf UNION ALL SELECT y, x, density FROM hf), ot AS (SELECT a.x, a.y, max(b.density) AS other FROM sd a LEFT JOIN sd b ON a.x = b.x AND a.y <> b.y GROUP BY a.x, a.y) "
    "SELECT hf.x, hf.y, links, round(density, 6) AS density, round(CASE WHEN p.other IS NULL AND q.other IS NULL THEN 2 ELSE density / greatest(coalesce(p.other, 0), coalesce(q.other, 0)) END, 6) AS confidence FROM hf JOIN ot p ON hf.x = p.x AND hf.y = p.y JOIN ot q ON hf.y = q.x AND hf.x = q.y"
)
def g15_half_densities(t):
    return g.half_densities(turned(t), t.contigs).select("x", "y", "links", r6("density").alias("density"), r6("confidence").alias("confidence"))


@query(None)
def g15_ordered_groups(t):
    return g.ordered_groups(t.pairs, t.contigs, t.membership)


@query(
    "WITH nx AS (SELECT grp, least(contig, b) AS contig1, greatest(contig, b) AS contig2 FROM (SELECT *, lead(contig) OVER (PARTITION BY grp ORDER BY pos) AS b FROM tour_test) WHERE b IS NOT NULL) SELECT grp, round(sum(CASE WHEN n > 0 THEN 1 / n ELSE 10000 END), 6) AS score, count(*) FILTER (n IS NULL) AS broken FROM nx LEFT JOIN contacts USING (contig1, contig2) GROUP BY grp"
)
def g16_tour_score(t):
    return s.tour_score(t.tour_test, t.contacts).select("grp", r6("score").alias("score"), "broken")


FACING = "fc AS (SELECT chrom1 AS contig1, chrom2 AS contig2, count(*) FILTER (pos1 * 2 > a.length AND pos2 * 2 <= b.length) AS pp, count(*) FILTER (pos1 * 2 > a.length AND pos2 * 2 > b.length) AS pm, count(*) FILTER (pos1 * 2 <= a.length AND pos2 * 2 <= b.length) AS mp, count(*) FILTER (pos1 * 2 <= a.length AND pos2 * 2 > b.length) AS mm FROM pairs JOIN contigs a ON chrom1 = a.contig JOIN contigs b ON chrom2 = b.contig WHERE chrom1 <> chrom2 GROUP BY 1, 2)"


@query(f"WITH {FACING} SELECT * FROM fc")
def g18_orientation_scores(t):
    return s.orientation_scores(t.pairs, t.contigs)


@query(f"WITH {FACING} SELECT contig1, contig2, CASE greatest(pp, pm, mp, mm) WHEN pp THEN '++' WHEN pm THEN '+-' WHEN mp THEN '-+' ELSE '--' END AS orientation, greatest(pp, pm, mp, mm) AS links FROM fc")
def g18_best_orientation(t):
    return s.best_orientation(s.orientation_scores(t.pairs, t.contigs))


@query(
    "WITH rk AS (SELECT *, row_number() OVER (PARTITION BY c1 ORDER BY mz_shared DESC, similarity DESC, c2) AS rn FROM (SELECT c1, c2 % (SELECT count(*) FROM contigs) + 1 AS c2, mz_shared, similarity, strand FROM alleles)), v AS (SELECT x.grp AS g1, y.grp AS g2, mz_shared * r.strand * (CASE WHEN x.strand = '+' THEN 1 ELSE -1 END) * (CASE WHEN y.strand = '+' THEN 1 ELSE -1 END) AS v FROM rk r JOIN tour_test x ON c1 = x.contig JOIN tour_test y ON c2 = y.contig WHERE rn <= 5 AND x.grp <> y.grp) "
    "SELECT g1, g2, CAST(sum(greatest(v, 0)) AS BIGINT) AS plus, CAST(sum(greatest(-v, 0)) AS BIGINT) AS minus, sum(greatest(-v, 0)) > 1.05 * sum(greatest(v, 0)) AS reverse FROM v GROUP BY g1, g2"
)
def g21_haplotype_votes(t):
    n = t.contigs.count()
    return s.haplotype_votes(t.alleles.withColumn("c2", F.col("c2") % n + 1), t.tour_test)


@query("WITH j AS (SELECT least(x.grp, y.grp) AS grp1, greatest(x.grp, y.grp) AS grp2, mz_shared, similarity FROM alleles JOIN tour_test x ON c1 = x.contig JOIN tour_test y ON c2 = y.contig WHERE x.grp <> y.grp) SELECT grp1, grp2, round(sum(mz_shared * similarity) / sum(mz_shared), 6) AS similarity FROM j GROUP BY 1, 2")
def g22_group_similarity(t):
    return s.group_similarity(t.alleles, t.tour_test.select("contig", "grp")).select("grp1", "grp2", r6("similarity").alias("similarity"))


@query(
    "WITH j AS (SELECT grp, read_name, CAST(sum(matches) AS BIGINT) AS matches, sum(CASE WHEN p.strand = '+' THEN matches ELSE -matches END) AS vote FROM paf p JOIN membership ON chrom = contig GROUP BY 1, 2) SELECT grp, read_name AS reference, matches, vote < 0 AS reverse FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY matches DESC, read_name) AS rn FROM j) WHERE rn = 1"
)
def g23_reference_votes(t):
    return s.reference_votes(t.paf, t.membership)


@query("WITH b AS (SELECT read_name, chrom FROM (SELECT *, row_number() OVER (PARTITION BY read_name ORDER BY matches DESC, chrom, start_pos, line_id) AS rn FROM paf) WHERE rn = 1) SELECT chrom, count(*) AS n, string_agg(CAST(read_name AS VARCHAR), ' ' ORDER BY read_name) AS members FROM b GROUP BY chrom")
def g24_prepartition(t):
    best = tb.best_alignment(t.paf)
    return best.groupBy("chrom").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("read_name")), lambda r: r.cast("string")), " ").alias("members"))


@query(
    f"WITH {PRUNED_CLIQUE}, b AS (SELECT src, dst, w FROM cq WHERE src <> dst UNION ALL SELECT dst, src, w FROM cq WHERE src <> dst), md AS (SELECT median(length) AS med FROM contigs), gs AS (SELECT grp, count(*) AS k FROM membership GROUP BY grp) "
    "SELECT src AS contig, grp, round(sum(w / (length / med)) / any_value(k), 6) AS score FROM b JOIN membership m ON dst = m.contig JOIN contigs x ON x.contig = dst JOIN gs USING (grp), md GROUP BY src, grp"
)
def g25_collapsed_scores(t):
    return s.collapsed_scores(pruned_clique(t), t.membership.select("contig", "grp"), t.contigs).select("contig", "grp", r6("score").alias("score"))


@query(
    f"WITH {PIXELS}, cp AS (SELECT DISTINCT bin1_id AS bin_id, 2 AS k FROM px WHERE bin1_id % 50 = 0), j AS (SELECT bin1_id, bin2_id, n / (coalesce(a.k, 1) * coalesce(b.k, 1)) AS v, coalesce(a.k, 1) AS k1, coalesce(b.k, 1) AS k2 FROM px LEFT JOIN cp a ON bin1_id = a.bin_id LEFT JOIN cp b ON bin2_id = b.bin_id) "
    "SELECT bin1_id, x.c AS copy1, bin2_id, y.c AS copy2, v FROM j JOIN (VALUES (1), (2)) x(c) ON x.c <= k1 JOIN (VALUES (1), (2)) y(c) ON y.c <= k2"
)
def g26_duplicate_bins(t):
    px = pixels(t)
    return s.duplicate_pixels(px, px.where("bin1_id % 50 = 0").select(F.col("bin1_id").alias("bin_id"), F.lit(2).alias("k")).distinct())


@query(
    "WITH cis AS (SELECT chrom1 AS contig, (least(pos1, pos2) - 1) // 1000 AS a, (greatest(pos1, pos2) - 1) // 1000 AS b FROM pairs WHERE chrom1 = chrom2), gr AS (SELECT contig, unnest(generate_series(0, (length - 1) // 1000)) AS w FROM contigs), "
    f"cv AS (SELECT gr.contig, gr.w, count(cis.a) AS n FROM gr LEFT JOIN cis ON cis.contig = gr.contig AND gr.w BETWEEN a AND b GROUP BY ALL), {troughs_sql('cv', 2.0, 0.5, 3)} SELECT * FROM tr"
)
def g27_chimeric_breaks(t):
    from ..operators.signals import coverage_breaks

    return coverage_breaks(c.cis_coverage(t.pairs, t.contigs, 1000))


@query(
    "SELECT read_idx, frag, contig, start_pos // 40000 AS piece, start_pos % 40000 AS start_pos FROM porec"
)
def g28_break_coordinates(t):
    from ..operators.contacts import break_positions

    return break_positions(t.porec, 40_000)


@query(f"WITH {PIXELS}, e AS (SELECT unnest(generate_series(greatest(bin1_id + 1, bin2_id - 4), least(bin2_id, bin1_id + 5))) AS bin_id, n FROM px WHERE bin2_id > bin1_id AND bin2_id - bin1_id < 10) SELECT bin_id, CAST(sum(n) AS BIGINT) AS score FROM e GROUP BY bin_id")
def g29_triangle_score(t):
    return s.triangle_score(pixels(t), 5)


BREAKS = (
    "ch AS (SELECT read_idx, contig, start_pos, end_pos, strand, lead(contig) OVER w AS c2, lead(start_pos) OVER w AS s2, lead(end_pos) OVER w AS e2, lead(strand) OVER w AS t2 FROM porec WINDOW w AS (PARTITION BY read_idx ORDER BY frag)), "
    "br AS (SELECT read_idx, contig, CASE WHEN strand = '+' THEN end_pos ELSE start_pos END AS pos FROM ch WHERE c2 <> contig UNION ALL SELECT read_idx, c2, CASE WHEN t2 = '+' THEN s2 ELSE e2 END FROM ch WHERE c2 <> contig), "
    "bw AS (SELECT contig, pos // 5000 * 5000 AS start_pos, count(DISTINCT read_idx) AS reads, pos // 5000 * 5000 + 5000 AS end_pos FROM br GROUP BY 1, 2 HAVING count(DISTINCT read_idx) >= 3)"
)


def break_windows(t):
    return s.break_windows(s.split_breaks(t.porec), 5000, 3)


@query(f"WITH {BREAKS} SELECT contig, start_pos, end_pos, reads FROM bw")
def g32_break_windows(t):
    return break_windows(t)


@query(f"WITH {BREAKS}, bed AS (SELECT contig AS chrom, start_pos, end_pos FROM bw), {island_sql('bed')} SELECT * FROM islands")
def g32_break_regions(t):
    return merge(break_windows(t).withColumnRenamed("contig", "chrom"))


@query(f"WITH {DEPTH}, {BREAKS}, mn AS (SELECT chrom AS contig, avg(n) AS mean FROM depth GROUP BY chrom) SELECT contig, start_pos, end_pos, reads, round(reads / mean, 6) AS score FROM bw JOIN mn USING (contig) JOIN contigs USING (contig) WHERE reads / mean >= 0.2 AND start_pos >= 10000 AND end_pos <= length - 10000")
def g33_normalised_breaks(t):
    return s.normalised_breaks(break_windows(t), depth(t), t.contigs, 0.2, 10_000).select("contig", "start_pos", "end_pos", "reads", r6("score").alias("score"))


@query(
    f"WITH {DEPTH}, cl AS (SELECT chrom, CASE WHEN median(n) < 205 THEN 1 ELSE 0 END AS low FROM depth GROUP BY chrom) SELECT CASE WHEN a.length <= b.length THEN c1 ELSE c2 END AS contig, count(*) AS covering FROM alleles JOIN contigs a ON c1 = a.contig JOIN contigs b ON c2 = b.contig JOIN cl x ON x.chrom = c1 JOIN cl y ON y.chrom = c2 WHERE similarity >= 0.7 AND x.low = 1 AND y.low = 1 GROUP BY 1"
)
def g34_false_duplicates(t):
    from ..operators.tables import copy_numbers

    low = copy_numbers(depth(t), 1.0).where("median < 205").select("chrom")
    l1, l2 = t.contigs.select(F.col("contig").alias("c1"), F.col("length").alias("n1")), t.contigs.select(F.col("contig").alias("c2"), F.col("length").alias("n2"))
    j = t.alleles.where("similarity >= 0.7").join(l1, "c1").join(l2, "c2").join(low.withColumnRenamed("chrom", "c1"), "c1", "left_semi").join(low.withColumnRenamed("chrom", "c2"), "c2", "left_semi")
    return j.groupBy(F.when(F.col("n1") <= F.col("n2"), F.col("c1")).otherwise(F.col("c2")).alias("contig")).agg(F.count("*").alias("covering"))


@query(
    f"WITH ok AS (SELECT contig AS chrom, start_pos, end_pos FROM porec WHERE mapq >= 20), {island_sql('ok')} SELECT islands.chrom, greatest(islands.start_pos, h.start_pos) AS start_pos, least(islands.end_pos, h.end_pos) AS end_pos FROM islands JOIN hcr h ON islands.chrom = h.chrom AND islands.start_pos < h.end_pos AND h.start_pos < islands.end_pos"
)
def g35_chain_regions(t):
    from ..operators.intervals import intersections

    ok = merge(t.porec.where("mapq >= 20").select(F.col("contig").alias("chrom"), "start_pos", "end_pos"))
    return intersections(ok, t.hcr)


SIDES = "sd AS (SELECT src AS contig, CASE WHEN src_strand = '+' THEN 'E' ELSE 'S' END AS side FROM gfa_links UNION ALL SELECT dst, CASE WHEN dst_strand = '+' THEN 'S' ELSE 'E' END FROM gfa_links)"


@query(f"WITH {SIDES}, k AS (SELECT contig, count(*) AS degree, count(DISTINCT side) AS sides FROM sd GROUP BY contig) SELECT contig, coalesce(degree, 0) AS degree, coalesce(degree, 0) = 0 AS isolate, coalesce(sides, 0) = 1 AS dead_end FROM contigs LEFT JOIN k USING (contig)")
def g38_topology(t):
    return s.topology(t.gfa_links, t.contigs)


@query(
    "WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM gfa_links UNION SELECT dst, src FROM gfa_links), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) "
    "SELECT a AS contig, least(a, min(b)) AS component FROM r GROUP BY a"
)
def g38_components(t):
    return g.components(t.gfa_links.select("src", "dst", F.lit(1.0).alias("w")))


@query(
    "SELECT l.src AS contig, count(*) AS redundant FROM gfa_links l JOIN contigs a ON src = a.contig JOIN contigs b ON dst = b.contig WHERE overlap >= 0.03 * least(a.length, b.length) GROUP BY 1"
)
def g39_redundant_contigs(t):
    a, b = t.contigs.select(F.col("contig").alias("src"), F.col("length").alias("la")), t.contigs.select(F.col("contig").alias("dst"), F.col("length").alias("lb"))
    return t.gfa_links.join(a, "src").join(b, "dst").where("overlap >= 0.03 * least(la, lb)").groupBy(F.col("src").alias("contig")).agg(F.count("*").alias("redundant"))


@query(f"WITH {PRUNED_CLIQUE}, bs AS (SELECT least(a.grp, b.grp) AS grp1, greatest(a.grp, b.grp) AS grp2, sum(w) AS w FROM cq JOIN membership a ON src = a.contig JOIN membership b ON dst = b.contig WHERE a.grp <> b.grp GROUP BY 1, 2) SELECT grp1, grp2, round((SELECT max(w) FROM bs) - w, 6) AS distance FROM bs")
def g40_chromosome_distance(t):
    bs = tb.block_sums(pruned_clique(t), t.membership.select("contig", "grp")).where("grp1 <> grp2")
    return bs.join(F.broadcast(bs.agg(F.max("w").alias("top"))), F.lit(True)).select("grp1", "grp2", r6(F.col("top") - F.col("w")).alias("distance"))


AGP = (
    "pl AS (SELECT t.*, length, coalesce(sum(length + 100) OVER (PARTITION BY grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY grp ORDER BY pos) AS rk, count(*) OVER (PARTITION BY grp) AS n FROM tour_test t JOIN contigs USING (contig)), "
    "ag AS (SELECT grp, CAST(before + 1 AS BIGINT) AS start_pos, CAST(before + length AS BIGINT) AS end_pos, 2 * rk - 1 AS number, 'W' AS kind, CAST(contig AS VARCHAR) AS id, CAST(1 AS BIGINT) AS tig_start, length AS tig_end, strand AS orientation FROM pl "
    "UNION ALL SELECT grp, CAST(before + length + 1 AS BIGINT), CAST(before + length + 100 AS BIGINT), 2 * rk, 'U', '100', NULL, NULL, '+' FROM pl WHERE rk < n)"
)


@query(f"WITH {AGP} SELECT * FROM ag")
def g41_agp(t):
    return tb.agp(t.tour_test, t.contigs)


@query(f"WITH {AGP} SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY number) AS BIGINT) AS pos, CAST(id AS BIGINT) AS contig, orientation AS strand FROM ag WHERE kind = 'W'")
def g41_agp_to_tour(t):
    from pyspark.sql import Window

    a = tb.agp(t.tour_test, t.contigs).where("kind = 'W'")
    return a.select("grp", F.row_number().over(Window.partitionBy("grp").orderBy("number")).cast("long").alias("pos"), F.col("id").cast("long").alias("contig"), F.col("orientation").alias("strand"))


@query(f"WITH {AGP} SELECT grp, count(*) FILTER (kind = 'W') AS contigs, count(*) FILTER (kind = 'U') AS gaps, max(end_pos) AS length, CAST(sum(CASE WHEN kind = 'W' THEN end_pos - start_pos + 1 ELSE 0 END) AS BIGINT) AS bases FROM ag GROUP BY grp")
def g41_agp_stats(t):
    a = tb.agp(t.tour_test, t.contigs)
    return a.groupBy("grp").agg(F.count_if(F.expr("kind = 'W'")).alias("contigs"), F.count_if(F.expr("kind = 'U'")).alias("gaps"), F.max("end_pos").alias("length"), F.sum(F.when(F.col("kind") == "W", F.col("end_pos") - F.col("start_pos") + 1).otherwise(0)).alias("bases"))


@query(f"WITH {PIXELS} SELECT * FROM px WHERE bin1_id <> bin2_id")
def g42_zero_diagonal(t):
    return pixels(t).where("bin1_id <> bin2_id")


@query(f"WITH {PIXELS} SELECT bin1_id, bin2_id, n FROM px UNION ALL SELECT bin2_id, bin1_id, n FROM px WHERE bin1_id <> bin2_id")
def u2_symmetrise(t):
    return c.symmetric(pixels(t))


# --- evaluation --------------------------------------------------------------------------------------------------------------------------------


def adjacency_sql(view: str, name: str) -> str:
    lead = f"SELECT contig AS a, strand AS s, lead(contig) OVER w AS b, lead(strand) OVER w AS u FROM {view} WINDOW w AS (PARTITION BY grp ORDER BY pos)"
    x, y = "a || CASE WHEN s = '+' THEN ':3' ELSE ':5' END", "b || CASE WHEN u = '+' THEN ':5' ELSE ':3' END"
    return f"{name} AS (SELECT DISTINCT least({x}, {y}) AS x, greatest({x}, {y}) AS y FROM ({lead}) WHERE b IS NOT NULL)"


PR = "SELECT tp, fp, fn, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / (tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1)) ELSE 0 END, 6) AS f1 FROM (SELECT (SELECT count(*) FROM (FROM tr INTERSECT FROM te)) AS tp, (SELECT count(*) FROM (FROM te EXCEPT FROM tr)) AS fp, (SELECT count(*) FROM (FROM tr EXCEPT FROM te)) AS fn)"


@query(f"WITH {adjacency_sql('tour_truth', 'tr')}, {adjacency_sql('tour_test', 'te')} {PR}")
def e1_end_adjacency(t):
    return tb.precision_recall(tb.end_adjacency(t.tour_truth), tb.end_adjacency(t.tour_test), "x", "y")


def neighbours_sql(view: str, name: str) -> str:
    return f"{name} AS (SELECT DISTINCT least(contig, b) AS x, greatest(contig, b) AS y FROM (SELECT contig, lead(contig) OVER (PARTITION BY grp ORDER BY pos) AS b FROM {view}) WHERE b IS NOT NULL)"


@query(
    f"WITH {neighbours_sql('tour_truth', 'tr')}, {neighbours_sql('tour_test', 'te')}, w AS (SELECT x, y, a.length + b.length AS w, (x, y) IN (SELECT (x, y) FROM tr) AS t, (x, y) IN (SELECT (x, y) FROM te) AS p FROM (FROM tr UNION FROM te) JOIN contigs a ON x = a.contig JOIN contigs b ON y = b.contig) "
    "SELECT CAST(sum(CASE WHEN t AND p THEN w ELSE 0 END) AS BIGINT) AS tp, round(sum(CASE WHEN t AND p THEN w ELSE 0 END) / sum(CASE WHEN p THEN w END), 6) AS precision, round(sum(CASE WHEN t AND p THEN w ELSE 0 END) / sum(CASE WHEN t THEN w END), 6) AS recall FROM w"
)
def e2_weighted_adjacency(t):
    return tb.weighted_adjacency(t.tour_truth, t.tour_test, t.contigs)


@query(f"WITH {neighbours_sql('tour_truth', 'tr')}, {neighbours_sql('tour_test', 'te')} {PR}")
def e3_id_adjacency(t):
    def n(tour):
        return tb.edges_lead(tour).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()

    return tb.precision_recall(n(t.tour_truth), n(t.tour_test), "x", "y")


ALIAS = "al AS (SELECT test_grp, truth_grp, n FROM (SELECT *, row_number() OVER (PARTITION BY test_grp ORDER BY n DESC, truth_grp) AS rn FROM (SELECT b.grp AS test_grp, a.grp AS truth_grp, count(*) AS n FROM tour_test b JOIN tour_truth a USING (contig) GROUP BY 1, 2)) WHERE rn = 1)"


@query(f"WITH {ALIAS} SELECT * FROM al")
def e4_group_alias(t):
    return tb.group_alias(t.tour_truth, t.tour_test)


@query(
    f"WITH {ALIAS}, j AS (SELECT al.truth_grp <> a.grp AS wrong, length FROM tour_test b JOIN tour_truth a USING (contig) JOIN al ON b.grp = al.test_grp JOIN contigs USING (contig)) SELECT count(*) AS contigs, count(*) FILTER (wrong) AS errors, CAST(sum(CASE WHEN wrong THEN length ELSE 0 END) AS BIGINT) AS error_bases, CAST(sum(length) AS BIGINT) AS bases FROM j"
)
def e5_grouping_errors(t):
    return tb.grouping_errors(t.tour_truth, t.tour_test, t.contigs)


@query(
    "WITH j AS (SELECT b.grp, count(*) AS contigs, count(*) FILTER (a.strand <> b.strand) AS differ FROM tour_test b JOIN tour_truth a USING (contig) GROUP BY b.grp) SELECT grp, contigs, differ * 2 > contigs AS flipped, CASE WHEN differ * 2 > contigs THEN contigs - differ ELSE differ END AS errors FROM j"
)
def e6_orientation_errors(t):
    return tb.orientation_errors(t.tour_truth, t.tour_test)


AGREE = (
    "pt AS (SELECT b.grp, a.grp AS truth, b.pos AS p, a.pos AS q, b.strand = a.strand AS same, length FROM tour_test b JOIN tour_truth a USING (contig) JOIN contigs USING (contig)), "
    "wy AS (SELECT w, grp, truth, p, CASE WHEN w IN ('back', 'back?') THEN -q ELSE q END AS q, length FROM pt, (VALUES ('on'), ('back'), ('on?'), ('back?')) v(w) WHERE w LIKE '%?' OR same = (w = 'on')), "
    "ch AS (SELECT w, grp, truth, p, q, 1 AS k, length AS bases FROM wy UNION SELECT c.w, c.grp, c.truth, n.p, n.q, c.k + 1, c.bases + n.length FROM ch c JOIN wy n ON c.w = n.w AND c.grp = n.grp AND c.truth = n.truth AND n.p > c.p AND n.q > c.q), "
    "tp AS (SELECT w, grp, truth, max(k) AS k, max(bases) AS bases FROM ch GROUP BY ALL), sz AS (SELECT grp, truth, count(*) AS n, CAST(sum(length) AS BIGINT) AS bases FROM pt GROUP BY ALL), "
    "al AS (SELECT grp, truth, n, bases FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, truth) AS rn FROM sz) WHERE rn = 1), "
    "bl AS (SELECT grp, coalesce(max(k) FILTER (w IN ('on', 'back')), 0) AS lcs, max(k) FILTER (w LIKE '%?') AS in_order FROM tp GROUP BY grp), "
    "ed AS (SELECT al.grp, al.n - coalesce(max(k) FILTER (w IN ('on', 'back')), 0) AS edits, CAST(al.bases - coalesce(max(tp.bases) FILTER (w IN ('on', 'back')), 0) AS BIGINT) AS weighted_edits, al.n - max(k) FILTER (w = 'on?') AS misplaced FROM al LEFT JOIN tp ON al.grp = tp.grp AND al.truth = tp.truth GROUP BY al.grp, al.n, al.bases), "
    "ag AS (SELECT t.grp, count(*) AS contigs, any_value(lcs) AS lcs, any_value(in_order) AS in_order, any_value(edits) AS edits, any_value(weighted_edits) AS weighted_edits, any_value(misplaced) AS misplaced FROM tour_test t LEFT JOIN bl USING (grp) LEFT JOIN ed USING (grp) GROUP BY t.grp)"
)


@query(f"WITH RECURSIVE {AGREE} SELECT grp, contigs, coalesce(lcs, 0) AS lcs, coalesce(in_order, 0) AS in_order, coalesce(edits, 0) AS edits, coalesce(weighted_edits, 0) AS weighted_edits, coalesce(misplaced, 0) AS misplaced FROM ag")
def e7_common_subsequence(t):
    from ..operators.evaluation import order_agreement

    return order_agreement(t.tour_truth, t.tour_test, t.contigs)


@query("SELECT c1, c2, x.n AS trans, round(x.n / CAST(x.n + p.n + q.n AS DOUBLE), 6) AS ratio FROM alleles JOIN contacts x ON x.contig1 = c1 AND x.contig2 = c2 JOIN contacts p ON p.contig1 = c1 AND p.contig2 = c1 JOIN contacts q ON q.contig1 = c2 AND q.contig2 = c2")
def e9_homolog_trans(t):
    from ..operators.evaluation import homolog_ratio

    return homolog_ratio(t.alleles, t.contacts).select("c1", "c2", "trans", r6("ratio").alias("ratio"))


@query(
    "WITH w AS (SELECT read_idx, frag, m.grp, m.grp <> lag(m.grp) OVER (PARTITION BY read_idx ORDER BY frag) AS changed FROM porec JOIN membership m USING (contig)), g AS (SELECT read_idx, grp, count(*) AS n FROM w GROUP BY ALL), m AS (SELECT read_idx, max(n) AS n FROM g GROUP BY read_idx) "
    "SELECT w.read_idx, count(*) AS windows, count(*) FILTER (changed) AS switches, count(*) - any_value(m.n) AS hamming FROM w JOIN m USING (read_idx) GROUP BY w.read_idx"
)
def e10_switch_errors(t):
    from ..operators.evaluation import switch_errors

    return switch_errors(t.porec.join(t.membership.select("contig", "grp"), "contig"))


CHAINED = "cw AS (SELECT read_name, chrom % 4 AS chain, read_start // 1000 AS win, mapq, nm, align_length AS length FROM paf)"


@query(
    f"WITH {CHAINED}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_name, chain, win ORDER BY nm, length, mapq) AS rn FROM cw) WHERE rn = 1), c AS (SELECT read_name, chain, count(*) FILTER (mapq >= 2) AS sure FROM f GROUP BY ALL), "
    "m AS (SELECT read_name, chain FROM (SELECT *, row_number() OVER (PARTITION BY read_name ORDER BY sure DESC, chain) AS rn FROM c) WHERE rn = 1), "
    "o AS (SELECT a.read_name, a.win, a.nm, a.length, (SELECT min(b.nm) FROM f b WHERE b.read_name = a.read_name AND b.win = a.win AND b.chain <> a.chain AND b.mapq >= 2) AS other FROM f a JOIN m USING (read_name, chain)) "
    "SELECT read_name, count(*) AS windows, count(*) FILTER (other < nm) AS switches, round(avg(CASE WHEN other < nm THEN CAST(nm - other AS DOUBLE) / length END), 6) AS rate FROM o GROUP BY read_name"
)
def e10_chain_switches(t):
    from ..operators.evaluation import chain_switches

    return chain_switches(t.paf.select("read_name", (F.col("chrom") % 4).alias("chain"), F.floor(F.col("read_start") / 1000).alias("win"), "mapq", "nm", F.col("align_length").alias("length")))


@query(
    "WITH f AS (SELECT contig AS chrom, start_pos, end_pos FROM porec), " + island_sql("f") + ", c AS (SELECT sum(end_pos - start_pos) / CAST(any_value(length) AS DOUBLE) AS r FROM islands JOIN contigs ON chrom = contig GROUP BY chrom), x AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS cut) SELECT cut, count(*) FILTER (r >= cut) AS contigs FROM x, c GROUP BY cut"
)
def e12_coverage_thresholds(t):
    from ..operators.evaluation import coverage_thresholds

    return coverage_thresholds(t.porec.select(F.col("contig").alias("chrom"), "start_pos", "end_pos"), t.contigs)


@query(
    "WITH p AS (SELECT contig1, contig2, n, similarity IS NOT NULL AS truth, n <= 40 AS called FROM contacts LEFT JOIN alleles ON contig1 = c1 AND contig2 = c2 WHERE contig1 <> contig2) SELECT count(*) FILTER (truth AND called) AS tp, count(*) FILTER (called AND NOT truth) AS fp, count(*) FILTER (truth AND NOT called) AS fn FROM p"
)
def e14_prune_evaluation(t):
    p = t.contacts.where("contig1 <> contig2").join(t.alleles.select(F.col("c1").alias("contig1"), F.col("c2").alias("contig2"), F.lit(True).alias("truth")), ["contig1", "contig2"], "left")
    truth, called = F.coalesce("truth", F.lit(False)), F.col("n") <= 40
    return p.agg(F.count_if(truth & called).alias("tp"), F.count_if(called & ~truth).alias("fp"), F.count_if(truth & ~called).alias("fn"))


@query("SELECT x.contig, sum(CASE WHEN contig1 = contig2 THEN n ELSE 0 END)::BIGINT AS cis, sum(CASE WHEN contig1 <> contig2 THEN n ELSE 0 END)::BIGINT AS trans FROM contigs x JOIN contacts ON x.contig = contig1 OR x.contig = contig2 GROUP BY x.contig")
def e14_cis_trans(t):
    cis = F.col("contig1") == F.col("contig2")
    ends = t.contacts.select(F.explode(F.when(cis, F.array("contig1")).otherwise(F.array("contig1", "contig2"))).alias("contig"), cis.alias("cis"), "n")
    return ends.groupBy("contig").agg(F.sum(F.when(F.col("cis"), F.col("n")).otherwise(0)).alias("cis"), F.sum(F.when(F.col("cis"), 0).otherwise(F.col("n"))).alias("trans"))


@query("WITH j AS (SELECT b.grp, a.grp AS truth, sum(length) AS bases FROM tour_test b JOIN tour_truth a USING (contig) JOIN contigs USING (contig) GROUP BY 1, 2) SELECT grp, round(max(bases) / CAST(sum(bases) AS DOUBLE), 6) AS purity, CAST(sum(bases) AS BIGINT) AS anchored FROM j GROUP BY grp")
def e15_group_purity(t):
    j = t.tour_test.select("contig", "grp").join(t.tour_truth.select("contig", F.col("grp").alias("truth")), "contig").join(t.contigs, "contig").groupBy("grp", "truth").agg(F.sum("length").alias("bases"))
    return j.groupBy("grp").agg(r6(F.max("bases") / F.sum("bases")).alias("purity"), F.sum("bases").alias("anchored"))


# --- sort, sample, sets ------------------------------------------------------------------------------------------------------------------------


@query("SELECT grp, CAST(sum(length) AS BIGINT) AS bases, row_number() OVER (ORDER BY sum(length) DESC, grp) AS rank FROM membership JOIN contigs USING (contig) GROUP BY grp")
def o2_sort_clusters(t):
    from pyspark.sql import Window

    s_ = t.membership.join(t.contigs, "contig").groupBy("grp").agg(F.sum("length").alias("bases"))
    return s_.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("bases"), "grp")).cast("long"))


@query("SELECT read_idx, frag, contig, start_pos FROM porec ORDER BY read_idx, frag")
def o3_sort_porec(t):
    return t.porec.select("read_idx", "frag", "contig", "start_pos").orderBy("read_idx", "frag")


@query("SELECT read_idx, chrom1, pos1, chrom2, pos2 FROM (SELECT *, md5('7:' || read_idx || ':' || chrom1 || ':' || pos1 || ':' || chrom2 || ':' || pos2) AS k FROM pairs) ORDER BY k, read_idx, chrom1, pos1, chrom2, pos2 LIMIT 5000")
def o5_downsample_pairs(t):
    from ..operators.samples import downsample_pairs

    return downsample_pairs(t.pairs, 5000, seed=7).select("read_idx", "chrom1", "pos1", "chrom2", "pos2")


@query("WITH n AS (SELECT read_idx, count(*) * (count(*) - 1) // 2 AS p, md5('7:' || read_idx) AS k FROM porec GROUP BY read_idx), r AS (SELECT *, sum(p) OVER (ORDER BY k, read_idx ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT read_idx, p AS pairs FROM r WHERE run <= 20000")
def o6_downsample_reads(t):
    from ..operators.samples import downsample_reads

    return downsample_reads(t.porec, 20_000, seed=7)


@query("SELECT count(*) AS n FROM pairs WHERE mapq >= 1 OR ('0x' || substr(md5('7:' || read_idx || ':' || chrom1 || ':' || pos1 || ':' || chrom2 || ':' || pos2), 1, 8))::BIGINT < 4294967296 * 0.3")
def o7_sample_low_mapq(t):
    from ..operators.samples import sample_low_mapq

    return sample_low_mapq(t.pairs, 0.3, seed=7).agg(F.count("*").alias("n"))


@query("SELECT read_name, chrom, start_pos, matches FROM (SELECT *, row_number() OVER (PARTITION BY read_name ORDER BY matches DESC, chrom, start_pos, line_id) AS rn FROM paf) WHERE rn <= 3")
def o8_top_fragments(t):
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("read_name").orderBy(F.desc("matches"), "chrom", "start_pos", "line_id"))
    return t.paf.withColumn("rn", rn).where("rn <= 3").select("read_name", "chrom", "start_pos", "matches")


@query("SELECT chrom1 AS contig1, chrom2 AS contig2, CAST(count(*) * 2 AS BIGINT) AS n FROM pairs GROUP BY 1, 2")
def u1_union_pairs(t):
    return c.contacts(t.pairs.unionByName(t.pairs))


@query("SELECT DISTINCT chrom1, chrom2, mapq FROM pairs")
def u3_distinct(t):
    return t.pairs.select("chrom1", "chrom2", "mapq").distinct()


@query("SELECT contig1, contig2 FROM contacts WHERE contig1 <> contig2 INTERSECT SELECT c1, c2 FROM alleles")
def u4_intersect(t):
    return t.contacts.where("contig1 <> contig2").select("contig1", "contig2").intersect(t.alleles.select("c1", "c2"))


@query("SELECT c1, c2 FROM alleles EXCEPT SELECT contig1, contig2 FROM contacts WHERE n >= 40")
def u4_except(t):
    return t.alleles.select("c1", "c2").subtract(t.contacts.where("n >= 40").select("contig1", "contig2"))


@query(
    "WITH s AS (SELECT DISTINCT read_name, chrom FROM paf WHERE mapq >= 30), n AS (SELECT read_name, count(*) AS n FROM s GROUP BY read_name), o AS (SELECT a.read_name, b.read_name AS other, count(*) AS k FROM s a JOIN s b ON a.chrom = b.chrom AND a.read_name <> b.read_name GROUP BY 1, 2) "
    "SELECT DISTINCT o.read_name FROM o JOIN n a ON o.read_name = a.read_name JOIN n b ON o.other = b.read_name WHERE k = a.n AND (a.n < b.n OR o.other < o.read_name)"
)
def u5_subset_rows(t):
    from ..operators.samples import subset_rows

    return subset_rows(t.paf.where("mapq >= 30").select("read_name", F.col("chrom").alias("member")).distinct())


@query(f"WITH {HE} SELECT contig, CAST(sum(cnt) + 2 * sum(CASE WHEN read_idx % 7 = 0 THEN cnt ELSE 0 END) AS BIGINT) AS n FROM he GROUP BY contig")
def u6_weighted_merge(t):
    from ..operators.samples import weighted_union

    he = incidence(t)
    return weighted_union(he, he.where("read_idx % 7 = 0"), 2).groupBy("contig").agg(F.sum("cnt").alias("n"))


@query("SELECT c1, c2, CAST(min(type) AS INTEGER) AS type FROM (SELECT c1, c2, 0 AS type FROM alleles WHERE similarity >= 0.8 UNION ALL SELECT c1, c2, 1 FROM alleles) GROUP BY c1, c2")
def u7_merge_prune(t):
    from ..operators.samples import merged_prune

    a = t.alleles.select("c1", "c2")
    return merged_prune(t.alleles.where("similarity >= 0.8").select("c1", "c2").withColumn("type", F.lit(0)), a.withColumn("type", F.lit(1)))
