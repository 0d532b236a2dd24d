"""Queries of the filters, joins and interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as f
from ..operators import intervals as iv
from ..operators.common import r6
from .registry import query

PAIR_COLUMNS = "read_idx, chrom1, pos1, chrom2, pos2, strand1, strand2, mapq"
POREC = "read_idx, frag, contig, start_pos, end_pos, mapq"


def bed(t):
    return t.hcr


@query("SELECT * FROM pairs WHERE mapq >= 10")
def f1_mapq_filter(t):
    return f.mapq_at_least(t.pairs, 10)


@query(
    "SELECT p.* FROM pairs p JOIN contigs a ON chrom1 = a.contig JOIN contigs b ON chrom2 = b.contig "
    "WHERE (pos1 < 20000 OR pos1 > a.length - 20000) AND (pos2 < 20000 OR pos2 > b.length - 20000)"
)
def f2_edge_length_pairs(t):
    return f.pairs_near_ends(t.pairs, t.contigs, 20_000)


@query(f"SELECT {POREC} FROM porec WHERE start_pos + (end_pos - start_pos) // 2 < 20000 OR contig_length - (start_pos + (end_pos - start_pos) // 2) < 20000")
def f3_edge_length_porec(t):
    return f.fragments_near_ends(t.porec, 20_000).select(*POREC.split(", "))


SPLIT = "s AS (SELECT contig, length, CAST(ceil(length / 30000) AS BIGINT) AS pieces, CAST(coalesce(sum(CAST(ceil(length / 30000) AS BIGINT)) OVER (ORDER BY contig ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_id FROM contigs)"


@query(f"WITH {SPLIT} SELECT read_idx, a.first_id + pos1 // 30000 AS id1, b.first_id + pos2 // 30000 AS id2 FROM pairs JOIN s a ON chrom1 = a.contig JOIN s b ON chrom2 = b.contig")
def f4_split_contig(t):
    pieces = f.split_contigs(t.contigs, 30_000)
    one, two = pieces.select(F.col("contig").alias("chrom1"), F.col("first_id").alias("f1")), pieces.select(F.col("contig").alias("chrom2"), F.col("first_id").alias("f2"))
    return t.pairs.join(one, "chrom1").join(two, "chrom2").select("read_idx", (F.col("f1") + F.floor(F.col("pos1") / 30_000)).alias("id1"), (F.col("f2") + F.floor(F.col("pos2") / 30_000)).alias("id2"))


IN1 = "EXISTS (SELECT 1 FROM hcr WHERE chrom = chrom1 AND start_pos <= pos1 AND pos1 < end_pos)"
IN2 = "EXISTS (SELECT 1 FROM hcr WHERE chrom = chrom2 AND start_pos <= pos2 AND pos2 < end_pos)"


@query(f"SELECT * FROM pairs WHERE {IN1} OR {IN2}")
def f5_region_any(t):
    return f.pairs_in_region_any(t.pairs, bed(t))


@query(f"SELECT * FROM pairs WHERE NOT ({IN1} OR {IN2})")
def f5_region_any_invert(t):
    return f.pairs_in_region_any(t.pairs, bed(t), invert=True)


MID = "start_pos + (end_pos - start_pos) // 2"


@query(f"SELECT {POREC} FROM porec p WHERE EXISTS (SELECT 1 FROM hcr h WHERE h.chrom = p.contig AND h.start_pos <= p.start_pos + (p.end_pos - p.start_pos) // 2 AND p.start_pos + (p.end_pos - p.start_pos) // 2 < h.end_pos)")
def f6_region_porec(t):
    return f.fragments_in_region(t.porec, bed(t)).select(*POREC.split(", "))


@query(f"SELECT * FROM pairs WHERE {IN1} AND {IN2}")
def f7_region_both(t):
    return f.pairs_in_region_both(t.pairs, bed(t))


@query(f"SELECT * FROM pairs WHERE NOT ({IN1} AND {IN2})")
def f7_region_both_invert(t):
    return f.pairs_in_region_both(t.pairs, bed(t), invert=True)


@query("SELECT p.read_idx, p.frag, p.contig, p.start_pos, p.end_pos FROM porec p JOIN hcr h ON p.contig = h.chrom AND p.start_pos < h.end_pos AND h.start_pos < p.end_pos")
def f8_porec_intersect(t):
    h = t.hcr.select(F.col("chrom").alias("b_chrom"), F.col("start_pos").alias("b_start"), F.col("end_pos").alias("b_end"))
    return iv.overlap_join(t.porec, h, a_key="contig", a_start="start_pos", a_end="end_pos").select("read_idx", "frag", "contig", "start_pos", "end_pos")


LOW = "(mapq < 5 OR identity < 0.82 OR end_pos - start_pos < 120)"


@query(f"SELECT read_idx, frag, NOT {LOW} AS pass_filter, CASE WHEN {LOW} THEN 'low_mq' ELSE 'pass' END AS filter_reason FROM porec")
def f9_low_mq(t):
    return f.low_quality_flag(t.porec, 5, 0.82, 120).select("read_idx", "frag", "pass_filter", "filter_reason")


@query(
    f"WITH q AS (SELECT read_idx, frag, NOT {LOW} AS ok FROM porec), n AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY read_idx) AS k FROM q) "
    "SELECT read_idx, frag, ok AND k <> 1 AS pass_filter, CASE WHEN NOT ok THEN 'low_mq' WHEN k = 1 THEN 'singleton' ELSE 'pass' END AS filter_reason FROM n"
)
def f10_singleton(t):
    return f.singleton_flag(f.low_quality_flag(t.porec, 5, 0.82, 120)).select("read_idx", "frag", "pass_filter", "filter_reason")


@query(f"SELECT {POREC} FROM porec WHERE read_idx IN (SELECT read_idx FROM porec GROUP BY read_idx HAVING count(DISTINCT contig) BETWEEN 2 AND 50)")
def f11_order(t):
    return f.order_between(t.porec, 2, 50).select(*POREC.split(", "))


@query("SELECT p.* FROM pairs p WHERE chrom1 IN (SELECT contig FROM contigs WHERE length >= 120000) AND chrom2 IN (SELECT contig FROM contigs WHERE length >= 120000) AND chrom1 % 10 <> 3 AND chrom2 % 10 <> 3")
def f12_contig_lists(t):
    long = f.only_contigs(t.pairs, t.contigs.where("length >= 120000"), "chrom1", "chrom2")
    return f.without_contigs(long, t.contigs.where("contig % 10 = 3"), "chrom1", "chrom2").select(*PAIR_COLUMNS.split(", "))


HE = "he AS (SELECT read_idx, contig, count(*) AS cnt FROM porec WHERE mapq >= 1 GROUP BY read_idx, contig)"


def incidence(t):
    return t.porec.where("mapq >= 1").repartition("read_idx").groupBy("read_idx", "contig").agg(F.count("*").alias("cnt"))


@query(f"WITH {HE}, a AS (SELECT * FROM he WHERE contig IN (SELECT contig FROM he GROUP BY contig HAVING sum(cnt) >= 25)) SELECT * FROM a WHERE read_idx IN (SELECT read_idx FROM a GROUP BY read_idx HAVING sum(cnt) >= 2)")
def f13_min_contacts(t):
    return f.min_contacts(incidence(t), 25)


@query(f"WITH {HE} SELECT * FROM he WHERE contig NOT IN (SELECT contig FROM contigs WHERE length < 110000)")
def f14_remove_rows(t):
    return f.without_contigs(incidence(t), t.contigs.where("length < 110000"), "contig")


@query(f"WITH {HE}, a AS (SELECT he.* FROM he JOIN contigs USING (contig) WHERE length >= 110000) SELECT * FROM a WHERE read_idx IN (SELECT read_idx FROM a GROUP BY read_idx HAVING sum(cnt) > 1)")
def f15_extract_incidence(t):
    left = f.only_contigs(incidence(t), t.contigs.where("length >= 110000"), "contig")
    return left.join(left.groupBy("read_idx").agg(F.sum("cnt").alias("n")).where("n > 1").select("read_idx"), "read_idx", "left_semi")


DEGREE = "d AS (SELECT contig, length, degree, degree / length * 1e4 AS density FROM (SELECT contig1 AS contig, sum(n) AS degree FROM (SELECT contig1, n FROM contacts UNION ALL SELECT contig2, n FROM contacts) GROUP BY contig1) JOIN contigs USING (contig))"


def degrees(t):
    ends = t.contacts.select(F.col("contig1").alias("contig"), "n").unionAll(t.contacts.select("contig2", "n"))
    return ends.groupBy("contig").agg(F.sum("n").alias("degree")).join(t.contigs, "contig")


@query(f"WITH {DEGREE} SELECT contig, CAST(degree AS BIGINT) AS degree, round(density, 6) AS density FROM d WHERE density BETWEEN (SELECT quantile_cont(density, 0.01) FROM d) AND (SELECT quantile_cont(density, 0.95) FROM d)")
def f16_degree_percentile(t):
    return f.degrees_in_range(degrees(t), 0.95, 0.01).select("contig", "degree", r6("density").alias("density"))


@query(f"WITH {DEGREE}, m AS (SELECT median(density) AS med FROM d), e AS (SELECT d.*, abs(density - med) AS dev FROM d, m) SELECT contig, CAST(degree AS BIGINT) AS degree FROM e WHERE dev * 0.6745 <= (SELECT median(dev) FROM e) * 1.5")
def f16_degree_mad(t):
    return f.degrees_by_mad(degrees(t), 1.5).select("contig", "degree")


@query("SELECT contig1 AS contig, n FROM contacts WHERE contig1 = contig2 AND n >= 20")
def f17_cis_weight(t):
    return t.contacts.where("contig1 = contig2 AND n >= 20").select(F.col("contig1").alias("contig"), "n")


@query("SELECT m.contig, m.grp FROM membership m WHERE grp IN (SELECT grp FROM membership JOIN contigs USING (contig) GROUP BY grp HAVING sum(length) >= 450000)")
def f19_group_length(t):
    return f.long_groups(t.membership.select("contig", "grp"), t.contigs, 450_000).select("contig", "grp")


@query(
    "SELECT a.c1, a.c2, round(similarity, 6) AS similarity FROM alleles a JOIN contigs x ON c1 = x.contig JOIN contigs y ON c2 = y.contig "
    "WHERE similarity > 0.8 AND (abs(x.length - y.length) <= 0.2 * greatest(x.length, y.length) OR abs(mz1 - mz2) <= 0.2 * greatest(mz1, mz2))"
)
def f20_similar_pairs(t):
    return f.similar_pairs(t.alleles, t.contigs, 0.8).select("c1", "c2", r6("similarity").alias("similarity"))


@query(
    "SELECT a.c1, a.c2, x.n AS trans, round(x.n / sqrt(p.n * q.n), 6) AS score FROM alleles a JOIN contacts x ON a.c1 = x.contig1 AND a.c2 = x.contig2 "
    "JOIN contacts p ON p.contig1 = a.c1 AND p.contig2 = a.c1 JOIN contacts q ON q.contig1 = a.c2 AND q.contig2 = a.c2 WHERE x.n / sqrt(p.n * q.n) >= 0.5"
)
def f21_homolog_noise(t):
    return f.homolog_noise(t.alleles, t.contacts, 0.5).select("c1", "c2", "trans", r6("score").alias("score"))


@query("SELECT line_id, read_name, chrom, matches FROM paf WHERE matches / align_length >= 0.88 AND mapq >= 2 AND dv <= 0.08 AND matches >= 500")
def f22_alignment_cutoffs(t):
    return t.paf.where("matches / align_length >= 0.88 AND mapq >= 2 AND dv <= 0.08 AND matches >= 500").select("line_id", "read_name", "chrom", "matches")


@query(
    "SELECT line_id, read_name, chrom, CASE WHEN read_start < 5000 THEN 0 ELSE read_start END AS read_start, CASE WHEN read_length - read_end < 5000 THEN read_length ELSE read_end END AS read_end, "
    "CASE WHEN start_pos < 5000 THEN 0 ELSE start_pos END AS start_pos, CASE WHEN chrom_length - end_pos < 5000 THEN chrom_length ELSE end_pos END AS end_pos FROM paf "
    "WHERE (read_start < 5000 OR read_length - read_end < 5000) AND (start_pos < 5000 OR chrom_length - end_pos < 5000)"
)
def f23_terminal_overlaps(t):
    return f.terminal_overlaps(t.paf, 5000).select("line_id", "read_name", "chrom", "read_start", "read_end", "start_pos", "end_pos")


@query("SELECT c1, c2 FROM alleles WHERE c1 IN (SELECT contig FROM contigs WHERE length >= 120000) AND c2 IN (SELECT contig FROM contigs WHERE length >= 120000)")
def f24_whitelist_pairs(t):
    return f.only_contigs(t.alleles, t.contigs.where("length >= 120000"), "c1", "c2").select("c1", "c2")


@query(
    "WITH r AS (SELECT length, sum(length) OVER (ORDER BY length DESC, contig ROWS UNBOUNDED PRECEDING) AS run, sum(length) OVER () AS total FROM contigs) "
    "SELECT contig, length FROM contigs WHERE length >= (SELECT max(length) FROM r WHERE run >= floor(total * 50 / 100))"
)
def f25_above_n50(t):
    return f.above_nx(t.contigs, 50)


# --- joins -------------------------------------------------------------------------------------------------------------------------------------


@query("WITH i AS (SELECT contig, row_number() OVER (ORDER BY contig) - 1 AS idx FROM contigs) SELECT read_idx, a.idx AS idx1, b.idx AS idx2 FROM pairs JOIN i a ON chrom1 = a.contig JOIN i b ON chrom2 = b.contig")
def j1_contig_index(t):
    from pyspark.sql import Window

    i = t.contigs.select("contig", (F.row_number().over(Window.orderBy("contig")) - 1).cast("long").alias("idx"))
    one, two = i.select(F.col("contig").alias("chrom1"), F.col("idx").alias("idx1")), i.select(F.col("contig").alias("chrom2"), F.col("idx").alias("idx2"))
    return t.pairs.join(one, "chrom1").join(two, "chrom2").select("read_idx", "idx1", "idx2")


@query("SELECT read_idx, frag, p.contig, length FROM porec p LEFT JOIN (SELECT * FROM contigs WHERE length >= 110000) c ON p.contig = c.contig")
def j2_lookup(t):
    return t.porec.join(t.contigs.where("length >= 110000"), "contig", "left").select("read_idx", "frag", "contig", "length")


@query(
    "SELECT p.read_idx, p.frag, p.contig, p.start_pos AS pos, h.start_pos AS iv_start, h.end_pos AS iv_end FROM porec p "
    "ASOF LEFT JOIN hcr h ON p.contig = h.chrom AND p.start_pos >= h.start_pos"
)
def j3_asof_backward(t):
    starts = t.hcr.select(F.col("chrom").alias("contig"), F.col("start_pos").alias("iv_start"), F.col("end_pos").alias("iv_end"))
    points = t.porec.select("read_idx", "frag", "contig", F.col("start_pos").alias("pos"))
    return iv.asof_backward(points, starts, "contig", "pos", "iv_start", ["iv_end"])


@query("SELECT p.read_idx, p.frag, p.contig, h.start_pos AS iv_start FROM porec p JOIN hcr h ON p.contig = h.chrom AND h.start_pos <= p.start_pos AND p.start_pos < h.end_pos")
def j4_point_in_interval(t):
    return iv.covering(t.porec.select("read_idx", "frag", "contig", F.col("start_pos").alias("pos")), t.hcr, "contig", "pos").where("iv_start is not null").select("read_idx", "frag", "contig", "iv_start")


@query("SELECT p.line_id, p.chrom, p.start_pos AS a_start, h.start_pos AS b_start FROM paf p JOIN hcr h ON p.chrom = h.chrom AND p.start_pos < h.end_pos AND h.start_pos < p.end_pos")
def j5_overlap_join(t):
    a = t.paf.select("line_id", "chrom", F.col("start_pos").alias("a_start"), F.col("end_pos").alias("a_end"))
    b = t.hcr.select(F.col("chrom").alias("b_chrom"), F.col("start_pos").alias("b_start"), F.col("end_pos").alias("b_end"))
    return iv.overlap_join(a, b).select("line_id", "chrom", "a_start", "b_start")


BINS = "w AS (SELECT contig AS chrom, s AS start_pos, least(s + 10000, length) AS end_pos FROM (SELECT contig, length, unnest(generate_series(0, length - 1, 10000)) AS s FROM contigs))"


def bins(t, size=10_000, step=10_000):
    return iv.windows(t.contigs.select(F.col("contig").alias("chrom"), "length"), size, step)


@query(
    f"WITH {BINS} SELECT w.chrom, h.start_pos AS a_start, w.start_pos AS b_start, least(h.end_pos, w.end_pos) - greatest(h.start_pos, w.start_pos) AS overlap FROM hcr h JOIN w ON h.chrom = w.chrom "
    "AND h.start_pos < w.end_pos AND w.start_pos < h.end_pos WHERE least(h.end_pos, w.end_pos) - greatest(h.start_pos, w.start_pos) >= 0.5 * (w.end_pos - w.start_pos)"
)
def j6_overlap_fraction(t):
    return iv.overlap_fraction(t.hcr, bins(t), 0.5).select("chrom", "a_start", "b_start", "overlap")


SLIDING = "w AS (SELECT contig AS chrom, s AS start_pos, least(s + 1000, length) AS end_pos FROM (SELECT contig, length, unnest(generate_series(0, length - 1, 500)) AS s FROM contigs))"


@query(
    f"WITH {SLIDING} SELECT w.chrom, w.start_pos, w.end_pos, count(p.line_id) AS n FROM w LEFT JOIN paf p ON p.chrom = w.chrom AND p.start_pos < w.end_pos AND w.start_pos < p.end_pos "
    "AND least(p.end_pos, w.end_pos) - greatest(p.start_pos, w.start_pos) >= 0.5 * (w.end_pos - w.start_pos) GROUP BY ALL"
)
def j7_window_count(t):
    return iv.window_counts(bins(t, 1000, 500), t.paf)


@query(f"WITH {BINS} SELECT h.chrom, greatest(h.start_pos, w.start_pos) AS start_pos, least(h.end_pos, w.end_pos) AS end_pos FROM hcr h JOIN w ON h.chrom = w.chrom AND h.start_pos < w.end_pos AND w.start_pos < h.end_pos")
def j8_intersection(t):
    return iv.intersections(t.hcr, bins(t))


@query(f"WITH {BINS} SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM hcr h WHERE h.chrom = w.chrom AND h.start_pos < w.end_pos AND w.start_pos < h.end_pos)")
def j9_interval_anti(t):
    return iv.anti(bins(t), t.hcr).select("chrom", "start_pos", "end_pos")


def island_sql(source: str, slack: int = 0) -> str:
    return (
        f"m1 AS (SELECT chrom, start_pos, end_pos, max(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {source}), "
        f"m2 AS (SELECT *, sum(CASE WHEN before IS NULL OR start_pos > before + {slack} THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS island FROM m1), "
        "islands AS (SELECT chrom, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM m2 GROUP BY chrom, island)"
    )


FRAGMENTS = "fr AS (SELECT contig AS chrom, start_pos, end_pos FROM porec)"


def fragments(t):
    return t.porec.select(F.col("contig").alias("chrom"), "start_pos", "end_pos")


@query(
    f"WITH {FRAGMENTS}, {island_sql('fr')}, g AS (SELECT chrom, coalesce(lag(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos), 0) AS a, start_pos AS b FROM islands UNION ALL "
    "SELECT c.contig, coalesce(e, 0), length FROM contigs c LEFT JOIN (SELECT chrom, max(end_pos) AS e FROM islands GROUP BY chrom) ON chrom = c.contig) "
    "SELECT chrom, a AS start_pos, b AS end_pos FROM g WHERE a < b"
)
def j10_interval_subtract(t):
    return iv.subtract(t.contigs.select(F.col("contig").alias("chrom"), "length"), fragments(t))


@query(f"WITH {FRAGMENTS}, {island_sql('fr')} SELECT * FROM islands")
def j11_interval_merge(t):
    return iv.merge(fragments(t))


@query(f"WITH {FRAGMENTS}, {island_sql('fr', 200)} SELECT * FROM islands")
def j11_interval_merge_slack(t):
    return iv.merge(fragments(t), slack=200)


@query(
    "SELECT a.read_idx, a.contig AS chrom1, a.start_pos + (a.end_pos - a.start_pos) // 2 AS pos1, b.contig AS chrom2, b.start_pos + (b.end_pos - b.start_pos) // 2 AS pos2, "
    "a.strand AS strand1, b.strand AS strand2 FROM porec a JOIN porec b ON a.read_idx = b.read_idx AND a.frag < b.frag"
)
def j12_concatemer_pairs(t):
    from ..operators.contacts import expand_pairs

    return expand_pairs(t.porec)


@query("WITH i AS (SELECT c.contig AS c1, d.contig AS c2 FROM contigs c, contigs d WHERE c.contig < d.contig) SELECT c1, c2, coalesce(n, 0) AS n FROM i LEFT JOIN contacts ON c1 = contig1 AND c2 = contig2")
def j14_symmetric_reindex(t):
    from ..operators.contacts import reindex_pairs

    return reindex_pairs(t.contigs, t.contacts)


@query("SELECT DISTINCT contig FROM membership WHERE contig IN (SELECT c1 FROM alleles) AND contig NOT IN (SELECT c2 FROM alleles)")
def j15_semi_anti(t):
    m = t.membership.select("contig").distinct()
    return m.join(t.alleles.select(F.col("c1").alias("contig")), "contig", "left_semi").join(t.alleles.select(F.col("c2").alias("contig")), "contig", "left_anti")


CHROM_PAIRS = (
    "cp AS (SELECT read_idx, a.chrom AS chrom1, a.chrom_start + pos1 - 1 AS p1, b.chrom AS chrom2, b.chrom_start + pos2 - 1 AS p2, mapq FROM pairs JOIN chroms a ON chrom1 = a.contig JOIN chroms b ON chrom2 = b.contig)"
)


@query(
    f"WITH {CHROM_PAIRS} SELECT read_idx, least((x.contig, p1 - x.chrom_start + 1), (y.contig, p2 - y.chrom_start + 1))[1] AS contig1, least((x.contig, p1 - x.chrom_start + 1), (y.contig, p2 - y.chrom_start + 1))[2] AS pos1, "
    "greatest((x.contig, p1 - x.chrom_start + 1), (y.contig, p2 - y.chrom_start + 1))[1] AS contig2, greatest((x.contig, p1 - x.chrom_start + 1), (y.contig, p2 - y.chrom_start + 1))[2] AS pos2 "
    "FROM cp JOIN chroms x ON x.chrom = chrom1 AND x.chrom_start <= p1 AND p1 < x.chrom_end JOIN chroms y ON y.chrom = chrom2 AND y.chrom_start <= p2 AND p2 < y.chrom_end"
)
def j16_chrom2contig_pairs(t):
    from ..operators.contacts import chrom_to_contig

    one = t.chroms.select(F.col("contig").alias("chrom1"), F.col("chrom").alias("k1"), F.col("chrom_start").alias("s1"))
    two = t.chroms.select(F.col("contig").alias("chrom2"), F.col("chrom").alias("k2"), F.col("chrom_start").alias("s2"))
    on_chroms = t.pairs.join(one, "chrom1").join(two, "chrom2").select("read_idx", F.col("k1").alias("chrom1"), (F.col("s1") + F.col("pos1") - 1).alias("pos1"), F.col("k2").alias("chrom2"), (F.col("s2") + F.col("pos2") - 1).alias("pos2"))
    return chrom_to_contig(on_chroms, t.chroms)


@query(
    "WITH f AS (SELECT read_idx, frag, chrom, chrom_start + start_pos + 60000 AS a, chrom_start + end_pos + 90000 AS b, (frag - 1) * 40000 AS read_start FROM porec JOIN chroms USING (contig)) "
    "SELECT read_idx, frag, c.contig, greatest(a, c.chrom_start) - c.chrom_start AS start_pos, least(b, c.chrom_end) - c.chrom_start AS end_pos, read_start + greatest(a, c.chrom_start) - a AS read_start, read_start + least(b, c.chrom_end) - a AS read_end "
    "FROM f JOIN chroms c ON f.chrom = c.chrom AND a < c.chrom_end AND c.chrom_start < b"
)
def j17_chrom2contig_porec(t):
    from ..operators.contacts import split_fragments

    f_ = t.porec.join(t.chroms.select("contig", "chrom", "chrom_start"), "contig").select(
        "read_idx", "frag", "chrom", (F.col("chrom_start") + F.col("start_pos") + 60_000).alias("a_start"), (F.col("chrom_start") + F.col("end_pos") + 90_000).alias("a_end"), ((F.col("frag") - 1) * 40_000).alias("read_start")
    )
    return split_fragments(f_, t.chroms)


@query(f"SELECT read_idx, frag, contig, ({MID}) // 10000 * 10000 AS start_pos, least((({MID}) // 10000 + 1) * 10000, contig_length) AS end_pos FROM porec")
def j18_binnify(t):
    b = F.floor(f.midpoint() / 10_000)
    return t.porec.select("read_idx", "frag", "contig", (b * 10_000).alias("start_pos"), F.least((b + 1) * 10_000, F.col("contig_length")).alias("end_pos"))


@query(
    f"WITH p AS (SELECT read_idx, frag, contig, contig_length, least(({MID}) // (contig_length // 5), 4) AS k FROM porec) SELECT read_idx, frag, contig, k, k * (contig_length // 5) AS start_pos, CASE WHEN k = 4 THEN contig_length ELSE (k + 1) * (contig_length // 5) END AS end_pos FROM p"
)
def j18_n_parts(t):
    part = F.floor(F.col("contig_length") / 5)
    k = F.least(F.floor(f.midpoint() / part), F.lit(4))
    return t.porec.select("read_idx", "frag", "contig", k.alias("k"), (k * part).alias("start_pos"), F.when(k == 4, F.col("contig_length")).otherwise((k + 1) * part).alias("end_pos"))


@query(
    f"WITH {BINS}, d AS (SELECT chrom1 AS chrom, pos1 // 10000 * 10000 AS start_pos, count(*) AS n FROM pairs GROUP BY ALL), r AS (SELECT chrom, start_pos, (chrom + start_pos // 10000) % 5 AS sites FROM w) "
    "SELECT d.chrom, d.start_pos, round(d.n / (r.sites + 1), 6) AS depth FROM d JOIN r ON d.chrom = r.chrom AND d.start_pos = r.start_pos"
)
def j19_depth_normalise(t):
    d = t.pairs.groupBy(F.col("chrom1").alias("chrom"), (F.floor(F.col("pos1") / 10_000) * 10_000).alias("start_pos")).agg(F.count("*").alias("n"))
    r = bins(t).select("chrom", "start_pos", ((F.col("chrom") + F.floor(F.col("start_pos") / 10_000)) % 5).alias("sites"))
    return d.join(r, ["chrom", "start_pos"]).select("chrom", "start_pos", r6(F.col("n") / (F.col("sites") + 1)).alias("depth"))


@query("SELECT a.contig AS gene1, a.grp AS chrom1, a.pos AS pos1, b.contig AS gene2, b.grp AS chrom2, b.pos AS pos2 FROM tour_truth a JOIN alleles x ON a.contig = x.c1 JOIN tour_test b ON b.contig = x.c2")
def j20_anchor_join(t):
    a = t.tour_truth.select(F.col("contig").alias("gene1"), F.col("grp").alias("chrom1"), F.col("pos").alias("pos1"))
    b = t.tour_test.select(F.col("contig").alias("gene2"), F.col("grp").alias("chrom2"), F.col("pos").alias("pos2"))
    return t.alleles.select(F.col("c1").alias("gene1"), F.col("c2").alias("gene2")).join(a, "gene1").join(b, "gene2")


@query("SELECT c1, c2, n FROM alleles JOIN contacts ON c1 = contig1 AND c2 = contig2")
def j21_homolog_lookup(t):
    return t.alleles.join(t.contacts, (F.col("c1") == F.col("contig1")) & (F.col("c2") == F.col("contig2"))).select("c1", "c2", "n")
