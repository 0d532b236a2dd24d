"""Hand-checked values and invariants of the operators."""

import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.functions import units
from skein.operators import contacts as c
from skein.operators import graph as g
from skein.operators import intervals as iv
from skein.operators import signals, scoring
from skein.operators import tables as tb
from skein.sources import sinks, text


def frame(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


def test_clique_by_hand(spark):
    h = frame(spark, "read_idx int, contig string, cnt int", (1, "A", 1), (1, "B", 1), (1, "C", 1), (2, "A", 1), (2, "B", 1))
    got = {(r.src, r.dst): r.w for r in c.clique(h).collect()}
    assert got == {("A", "A"): 1.5, ("A", "B"): 1.5, ("A", "C"): 0.5, ("B", "B"): 1.5, ("B", "C"): 0.5, ("C", "C"): 0.5}


def test_orientation_distances(spark):
    pairs = frame(spark, "chrom1 int, pos1 long, chrom2 int, pos2 long", (1, 10, 2, 50))
    contigs = frame(spark, "contig int, length long", (1, 100), (2, 200))
    assert {r.orientation: r.d for r in c.distances(pairs, contigs).collect()} == {"++": 140, "+-": 240, "-+": 60, "--": 160}


def test_pixels_swap_and_depth(spark):
    pairs = frame(spark, "chrom1 int, pos1 long, chrom2 int, pos2 long", (2, 35, 1, 31), (1, 5, 1, 15))
    contigs = frame(spark, "contig int, length long", (1, 40), (2, 40))
    assert sorted(map(tuple, c.pixels(pairs, contigs, 10).collect())) == [(0, 1, 1), (3, 7, 1)]
    one = frame(spark, "chrom1 int, pos1 long, chrom2 int, pos2 long", (1, 5, 1, 15))
    got = c.depth(one, frame(spark, "contig int, length long", (1, 18)), 10).orderBy("start_pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, 10, 1), (1, 10, 18, 1)]


def test_cis_coverage(spark):
    pairs = frame(spark, "chrom1 int, pos1 long, chrom2 int, pos2 long", (1, 1, 1, 1001))
    got = c.cis_coverage(pairs, frame(spark, "contig int, length long", (1, 2000)), 500).orderBy("w").collect()
    assert [r.n for r in got] == [1, 1, 1, 0]


def test_merge_and_subtract(spark):
    bed = frame(spark, "chrom string, start_pos long, end_pos long", ("a", 0, 10), ("a", 5, 20), ("a", 30, 40), ("a", 40, 45))
    assert sorted(map(tuple, iv.merge(bed).collect())) == [("a", 0, 20), ("a", 30, 45)]
    gaps = iv.subtract(frame(spark, "chrom string, length long", ("a", 50), ("b", 5)), bed)
    assert sorted(map(tuple, gaps.collect())) == [("a", 20, 30), ("a", 45, 50), ("b", 0, 5)]


def test_n50(spark):
    contigs = frame(spark, "contig int, length long", *enumerate((10, 8, 6, 4, 2)))
    assert {r.x: (r.nx, r.lx) for r in tb.nx(contigs, (50,)).collect()} == {50: (8, 2)}


def test_digest_by_hand(spark):
    seqs = frame(spark, "contig int, seq string", (1, "aagcaaagcgggatcgatc"))
    assert [(r.start_pos, r.end_pos) for r in tb.digest(seqs, "gatc").orderBy("i").collect()] == [(0, 13), (13, 17), (17, 19)]


def test_adjacency_by_hand(spark):
    ddl = "grp int, pos int, contig string, strand string"
    truth = frame(spark, ddl, (1, 1, "A", "+"), (1, 2, "B", "+"), (1, 3, "C", "-"))
    test = frame(spark, ddl, (1, 1, "A", "+"), (1, 2, "B", "+"), (1, 3, "C", "+"))
    assert tuple(tb.precision_recall(tb.end_adjacency(truth), tb.end_adjacency(test), "x", "y").first()) == (1, 1, 1, 0.5, 0.5, 0.5)


def test_reweight_by_hand(spark):
    rows = [(1, i, grp) for i, grp in enumerate(sum([[k] * n for k, n in enumerate((3, 4, 1, 4, 5))], []))]
    inc = frame(spark, "read_idx int, contig int, cnt int", *[(r, k, 1) for r, k, _ in rows])
    mem = frame(spark, "contig int, grp int", *[(k, grp) for _, k, grp in rows])
    assert scoring.edge_reweight(inc, mem).first().weight == pytest.approx(0.851961, abs=1e-6)


def test_weak_contacts_by_hand(spark):
    alleles = frame(spark, "c1 long, c2 long", (1, 3), (2, 4))
    strong = frame(spark, "contig1 long, contig2 long, n long", (1, 2, 5), (3, 4, 4), (1, 4, 1), (2, 3, 1))
    assert {(r.c1, r.c2) for r in scoring.weak_2x2(strong, alleles).collect()} == {(1, 4), (2, 3)}
    assert {(r.c1, r.c2) for r in scoring.weak_matching(strong, alleles).collect()} == {(1, 4), (2, 3)}


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 5), st.integers(0, 3), st.integers(0, 10_000))
def test_hungarian_is_optimal(n, more, seed):
    from itertools import permutations

    cost = np.random.default_rng(seed).integers(0, 9, (n, n + more)).astype(float)
    got = cost[np.arange(n), g.hungarian(cost)].sum()
    assert got == min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n + more), n))


def test_leiden_finds_cliques():
    edges = [(a, b, 1.0) for k in range(3) for a in range(k * 5, k * 5 + 5) for b in range(a + 1, k * 5 + 5)] + [(4, 5, 0.1), (9, 10, 0.1)]
    s, d, w = (np.array(x) for x in zip(*edges, strict=True))
    label = g.leiden(15, s, d, w)
    assert [len(set(label[k * 5 : k * 5 + 5])) for k in range(3)] == [1, 1, 1] and len(set(label)) == 3


def test_communities_cover_and_beat_singletons(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), float(1 + 9 * (a // 10 == b // 10))) for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.6 if a // 10 == b // 10 else 0.05)]
    edges = frame(spark, "src long, dst long, w double", *rows)
    found = g.communities(edges)
    assert sorted(r.contig for r in found.collect()) == sorted({x for r in rows for x in r[:2]})
    mem = found.selectExpr("contig", "community AS grp")
    alone = found.selectExpr("contig", "contig AS grp")
    assert g.modularity(edges, mem).first()[0] > max(0.5, g.modularity(edges, alone).first()[0])


def test_components_of_a_long_path(spark):
    edges = frame(spark, "src long, dst long", *[(i, i + 1) for i in range(60)], (100, 101))
    assert {r.contig: r.component for r in g.components(edges).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_ice_rows_sum_to_one(spark):
    rng = np.random.default_rng(1)
    edges = frame(spark, "src long, dst long, w double", *[(i, j, float(rng.integers(1, 50))) for i in range(12) for j in range(i, 12)])
    sums = g.ice(edges, 1e-6).groupBy("src").sum("w").collect()
    assert all(abs(r[1] - 1) < 1e-4 for r in sums)


def test_merge_groups_to_k_respects_conflicts():
    blocks = pd.DataFrame([(1, 2, 10.0), (1, 3, 1.0), (2, 3, 1.0), (3, 4, 9.0), (1, 1, 5.0), (2, 2, 5.0), (3, 3, 5.0), (4, 4, 5.0)], columns=["grp1", "grp2", "w"])
    sizes = {1: 1, 2: 1, 3: 1, 4: 1}
    assert g.merge_groups(blocks, sizes, 2) == {1: 1, 2: 1, 3: 3, 4: 3}
    apart = g.merge_groups(blocks, sizes, 2, {(1, 2)})
    assert apart[1] != apart[2]


def test_paths_grow_in_order(spark):
    pairs = frame(spark, "chrom1 int, pos1 long, chrom2 int, pos2 long", *[(1, 90, 2, 10)] * 9, *[(2, 90, 3, 90)] * 8, *[(1, 10, 3, 10)] * 1)
    contigs = frame(spark, "contig int, length long", (1, 100), (2, 100), (3, 100))
    mem = frame(spark, "contig int, grp long", (1, 7), (2, 7), (3, 7))
    got = [(r.contig, r.strand) for r in g.ordered_groups(pairs, contigs, mem).orderBy("pos").collect()]
    assert got in ([(1, "+"), (2, "+"), (3, "-")], [(3, "+"), (2, "-"), (1, "-")])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=14), st.lists(st.integers(0, 8), max_size=14))
def test_subsequences(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    assert g.longest_common(a, b) == t[-1, -1]
    best = [1] * len(a)
    for i in range(len(a)):
        best[i] = 1 + max([best[j] for j in range(i) if a[j] < a[i]], default=0)
    assert g.longest_increasing(a) == max(best, default=0)


def test_rescue_longest_first():
    edges = pd.DataFrame([(1, 10, 30.0), (1, 20, 2.0), (2, 10, 5.0), (2, 1, 40.0)], columns=["src", "dst", "w"])
    out = scoring.rescue(edges, {10: 100, 20: 200}, {1: 50, 2: 40, 10: 5, 20: 5}, set(), least=10, share=0.5)
    assert out[1] == 100 and out[2] == 100
    assert 2 not in scoring.rescue(edges, {10: 100, 20: 200}, {1: 50, 2: 40, 10: 5, 20: 5}, {(1, 2)}, least=10, share=0.5)


def test_peaks_and_mixture(spark):
    v = signals.smooth(np.array([0, 0, 5, 0, 0, 0, 9, 0, 0.0]), 0.5)
    assert signals.peaks(v).tolist() == [2, 6]
    depth = frame(spark, "n long", *[(int(x),) for x in np.random.default_rng(0).normal(200, 15, 4000)])
    assert abs(signals.depth_peak(depth) - 200) < 15
    rows = [(i, float(x)) for i, x in enumerate(np.concatenate([np.random.default_rng(0).normal(1, 0.1, 200), np.random.default_rng(1).normal(2, 0.1, 40)]))]
    assert {r.chrom for r in signals.collapsed_by_mixture(frame(spark, "chrom long, copies double", *rows)).collect()} == set(range(200, 240))


def test_asof_takes_the_latest_start(spark):
    points = frame(spark, "k int, pos long", (1, 5), (1, 10), (1, 25), (2, 5))
    starts = frame(spark, "k int, at long, label string", (1, 10, "x"), (1, 20, "y"))
    got = {(r.k, r.pos): r.label for r in iv.asof_backward(points, starts, "k", "pos", "at", ["label"]).collect()}
    assert got == {(1, 5): None, (1, 10): "x", (1, 25): "y", (2, 5): None}


def test_units():
    assert [units.to_number(x) for x in ("5m", "500k", "1.5g", "10kb", 7)] == [5_000_000, 500_000, 1_500_000_000, 10_000, 7]
    assert [units.to_text(x) for x in (5_000_000, 1500, 999)] == ["5m", "1.5k", "999"]
    with pytest.raises(ValueError):
        units.to_number("x")


def test_stores_and_files(spark, tmp_path):
    pairs = frame(spark, "read_idx string, chrom1 string, pos1 long, chrom2 string, pos2 long, strand1 string, strand2 string, mapq short", ("a", "x", 1, "y", 2, "+", "-", 0), ("b", "x", 3, "y", 4, "-", "+", 1), ("c", "x", 5, "y", 6, "+", "+", 30))
    sinks.write_pairs_store(pairs, str(tmp_path / "store"))
    assert text.is_pairs_store(spark, str(tmp_path / "store")) and not text.is_pairs_store(spark, str(tmp_path / "none"))
    assert [text.read_pairs_store(spark, str(tmp_path / "store"), q).count() for q in (0, 1, 2)] == [3, 2, 1]
    sinks.write_lines(sinks.pairs_lines(pairs), str(tmp_path / "lines"))
    assert sorted(map(tuple, text.read(spark, str(tmp_path / "lines"), text.pairs).collect())) == sorted(map(tuple, pairs.collect()))
    (tmp_path / "a.fa").write_text(">c1 first\nACGT\nAC\n>c2\nGG\n>c3\n")
    assert sorted(map(tuple, text.fasta(spark, str(tmp_path / "a.fa")).collect())) == [("c1", "ACGTAC"), ("c2", "GG"), ("c3", "")]
    assert text.pairs(frame(spark, "value string", ("#x",), ("",), ("r\ta\tb",))).first().pos1 is None


def test_stream_equals_batch(spark, tmp_path):
    from skein.streaming import pixels as s

    rows = [(i, i % 3, 1 + i * 7 % 90, (i * 5) % 3, 1 + i * 11 % 90, "+", "+", 1) for i in range(200)]
    pairs = frame(spark, s.PAIRS, *rows)
    pairs.repartition(5).write.parquet(str(tmp_path / "in"))
    contigs = frame(spark, "contig long, length long", (0, 100), (1, 100), (2, 100))
    q = s.drain(s.pixel_stream(s.pairs_stream(spark, str(tmp_path / "in"), 2), contigs, 10), "pixels_out")
    assert sorted(map(tuple, spark.table("pixels_out").collect())) == sorted(map(tuple, c.pixels(pairs, contigs, 10).collect()))
    q.stop()


def test_orders_and_clusters():
    from skein.operators import chains as ch

    d = np.array([[0, 0.1, 0.9, 0.9], [0.1, 0, 0.9, 0.8], [0.9, 0.9, 0, 0.2], [0.9, 0.8, 0.2, 0]])
    assert ch.average_linkage([5, 6, 7, 8], d, 0.5) == {5: 5, 6: 5, 7: 7, 8: 7}
    assert ch.ordered_by_similarity([5, 6, 7, 8], 1 - d) in ([5, 6, 8, 7], [7, 8, 6, 5])
    w = np.zeros((6, 6))
    for a, b in zip((2, 0, 4, 1, 5), (0, 4, 1, 5, 3), strict=True):
        w[a, b] = w[b, a] = 5
    assert ch.nearest_path(np.arange(6), w) in ([2, 0, 4, 1, 5, 3], [3, 5, 1, 4, 0, 2])


def test_balanced_rows_are_even(spark):
    from skein.operators import chains as ch

    rng = np.random.default_rng(2)
    px = frame(spark, "bin1_id long, bin2_id long, n long", *[(i, j, int(rng.integers(1, 30))) for i in range(20) for j in range(i, 20)])
    bins = frame(spark, "bin_id long, chrom string", *[(i, "a") for i in range(20)], (20, "a"), (21, "b"))
    w = {r.bin_id: r.weight for r in ch.balanced(px, bins, percentile=1.0).collect()}
    assert len(w) == 22 and sum(x is None or np.isnan(x) for x in w.values()) == 2
    m = np.zeros((20, 20))
    for r in px.collect():
        m[r.bin1_id, r.bin2_id] = m[r.bin2_id, r.bin1_id] = r.n
    v = np.array([w[i] for i in range(20)])
    sums = v * (m @ v)
    assert np.ptp(sums) < 1e-2 * sums.mean()


def test_chains_by_hand(spark):
    from skein.operators import chains as ch

    rows = [("r", 0, "c", "+", 100, 200, 1), ("r", 100, "c", "+", 200, 300, 2), ("r", 200, "c", "+", 900, 990, 3), ("r", 300, "d", "-", 500, 600, 4), ("r", 400, "d", "-", 400, 500, 5)]
    got = ch.read_chains(frame(spark, "read_name string, read_start long, chrom string, strand string, start_pos long, end_pos long, line_id long", *rows), 100)
    assert sorted((r.chrom, r.start_pos, r.end_pos, r.windows) for r in got.collect()) == [("c", 100, 300, 2), ("d", 400, 600, 2)]


def test_leiden_parts_hang_together():
    rng = np.random.default_rng(2)
    for seed in range(12):
        n = 30
        src, dst = np.triu_indices(n, 1)
        keep = np.random.default_rng(seed).random(len(src)) < 0.12
        src, dst, w = src[keep], dst[keep], rng.integers(1, 9, keep.sum()).astype(float)
        label = g.leiden(n, src, dst, w)
        for c in set(label.tolist()):
            members = np.flatnonzero(label == c).tolist()
            left, open_ = set(members), [members[0]]
            while open_:
                v = open_.pop()
                if v in left:
                    left.remove(v)
                    open_ += dst[src == v].tolist() + src[dst == v].tolist()
            assert not left


def test_natural_order(spark):
    from skein.functions.units import natural_key

    names = ["chr10_ctg1", "chr2_ctg10", "chr2_ctg9", "ctg", "2", "10", "ctg1", "a01", "a1", "a1b", "a" + "9" * 50, "a" + "1" + "0" * 50, ""]
    got = [r.name for r in frame(spark, "name string", *[(x,) for x in names]).orderBy(natural_key("name")).collect()]
    assert got == ["", "2", "10", "a1", "a1b", "a01", "a" + "9" * 50, "a" + "1" + "0" * 50, "chr2_ctg9", "chr2_ctg10", "chr10_ctg1", "ctg", "ctg1"]


def test_confidence_of_lone_second_and_reversed_links(spark):
    contigs = frame(spark, "contig long, length long", (1, 100), (2, 100), (3, 100), (4, 100), (5, 100))
    pairs = frame(spark, "chrom1 long, pos1 long, chrom2 long, pos2 long", *[(1, 90, 2, 10)] * 5, *[(2, 10, 1, 90)] * 4, *[(1, 90, 3, 10)] * 4, (4, 90, 5, 10))
    got = {(r.x, r.y): (r.links, round(r.confidence, 6)) for r in g.half_densities(pairs, contigs).collect()}
    assert got == {("1T", "2H"): (9, 2.25), ("1T", "3H"): (4, round(4 / 9, 6)), ("4T", "5H"): (1, 2.0)}


def test_paths_grow_over_rounds():
    rng = np.random.default_rng(1)
    truth = [(int(c), int(s)) for c, s in zip(rng.permutation(12), rng.integers(0, 2, 12), strict=True)]
    halves = [f"{c}{'HT'[h]}" for c, s in truth for h in ((0, 1) if s == 0 else (1, 0))]
    rows = [(*sorted((halves[i], halves[j])), int(4000 / (j - i) ** 2)) for i in range(24) for j in range(i + 1, 24) if halves[i][:-1] != halves[j][:-1] and 4000 / (j - i) ** 2 >= 1]
    links = pd.DataFrame(rows, columns=["x", "y", "links"])
    paths = g.Growth(dict.fromkeys(range(12), 100_000), 500_000, 1.0).run(links)
    want = [(c, "+" if s == 0 else "-") for c, s in truth]
    back = [(c, "-" if s == "+" else "+") for c, s in reversed(want)]
    assert max(paths, key=len) in (want, back)
    alone = g.Growth({1: 10, 2: 20, 3: 5}, 100, 1.0).run(links[:0])
    assert alone[-1] == [(1, "+")] or sorted(x for p in alone for x in p) == [(1, "+"), (2, "+"), (3, "+")]


def test_christofides_and_genetic_search_against_all_orders():
    from itertools import permutations

    from skein.operators import chains as ch

    for seed in range(6):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(3, 8))
        m = rng.random((n, n)) * 10
        m = np.triu(m, 1) + np.triu(m, 1).T
        best = max(ch.path_weight(list(p), m) for p in permutations(range(n)))
        for path in (ch.christofides(m), ch.evolved_path(m, seed)):
            assert sorted(path) == list(range(n)) and ch.path_weight(path, m) >= 0.8 * best
        assert ch.path_weight(ch.evolved_path(m), m) >= ch.path_weight(ch.tree_path(m), m)


def test_hot_pairs_are_split(spark):
    contigs = frame(spark, "contig long, length long", (1, 1000), (2, 1000))
    pairs = frame(spark, "chrom1 long, pos1 long, chrom2 long, pos2 long", *[(1, i + 1, 2, 2 * i + 1) for i in range(300)])
    whole = c.clm(pairs, contigs).collect()
    parts = c.clm(pairs, contigs, most=70).collect()
    assert len(whole) == 4 and len(parts) == 20 and all(r.n == 300 for r in parts)
    for o in c.ORIENTATIONS:
        assert sorted(d for r in parts if r.orientation == o for d in r.distances) == next(r.distances for r in whole if r.orientation == o)


def test_subsets_against_brute_force(spark):
    from skein.operators.samples import subset_rows

    rng = np.random.default_rng(5)
    sets = {i: set(rng.choice(8, rng.integers(1, 5), replace=False).tolist()) for i in range(40)}
    got = {r.read_name for r in subset_rows(frame(spark, "read_name long, member long", *[(i, int(m)) for i, s in sets.items() for m in s])).collect()}
    assert got == {i for i, s in sets.items() if any(s < t or s == t and j < i for j, t in sets.items() if j != i)}


def test_small_tables_only_reach_the_driver(spark):
    from skein.operators.common import collected

    assert len(collected(spark.range(5), 5)) == 5
    with pytest.raises(ValueError):
        collected(spark.range(6), 5)


def test_clique_keeps_weights_of_exactly_the_limit(spark):
    # six reads of four contigs for each of 40 pairs (0, k): terms of 1/3, which some orders of adding make a bit less than 2
    rows = [(10 * k + r, x, 1) for k in range(1, 41) for r in range(6) for x in (0, k, 1000 + 20 * k + 2 * r, 1001 + 20 * k + 2 * r)]
    got = c.clique(frame(spark, "read_idx long, contig long, cnt long", *rows), 2.0, cis=False).collect()
    assert {(r.src, r.dst) for r in got if r.dst < 1000} == {(0, k) for k in range(1, 41)}


def test_pruned_clique_keeps_weights_of_exactly_the_limit(spark):
    from types import SimpleNamespace

    from skein.plans.aggregate_queries import a11_clique_pruned

    rows = [(10 * k + r, x, 9) for k in range(1, 41) for r in range(6) for x in (0, k, 1000 + 2 * r, 1001 + 2 * r)]
    rows += [(1000 + k, k, 9) for k in range(1, 41) for _ in range(20)]  # each contig counts 25 at least
    got = a11_clique_pruned(SimpleNamespace(porec=frame(spark, "read_idx long, contig long, mapq long", *rows))).collect()
    assert {(r.src, r.dst) for r in got if r.src < r.dst < 1000} == {(0, k) for k in range(1, 41)}


def test_recluster_leaves_scores_of_exactly_the_limits(spark):
    scores = frame(spark, "contig long, grp long, score double", (1, 10, 4 / 3), (1, 20, 2.0000000000000004), (2, 10, 1.0), (2, 20, 1.0000000000000002), (3, 10, 1.0), (3, 20, 1.6))
    member = frame(spark, "contig long, grp long", (1, 10), (2, 30), (3, 10))
    assert [r.contig for r in scoring.recluster_candidates(scores, member, 1.5, 2.0, 0.05).collect()] == [3]


def test_matchings_are_made_once_for_two_sets_of_alleles(spark):
    # two sets of 30 alleles each, all with links across: 900 contacts, one matching of 900 cells
    alleles = frame(spark, "c1 long, c2 long", *[(k + i, k + j) for k in (0, 100) for i in range(30) for j in range(i + 1, 30)])
    w = np.random.default_rng(0).permutation(900).reshape(30, 30) + 1
    got = scoring.weak_matching(frame(spark, "contig1 long, contig2 long, n long", *[(i, 100 + j, int(w[i, j])) for i in range(30) for j in range(30)]), alleles)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
    best = g.hungarian(-w.astype(float) + 1000)
    assert {(r.c1, r.c2) for r in got.collect()} == {(i, 100 + j) for i in range(30) for j in range(30) if best[i] != j}


def test_heaviest_matchings_of_parts_add_up():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x, y = (v.ravel() for v in np.meshgrid(range(4), range(5), indexing="ij"))
        some = rng.random(20) < 0.4
        some[0] = True
        x, y, n = x[some], y[some], rng.integers(1, 9, some.sum())
        m = np.zeros((4, 5))
        m[x, y] = n
        taken = scoring.heaviest(x, y, n)
        assert len(set(x[taken])) == taken.sum() == len(set(y[taken])) and n[taken].sum() == m[np.arange(4), g.hungarian(m.max() - m)].sum()


def test_strongest_alleles_are_not_shuffled(spark, monkeypatch):
    alleles = frame(spark, "c1 long, c2 long", (1, 2), (2, 3), (1, 3), (5, 4), (4, 5), (7, 8))
    links = [(1, 9, 4), (2, 9, 4), (3, 9, 5), (4, 9, 1), (5, 9, 1), (1, 2, 3), (6, 7, 1), (7, 7, 5), (6, 9, 1)]
    want = {(9, "1-2", 1, 4), (9, "2-3", 3, 5), (9, "1-3", 3, 5), (9, "5-4", 4, 1), (9, "4-5", 4, 1), (1, "1-2", 2, 3), (1, "2-3", 2, 3), (2, "1-2", 1, 3), (2, "1-3", 1, 3), (6, "7-8", 7, 1)}
    for side in (scoring.SIDE, 2):  # all in one task, and many blocks on both sides
        monkeypatch.setattr(scoring, "SIDE", side)
        out = scoring.strongest_allele(frame(spark, "contig1 long, contig2 long, n long", *links), alleles)
        assert sorted(tuple(r) for r in out.collect()) == sorted(want)
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_graphs_in_files_are_clustered_alike(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    src, dst = np.triu_indices(60, 1)
    some = rng.random(len(src)) < np.where(src % 4 == dst % 4, 0.8, 0.1)
    src, dst, w = src[some], dst[some], rng.integers(1, 9, some.sum()).astype(float)
    want = g.leiden(60, src, dst, w)
    monkeypatch.setattr(g, "CHUNK", 16)
    spool = g.Spool(str(tmp_path))
    for k in range(0, len(src), 7):
        spool.add(src[k : k + 7], dst[k : k + 7], w[k : k + 7])
    graph = spool.network(str(tmp_path))
    assert isinstance(graph.heads, np.memmap) and isinstance(graph.folded(np.arange(60) // 2, 30).weights, np.memmap)
    assert g.clustered(graph).tolist() == want.tolist()
    assert {len({want[v] for v in range(60) if v % 4 == k}) for k in range(4)} == {1}


def test_more_groups_than_a_driver_holds_are_merged(spark):
    from skein.plans.partition import merged_to

    n = 460  # groups, each of one contig, every two with an edge: over 100 000 block sums
    edges = spark.range(n * n).selectExpr("id div 460 AS src", "id % 460 AS dst").where("src < dst").selectExpr("src", "dst", "IF(src % 2 = dst % 2, 5.0D, 1.0D) AS w")
    got = {r.contig: r.grp for r in merged_to(edges, spark.range(n).selectExpr("id AS contig", "id AS grp"), 2).collect()}
    assert got == {c: c % 2 for c in range(n)}


def test_rescue_reads_a_component_batch_by_batch(spark):
    edges = frame(spark, "src long, dst long, w double", (1, 10, 9.0), (1, 20, 5.0), (2, 10, 8.0), (1, 2, 50.0), (3, 20, 7.0), (3, 10, 9.0))
    sizes = frame(spark, "contig long, length long", (1, 50), (2, 40), (3, 30), (10, 5), (20, 5))
    out = scoring.rescued(edges, frame(spark, "contig long, grp long", (10, 100), (20, 200), (30, 300)), sizes, frame(spark, "c1 long, c2 long", (3, 10), (4, 5)), least=5, share=0.5)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.contig: r.grp for r in out.collect()} == {10: 100, 20: 200, 30: 300, 1: 100, 2: 100}


def test_windows_are_not_broadcast(spark):
    wins = iv.windows(spark.range(1, 2).selectExpr("id AS chrom", "2000L AS length"), 1000, 500)  # known to be small
    out = iv.window_counts(wins, spark.range(2).selectExpr("1L AS chrom", "400 * id AS start_pos", "600 + 900 * id AS end_pos"))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.start_pos, r.n) for r in out.collect()} == {(0, 2), (500, 1), (1000, 1), (1500, 0)}


def test_single_partition_rescues_what_it_left_out(spark):
    from skein.plans.partition import single_partition

    # two groups 1-4 and 11-14, a short one 21-22; 5 to 7 have little cis weight: 5 is pulled enough, 6 is not, 7 is an allele of 1
    blocks = [(a, b, 50.0) for own in (range(1, 5), range(11, 15), (21, 22)) for a, b in itertools.combinations(own, 2)]
    rows = [*blocks, (5, 11, 9.0), (5, 12, 9.0), (6, 12, 3.0), (1, 7, 9.0), (2, 22, 6.0)]
    cis = [(c, c, 100.0) for c in (*range(1, 5), *range(11, 15), 21, 22)] + [(c, c, 1.0) for c in (5, 6, 7)]
    edges = frame(spark, "src long, dst long, w double", *rows, *cis)
    sizes = frame(spark, "contig long, length long", *[(c, {21: 10, 22: 20}.get(c, 100)) for c, _, _ in cis])
    got = single_partition(edges, edges.where("src <> dst"), sizes, frame(spark, "c1 long, c2 long", (1, 7)), 3, shortest=100).collect()
    assert {r.contig: r.name for r in got} == dict.fromkeys((5, 11, 12, 13, 14), "Chr01") | dict.fromkeys((1, 2, 3, 4, 21, 22), "Chr02")


def test_components_of_any_number_of_edges(spark, monkeypatch):
    pairs = [(int(a), int(b)) for a, b in np.random.default_rng(3).integers(0, 400, (240, 2)) if a != b]
    least = {x: x for p in pairs for x in p}
    while any(least[a] != least[b] for a, b in pairs):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    names, found = g.stars(*np.array(pairs, dtype=np.int64).T)
    assert dict(zip(names.tolist(), found.tolist(), strict=True)) == least
    edges = frame(spark, "src long, dst long", *pairs)
    for most in (1 << 20, 16):  # in one partition; in rounds
        monkeypatch.setattr(g, "EDGES", most)
        got = g.components(edges).collect()
        assert {r.contig: r.component for r in got} == least and len(got) == len(least)


def test_components_are_clustered_in_whatever_order_their_edges_come(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    src, dst = np.triu_indices(40, 1)
    own, w = np.repeat([7, 9, 11], len(src)), rng.random(3 * len(src)) + 4.0 * np.tile(src % 2 == dst % 2, 3)
    src, dst, mix = np.tile(src, 3) + 100 * own, np.tile(dst, 3) + 100 * own, rng.permutation(len(own))
    monkeypatch.setattr(g, "CHUNK", 1000)
    for kinds in ([7, 9, 11], [9]):
        parts = g.Parts(str(tmp_path))
        for k in range(0, len(mix), 50):
            at = mix[k : k + 50][np.isin(own[mix[k : k + 50]], kinds)]
            parts.put(own[at], src[at], dst[at], w[at])
        got = {key: (names, g.clustered(graph)) for key, names, graph in parts.networks()}
        assert sorted(got) == kinds
        for key in kinds:
            names, back = np.unique(np.concatenate([src[own == key], dst[own == key]]), return_inverse=True)
            assert (got[key][0] == names).all() and (got[key][1] == g.leiden(len(names), *np.split(back, 2), w[own == key])).all()
    edges = frame(spark, "src long, dst long, w double", *zip(src.tolist(), dst.tolist(), w.tolist(), strict=True))
    plan = g.communities(edges)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Sort [component" not in plan


def test_resolution_search_does_no_round_that_it_can_do_without(spark, monkeypatch):
    from skein.plans.partition import to_group_count

    calls, own = [], g.communities
    monkeypatch.setattr(g, "communities", lambda edges, resolution=1.0, group=None: calls.append(resolution) or own(edges, resolution, group))
    cliques = [(10 * k + a, 10 * k + b, 1.0) for k in range(4) for a, b in itertools.combinations(range(4), 2)]
    apart = frame(spark, "src long, dst long, w double", *cliques)
    assert len({r.grp for r in to_group_count(apart, 3).collect()}) == 4 and calls == [0.1]  # one for each component, at any resolution
    together = frame(spark, "src long, dst long, w double", *cliques, *[(10 * k, 10 * k + 10, 0.5) for k in range(3)])
    assert len({r.grp for r in to_group_count(together, 2).collect()}) == 2 and calls == [0.1]  # one component: all in one task
    assert len({r.grp for r in to_group_count(together, 4).collect()}) == 4


def test_large_matchings_of_small_weights_are_as_heavy_as_any(monkeypatch):
    rng = np.random.default_rng(11)
    for _ in range(150):
        m = rng.integers(0, int(rng.integers(2, 7)), rng.integers(1, 12, 2)) * (rng.random() > rng.random())
        x, y = np.nonzero(m)
        if len(x):
            taken = scoring.heaviest(x, y, m[x, y])
            assert len(set(x[taken])) == len(set(y[taken])) == taken.sum()
            square = m if m.shape[0] <= m.shape[1] else m.T
            assert m[x, y][taken].sum() == square[np.arange(len(square)), g.hungarian(square.max() - square.astype(float))].sum()
    monkeypatch.setattr(scoring, "hungarian", lambda cost: pytest.fail("rows times columns are looked at"))
    cells = np.unique(rng.integers(0, 2400 * 2400, 220_000))
    x, y, n = cells // 2400, cells % 2400, 1 + (rng.random(len(cells)) < 0.002)
    taken = scoring.heaviest(x, y, n)
    assert taken.sum() > 2390 and n[taken].sum() > 2390 + 0.8 * (n > 1).sum()
