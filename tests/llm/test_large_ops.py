"""Decontamination, substring deduplication, SimHash, language model, mixing, top-k: brute force on small fixtures, edge cases, hot groups."""

import math
import time
from collections import Counter, defaultdict
from hashlib import md5, sha256
from pathlib import Path

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import decontaminate, lm, mixing, simhash, substring, topk
from skein.llm.common import pack, pack_counts, unpack, unpack_counts
from skein.llm.fmindex import FMIndex

from .test_small_ops import DOCS, clashing, docs


def sentences(rng, words, n, low, high):
    return [" ".join(rng.choice(words, rng.integers(low, high))) for _ in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40))
def test_packing_round_trip(values):
    v = np.array(sorted(values), dtype=np.uint64)
    assert unpack(pack(v)).tolist() == v.tolist()
    c = np.array(values, dtype=np.uint64) >> np.uint64(8)
    assert unpack_counts(pack_counts(c)).tolist() == c.tolist() if len(c) else True


# --- FM-index and decontamination --------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 5), min_size=3, max_size=3), min_size=1, max_size=6), st.integers(1, 9))
def test_index_finds_all_occurrences(text, patterns, sample):
    index = FMIndex(np.array(text), 6, sample)
    low, high = index.ranges(np.array(patterns))
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [i for i in range(len(text) - 2) if text[i : i + 3] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def fold(t):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(texts, items):
    out = []
    for t in texts:
        w, hit, who = fold(t), set(), set()
        for name, x in items:
            b = fold(x)
            for j in range(max(1, len(b) - 12) if b else 0):
                g = b[j : j + 13]
                for i in range(len(w) - len(g) + 1):
                    if w[i : i + len(g)] == g:
                        hit.update(range(i, i + len(g)))
                        if name is not None:
                            who.add(str(name))
        out.append((len(w), len(hit), len(who), sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.fixture(scope="module")
def leaks(spark):
    rng = np.random.default_rng(4)
    words = ["Aa", "bb", "c1", "ünd", "漢字", "dd", "e"]
    items = [(i, t) for i, t in enumerate(sentences(rng, words, 12, 1, 30))] + [(12, ""), (13, None), (None, "no id at all"), (14, "e"), (3, "same id other text here")]
    texts = sentences(rng, words, 40, 0, 120) + ["", None, "... ,,", "no-ID, at ALL!", "E"]
    texts += [" ".join([*rng.choice(["zz", "yy"], 300), items[2][1], *rng.choice(["zz"], 50)]), "xx " * 60_000 + items[5][1], items[1][1] * 3]
    return texts, items


def test_decontamination_against_brute_force(spark, leaks):
    texts, items = leaks
    b = clashing(spark.createDataFrame(items, "item_id long, text string"))
    for size in (1 << 24, 300):
        got = {r.doc_id: tuple(r)[1:] for r in decontaminate.find(clashing(docs(spark, *texts)).select("doc_id", "text", "score"), b, pass_bytes=size).select("doc_id", "__n_words", decontaminate.hit_words(), F.size("__items"), F.sha2(F.array_join("__items", ",").cast("binary"), 256), decontaminate.contaminated()).collect()}
        assert [got[i] for i in range(len(texts))] == brute_hits(texts, items), size
    assert [c for c in decontaminate.report(docs(spark, "a"), b).columns] == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert decontaminate.report(docs(spark, "a").limit(0), b).count() == 0
    assert not decontaminate.report(docs(spark, "a b"), b.limit(0)).first().contaminated


def test_removal_cuts_spans_and_drops_contaminated(spark, leaks):
    texts, items = leaks
    b = spark.createDataFrame(items, "item_id long, text string")
    d = clashing(docs(spark, *texts))
    out = decontaminate.remove(d, b)
    assert out.columns == d.columns
    rows = {r.doc_id: r for r in out.collect()}
    for i, (t, want) in enumerate(zip(texts, brute_hits(texts, items), strict=True)):
        assert (i in rows) == (not want[4])
        if i in rows and want[1] == 0:
            assert rows[i].text == t
        elif i in rows:
            assert len(fold(rows[i].text)) == want[0] - want[1] and rows[i].n_chars == len(rows[i].text)


# --- substring deduplication -------------------------------------------------------------------------------------------------------------------


def brute_repeats(texts, window):
    ws = [[x for x in (t or "").encode().split()] for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize(("window", "chunk"), [(35, 1 << 23), (35, 900), (5, 700), (4, 200)])
def test_repeats_against_brute_force(spark, window, chunk):
    rng = np.random.default_rng(window)
    words = ["a", "b", "cé", "D."]
    base = sentences(rng, words + [f"u{i}" for i in range(200)], 8, 30, 90)
    texts = sentences(rng, words, 10, 0, 12) + base + base[:3] * 4 + [base[4] + " x " + base[4], " ".join(base[5].split()[7:60]), "", None, "  \x0b\x0c x\ty"]
    texts += [" ".join(["h"] * 120)] + [f"{i} " + base[6] for i in range(6)]
    got = {r.doc_id: r for r in substring.repeats(clashing(docs(spark, *texts)), window, chunk_chars=chunk).collect()}
    want = brute_repeats(texts, window)
    assert [(got[i].n_words, sum(s["end"] - s["start"] for s in got[i].spans), got[i].kept) for i in range(len(texts))] == want


def test_repeats_edges(spark):
    assert substring.report(docs(spark, "a").limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "w " * 40, "en", "s", 1), (1, "w " * 40, "en", "s", 1), (None, None, None, None, None)], DOCS)
    out = substring.report(twice).collect()
    assert sorted((r.n_words, r.n_removed) for r in out) == [(0, 0), (40, 40), (40, 40)]


# --- SimHash -----------------------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, k=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, d=2):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= d:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            r = find(i)
            least[r] = min(least.get(r, x), x)
    return [least.get(find(i)) for i in range(len(ids))]


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = sentences(rng, [f"t{i}" for i in range(60)], 60, 0, 200)
    for t in texts[:20]:
        w = t.split()
        if w:
            w[int(rng.integers(len(w)))] = "ODD"
        texts += [" ".join(w), t.upper(), t]
    texts += ["", None, " \n", "ß", "one two", "one  two\tthree"] + ["many words here " * 3000]
    d = clashing(docs(spark, *texts, first=5))
    got = {r.doc_id: r for r in simhash.near_duplicates(d).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    comp = brute_components(list(range(5, 5 + len(texts))), fps)
    for i, (f, c) in enumerate(zip(fps, comp, strict=True)):
        assert (got[i + 5].fingerprint, got[i + 5].component_id) == (f"{f:016x}", c), i


def test_links_of_hot_buckets_connect_what_brute_force_connects(spark):
    rng = np.random.default_rng(7)
    base = int(rng.integers(0, 2**62)) | 1 << 63
    fps = {base}
    for n in (1, 1, 2, 2, 2, 3, 4):
        for _ in range(40):
            x = base
            for b in rng.choice(64, n, replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 2**63, 60)}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    links = simhash.links(df).collect()
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 2 for r in links)
    found = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = brute_components(list(range(len(fps))), fps)
    groups, theirs = defaultdict(set), defaultdict(set)
    for i, f in enumerate(fps):
        groups[want[i]].add(f)
        theirs[found.get(simhash.signed(f), f"alone{i}")].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(-40, 40)] + [(100, i) for i in range(101, 160)] + [(500, 499)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(-40, 41)} == {-40} and {got[i] for i in range(100, 160)} == {100} and got[500] == 499
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c", "", "", 0), (7, "a b c", "", "", 0), (7, "a b c", "", "", 0), (None, "x y z w", "", "", 0)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id is None, r.component_id or -1) for r in out) == [(False, 7), (False, 7), (True, -1), (True, 7)]
    assert simhash.near_duplicates(docs(spark, "a").limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rng = np.random.default_rng(9)
    words = [f"t{i}" for i in range(3000)]
    base = sentences(rng, words, 40, 150, 400)
    rows, group = [], {}
    for g, t in enumerate(base):
        for copy in range(6 if g < 25 else 1):
            w = t.split()
            for _ in range(copy % 3):
                w[int(rng.integers(len(w)))] = "changed"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(w), "en", "s", 1))
    rows += [(1000, "", "", "", 0), (1001, None, "", "", 0), (1002, "\t", "", "", 0), (0, rows[0][1], "en", "s", 1), (None, "alone " * 9, "", "", 0)]
    d = clashing(spark.createDataFrame(rows, DOCS))
    out = simhash.keep_one(d)
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect())
    firsts = {}
    for i, g in group.items():
        firsts.setdefault(g, i)
    assert out.columns == d.columns
    assert [i for i in ids if 0 <= i < 1000] == sorted(firsts.values())
    assert -1 in ids and 1000 in ids and 1001 not in ids
    assert simhash.keep_one(d.limit(0)).count() == 0


def kept(spark, texts):
    return {r.doc_id for r in simhash.keep_one(docs(spark, *texts)).collect()}


def kept_by_brute_force(texts):
    """The least of each component over all pairs with a Jaccard similarity of 0.8 or more on five-word shingles."""
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in range(len(texts))}


def test_near_copies_within_a_template(spark):
    rng = np.random.default_rng(4)
    words = [f"u{i}" for i in range(5000)]
    template = list(rng.choice(words, 300))
    texts = []
    for i in range(600):
        w = template[:240] + list(rng.choice(words, 48)) + template[288:]
        texts.append(" ".join(w))
        if i % 10 == 0:
            at = int(rng.integers(200))
            w[at : at + 20] = rng.choice(words, 20)
            texts.append(" ".join(w))
    want = kept_by_brute_force(texts)
    assert len(want) == 600 and kept(spark, texts) == want


def test_near_copies_are_found_at_every_size(spark):
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(9000)]
    rows = []
    for i in range(300):
        w = list(rng.choice(words, 104))
        rows.append((2 * i, " ".join(w), "en", "s", 0))
        # 89 of 100 shingles are common: a similarity of 0.802
        rows.append((2 * i + 1, " ".join([*w[:93], *(f"z{k}" for k in range(11))]), "en", "s", 0))
    pairs = spark.createDataFrame(rows, DOCS)
    many = spark.range(1000, 201_000).selectExpr("id AS doc_id", "concat('single', id) AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    for d in (pairs, pairs.unionByName(many)):
        assert simhash.keep_one(d).where("doc_id < 1000 AND doc_id % 2 = 1").count() == 0


def test_short_near_copies(spark):
    texts = []
    for i in range(200):
        w = [f"s{i}x{k}" for k in range(9)]
        texts += [" ".join(w[:8]), " ".join(w)]
    assert kept(spark, texts) == set(range(0, 400, 2)) == kept_by_brute_force(texts)


# --- language model ----------------------------------------------------------------------------------------------------------------------------


def brute_scores(texts, order):
    """Words and log_prob of each text as the definition states it."""
    own = [(t or "").encode().lower().split() for t in texts]

    def count(words):
        return Counter(tuple(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1))

    everything = sum((count(d) for d in own), Counter())
    size = sum(map(len, own))
    out = []
    for d in own:
        rest = everything - count(d)
        total = max(1, size - len(d))

        def score(gram):
            if len(gram) == 1:
                return (rest[gram] or lm.BACKOFF) / total
            return rest[gram] / rest[gram[:-1]] if rest[gram] and rest[gram[:-1]] else lm.BACKOFF * score(gram[1:])

        out.append((len(d), sum(math.log10(score(tuple(d[max(0, i - order + 1) : i + 1]))) for i in range(len(d)))))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2**32 - 1), st.integers(0, 300), st.integers(1, 2**32 - 1)), min_size=1, max_size=30))
def test_tuples_round_trip(rows):
    parts = np.array(sorted(rows), dtype=np.uint64)
    assert lm.unpack_tuples(lm.pack_tuples(parts), 3).tolist() == parts.tolist()


def test_count_table(spark):
    texts = ["a B a b", "", None, "a\tb"]
    got = {(r.n, r.gram): r["count"] for r in lm.count_table(docs(spark, *texts), 2).collect()}
    assert got == {(1, "a"): 3, (1, "b"): 3, (2, "a b"): 3, (2, "b a"): 1}


@pytest.mark.parametrize(("order", "chunk"), [(1, 1 << 23), (2, 1 << 23), (2, 400), (3, 300), (4, 200)])
def test_scores_against_the_definition(spark, order, chunk, monkeypatch):
    if chunk < 1000:
        monkeypatch.setattr("skein.llm.substring.BUCKET_ENTRIES", 40)
    rng = np.random.default_rng(order)
    texts = sentences(rng, ["a", "B", "c", "dé", "e."], 25, 0, 40) + ["", None, "once", "a a a a"] + ["a b c d e f g"] * 3
    got = {r.doc_id: r for r in lm.scores(clashing(docs(spark, *texts)), order, chunk).collect()}
    for i, (n, total) in enumerate(brute_scores(texts, order)):
        assert got[i].n_words == n and got[i].log_prob == pytest.approx(total, abs=1e-9)
        assert (got[i].mean_log_prob is None) == (n == 0) and (n == 0 or got[i].mean_log_prob == pytest.approx(total / n))


def test_score_edges(spark):
    assert lm.scores(docs(spark, "a").limit(0)).count() == 0
    alone = lm.scores(docs(spark, "just one text")).first()
    assert alone.n_words == 3 and np.isfinite(alone.log_prob)


# --- mixing ------------------------------------------------------------------------------------------------------------------------------------


def brute_mix(rows):
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    by = defaultdict(list)
    for (i, t, s), n in zip(rows, size, strict=True):
        named = "text:" + md5((t or "").encode()).hexdigest() if i is None else str(i)
        by[s].append((md5(f"0:{named}".encode()).hexdigest(), n, i))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total = {s: sum(n for _, n, _ in by[s]) for s in order}
    capped, T = set(), sum(size)
    while True:
        free = [s for s in order if s not in capped]
        left = T - sum(3 * total[s] for s in capped)
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] > 3 * total[s] * w}
        if not over:
            break
        capped |= over
    target = {s: 3.0 * total[s] if s in capped else left * weight[s] / max(w, 1) for s in order}
    out = []
    for s in order:
        budget = int(target[s])
        full = budget // total[s] if total[s] else 0
        rest, at = budget - full * total[s], 0
        for _, n, i in sorted(by[s], key=lambda x: (x[0], x[1])):
            out.append((-1 if i is None else i, n, total[s], round(target[s], 6), n * full + max(0, min(n, rest - at))))
            at += n
    return sorted(out)


def test_mix_against_brute_force(spark):
    rng = np.random.default_rng(5)
    names = ["b", "a", None, "é", "Z", "tiny", "empty"]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), names[min(int(rng.integers(0, 12)), 4)]) for i in range(900)]
    rows += [(1000, "x y", "tiny"), (1001, None, "empty"), (None, "one two", "a"), (5, "again", "a"), (5, "again", "a"), (1002, "v " * 40_000, "Z")]
    d = clashing(spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS))
    for r in (1024, 8):
        got = mixing.mix(d, rows_per_range=r).collect()
        assert sorted((-1 if x.doc_id is None else x.doc_id, x.size, x.source_size, round(x.target, 6), x.taken) for x in got) == brute_mix(rows)
    taken = defaultdict(int)
    for x in got:
        taken[x.source] += x.taken
        assert x.taken <= 3 * x.size
    assert all(taken[x.source] == int(x.target) for x in got)
    many = mixing.RANGES_PER_BLOCK
    try:
        mixing.RANGES_PER_BLOCK = 4
        assert sorted(map(str, mixing.mix(d, rows_per_range=8).collect())) == sorted(map(str, got))
    finally:
        mixing.RANGES_PER_BLOCK = many
    kept = mixing.mix(d, keep=("text", "lang"))
    assert kept.columns == ["doc_id", "source", "size", "source_size", "target", "taken", "text", "lang"] and kept.count() == len(rows)


def test_mix_edges(spark):
    d = docs(spark, "a b")
    assert mixing.mix(d.limit(0)).count() == 0
    assert [tuple(r)[2:] for r in mixing.mix(docs(spark, None, "")).collect()] == [(0, 0, 0.0, 0)] * 2
    one = mixing.mix(d).first()
    assert (one.size, one.target, one.taken) == (2, 2.0, 2)


# --- top-k -------------------------------------------------------------------------------------------------------------------------------------


def brute_top(rows, every, k):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -v) for r, (v, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize(("d", "bytes_"), [(1, 1 << 25), (3, 1 << 25), (16, 1 << 25), (64, 3000)])
def test_top_k_against_brute_force(spark, d, bytes_):
    rng = np.random.default_rng(d)
    rows = [(i, rng.normal(0, 0.3, d).astype(np.float32).tolist()) for i in range(220)]
    rows += [(300 + i, rows[7][1]) for i in range(9)] + [(400, [0.0] * d), (450, None), (500, [None] + [0.0] * (d - 1)), (550, [float("nan")] * d), (600, [float("inf")] * d), (None, [0.1] * d), (650, [0.5] * (d + 1)), (651, [0.25] * (d + 1)), (700, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1)).withColumn("label", F.lit(0))
    got = sorted(map(tuple, topk.top_k(df, query_bytes=bytes_).collect()))
    assert got == brute_top(rows, 50, 5)


def test_top_k_edges(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1e9, 1e9]), (50, [3e9, -1e9])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df).collect()))
    assert got == [(0, 1, 1, 256 * 256 * 3 * 10**9), (0, 2, 50, 256 * 256 * 10**9), (50, 1, 1, min(2**63 - 1, 256 * 256 * 2 * 10**18)), (50, 2, 0, 256 * 256 * 10**9)]
    assert topk.top_k(df.limit(0)).count() == 0


def searched(x, every=50, k=5, sample=1000):
    """Results of the search over rows x, and the share of pairs that each level leaves."""
    rng = np.random.default_rng(0)
    ids = np.arange(len(x))
    asked, some = ids % every == 0, rng.permutation(len(x))[:sample]
    block = topk.Block(ids[asked], x[asked], topk.fitted(x[some]), topk.floors(ids[asked], x[asked], ids[some], x[some], k))
    best = (np.full((asked.sum(), k), topk.LEAST), np.full((asked.sum(), k), topk.NONE))
    left = np.zeros(len(topk.LEVELS) + 1)
    for a in range(0, len(x), 1024):
        seen = []
        topk.search(block, ids[a : a + 1024], x[a : a + 1024], best, k, seen)
        left += seen
    scores = (x[asked] @ x.T).astype(np.int64)
    scores[np.arange(asked.sum()), ids[asked]] = topk.LEAST
    order = np.lexsort((np.broadcast_to(ids, scores.shape), ~scores), axis=1)[:, :k]
    assert (best[1] == order).all() and (best[0] == np.take_along_axis(scores, order, 1)).all()
    return left / left[0]


@pytest.mark.parametrize(("kind", "most"), [("clusters", 0.05), ("low rank", 0.01), ("isotropic", 1)])
def test_bounds_prune_where_vectors_have_a_structure(kind, most):
    rng = np.random.default_rng(1)
    if kind == "clusters":
        centres = rng.normal(0, 1, (40, 64))
        x = centres[rng.integers(0, 40, 5000)] + rng.normal(0, 0.15, (5000, 64))
    else:
        x = rng.normal(0, 1, (5000, 64)) if kind == "isotropic" else rng.normal(0, 1, (5000, 6)) @ rng.normal(0, 1, (6, 64)) + rng.normal(0, 0.05, (5000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
    left = searched(x)
    assert left[-1] <= most and (np.diff(left) <= 0).all()


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 20), st.integers(0, 10**6), st.sampled_from([1.0, 1e4, 1e9, 1e160]))
def test_bounds_never_lie_below_the_product(n, seed, size):
    rng = np.random.default_rng(seed)
    x = np.floor(size * rng.normal(0, 1, (30, n)) * rng.integers(0, 2, (30, n)))
    basis = topk.fitted(x[:10])
    block = topk.Block(np.arange(30), x, basis, np.full(30, topk.LEAST))
    want = x @ x.T
    for i in range(30):
        q, c = topk.survivors(block.part(i, i + 1), x, np.array([want[i].min() if size < 1e100 else 0]))
        assert len(c) == 30 or size > 1e100
        kept = topk.survivors(block.part(i, i + 1), x, np.array([np.median(want[i])]))[1]
        assert size > 1e100 or set(np.flatnonzero(want[i] >= np.median(want[i]))) <= set(kept.tolist())


def test_near_copies_are_linked_by_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for n in range(500, 4000, 50):  # until one word more changes one or two bits
        words = [f"w{i}" for i in rng.integers(0, 5000, n)]
        one, two = " ".join(words), " ".join([*words, "end"])
        if 1 <= (simhash.fingerprint(one.encode(), 5) ^ simhash.fingerprint(two.encode(), 5)).bit_count() <= 2:
            break
    rows = [(1, one), (2, two), (3, " ".join(words[::-1]))]
    seen, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, distance: seen.append((links(fps, distance).count(), distance)) or links(fps, distance))
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out} == {1, 3} and seen == [(1, 2)]


# --- Many short steps on little data: what they leave on disk ---------------------------------------------------------------------------------


def shuffle_files(spark):
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {f for folder in folders for f in Path(str(folder)).rglob("shuffle_*")}


def test_near_copy_steps_are_few_and_leave_no_shuffle_files(spark):
    rng = np.random.default_rng(31)
    words = [f"w{i}" for i in range(600)]
    rows = []
    for text in sentences(rng, words, 40, 60, 90):
        rows += [(len(rows), text), (len(rows) + 1, text + " more"), (len(rows) + 2, text)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).checkpoint()
    context, before = spark.sparkContext, shuffle_files(spark)
    context.setJobGroup("near copies", "near copies")
    try:
        out = simhash.keep_one(d)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in context.statusTracker().getJobIdsForGroup("near copies") for s in context.statusTracker().getJobInfo(j).stageIds}
    for _ in range(50):  # files go in the background
        if len(left := shuffle_files(spark) - before) <= 100:
            break
        time.sleep(0.2)
    print("stages", len(stages), "files", len(left))
    assert len(stages) <= 200
    assert len(left) <= 100  # those of a few counts
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 120, 3))


def test_components_are_the_same_in_rounds_and_on_the_driver(spark):
    rng = np.random.default_rng(32)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (250, 2))] + [(2**63 - 1, -(2**63)), (5, 5), (700, 701), (702, 701), (703, 702), (704, 703)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    few, many = ({(r.node, r.root) for r in simhash.components(edges, few=n).collect()} for n in (10**6, -1))
    assert few == many and (704, 700) in few and (2**63 - 1, -(2**63)) in few
    assert len(few) == len({x for a, b in pairs if a != b for x in (a, b)})


def test_links_within_large_buckets_need_no_pairs(spark):
    fps = [a << 40 | b for a in range(3) for b in range(64)]  # one bucket of all masks that leave the low bits free
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    assert all((a ^ b).bit_count() <= 2 and a < b for a, b in got) and len(got) < len(fps) * 30
    root = {x: x for x in fps}
    for _ in fps:
        for a, b in got:
            root[a] = root[b] = min(root[a], root[b])
    assert set(root.values()) == {0}  # 1 << 40 and 2 << 40 are one bit from nought
