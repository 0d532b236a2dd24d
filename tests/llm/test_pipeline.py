"""The pipeline and the registered queries, on small tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from skein.llm import decontaminate, secrets, simhash, toxicity
from skein.llm.queries import ORACLE_SQL, QUERIES

from .test_small_ops import DOCS

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        cur = con.execute(ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got)


def test_entry_lists_them():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def small(spark, folder):
    rng = np.random.default_rng(8)
    words = [f"t{i}" for i in range(900)]
    text = lambda n: " ".join(rng.choice(words, n))
    bench = [(i, text(30)) for i in range(5)]
    rows, kind = [], {}

    def add(t, what, source):
        kind[len(rows)] = what
        rows.append((len(rows), t, "en", source, len(t)))

    for i in range(260):
        bad = i % 4 == 0
        add(text(60) + (" grumpf folk" if bad else ""), "toxic" if bad else "clean", f"s{i % 3}")
    for i in range(10):
        t = text(120)
        add(t, "clean", "s0")
        add(t, "copy", "s1")
        add(t + " more", "copy", "s1")
    for i in range(5):
        add(text(40) + " " + bench[i][1], "leak", "s2")
        add(text(900) + " " + bench[i][1], "part", "s2")
        add(text(50) + f' token = "{i}4dbebab91ab85687d33eeaaf9ac699e1188f962"', "secret", "s2")
    spark.createDataFrame([*rows, (9000, None, None, None, None), (9001, "", "en", None, 0)], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0, int(k == "toxic")) for i, k in kind.items() if i < 260], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return kind, bench


def test_each_stage_does_its_work(spark, tmp_path):
    folder = str(tmp_path)
    kind, bench = small(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontaminate", "secrets", "mixing"]
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if name != "mixing":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/out{i}")
        before, docs = docs, spark.read.parquet(f"{folder}/out{i}")
        seen[name] = ({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()})
    gone = {n: set(a) - set(b) for n, (a, b) in seen.items()}
    # toxicity: as the operator scores them, and nearly all of the planted ones
    machine = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scored = {r.doc_id: r.predicted for r in toxicity.score(spark.read.parquet(f"{folder}/documents.parquet"), machine).collect()}
    assert gone["toxicity"] == {i for i, p in scored.items() if p}
    planted = {i for i, k in kind.items() if k == "toxic"}
    assert len(planted & gone["toxicity"]) >= 0.95 * len(planted) and not any(kind[i] == "clean" for i in gone["toxicity"] if i < 260)
    copies = {i for i, k in kind.items() if k == "copy"} - gone["toxicity"]
    assert gone["simhash"] == copies | {9001}
    assert gone["decontaminate"] == {i for i, k in kind.items() if k == "leak"} - gone["toxicity"]
    cut = seen["decontaminate"][1]
    for i, k in kind.items():
        if k == "part" and i in cut:
            assert not any(b in cut[i].text for _, b in bench) and len(cut[i].text.split()) == 900
    assert not gone["secrets"]
    for i, r in seen["secrets"][1].items():
        assert kind.get(i) != "secret" or ("[SECRET]" in r.text and "ebab91ab" not in r.text)
    mix = docs.collect()
    assert all(0 < r.taken <= 3 * r.size for r in mix)
    by = {}
    for r in mix:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(t == int(target) for t, target in by.values())


def test_run_is_the_stages_and_reruns_agree(spark, tmp_path):
    folder = str(tmp_path)
    small(spark, folder)
    a, b = (sorted(map(str, corpus_pipeline.run(spark, folder).collect())) for _ in range(2))
    assert a == b and a
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/r{i}")
        docs = spark.read.parquet(f"{folder}/r{i}")
    assert sorted(map(str, docs.collect())) == a


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_an_empty_table(spark, tmp_path, stage):
    folder = str(tmp_path)
    small(spark, folder)
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, empty, folder).count() == 0


MADE = ("size", "source_size", "target", "taken", "__score", "__md", "__own", "__first", "__n", "md", "node", "slot", "key", "Text2")


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_clashing_columns_repeated_rows_nulls_and_long_texts(spark, tmp_path, stage):
    folder = str(tmp_path)
    small(spark, folder)
    name, run = corpus_pipeline.STAGES[stage]
    rng = np.random.default_rng(2)
    long = " ".join(rng.choice([f"l{i}" for i in range(5000)], 60_000))
    rows = [(1, "one and the same text", "en", "s", 21)] * 3 + [(2, long, "en", "s", len(long)), (3, long + " end", None, None, None), (None, "no id here", None, "s", None), (None, None, None, None, None), (None, "", None, None, 0), (4, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    for i, c in enumerate(MADE):
        docs = docs.withColumn(c, F.lit(100 + i))
    out = run(spark, docs, folder)
    added = ["_size", "_source_size", "_target", "_taken"] if name == "mixing" else []
    assert out.columns == [*docs.columns, *added]
    got = out.collect()
    assert all(r[c] == 100 + i for r in got for i, c in enumerate(MADE))
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text is None, len(r.text or "")) for r in got)
    everything = sorted((-1 if r[0] is None else r[0], r[1] is None, len(r[1] or "")) for r in rows)
    if name == "simhash":  # one of each: the repeated row, the long text and its near copy, the text without id, the empty ones
        assert [k[0] for k in kept] == [-1, 1, 2, 4]
    elif name == "mixing":  # what has no words is never taken
        assert kept == [k for k in everything if k[2]] and all(0 < r._taken <= 3 * r._size for r in got)
    else:
        assert kept == everything


def test_operators_are_those_of_the_queries():
    assert callable(simhash.keep_one) and callable(decontaminate.remove) and callable(secrets.redact)
