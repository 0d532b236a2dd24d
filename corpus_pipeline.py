"""The corpus pipeline: documents in, a deduplicated, cleaned and mixed corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All stages take whole tables and
whole texts; all but the last return the columns of docs, whatever others there are and however they are named.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, mixing, secrets, simhash, toxicity
from skein.llm.common import fresh, load, shared_folder

#: Toxicity score from which a document is rejected.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under TOXIC; the model learns from the labels of documents that are here, outside the held-out quarter.

    Null and empty texts get the score of a text without words; a null doc_id has no label and is scored like any other; repeated rows share their fate; a score of exactly TOXIC
    is rejected; long texts are scored whole; without labels the score is a base rate under TOXIC, so all stay; an empty table gives no rows.
    """
    machine = toxicity.train(docs, load(spark, sf_dir, "labels"))
    [name] = fresh(docs.columns, "__score")
    return toxicity.score(docs, machine, column=name).where(F.col(name) < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five-word shingles, a similarity of 0.8 or more): that with the smallest doc_id, null last.

    Null and empty texts are copies of each other; texts under five words are one shingle; of repeated rows one stays, of a tie without doc_id the
    lower md5; long texts are compared whole; an empty table gives no rows.
    """
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No contaminated documents; the hit words of others are cut out, and n_chars follows.

    Null and empty texts have no words and stay as they are; repeated rows are treated alike; a document with exactly a twentieth of its words hit goes;
    long texts are searched whole; with an empty benchmark all stay; an empty table gives no rows.
    """
    return decontaminate.remove(docs, load(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark, and n_chars follows.

    Null and empty texts stay as they are; repeated rows are treated alike; spans that overlap get one mark; long texts are scanned whole; an empty table gives no rows.
    """
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken (the words taken of each, repeats counted).

    Texts without words are never taken; a null source is a source of its own; rows without doc_id are placed by their text; repeated rows count each, and equal
    sizes of one doc_id are ordered by their texts, so reruns agree; an empty table gives no rows. Columns of docs all stay: where one has the
    name of a made column, the made one gets underscores before its name.
    """
    made = ("size", "source_size", "target", "taken")
    names = fresh(docs.columns, *made)
    own = fresh((*docs.columns, *made), *(f"__own_{c}" for c in docs.columns))
    kept = {c: o for c, o in zip(docs.columns, own, strict=True) if c not in ("doc_id", "source")}
    out = mixing.mix(docs.select("*", *(F.col(f"`{c}`").alias(o) for c, o in kept.items())), keep=tuple(kept.values())).where("taken > 0")
    return out.select(*(F.col(kept.get(c, c)).alias(c) for c in docs.columns), *(F.col(m).alias(n) for m, n in zip(made, names, strict=True)))


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("decontaminate", decontaminated), ("secrets", redacted), ("mixing", mixed)]
#: SQL can't express the model, XXH64 sketches or zstandard; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
