"""Mixing sources to target weights with exact budgets, in native DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORDS = r"[^\x20\x09-\x0D]+"
#: A source is dealt out over hash ranges of about this many rows, so that no task holds a hot source.
ROWS_PER_RANGE = 1024
#: Ranges whose sums run up in one group; the sums of whole blocks run up over a source.
RANGES_PER_BLOCK = 1024


def targets(sizes: DataFrame, cycle: int = 3, most: int = 3) -> DataFrame:
    """Adds rank, weight and target to (source, source_size, rows), one row for each source.

    Sources by code point, null last, weigh 1, 2, .. cycle, repeating. They share the sum of all sizes by weight; a target stops at
    most * source_size and the excess is shared anew by weight. In closed form: taken in order of cap / weight, a source is capped if
    its share of what the sources before it leave exceeds its cap. This table has a row for each source, not for each document.
    """
    everything = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("rank", F.row_number().over(everything)).withColumn("weight", (F.col("rank") - 1) % cycle + 1).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    shared = (
        ranked.withColumn("cap_before", F.coalesce(F.sum("cap").over(order), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(order), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("weights", F.sum("weight").over(whole))
    )
    left = (F.col("total") - F.col("cap_before")).cast("double") * F.col("weight")
    capped = left > F.col("cap").cast("double") * (F.col("weights") - F.col("weight_before"))
    shared = shared.withColumn("capped", capped)
    shared = shared.withColumn("cap_sum", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(whole)).withColumn("weight_sum", F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(whole))
    share = F.col("weight") * (F.col("total") - F.col("cap_sum")) / F.greatest(F.col("weights") - F.col("weight_sum"), F.lit(1))
    return shared.select("source", "source_size", "rows", "rank", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share.cast("double")).alias("target"))


def mix(docs: DataFrame, seed: int = 0, rows_per_range: int = ROWS_PER_RANGE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Deals each source's budget of words to its documents in random order; returns doc_id, source, size, source_size, target, taken.

    Each document gets a hash-random key. A source's key space is cut into ranges of about rows_per_range documents. Prefix sums are taken in three levels: over
    the blocks of RANGES_PER_BLOCK ranges of a source, over the ranges of a block, and inside each range; together they are every document's place. The
    budget is floor(target) words: whole epochs over the source first, then documents in key order, the last one in part, so the words taken of a
    source are its budget exactly and no document is taken more than three times.

    Null or empty text: size 0, taken 0. Null source: a source of its own, ranked last. Null or repeated doc_id: each row counts; rows with
    the same doc_id share a key (rows without one: those with the same text) and are ordered by size, then by a hash of the text, so that reruns agree on which
    text is cut. Very long texts are only counted. An empty table gives no rows. Columns other than doc_id, source and text are ignored, but those named in
    keep are carried along under their own names (texts then move once, with their rows; sizes and sums never carry them).
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size")
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    key = F.md5(F.concat(F.lit(f"{seed}:"), named)).alias("key")
    extra = [F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)]
    sized = materialize(docs.select("doc_id", "source", size, key))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / rows_per_range))).cast("int")
    sources = sources.select(F.col("source").alias("of"), "source_size", "rank", "target", F.least(bits, F.lit(31)).alias("bits"))

    def placed_in_range(rows: DataFrame) -> DataFrame:
        found = rows.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        return found.withColumn("range", F.expr("shiftright(cast(conv(substring(key, 1, 8), 16, 10) as bigint), 32 - bits)")).drop("bits")

    narrow = placed_in_range(sized)
    rows = placed_in_range(docs.select("doc_id", "source", size, key, F.xxhash64("text").alias("tie"), *extra)) if keep else narrow.withColumn("tie", F.lit(0))
    block = F.floor(F.col("range") / RANGES_PER_BLOCK).cast("long")
    summed = narrow.groupBy("rank", "range").agg(F.sum("size").alias("in_range")).withColumn("block", block)
    earlier = Window.partitionBy("rank").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = summed.groupBy("rank", "block").agg(F.sum("in_range").alias("in_block"))
    blocks = blocks.select(F.col("rank").alias("b_rank"), F.col("block").alias("b_block"), F.coalesce(F.sum("in_block").over(earlier), F.lit(0)).alias("base"))
    before = Window.partitionBy("rank", "block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = summed.withColumn("before", F.coalesce(F.sum("in_range").over(before), F.lit(0))).join(blocks, (F.col("rank") == F.col("b_rank")) & (F.col("block") == F.col("b_block")))
    ranges = ranges.select(F.col("rank").alias("r_rank"), F.col("range").alias("r_range"), (F.col("base") + F.col("before")).alias("offset"))
    inside = Window.partitionBy("rank", "range").orderBy("key", "size", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(ranges, (F.col("rank") == F.col("r_rank")) & (F.col("range") == F.col("r_range"))).withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - F.col("start")))
    kept = [F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)]
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * epochs + part).cast("long").alias("taken"), *kept)


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))) AS key
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rnk FROM sized GROUP BY source),
weighed AS (SELECT *, (rnk - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM ranked),
run AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM weighed WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (
  SELECT *, CAST(total - cap_before AS DOUBLE) * weight > CAST(cap AS DOUBLE) * CAST(weights - weight_before AS DOUBLE) AS is_capped FROM run),
sums AS (
  SELECT *, sum(CASE WHEN is_capped THEN cap ELSE 0 END) OVER () AS cap_sum,
         sum(CASE WHEN is_capped THEN weight ELSE 0 END) OVER () AS weight_sum FROM capped),
targets AS (
  SELECT source, source_size, CASE WHEN is_capped THEN CAST(cap AS DOUBLE)
    ELSE CAST(weight * (total - cap_sum) AS DOUBLE) / CAST(greatest(weights - weight_sum, 1) AS DOUBLE) END AS target FROM sums),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(size * epochs + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken
FROM cut
"""
