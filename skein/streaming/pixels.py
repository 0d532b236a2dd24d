"""Incremental contact aggregates over a folder that pairs files arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import contacts as c

PAIRS = "read_idx long, chrom1 long, pos1 long, chrom2 long, pos2 long, strand1 string, strand2 string, mapq int"


def pairs_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of pairs as a stream, so many new files a batch."""
    return spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def pixel_stream(pairs: DataFrame, contigs: DataFrame, size: int) -> DataFrame:
    """The batch aggregation over a stream: state is one count a bin pair. The contig table is static."""
    return c.pixels(pairs, contigs, size)


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Tumbling windows over event time with a watermark: count and sum by type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def drain(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> StreamingQuery:
    """Runs a stream over what there is into an in-memory table, and returns the finished query."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return query
