"""Small helpers of the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: str | Column) -> Column:
    """Rounded to six places, as sums of doubles depend on their order."""
    return F.round(col(c), 6)


def r9(c: str | Column) -> Column:
    """Rounded to nine places: what limits are compared with, as a sum of fractions that makes 2 may come out a bit under it, by the order of its terms."""
    return F.round(col(c), 9)


def floordiv(a: str | Column, b: int | str | Column) -> Column:
    """Whole-number quotient, rounded down; operands are not negative here."""
    b = F.lit(b) if isinstance(b, int) else col(b)
    return F.floor(col(a) / b).cast("long")


def in_partition(*keys: str, order: list | None = None):
    w = Window.partitionBy(*keys)
    return w.orderBy(*order) if order else w


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, that of spark.checkpoint.dir. Where it is unset, a temporary one in a single local JVM; on a cluster an error, as others wouldn't see it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skein-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As cut_lineage(), for large tables that are read more than once: as Parquet in the shared folder, a fraction of a checkpoint's size, which goes with that folder."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A broadcast hint for tables of at most so many rows (narrow ones: some tens of bytes a row), which are counted first; larger ones are joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def collected(df: DataFrame, most: int = 100_000) -> list:
    """The rows of a table of groups, on the driver; an error, not a longer wait, if it has more than `most`."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: this table is no table of groups")
    return rows
