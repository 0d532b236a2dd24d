"""Session factory used by tests, the bench and ad-hoc runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "skein", cores: int | None = None, shuffle: int | None = None, **conf: str) -> SparkSession:
    """A local session with adaptive execution on; on a cluster pass the master through spark-submit instead."""
    cores = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SKEIN_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
