"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Odd multiplier of the rolling word-sequence hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: A second, independent multiplier.
BASE2 = 0xC2B2AE3D27D4EB4F
BASE2_INV = pow(BASE2, -1, 1 << 64)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, that of spark.checkpoint.dir. Where it is unset, a temporary one in a single local JVM; on a cluster an error, as others wouldn't see it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skein-checkpoint-"))
    return context.getCheckpointDir()


#: Set while a DataFrame is made, lets its shuffle files go at the end of the action that runs it.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, release: bool = False) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder.

    release: its shuffle files go once the checkpoint is written, as nothing reads them again; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if release:
        before = spark.conf.get(RELEASE, "false")
        spark.conf.set(RELEASE, "true")
        try:
            df = df.select("*")
        finally:
            spark.conf.set(RELEASE, before)
    return df.checkpoint(eager=True)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns (which Spark compares without case)."""
    known = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        out.append(name)
    return out


def raw(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, without copies, so that Python objects are made for few rows at a time; memory that a batch used goes back to the system."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
        del batch
        pa.default_memory_pool().release_unused()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), dtype=U64, count=len(words))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting: much faster for 64-bit integers than numpy's hash table."""
    values = np.sort(values)
    fresh = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    return values[fresh]


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base & (2**64 - 1), dtype=U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=U64)


class Rolling:
    """Hashes of all windows of a word-hash sequence in linear time: prefix sums of h[i] * B**i, shifted back by B**-i."""

    def __init__(self, base: int = BASE, inverse: int = BASE_INV):
        self.base, self.inverse = base, inverse
        self.up = self.down = np.zeros(0, dtype=U64)

    def __call__(self, h: np.ndarray, width: int) -> np.ndarray:
        n = len(h) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=U64)
        if len(self.up) < len(h):
            size = max(len(h), 2 * len(self.up))
            self.up, self.down = powers(size, self.base), powers(size, self.inverse)
        total = np.zeros(len(h) + 1, dtype=U64)
        np.cumsum(h * self.up[: len(h)], out=total[1:], dtype=U64)
        return mix((total[width:] - total[:n]) * self.down[:n])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned values as differences, cut to as many bytes as the largest one needs."""
    if not len(values):
        return b""
    steps = np.empty(len(values), dtype=U64)
    steps[0] = values[0]
    np.subtract(values[1:], values[:-1], out=steps[1:])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = steps.view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype=U64)
    width = blob[0]
    planes = np.frombuffer(blob, dtype=np.uint8, offset=1).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(steps.view(U64).reshape(-1), dtype=U64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Unsigned counts in any order: a byte each, and those of 255 or more in full after them."""
    return len(counts).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    out = np.frombuffer(blob, dtype=np.uint8, offset=8, count=n).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, dtype="<u8", offset=8 + n).astype(np.int64)
    return out
