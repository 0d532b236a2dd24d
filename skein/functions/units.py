"""Sizes as people write them, and strand helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors of the suffixes.
FACTORS = {"": 1, "k": 1_000, "m": 1_000_000, "g": 1_000_000_000}


def to_number(size: str | int) -> int:
    """'500k', '5m', '1.5g', '10kb' or a number, as a number of bases."""
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\s*([kmgKMG]?)[bB]?(?:p|P)?\s*", str(size))
    if not m:
        raise ValueError(f"not a size: {size!r}")
    return round(float(m[1]) * FACTORS[m[2].lower()])


def to_text(n: int) -> str:
    """The largest suffix that leaves a whole number, else one decimal."""
    for suffix in ("g", "m", "k"):
        if n and n % FACTORS[suffix] == 0:
            return f"{n // FACTORS[suffix]}{suffix}"
    for suffix in ("g", "m", "k"):
        if n >= FACTORS[suffix]:
            return f"{n / FACTORS[suffix]:.1f}{suffix}"
    return str(n)


def flip(strand: str | Column) -> Column:
    return F.translate(F.col(strand) if isinstance(strand, str) else strand, "+-", "-+")


def sign(strand: str | Column) -> Column:
    return F.when((F.col(strand) if isinstance(strand, str) else strand) == "+", 1).otherwise(-1)


def natural_key(name: str) -> Column:
    """Orders names by their runs of text and of digits in turn, digits by value (of any length; equal values by fewer leading zeros) and before text."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))

    def part(run: Column) -> Column:
        digits = run.rlike(r"^\d")
        value = F.when(digits, F.regexp_replace(run, r"^0+(?=\d)", "")).otherwise(run)
        return F.struct(F.when(digits, 0).otherwise(1).alias("kind"), F.when(digits, F.length(value)).otherwise(0).alias("size"), value.alias("value"), F.length(run).alias("width"))

    return F.transform(runs, part)


def split_name(name: str) -> tuple[Column, Column, Column]:
    """Parts of 'contig|start_end'."""
    return F.substring_index(name, "|", 1), F.regexp_extract(name, r"\|(\d+)_\d+$", 1).try_cast("bigint"), F.regexp_extract(name, r"\|\d+_(\d+)$", 1).try_cast("bigint")
