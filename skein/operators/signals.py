"""Signal routines on per-contig series: smoothing, peaks, troughs, depth peaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with mirrored ends."""
    reach = max(1, int(4 * sigma + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(values.astype(float), reach, mode="symmetric" if len(values) >= reach else "edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def peaks(values: np.ndarray, prominence: float = 0.0) -> np.ndarray:
    """Places of local maxima (the middle of plateaus) that rise by the prominence over the higher of the lowest points to both sides before higher ground."""
    out, i, n = [], 1, len(values)
    while i < n - 1:
        if values[i] > values[i - 1]:
            j = i
            while j < n - 1 and values[j + 1] == values[i]:
                j += 1
            if j < n - 1 and values[j + 1] < values[i]:
                at = (i + j) // 2
                higher_left = np.flatnonzero(values[:i] > values[at])
                higher_right = np.flatnonzero(values[j + 1 :] > values[at])
                left = values[(higher_left[-1] if len(higher_left) else 0) : i].min()
                right = values[j + 1 : (j + 1 + higher_right[0] if len(higher_right) else n)].min()
                if values[at] - max(left, right) >= prominence:
                    out.append(at)
            i = j
        i += 1
    return np.array(out, dtype=int)


def coverage_breaks(coverage: DataFrame, sigma: float = 2.0, depth: float = 0.5, edge: int = 3) -> DataFrame:
    """Troughs of each contig's smoothed spanning coverage that fall under `depth` times its median, away from its ends: contig, w, n, ratio.

    A contig's windows are one group: its length over the window size, whatever the number of reads.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("w")
        v = np.round(smooth(rows["n"].to_numpy(), sigma), 9)  # so that equal stretches stay level
        med = float(np.median(v))
        at = peaks(-v)
        at = at[(at >= edge) & (at < len(v) - edge) & (v[at] < depth * med)] if med > 0 and len(at) else np.zeros(0, dtype=int)
        part = rows.iloc[at]
        return pd.DataFrame({"contig": part["contig"], "w": part["w"], "n": part["n"], "ratio": np.round(v[at] / med, 6) if len(at) else np.zeros(0)})

    return coverage.groupBy("contig").applyInPandas(run, "contig long, w long, n long, ratio double")


def depth_peak(depth: DataFrame, bins: int = 100, sigma: float = 2.0) -> float:
    """The main peak of the histogram of depths up to the 99th percentile, smoothed; at least the median. The histogram is made in Spark; `bins` numbers come back."""
    top, median = depth.agg(F.percentile("n", F.lit(0.99)).alias("a"), F.percentile("n", F.lit(0.5)).alias("b")).first()
    if not top:
        return 0.0
    width = top / bins
    got = depth.where((F.col("n") > 0) & (F.col("n") <= top)).groupBy(F.least(F.floor(F.col("n") / width), F.lit(bins - 1)).alias("k")).agg(F.count("*").alias("c")).collect()
    hist = np.zeros(bins)
    for r in got:
        hist[int(r["k"])] = r["c"]
    v = smooth(hist, sigma)
    at = peaks(v)
    best = int(at[np.argmax(v[at])]) if len(at) else int(np.argmax(v))
    return max((best + 0.5) * width, float(median))


def two_normals(values: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares, means and deviations of a mixture of two normal distributions, by expectation maximisation from the quartiles."""
    m = np.quantile(values, [0.25, 0.9])
    s, p = np.full(2, max(values.std(), 1e-6)), np.array([0.5, 0.5])
    for _ in range(rounds):
        d = p * np.exp(-0.5 * ((values[:, None] - m) / s) ** 2) / s + 1e-300
        r = d / d.sum(1, keepdims=True)
        n = r.sum(0) + 1e-12
        fresh = (r * values[:, None]).sum(0) / n
        s = np.maximum(np.sqrt((r * (values[:, None] - fresh) ** 2).sum(0) / n), 1e-6)
        p = n / len(values)
        if np.abs(fresh - m).max() < 1e-9:
            break
        m = fresh
    return p, m, s


def collapsed_by_mixture(copies: DataFrame, probability: float = 0.8, least: float = 1.35) -> DataFrame:
    """Contigs (chrom, copies) that belong to the upper of two normal components with the given probability and exceed a copy number. One row a contig goes to one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows["copies"].to_numpy(dtype=float)
        p, m, s = two_normals(v)
        hi = int(np.argmax(m))
        d = p * np.exp(-0.5 * ((v[:, None] - m) / s) ** 2) / s + 1e-300
        prob = (d / d.sum(1, keepdims=True))[:, hi]
        keep = (prob > probability) & (v > least)
        return pd.DataFrame({"chrom": rows["chrom"][keep], "copies": v[keep], "probability": np.round(prob[keep], 6)})

    return copies.select("chrom", "copies", F.lit(1).alias("one")).groupBy("one").applyInPandas(run, "chrom long, copies double, probability double")
