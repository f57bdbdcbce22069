"""Quality recalibration: count lookup tables, grid binning in Spark, smoothing on the grid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_table(df: DataFrame, score: str, label: str, scale: float = 1.0, most: float = 100.0) -> DataFrame:
    """(score, tpr, fpr, quality): at each whole score, the shares of either class at or over
    it, and the phred of scale * fpr / tpr. One pass, then as many rows as scores."""
    by = df.groupBy(F.floor(score).cast("int").alias("score")).agg(F.sum(F.col(label).cast("int")).alias("t"), F.sum(1 - F.col(label).cast("int")).alias("f"))
    up = Window.orderBy(F.col("score").desc())
    whole = Window.partitionBy()
    run = by.select("score", F.try_divide(F.sum("t").over(up).cast("double"), F.sum("t").over(whole)).alias("tpr"), F.try_divide(F.sum("f").over(up).cast("double"), F.sum("f").over(whole)).alias("fpr"))
    error = F.greatest(F.coalesce(F.try_divide(scale * F.col("fpr"), F.col("tpr")), F.lit(1.0)), F.lit(10.0 ** (-most / 10)))
    return run.withColumn("quality", -10 * F.log10(F.least(error, F.lit(1.0))))


def on_grid(df: DataFrame, value: str, low: float, high: float, cells: int, weight: str | None = None) -> DataFrame:
    """(cell, mass): each value's weight shared linearly by the two grid points around it;
    values beyond the ends go to them. Mass is conserved."""
    step = (high - low) / (cells - 1)
    x = (F.least(F.greatest(F.col(value).cast("double"), F.lit(low)), F.lit(high)) - low) / step
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    at = F.least(F.floor(x), F.lit(cells - 2)).cast("int")
    parts = df.where(F.col(value).isNotNull()).select(at.alias("i"), (x - at).alias("f"), w.alias("w"))
    both = parts.groupBy("i").agg(F.sum(F.col("w") * (1 - F.col("f"))).alias("a"), F.sum(F.col("w") * F.col("f")).alias("b"))
    return both.select(F.explode(F.array(F.struct(F.col("i").alias("cell"), F.col("a").alias("m")), F.struct((F.col("i") + 1).alias("cell"), F.col("b").alias("m")))).alias("c")).groupBy("c.cell").agg(F.sum("c.m").alias("mass"))


def grid_array(cells: DataFrame, size: int) -> np.ndarray:
    """The grid as an array; it has ``size`` cells however long the table was."""
    out = np.zeros(size)
    for cell, mass in cells.collect():
        out[cell] = mass
    return out


def gaussian(sigma: float, step: float, reach: float = 6.0) -> np.ndarray:
    n = max(1, int(np.ceil(reach * sigma / step)))
    k = np.exp(-0.5 * (np.arange(-n, n + 1) * step / sigma) ** 2)
    return k / k.sum()


def exponential(sigma: float, step: float, reach: float = 8.0) -> np.ndarray:
    n = max(1, int(np.ceil(reach * sigma / step)))
    k = np.exp(-np.abs(np.arange(-n, n + 1)) * step / sigma)
    return k / k.sum()


def convolved(signal: np.ndarray, kernel: np.ndarray, edge: str = "reflect") -> np.ndarray:
    """The signal smoothed by FFT, of the same length; ``edge``: reflect or zero."""
    n = len(kernel) // 2
    wide = np.pad(signal, n, mode="symmetric") if edge == "reflect" else np.pad(signal, n)
    size = 1 << (len(wide) + len(kernel) - 2).bit_length()
    out = np.fft.irfft(np.fft.rfft(wide, size) * np.fft.rfft(kernel, size), size)
    return np.maximum(out[2 * n : 2 * n + len(signal)], 0)


def adaptive_density(mass: np.ndarray, sigma: np.ndarray, step: float, levels: int = 5) -> np.ndarray:
    """Kernel density with a bandwidth for each cell: cells of a like bandwidth are smoothed
    together, each cell's mass shared by the two levels around its own."""
    low, high = np.log(max(sigma.min(), step / 4)), np.log(max(sigma.max(), step / 4))
    marks = np.linspace(low, high, levels) if high > low else np.array([low])
    x = (np.log(np.maximum(sigma, step / 4)) - low) / (high - low) * (levels - 1) if len(marks) > 1 else np.zeros(len(sigma))
    at = np.minimum(np.floor(x).astype(int), max(len(marks) - 2, 0))
    part = x - at
    out = np.zeros(len(mass))
    for i, mark in enumerate(marks):
        share = np.where(at == i, 1 - part, 0.0) + np.where(at == i - 1, part, 0.0)
        if len(marks) == 1:
            share = np.ones(len(mass))
        out += convolved(mass * share, gaussian(float(np.exp(mark)), step))
    return out


def monotone(values: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """The nearest non-decreasing sequence, by pooling adjacent violators."""
    weights = np.ones(len(values)) if weights is None else weights
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([float(v), float(w), 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            w = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w if w else a[0], w, a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def smoothed_quality(df: DataFrame, score: str, label: str, sigma: float, cells: int = 1024, high: float = 100.0, scale: float = 1.0, levels: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(grid, quality): the count table's quality with both densities smoothed on a grid. One
    pass over the data for either class; the rest works on ``cells`` numbers."""
    grid = np.linspace(0, high, cells)
    step = grid[1] - grid[0]
    width = np.maximum(sigma * (1 + grid / high), step)
    true, false = (adaptive_density(grid_array(on_grid(df.where(F.col(label) == v), score, 0.0, high, cells), cells), width, step, levels) for v in (True, False))
    tpr, fpr = (np.cumsum(d[::-1])[::-1] / max(d.sum(), 1e-300) for d in (true, false))
    error = np.clip(scale * fpr / np.maximum(tpr, 1e-12), 10 ** (-high / 10), 1.0)
    return grid, monotone(-10 * np.log10(error))
