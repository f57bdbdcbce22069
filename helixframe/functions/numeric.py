"""Quality, probability and array expressions. Spark's ANSI mode is expected: ratios are
guarded and never raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b == 0, default).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def phred(p: Column) -> Column:
    return -10 * F.log10(p)


def unphred(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def phred_text(p: Column) -> Column:
    """An array of error probabilities as a quality string."""
    return F.array_join(F.transform(p, lambda x: F.char((-10 * F.log10(x)).cast("int") + 33)), "")


def text_quals(s: Column) -> Column:
    """A quality string as error probabilities."""
    return F.transform(F.filter(F.split(s, ""), lambda x: x != ""), lambda c: F.pow(F.lit(10.0), (33 - F.ascii(c)) / 10.0))


def capped_phred(correct: Column, most: float = 60.0) -> Column:
    """Phred of the error probability 1 - correct, at most ``most``."""
    return -10 * F.log10(F.greatest(1 - correct, F.pow(F.lit(10.0), F.lit(-most / 10))))


def phred_correct(q: Column) -> Column:
    return 1 - F.pow(F.lit(10.0), -q / 10)


def logit_phred(p: Column, most: float = 60.0) -> Column:
    """Log odds in phred units: phred of 1 - p less phred of p, both capped."""
    floor = F.pow(F.lit(10.0), F.lit(-most / 10))
    return -10 * F.log10(F.greatest(1 - p, floor)) + 10 * F.log10(F.greatest(p, floor))


def from_logit_phred(x: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -x / 10))


def other_prior(p: Column, old: float, new: float) -> Column:
    """A probability moved from one prior to another by its odds."""
    odds = F.try_divide(p, 1 - p) * (new / (1 - new)) / (old / (1 - old))
    return F.when(p >= 1, 1.0).otherwise(odds / (1 + odds))


def mean_over_folds(probs: Column, most: float = 60.0) -> Column:
    """Mean of an array of probabilities in log-odds space, nulls left out."""
    there = F.filter(probs, lambda x: x.isNotNull())
    total = F.aggregate(there, F.lit(0.0), lambda s, x: s + logit_phred(x, most))
    return from_logit_phred(F.try_divide(total, F.size(there).cast("double")))


def out_of_fold(probs: Column, fold: Column) -> Column:
    """The probability of the fold's own model; the mean of all for rows in no fold."""
    return F.when(fold.isNull(), mean_over_folds(probs)).otherwise(F.get(probs, fold))


def scaled_table(table: Column, n: Column) -> Column:
    total = F.aggregate(table, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.transform(table, lambda x: F.bround(F.try_divide(x * n, total)).cast("long"))


def plus_one_shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x.cast("double") + 1)
    return F.transform(counts, lambda x: (x + 1) / total)


def scaled_gap(a: Column, b: Column, most: int, scale: float) -> Column:
    return F.least(F.lit(most), F.floor(scale * F.greatest(a, b)))


def bracket(value: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear interpolation through sorted points, level beyond the ends."""
    out = F.lit(float(ys[-1]))
    for i in range(len(xs) - 1, 0, -1):
        slope = (ys[i] - ys[i - 1]) / (xs[i] - xs[i - 1]) if xs[i] > xs[i - 1] else 0.0
        out = F.when(value < xs[i], ys[i - 1] + (value - xs[i - 1]) * slope).otherwise(out)
    return F.when(value <= xs[0], float(ys[0])).otherwise(out)


def insert_place(values: Column, x: Column) -> Column:
    """How many entries of a sorted array are under ``x``."""
    return F.size(F.filter(values, lambda v: v < x))


def sanitized(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_.+-]", "_")
