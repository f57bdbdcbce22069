"""Read-count matrices of cohorts, kept long: chrom, start, end, sample, count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rebinned(df: DataFrame, width: int, key: str = "chrom") -> DataFrame:
    """Counts of wider windows (from 0); ``width`` must be a multiple of the present one."""
    at = F.floor(F.col("start") / width) * width
    return df.groupBy(key, at.alias("start"), "sample").agg(F.max("end").alias("end"), F.sum("count").alias("count"))


def window_counts(reads: DataFrame, width: int, key: str = "chrom", pos: str = "pos") -> DataFrame:
    at = F.floor(F.col(pos) / width) * width
    return reads.groupBy(key, at.alias("start")).agg(F.count(F.lit(1)).alias("count")).withColumn("end", F.col("start") + width)


def matrix(df: DataFrame, samples: list[str], key: str = "chrom") -> DataFrame:
    """One column a sample, zeros where a window has no row."""
    return df.groupBy(key, "start", "end").pivot("sample", samples).agg(F.sum("count")).na.fill(0)


def normalised(df: DataFrame, by: str = "median") -> DataFrame:
    """Counts scaled so that each sample's statistic over windows with reads is the cohort's mean of it."""
    stat = {"median": F.median("count"), "mean": F.avg("count"), "q75": F.percentile("count", F.lit(0.75)), "mode": F.mode("count", True).cast("double")}[by]
    per = df.where("count > 0").groupBy("sample").agg(stat.cast("double").alias("__s"))
    target = per.agg(F.avg("__s").alias("__t"))
    return df.join(per, "sample", "left").join(F.broadcast(target)).withColumn("norm", F.coalesce(F.col("count") * F.try_divide(F.col("__t"), F.col("__s")), F.lit(0.0))).drop("__s", "__t")


def cohort_mean(df: DataFrame, key: str = "chrom", value: str = "count") -> DataFrame:
    return df.groupBy(key, "start", "end").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"))


def capped(df: DataFrame, q: float = 0.999, factor: float = 2.0, key: str = "chrom", value: str = "count") -> DataFrame:
    """Windows whose cohort mean is over its ``q`` quantile become ``factor`` times the quantile."""
    means = df.groupBy(key, "start", "end").agg(F.avg(value).alias("__m"))
    cut = means.agg(F.percentile("__m", F.lit(q)).alias("__c"))
    over = means.join(F.broadcast(cut)).where("__m > __c").select(key, "start", "end", "__c")
    return df.join(over, [key, "start", "end"], "left").withColumn(value, F.coalesce(F.col("__c") * factor, F.col(value).cast("double"))).drop("__c")


def two_class_cutoff(df: DataFrame, value: str) -> DataFrame:
    """The cutoff between two classes with the least summed squared deviation, by running sums.

    One row a sample is ordered, not one a read."""
    w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value).cast("double")
    run = df.select(x.alias("x")).withColumns({"n": F.count(F.lit(1)).over(w), "s": F.sum("x").over(w), "q": F.sum(F.col("x") ** 2).over(w), "next": F.lead("x").over(Window.orderBy("x"))})
    total = df.agg(F.count(F.lit(1)).alias("n_all"), F.sum(x).alias("s_all"), F.sum(x**2).alias("q_all"))
    cost = F.col("q") - F.col("s") ** 2 / F.col("n") + (F.col("q_all") - F.col("q")) - (F.col("s_all") - F.col("s")) ** 2 / (F.col("n_all") - F.col("n"))
    return run.where("next IS NOT NULL").join(F.broadcast(total)).select(((F.col("x") + F.col("next")) / 2).alias("cutoff"), cost.alias("cost")).orderBy("cost", "cutoff").limit(1)


def smoothed_windows(df: DataFrame, width: int, key: str = "chrom", value: str = "count") -> DataFrame:
    return df.groupBy(key, (F.floor(F.col("start") / width) * width).alias("start")).agg(F.median(value).alias("median")).withColumn("end", F.col("start") + width)
