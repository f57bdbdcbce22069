"""Methylation summaries by genome and read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def control_percentages(df: DataFrame, controls: list[str], chrom: str = "chrom", percent: str = "percent") -> DataFrame:
    """(genome, n, mean, std, median) of the percentages on contigs that begin with a control's name."""
    name = F.lit(None).cast("string")
    for c in controls:
        name = F.when(F.col(chrom).startswith(c), c).otherwise(name)
    rows = df.withColumn("genome", name).where("genome IS NOT NULL")
    return rows.groupBy("genome").agg(F.count(percent).alias("n"), F.avg(percent).alias("mean"), F.stddev_samp(percent).alias("std"), F.percentile(percent, F.lit(0.5)).alias("median"))


def distribution(df: DataFrame, value: str, detail: str) -> DataFrame:
    """(metric, value, detail): mean, std and median of a column as rows."""
    sums = df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.percentile(value, F.lit(0.5)).alias("median"))
    return sums.unpivot([], ["mean", "std", "median"], "metric", "value").withColumn("detail", F.lit(detail))
