"""Tables of assay quality: substitutions, methylation, coverage, tag categories, costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna, numeric


def zero_filled(counts: DataFrame, name: str, values: list[str], count: str = "n") -> DataFrame:
    """``counts`` with one row for each of ``values``, 0 where there is none."""
    spark = counts.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return F.broadcast(wanted).join(counts, name, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def substitution_counts(df: DataFrame, left: str, ref: str, right: str, alt: str) -> DataFrame:
    """(substitution, n) for all substitutions within three bases; those with N don't count."""
    found = df.select(dna.substitution(F.col(left), F.col(ref), F.col(right), F.col(alt)).alias("substitution")).groupBy("substitution").agg(F.count(F.lit(1)).alias("n"))
    return zero_filled(found, "substitution", dna.all_substitutions())


def summed(frames: list[DataFrame], count: str) -> DataFrame:
    """The union, counts summed over equal other columns; null is a value."""
    both = reduce(DataFrame.unionByName, frames)
    return both.groupBy(*[c for c in both.columns if c != count]).agg(F.sum(count).alias(count))


def summed_frequencies(frames: list[DataFrame], context: str, count: str, expected: str) -> DataFrame:
    """(context, count, expected, observed, ratio): shares recomputed from summed counts."""
    both = reduce(DataFrame.unionByName, frames).groupBy(context).agg(F.sum(count).alias(count), F.first(expected, ignorenulls=True).alias(expected))
    total = both.agg(F.sum(count).alias("__all"))
    shares = both.crossJoin(F.broadcast(total)).withColumn("observed", F.try_divide(F.col(count), F.col("__all"))).drop("__all")
    return shares.withColumn("ratio", F.try_divide(F.col("observed"), F.col(expected)))


def percent_histogram(df: DataFrame, value: str, keys: list[str] = (), width: int = 10) -> DataFrame:
    """(keys, upper edge, n, share) of percentages; the last bin holds 100 itself."""
    edge = (F.least(F.floor(F.col(value) / width), F.lit(100 // width - 1)) + 1) * width
    counts = df.where(F.col(value).between(0, 100)).groupBy(*keys, edge.cast("int").alias("edge")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def methylation_by_position(df: DataFrame, strand: str, position: str, methylated: str, unmethylated: str) -> DataFrame:
    """(strand, position, percent)."""
    counts = df.groupBy(strand, position).agg(F.sum(methylated).alias("m"), F.sum(unmethylated).alias("u"))
    return counts.select(strand, position, (100 * F.try_divide(F.col("m"), F.col("m") + F.col("u"))).alias("percent"))


def family(contig: Column) -> Column:
    """The genome family that a contig name begins with: its letters."""
    return F.nullif(F.regexp_extract(contig, r"^([A-Za-z]+)", 1), F.lit(""))


def truncated(hist: DataFrame, keys: list[str], value: str, count: str, q: float = 0.99) -> DataFrame:
    """The histogram up to and with the first value at which the share ``q`` is reached."""
    line = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(count).over(line), F.lit(0))
    return hist.withColumn("__b", before / F.sum(count).over(Window.partitionBy(*keys))).where(F.col("__b") < q).drop("__b")


def mean_of_histogram(hist: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """(keys, mean, whole): the mean and the next whole number."""
    mean = F.try_divide(F.sum(F.col(value) * F.col(count)), F.sum(count))
    return hist.groupBy(*keys).agg(mean.alias("mean"), F.ceil(mean).alias("whole"))


def category_counts(df: DataFrame, columns: list[str], categories: list[str], count: str) -> DataFrame:
    """(category, one total per column) for each category; one pass whatever the columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("category")) for c in columns]))
    long = df.select(pairs.alias("p"), F.col(count).alias("c")).select("p.*", "c").where(F.col("category").isin(*categories))
    sums = long.groupBy("category").agg(*[F.coalesce(F.sum(F.when(F.col("column") == c, F.col("c"))), F.lit(0)).alias(c) for c in columns])
    return reduce(lambda d, c: d.withColumn(c, F.coalesce(c, F.lit(0))), columns, zero_filled(sums, "category", categories, columns[0]))


def consensus(df: DataFrame, start: str, end: str, count: str, unreached: str = "END_UNREACHED") -> DataFrame:
    """(category, share): reads whose ends agree, DISCORDANT for the rest; unreached ends don't count."""
    agree = F.when(F.col(start) == F.col(end), F.col(start)).otherwise("DISCORDANT")
    sums = df.where(~F.col(end).eqNullSafe(unreached)).groupBy(agree.alias("category")).agg(F.sum(count).alias("n"))
    return sums.select("category", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def least_in_family(df: DataFrame, family: str, value: str, ties: str) -> DataFrame:
    """The row of each family with the least ``value``, then the least ``ties``; no shuffle of rows."""
    others = F.struct(F.col(value), F.col(ties), *[F.col(c) for c in df.columns if c not in (family, value, ties)])
    return df.where(F.col(value).isNotNull()).groupBy(family).agg(F.min(others).alias("r")).select(family, "r.*")


def filter_quality(tpr: Column, fpr: Column, base_error: float, most: float = 60.0) -> Column:
    """The quality of reads that pass, from both rates and the error rate before."""
    return numeric.capped_phred(1 - F.try_divide(fpr, tpr) * base_error, most)


def task_costs(df: DataFrame, name: str, cost: str, seconds: str, instance: str) -> DataFrame:
    """(task, cost, hours, instance): shards of a task together, and a row ``total``.

    A shard's name is the task's and a number after the last hyphen.
    """
    task = F.regexp_replace(name, r"-\d+$", "")
    first = F.min(instance).alias("instance")
    rows = df.groupBy(task.alias("task")).agg(F.sum(cost).alias("cost"), (F.avg(seconds) / 3600).alias("hours"), first)
    total = df.agg(F.lit("total").alias("task"), F.sum(cost).alias("cost"), (F.sum(seconds) / 3600).alias("hours"), F.lit(None).cast(df.schema[instance].dataType).alias("instance"))
    return rows.unionByName(total)
