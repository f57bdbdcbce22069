"""Systematic-error correction from conditional allele distributions of a cohort."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import special

KEY = ["chrom", "pos", "genotype", "alleles", "allele"]


def merged_distributions(df: DataFrame) -> DataFrame:
    """Strand counts of all samples by locus, genotype, observed alleles and allele."""
    return df.groupBy(*KEY).agg(F.sum("fwd").alias("fwd"), F.sum("rev").alias("rev"), F.sum("n_samples").alias("n_samples"))


def allele_frequency(df: DataFrame) -> DataFrame:
    """Share of a genotype's samples that show the alleles; and the share of an unseen set."""
    sets = df.select("chrom", "pos", "genotype", "alleles", "n_samples").distinct()
    w = Window.partitionBy("chrom", "pos", "genotype")
    total = F.sum("n_samples").over(w)
    return sets.withColumn("frequency", F.try_divide(F.col("n_samples").cast("double"), total.cast("double"))).withColumn("unseen", F.least(1 / (total + 1), F.lit(0.01)))


def likelihood_ratio(actual: Column, expected: Column) -> Column:
    """Multinomial likelihood over its best, of count arrays, on Arrow batches."""
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else special.multinomial_ratio(list(x), [v + 1 for v in y]) for x, y in zip(a, e)], dtype="float64")

    return run(actual, expected)


def enrichment(alt: Column, depth: Column, expected_share: Column) -> Column:
    """P(at least so many alternative reads) under the expected share."""
    return special.arrow(lambda k, n, p: special.binomial_tail(int(k), int(n), p), alt.cast("double"), depth.cast("double"), expected_share)


def called(df: DataFrame, ratio: str = "ratio", enriched: str = "p_enriched", least_ratio: float = 0.1, alpha: float = 0.01) -> DataFrame:
    """novel: no distribution; known: like the reference's noise; variant: enriched beyond it; else uncertain."""
    kind = F.when(F.col(ratio).isNull(), "novel").when((F.col(enriched) < alpha) & (F.col(ratio) < least_ratio), "variant").when(F.col(ratio) >= least_ratio, "known").otherwise("uncertain")
    return df.withColumn("call", kind)


#: Expected share of noise where the alleles were never seen.
UNSEEN_SNP, UNSEEN_INDEL = 0.02, 0.05


def expected_counts(expected: Column, seen: Column, snp: Column, alleles: Column) -> Column:
    """Counts by allele and strand (reference first); where the alleles were never seen, one read of
    each and as many of the reference as the noise share says."""
    ref = F.when(snp, 1 / UNSEEN_SNP).otherwise(1 / UNSEEN_INDEL)
    made = F.transform(F.sequence(F.lit(0), 2 * alleles - 1), lambda i: F.when(i < 2, ref).otherwise(F.lit(1.0)))
    return F.when(seen, F.transform(expected, lambda x: x.cast("double"))).otherwise(made)


def strand_p(actual: Column, expected: Column, snp: Column, strand: int) -> Column:
    """P(at least so many other reads on a strand: 0 forward, 1 reverse); null without reads there."""
    of = lambda xs: F.filter(xs, lambda _, i: i % 2 == strand)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x.cast("double"))
    n, e_all = total(of(actual)), total(of(expected))
    alt, e_alt = n - F.get(actual, F.lit(strand)), e_all - F.get(expected, F.lit(strand))
    share = F.when(e_alt > 0, F.try_divide(e_alt, e_all)).when(e_all > 0, 1 / (e_all + 2)).when(snp, UNSEEN_SNP).otherwise(UNSEEN_INDEL)
    return enrichment(alt, F.when(n > 0, n), share)


def record(df: DataFrame, actual: str = "actual", expected: str = "expected", seen: str = "seen", snp: str = "snp", frequency: str = "frequency") -> DataFrame:
    """``df`` with the p-values of both strands (-1 without reads), both together and their larger
    one, of all other reads, and the likelihood ratio, scaled by how often the alleles are seen."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x.cast("double"))
    rows = df.withColumn("__e", expected_counts(F.col(expected), F.col(seen), F.col(snp), F.floor(F.size(actual) / 2)))
    rows = rows.withColumns({"__f": strand_p(F.col(actual), F.col("__e"), F.col(snp), 0), "__r": strand_p(F.col(actual), F.col("__e"), F.col(snp), 1)})
    n, e = total(F.col(actual)), total(F.col("__e"))
    others = lambda xs: total(F.slice(xs, F.lit(3), F.size(xs)))
    share = F.when(e > 0, (others(F.col("__e")) + 1) / (e + 2)).when(F.col(snp), UNSEEN_SNP).otherwise(UNSEEN_INDEL)
    rows = rows.withColumns({"p_alt": enrichment(others(F.col(actual)), F.when(n > 0, n), share), "ratio": likelihood_ratio(F.col(actual), F.col("__e")) * F.col(frequency)})
    both = F.coalesce(F.col("__f") * F.col("__r"), F.col("__f"), F.col("__r"), F.lit(1.0))
    return rows.withColumns({"p_forward": F.coalesce("__f", F.lit(-1.0)), "p_reverse": F.coalesce("__r", F.lit(-1.0)), "p_strand": both, "p_scaled": both * F.col(frequency), "p_lesser": F.coalesce(F.greatest("__f", "__r"), F.lit(1.0))}).drop("__e", "__f", "__r")
