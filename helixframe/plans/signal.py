"""Residual-signal estimation: locus filters, signal fraction, outlier loci and detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..operators.rules import translate_query


def filtered_signatures(df: DataFrame, query: str | None, coverage: str = "coverage", group: str = "signature") -> DataFrame:
    """Signature loci that satisfy ``query``, with coverage over the signature's median."""
    w = Window.partitionBy(group)
    out = df.withColumn("norm_coverage", F.try_divide(F.col(coverage).cast("double"), F.median(coverage).over(w)))
    return out.where(translate_query(query)) if query else out


def locus_flags(reads: DataFrame, locus: list[str], good: Column, most_low: float, least_reads: int) -> DataFrame:
    """``reads`` with the number and share of good reads at their locus, and whether both suffice."""
    w = Window.partitionBy(*locus)
    n, g = F.count(F.lit(1)).over(w), F.sum(good.cast("int")).over(w)
    return reads.withColumns({"locus_reads": n, "good_reads": g}).withColumn("locus_ok", (F.try_divide(F.col("good_reads").cast("double"), F.col("locus_reads")) >= 1 - most_low) & (F.col("good_reads") >= least_reads))


def signal_fraction(reads: DataFrame, signatures: DataFrame, locus: list[str], group: list[str], coverage: str, recall: float, excluded: DataFrame | None = None) -> DataFrame:
    """(group, supporting_reads, coverage, corrected_coverage, fraction) for every group of
    ``signatures``, zero where no read supports it."""
    if excluded is not None:
        signatures = signatures.join(excluded.select(*locus).distinct(), locus, "left_anti")
    loci = signatures.select(*group, *locus).distinct()
    support = reads.join(loci, [*group, *locus], "left_semi").groupBy(*group).agg(F.count(F.lit(1)).alias("supporting_reads"))
    cover = signatures.groupBy(*group).agg(F.sum(coverage).alias("coverage"))
    out = cover.join(support, group, "left").withColumn("supporting_reads", F.coalesce("supporting_reads", F.lit(0)))
    out = out.withColumn("corrected_coverage", F.ceil(F.col("coverage") * recall))
    return out.withColumn("fraction", F.coalesce(F.try_divide(F.col("supporting_reads").cast("double"), F.col("corrected_coverage").cast("double")), F.lit(0.0)))


def outlier_loci(loci: DataFrame, group: list[str], order: list[str], reads: str, coverage: str, width: int, alpha: float) -> DataFrame:
    """Loci with two reads or more that their neighbourhood's rate makes unlikely (Poisson
    tail, Bonferroni by the group's loci)."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-(width // 2), width - 1 - width // 2)
    local = loci.withColumn("rate", F.try_divide(F.sum(reads).over(w).cast("double"), F.sum(coverage).over(w).cast("double"))).withColumn("n_loci", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    p = special.arrow(lambda k, mean: special.poisson_tail(int(k), mean), F.col(reads).cast("double"), F.col("rate") * F.col(coverage))
    return local.where(F.col(reads) >= 2).withColumn("p_value", p * F.col("n_loci")).where(F.col("p_value") < alpha)


def detection(fractions: DataFrame, kind: str, matched: str, control: str, alpha: float = 0.05, fpr: float = 0.05, recall: float = 0.95) -> dict:
    """Error rate from the controls (half a read if there was none), p-value, call and limit
    of detection of the matched signature. The sums are two rows."""
    sums = {r[0]: (r[1] or 0, r[2] or 0) for r in fractions.groupBy(kind).agg(F.sum("supporting_reads"), F.sum("corrected_coverage")).collect()}
    k, n = sums.get(matched, (0, 0))
    ck, cn = sums.get(control, (0, 0))
    p_err = ck / cn if ck and cn else 0.5 / (cn + 1)
    p = special.binomial_tail(int(k), int(n), p_err)
    return {"p_err": p_err, "p_value": p, "detected": p < alpha, "lod": special.limit_of_detection(int(n), p_err, recall, fpr), "fraction": k / n if n else 0.0}
