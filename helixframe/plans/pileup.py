"""Base counts at loci, allele shares and their background."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import intervals

BASES, INDELS = ("A", "C", "G", "T"), ("INS", "DEL")


def reference_counts(ref: Column, counts: dict[str, Column]) -> tuple[Column, Column]:
    """(reads of the reference base, all others) from a column for each base and indel kind;
    nulls count 0, and a reference that is no base has no reads."""
    zero = F.lit(0)
    own = reduce(lambda out, b: F.when(ref == b, counts[b]).otherwise(out), BASES, F.lit(None))
    other = [F.when(ref != b, F.coalesce(counts[b], zero)).otherwise(zero) for b in BASES if b in counts]
    return F.coalesce(own, zero), reduce(lambda a, b: a + b, [*other, *[F.coalesce(counts[i], zero) for i in INDELS if i in counts]])


def allele_counts(pileup: DataFrame) -> DataFrame:
    """(chrom, pos, ref, depth, base, count) of a read pileup, one row for each allele seen."""
    return pileup.select("chrom", "pos", "ref", "depth", F.explode(dna.pileup_counts(F.col("ref"), F.col("bases"))).alias("base", "count"))


def substitution_shares(counts: DataFrame) -> DataFrame:
    """(chrom, pos, base, share) of bases other than the reference; indels and deletions don't count."""
    return counts.where(~F.col("base").rlike(r"^[+\-*]") & (F.col("base") != F.upper("ref"))).select("chrom", "pos", "base", F.try_divide(F.col("count").cast("double"), F.col("depth")).alias("share"))


def neutral(points: DataFrame, calls: DataFrame, bin_size: int) -> DataFrame:
    """Points (chrom, pos) outside of all calls."""
    spans = points.withColumns({"__s": F.col("pos"), "__e": F.col("pos") + 1})
    return intervals.overlaps(spans, calls, bin_size, a_cols=("__s", "__e"), how="left_anti").drop("__s", "__e")


def low_background_ratio(samples: Column, least_ratio: float, least_share: float) -> Column:
    """Whether a record fails for its alleles' shares against their background. ``samples``: array of
    (gt, vaf, background); alleles are judged in order, the first that stands out clears what came
    before it and ends its sample; samples that lack a field don't count."""

    def allele(acc: Column, g: Column, s: Column) -> Column:
        share, back = F.get(s["vaf"], g - 1), F.get(s["background"], g - 1)
        skipped = acc["stop"] | F.coalesce(g == 0, F.lit(True)) | (g > F.size(s["vaf"])) | (g > F.size(s["background"]))
        absent = F.coalesce(share == 0, F.lit(True))
        clear = F.coalesce(back == 0, F.lit(True)) | (share / back >= least_ratio) | (share >= least_share)
        made = lambda failed, stop: F.struct(F.lit(failed).alias("failed"), F.lit(stop).alias("stop"))
        return F.when(skipped, acc).when(absent, made(True, False)).when(clear, made(False, True)).otherwise(made(True, False))

    def sample(failed: Column, s: Column) -> Column:
        begin = F.struct(failed.alias("failed"), F.lit(False).alias("stop"))
        judged = F.aggregate(s["gt"], begin, lambda acc, g: allele(acc, g, s), lambda acc: acc["failed"])
        return F.when(s["gt"].isNull() | s["vaf"].isNull() | s["background"].isNull(), failed).otherwise(judged)

    return F.aggregate(samples, F.lit(False), sample)
