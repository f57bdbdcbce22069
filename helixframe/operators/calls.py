"""Selections of variant calls and of their filter tokens, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype


def _tokens(filters: Column) -> Column:
    return F.filter(F.split(F.coalesce(filters, F.lit("")), ";"), lambda t: ~t.isin("", "."))


def cleared(filters: Column, gone: list[str] | None = None) -> Column:
    """The filter text without the tokens ``gone`` (null: without any); PASS where none is left."""
    if gone is None:
        return F.lit(None).cast("string")
    left = F.array_except(_tokens(filters), F.array(*[F.lit(g) for g in gone]))
    return F.when(F.size(left) > 0, F.array_join(left, ";")).otherwise("PASS")


def filled(filters: Column) -> Column:
    """PASS for a null or empty filter text."""
    return F.coalesce(F.nullif(filters, F.lit("")), F.lit("PASS"))


def is_pass(filters: Column) -> Column:
    return F.coalesce(filters, F.lit("")).isin("", ".", "PASS")


def has_token(filters: Column, token: str) -> Column:
    return F.coalesce(F.contains(filters, F.lit(token)), F.lit(False))


def missed(classified: Column, filters: Column) -> Column:
    """False negatives: fn, or tp that the score filter takes away."""
    return (classified == "fn") | ((classified == "tp") & has_token(filters, "LOW_SCORE"))


def genotype_only(allele_class: Column, genotype_class: Column, kind: str) -> Column:
    """The allele is right but the genotype is ``kind`` (fp or fn)."""
    return (allele_class == "tp") & (genotype_class == kind)


def in_homopolymer(indel: Column, hmer: Column, low: int, high: int) -> Column:
    return indel & hmer.between(low, high)


def outside_homopolymer(indel: Column, hmer: Column, length: Column, single: bool = False) -> Column:
    """Indels beside any homopolymer, of one base (``single``) or of more."""
    return indel & (hmer == 0) & ((length == 1) if single else (length > 1))


def gc_insertion(alleles: Column) -> Column:
    """The blacklist name of calls with an allele GGC or CCG, else PASS."""
    return F.when(F.arrays_overlap(alleles, F.array(F.lit("GGC"), F.lit("CCG"))), "CG_NON_HMER_INDEL").otherwise("PASS")


def above_background(vaf: Column, background: Column, ratio: float, least: float) -> Column:
    """Some alternative allele has ``least`` frequency or ``ratio`` times its background."""
    pairs = F.arrays_zip(vaf.alias("v"), background.alias("b"))
    return F.coalesce(F.exists(pairs, lambda p: (p["v"] >= least) | F.coalesce(F.try_divide(p["v"], p["b"]) >= ratio, F.lit(False))), F.lit(False))


def split_alternatives(df: DataFrame, alleles: str = "alleles", gt: str = "gt", pl: str = "pl") -> DataFrame:
    """One row per alternative allele, its genotype and likelihoods cut down to it.

    ``alt_index`` is the place of the alternative (from 1). Rows without one are dropped.
    """
    rows = df.where(F.size(alleles) > 1).withColumn("alt_index", F.explode(F.sequence(F.lit(1), F.size(alleles) - 1)))
    pick = F.array(F.lit(0), F.col("alt_index"))
    return rows.withColumns({gt: genotype.recoded_gt(F.col(gt), pick), pl: genotype.pl_subset(F.col(pl), pick), alleles: F.array(F.get(alleles, F.lit(0)), F.get(alleles, F.col("alt_index")))})


def mates(left: DataFrame, right: DataFrame, name: str = "qname", group: str = "rg", flag: str = "flag") -> DataFrame:
    """Reads of both sides with one name and read group but other flags: (name, group, left_flag, right_flag)."""
    a = left.select(name, group, F.col(flag).alias("left_flag"))
    b = right.select(name, group, F.col(flag).alias("right_flag"))
    return a.join(b, [name, group]).where("left_flag <> right_flag")


def training_rows(df: DataFrame, label: bool, ref: str = "ref", alt: str = "alt", hmer_ref: str = "hmer_ref", hmer_alt: str = "hmer_alt", distance: str = "edist") -> DataFrame:
    """Rows for the classifier. Positive ones are read as seen against the other allele:
    the reference is ``alt``, homopolymers change places, the edit distance grows by one,
    and rows at the greatest distance go, as their own would lie beyond it."""
    if not label:
        return df.drop(alt).withColumn("label", F.lit(False))
    top = df.agg(F.max(distance).alias("__top"))
    kept = df.crossJoin(F.broadcast(top)).where(F.col(distance) != F.col("__top")).drop("__top")
    changed = {ref: F.col(alt), distance: F.col(distance) + 1, hmer_ref: F.col(hmer_alt), hmer_alt: F.col(hmer_ref), "label": F.lit(True)}
    return kept.withColumns(changed).drop(alt)


def scored_above(df: DataFrame, score: str, share: float = 0.1, filters: str = "filter") -> DataFrame:
    """Passing rows with ``above``: whether their score (1 where it is missing) is over the ``share`` quantile."""
    kept = df.where(F.contains(F.col(filters), F.lit("PASS"))).withColumn("__s", F.coalesce(F.col(score).cast("double"), F.lit(1.0)))
    cut = kept.agg(F.percentile("__s", F.lit(share)).alias("__cut"))
    return kept.join(F.broadcast(cut), how="cross").withColumn("above", F.col("__s") > F.col("__cut")).drop("__s", "__cut")  # one row


def as_track(df: DataFrame, name: str, shown: Column, black: Column | None = None) -> DataFrame:
    """Calls as a track: chrom, start, end, name, colour (blue, grey where not ``shown``, black on a blacklist)."""
    colour = F.when(shown, "0,0,255").otherwise("121,121,121")
    return df.select("chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), F.col(name).alias("name"), (colour if black is None else F.when(black, "0,0,0").otherwise(colour)).alias("colour"))


def source_set(sources: Column) -> Column:
    """All sources of a group's calls (arrays; null and empty ones don't count), sorted, once each."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(sources, lambda s: s != "")))))


def supported(length: Column, sources: Column, most: int, own: str) -> Column:
    """Events up to ``most`` long, and longer ones that some source other than ``own`` has too."""
    return (F.abs(length) <= most) | F.coalesce(F.exists(sources, lambda s: s != own), F.lit(False))


def category_counts(df: DataFrame, classified: str) -> DataFrame:
    """(category, n): tp as dbsnp, unknown, fp as blacklist; zero where there is none."""
    one = lambda value: F.coalesce(F.sum((F.col(classified) == value).cast("long")), F.lit(0))
    return df.agg(*[one(v).alias(n) for n, v in (("dbsnp", "tp"), ("unknown", "unknown"), ("blacklist", "fp"))]).unpivot([], ["dbsnp", "unknown", "blacklist"], "category", "n")
