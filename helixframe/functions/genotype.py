"""Genotypes, likelihood indexes and label codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_gt(gt: Column) -> Column:
    return F.array_sort(gt)


def different_gt(a: Column, b: Column) -> Column:
    return ~sorted_gt(a).eqNullSafe(sorted_gt(b))


def pl_index(a: Column, b: Column) -> Column:
    """Place of the genotype a/b (a <= b) in a likelihood list."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return (hi * (hi + 1) / 2 + lo).cast("int")


def gt_of_index(i: Column) -> Column:
    """The genotype at a place of a likelihood list."""
    b = F.floor((F.sqrt(8.0 * i + 1) - 1) / 2)
    return F.array((i - b * (b + 1) / 2).cast("int"), b.cast("int"))


def genotype_order(alts: int) -> list[tuple[int, int]]:
    return [(a, b) for b in range(alts + 1) for a in range(b + 1)]


def pl_subset(pl: Column, alleles: Column, normed: bool = True) -> Column:
    """Likelihoods of the genotypes over a subset of alleles (places in the list, sorted)."""
    pairs = F.flatten(F.transform(alleles, lambda b, j: F.transform(F.slice(alleles, 1, j + 1), lambda a: pl_index(a, b))))
    out = F.transform(pairs, lambda i: F.get(pl, i))
    if not normed:
        return out
    least = F.array_min(out)
    return F.transform(out, lambda x: x - least)


def recoded_gt(gt: Column, alleles: Column) -> Column:
    """Alleles of a genotype by their place in ``alleles``; 0 for one that is not there."""
    return F.array_sort(F.transform(gt, lambda g: F.greatest(F.array_position(alleles, g) - 1, F.lit(0)).cast("int")))


def is_indel(alleles: Column) -> Column:
    return F.size(F.array_distinct(F.transform(alleles, lambda a: F.length(a)))) > 1


def indel_kind(alleles: Column) -> Column:
    """(kind, length): ins or del by the longest change against the first allele."""
    ref = F.length(F.get(alleles, F.lit(0)))
    by = F.transform(F.slice(alleles, 2, F.greatest(F.size(alleles) - 1, F.lit(0))), lambda a: F.length(a) - ref)
    size = F.array_max(F.transform(by, lambda x: F.abs(x)))
    kind = F.when(~is_indel(alleles), None).when(F.array_contains(by, -size), "del").otherwise("ins")
    return F.struct(kind.alias("kind"), F.when(is_indel(alleles), size).alias("length"))


def label_code(gt: Column) -> Column:
    """0/0 is 0, 0/1 is 1, 1/1 is 2."""
    s = sorted_gt(gt)
    return F.when(s == F.array(F.lit(0), F.lit(0)), 0).when(s == F.array(F.lit(0), F.lit(1)), 1).when(s == F.array(F.lit(1), F.lit(1)), 2)


def decoded_label(code: Column, as_reference: bool = False) -> Column:
    """The inverse of ``label_code``; ``as_reference`` gives the published map, whose codes are
    0 for 0/1, 1 for 1/1 and 2 for 0/0."""
    gts = [(0, 1), (1, 1), (0, 0)] if as_reference else [(0, 0), (0, 1), (1, 1)]
    out = F.lit(None).cast("array<int>")
    for i, (a, b) in enumerate(gts):
        out = F.when(code == i, F.array(F.lit(a), F.lit(b))).otherwise(out)
    return out


def copy_number_gt(cn: Column) -> Column:
    n = F.bround(cn)
    return F.when(n == 1, "0/1").when(n == 0, "1/1").otherwise("./1")


def svtype_gt(kind: Column) -> Column:
    return F.when(kind == "DEL", "0/1").when(kind == "DUP", "./1")


def hom_to_het(gt: Column, filters: Column) -> Column:
    """0/0 becomes 0/1; ./. does where the record does not pass."""
    return F.when(gt == "0/0", "0/1").when((gt == "./.") & (F.coalesce(filters, F.lit("PASS")) != "PASS"), "0/1").otherwise(gt)
