"""Codes of categorical annotations.

The numbers are fixed values: models trained elsewhere expect them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def motif_code(motif: Column, leftward: bool = False) -> Column:
    """Letters as decimal digits (A1 T2 G3 C4 N5, others 0), read outward from the variant."""
    text = F.reverse(motif) if leftward else motif
    digits = F.regexp_replace(F.translate(text, "ATGCN", "12345"), "[^1-5]", "0")
    return digits.try_cast("bigint")


def coded(value: Column, codes: dict[str, int], default: int | None = None) -> Column:
    out = F.lit(default).cast("int")
    for k, v in codes.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def heterozygous_code(gt: Column) -> Column:
    """1 for two equal alleles, else 0."""
    return F.when(F.size(F.array_distinct(gt)) == 1, 1).otherwise(0)


def strand_category(ratio: Column, low: float = 0.27, high: float = 0.73) -> Column:
    return F.when(ratio == 0, "PLUS").when(ratio == 1, "MINUS").when(ratio.between(low, high), "MIXED").otherwise("UNDETERMINED")


def strand_category_of_counts(a: Column, t: Column, low: float = 0.27, high: float = 0.73, least: int = 4, most: int = 8) -> Column:
    """By the lengths of the two tag letters: null if one is null, UNDETERMINED outside the total."""
    total = a + t
    ratio = F.try_divide(t.cast("double"), total.cast("double"))
    return F.when(total.isNull(), None).when(~total.between(least, most), "UNDETERMINED").when(t == 0, "PLUS").when(a == 0, "MINUS").when(ratio.between(low, high), "MIXED").otherwise("UNDETERMINED")


def filled_end_tag(tag: Column, trimmed: Column) -> Column:
    """An absent or undetermined end tag: END_UNREACHED unless the adapter (A) was trimmed."""
    gone = tag.isNull() | (tag == "UNDETERMINED")
    return F.when(~gone, tag).when(F.coalesce(trimmed, F.lit("")).contains("A"), "UNDETERMINED").otherwise("END_UNREACHED")


def is_mixed(start: Column, end: Column) -> Column:
    return F.coalesce(start == "MIXED", F.lit(False)) & F.coalesce(end == "MIXED", F.lit(False))


def gain_loss(ratio: Column, gain: float, loss: float) -> Column:
    """Segments by median ratio; ratios of -1 and less carry no call."""
    return F.when(ratio >= gain, "gain").when((ratio <= loss) & (ratio > -1), "loss").otherwise("neutral")


def log_ratio_type(x: Column, dup: float, dele: float) -> Column:
    return F.when(x >= dup, "DUP").when(x <= dele, "DEL").otherwise("NEU")
