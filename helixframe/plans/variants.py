"""Annotation of variants from the reference sequence.

The reference is a table of blocks of ``size`` bases, each with ``flank`` more on either
side, so that what lies around a variant is in the one block of its position: an equi-join
on (chrom, block), whatever the length of a sequence. ``pos`` counts from 1, as in records;
places in sequences count from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, FLANK = 10_000, 256


def reference_blocks(pieces: DataFrame, size: int = SIZE, flank: int = FLANK) -> DataFrame:
    """(chrom, block, first, bases) from ``pieces`` (chrom, start, seq), such as the lines of a FASTA."""
    end = F.col("start") + F.length("seq")
    touched = F.sequence(F.greatest(F.floor((F.col("start") - flank) / size), F.lit(0)), F.floor((end - 1 + flank) / size))
    cut = pieces.where(F.length("seq") > 0).select("chrom", "start", "seq", F.explode(touched).alias("block"))
    low = F.greatest("start", F.col("block") * size - flank)
    high = F.least(end, (F.col("block") + 1) * size + flank)
    part = F.upper(F.substring("seq", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")))
    rows = cut.where(high > low).select("chrom", "block", F.struct(low.alias("at"), part.alias("seq")).alias("part"))
    whole = rows.groupBy("chrom", "block").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select("chrom", "block", F.get("parts", F.lit(0))["at"].alias("first"), F.array_join("parts.seq", "").alias("bases"))


def with_reference(variants: DataFrame, blocks: DataFrame, size: int = SIZE) -> DataFrame:
    """``variants`` with ``first`` and ``bases`` of their block."""
    keyed = variants.withColumn("block", F.floor((F.col("pos") - 1) / size))
    return keyed.join(blocks, ["chrom", "block"], "left").drop("block")


def bases_between(low: Column, high: Column) -> Column:
    """Bases from ``low`` to ``high`` (from 0, half-open) of a row with its block; cut at the sequence's ends."""
    low = F.greatest(low, F.lit(0))
    return F.substring("bases", (low - F.col("first") + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))


def indel_class() -> tuple[Column, Column]:
    """(ins or del, length) of an indel row: ins where an allele is longer than the reference."""
    by = F.transform("alleles", lambda a: F.length(a) - F.length("ref"))
    kind = F.when(~F.col("indel"), None).when(F.array_max(by) > 0, "ins").otherwise("del")
    return kind, F.array_max(F.transform(by, lambda x: F.abs(x)))


def _run(place: Column, most: int) -> Column:
    return F.length(F.regexp_extract(bases_between(place, place + most), r"^(.)\1*", 0))


def hmer_indel(most: int = FLANK) -> tuple[Column, Column]:
    """(length, base) of the homopolymer that a row's indel (``indel_classify``) lengthens or
    shortens; 0 and null for other rows. Runs count up to ``most`` bases."""
    pos, after = F.col("pos"), F.col("pos") + F.length("ref") - 1
    added = F.substring(F.get(F.filter("alleles", lambda a: a != F.col("ref")), F.lit(0)), 2, 1 << 20)
    gone = F.substring("ref", 2, 1 << 20)
    one = lambda s: s.rlike(r"^(.)\1*$")
    ins = (F.col("indel_classify") == "ins") & one(added) & (bases_between(pos, pos + 1) == F.left(added, F.lit(1)))
    dele = (F.col("indel_classify") == "del") & one(gone) & (bases_between(after, after + 1) == F.left(gone, F.lit(1)))
    length = F.when(F.col("indel") & ins, _run(pos, most)).when(F.col("indel") & dele, F.length(gone) + _run(after, most)).otherwise(0)
    return length, F.when(F.col("indel") & ins, F.left(added, F.lit(1))).when(F.col("indel") & dele, F.left(gone, F.lit(1)))


def motifs(width: int) -> tuple[Column, Column]:
    """(left, right) of ``width`` bases around a row with ``indel`` and ``hmer_indel_length``:
    beside a substituted base, beside an indel's bases, or beside the whole homopolymer."""
    pos, hmer = F.col("pos"), F.col("hmer_indel_length")
    past = F.when(hmer > 0, pos + hmer).otherwise(pos + F.length("ref") - 1)
    left = F.when(F.col("indel"), bases_between(pos - width, pos)).otherwise(bases_between(pos - width - 1, pos - 1))
    return left, F.when(F.col("indel"), bases_between(past, past + width)).otherwise(bases_between(pos, pos + width))


def centred_motif(width: int) -> Column:
    """The base of a substitution with ``width`` bases on either side."""
    return bases_between(F.col("pos") - width - 1, F.col("pos") + width)


def gc_around(window: int) -> Column:
    """Share of bases other than A and T in ``window`` bases around a row."""
    low = F.col("pos") - window // 2
    seq = bases_between(low, low + window)
    return F.try_divide(F.length(F.regexp_replace(seq, "[AT]", "")).cast("double"), F.length(seq))


def annotated(variants: DataFrame, blocks: DataFrame, width: int = 5, window: int = 10, size: int = SIZE) -> DataFrame:
    """``variants`` (chrom, pos, ref, alleles, indel) with all of the above."""
    kind, length = indel_class()
    rows = with_reference(variants, blocks, size).withColumns({"indel_classify": kind, "indel_length": length})
    hmer, base = hmer_indel()
    rows = rows.withColumns({"hmer_indel_length": hmer, "hmer_indel_nuc": base})
    left, right = motifs(width)
    return rows.withColumns({"left_motif": left, "right_motif": right, "gc_content": gc_around(window)}).drop("first", "bases")


def gap_share(intervals: DataFrame, pieces: DataFrame, ids: list[str], size: int = SIZE, digits: int = 5) -> DataFrame:
    """``intervals`` (chrom, start, end) with ``gap``, the share of N in them: N are counted by block
    first, only the two blocks at an interval's ends are looked at base by base."""
    blocks = reference_blocks(pieces, size, 0)
    each = intervals.select(*ids, "chrom", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("block"))
    joined = each.join(blocks, ["chrom", "block"])
    low, high = F.greatest("start", "first"), F.least("end", F.col("first") + F.length("bases"))
    seq = F.substring("bases", (low - F.col("first") + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    sums = joined.groupBy(*ids).agg(F.sum(F.length(F.regexp_replace(seq, "[^N]", ""))).alias("__n"))
    return intervals.join(sums, ids, "left").withColumn("gap", F.round(F.coalesce(F.col("__n"), F.lit(0)) / (F.col("end") - F.col("start")), digits)).drop("__n")
