"""Sequence, CIGAR and pileup expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def reverse_complement(seq: Column) -> Column:
    """Case is kept; letters other than ACGT stay as they are."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def run_length(seq: Column, start: Column) -> Column:
    """Length of the run of one letter that begins at ``start`` (from 0)."""
    return F.length(F.regexp_extract(F.substring(seq, start + 1, F.length(seq)), r"^(.)\1*", 0))


def gc_share(seq: Column, n_is_gc: bool = False) -> Column:
    """Share of G and C; ``n_is_gc`` counts every letter but A and T, as some tools do."""
    rest = F.regexp_replace(F.upper(seq), "[AT]" if n_is_gc else "[^GC]", "")
    return F.try_divide(F.length(rest).cast("double"), F.length(seq))


def cigar(text: Column) -> Column:
    """Array of (op, n)."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0)), lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.regexp_extract(x, r"^\d+", 0).cast("int").alias("n")))


def cigar_sum(text: Column, ops: str) -> Column:
    return F.aggregate(F.filter(cigar(text), lambda c: c["op"].isin(*ops)), F.lit(0), lambda s, c: s + c["n"])


def alignment_end(start: Column, text: Column) -> Column:
    """End on the reference: start plus all M, D, N, = and X."""
    return start + cigar_sum(text, "MDN=X")


def longest_clip(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.filter(cigar(text), lambda c: c["op"] == "S"), lambda c: c["n"])), F.lit(0))


def clipped_left(text: Column) -> Column:
    return F.coalesce(F.get(cigar(text), F.lit(0))["op"] == "S", F.lit(False))


def clipped_right(text: Column) -> Column:
    return F.coalesce(F.try_element_at(cigar(text), F.lit(-1))["op"] == "S", F.lit(False))


def clip_position(start: Column, text: Column) -> Column:
    """Where the longer soft clip meets the alignment; the left one on a tie, null without any."""
    left = F.when(clipped_left(text), F.get(cigar(text), F.lit(0))["n"]).otherwise(0)
    right = F.when(clipped_right(text), F.try_element_at(cigar(text), F.lit(-1))["n"]).otherwise(0)
    return F.when((left == 0) & (right == 0), None).when(left >= right, start).otherwise(alignment_end(start, text))


def mismatches(nm: Column, text: Column) -> Column:
    """The edit distance without inserted and deleted bases."""
    return F.coalesce(nm, F.lit(0)) - cigar_sum(text, "ID")


def supplementary(sa: Column) -> Column:
    """The SA tag as an array of (chrom, pos, strand, cigar, mapq, nm)."""
    parts = F.filter(F.split(F.coalesce(sa, F.lit("")), ";"), lambda x: x != "")

    def one(x: Column) -> Column:
        f = F.split(x, ",")
        return F.struct(F.get(f, F.lit(0)).alias("chrom"), (F.get(f, F.lit(1)).try_cast("bigint") - 1).alias("pos"), F.get(f, F.lit(2)).alias("strand"), F.get(f, F.lit(3)).alias("cigar"), F.get(f, F.lit(4)).try_cast("int").alias("mapq"), F.get(f, F.lit(5)).try_cast("int").alias("nm"))

    return F.transform(parts, one)


def substitution(left: Column, ref: Column, right: Column, alt: Column) -> Column:
    """``LrR>LaR``; null where a letter is N."""
    out = F.concat(left, ref, right, F.lit(">"), left, alt, right)
    return F.when(~F.upper(out).contains("N"), out)


def all_substitutions() -> list[str]:
    """All 192 ordered single-base substitutions in their context."""
    return [f"{a}{r}{b}>{a}{x}{b}" for r in "ACGT" for x in "ACGT" if x != r for a in "ACGT" for b in "ACGT"]


def read_oriented(context: Column, forward: Column) -> Column:
    """A context of previous, ref, next, alt in the direction of the read."""
    at = lambda i: F.substring(context, i, 1)
    back = F.translate(F.concat(at(3), at(2), at(1), at(4)), "ACGT", "TGCA")
    return F.when(forward, context).otherwise(back)


def flow_key_of(seq: str, order: str = "TGCA") -> list[int]:
    """How many bases each flow takes up; stops at the last base."""
    out, at, flow = [], 0, 0
    if any(b not in order for b in seq):
        raise ValueError("a base that no flow takes up")
    while at < len(seq):
        n = 0
        while at < len(seq) and seq[at] == order[flow % len(order)]:
            n, at = n + 1, at + 1
        out.append(n)
        flow += 1
    return out


def flow_key(seq: Column, order: str = "TGCA") -> Column:
    """``flow_key_of`` on Arrow batches; null where a letter is not in the flow order."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: flow_key_of(x, order) if isinstance(x, str) and set(x) <= set(order) else None)

    return run(seq)


def key_sequence(key: Column, order: str = "TGCA") -> Column:
    """The bases of a flow key."""
    letters = F.array(*map(F.lit, order))
    return F.array_join(F.transform(key, lambda n, i: F.repeat(F.get(letters, i % len(order)), n)), "")


def key_bases(key: Column) -> Column:
    """Index of the last base before each flow (-1 before the first)."""
    return F.transform(key, lambda n, i: F.aggregate(F.slice(key, 1, i), F.lit(0), lambda a, b: a + b) - 1)


def cycle_skip_kind(ref: str, alt: str, order: str = "TGCA") -> str:
    """cycle-skip, possible-cycle-skip or non-skip for two contexts of one length."""
    if set(ref + alt) - set(order):
        return "NA"
    a, b = flow_key_of(ref, order), flow_key_of(alt, order)
    skip = next((i for i, (x, y) in enumerate(zip(a, b)) if x or y), 0)
    a, b = a[skip:], b[skip:]
    if len(a) != len(b):
        return "cycle-skip"
    return "possible-cycle-skip" if any((x == 0) != (y == 0) for x, y in zip(a, b)) else "non-skip"


def cycle_skips(order: str = "TGCA") -> list[tuple[str, str]]:
    """(substitution, kind) for all substitutions: a table to join by broadcast (192 rows)."""
    return [(s, cycle_skip_kind(*s.split(">"), order)) for s in all_substitutions()]


def pileup_counts_of(ref: str, bases: str) -> dict[str, int]:
    """Bases, deletions (*) and indels of a pileup string, in upper case."""
    out: dict[str, int] = {}
    i = 0
    while i < len(bases):
        c = bases[i]
        if c == "^":
            i += 2
            continue
        if c in "+-":
            j = i + 1
            while j < len(bases) and bases[j].isdigit():
                j += 1
            n = int(bases[i + 1 : j] or 0)
            key, i = c + bases[j : j + n].upper(), j + n
        else:
            key, i = ref.upper() if c in ".," else c.upper(), i + 1
            if c == "$":
                continue
        out[key] = out.get(key, 0) + 1
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.IntegerType()))
def pileup_counts(ref: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([pileup_counts_of(r, b) if isinstance(r, str) and isinstance(b, str) else None for r, b in zip(ref, bases)])
