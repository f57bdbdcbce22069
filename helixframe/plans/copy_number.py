"""Copy-number calls: breakpoints, read support, coverage by GC and repeat copy numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.special import log_binomial
from ..operators import ordered

#: Width of a GC bucket, share trimmed from either end, limits of a heterozygous marker's
#: alternative share, noise of a small variant, highest quality.
GC_WIDTH, TRIM, HET_LOW, HET_HIGH, NOISE, MOST_QUAL = 0.05, 0.1, 0.1, 0.9, 0.003, 99.0


def position_interval(width: int) -> Column:
    """The confidence interval of a window of ``width``: half of it to either side, halves to even."""
    return F.array(F.lit(round(-width / 2)), F.lit(round(width / 2 + 1)))


def tightest_breakpoints(df: DataFrame, group: str, pos: str = "pos", end: str = "end", low: str = "ci_low", high: str = "ci_high", window: int = 2500) -> DataFrame:
    """(group, pos, end): of the records within ``window`` of a group's outer bounds, the bound of
    the one with the narrowest interval; on a tie the outermost."""
    outer = df.groupBy(group).agg(F.min(pos).alias("__low"), F.max(end).alias("__high"))
    width = F.col(high) - F.col(low) - 1
    near = df.join(outer, group)
    best = lambda c, bound, sign: F.min(F.when(F.abs(F.col(c) - F.col(bound)) <= window, F.struct(width.alias("w"), (sign * F.col(c)).alias("at"))))["at"] * sign
    return near.groupBy(group).agg(best(pos, "__low", 1).alias("pos"), best(end, "__high", -1).alias("end"))


def duplication_insert(p: Column, s: Column) -> Column:
    """Insert size of a split read over a duplication's seam, null if it is none. ``p`` and ``s``
    (primary, supplementary) hold start, end, left, right (clipped on that side)."""
    return F.when(p["right"] & s["left"] & (p["start"] > s["end"]), p["end"] - s["start"]).when(p["left"] & s["right"] & (s["start"] > p["end"]), s["end"] - p["start"])


def deletion_insert(p: Column, s: Column) -> Column:
    """Insert size of a split read over a deletion, null if it is none."""
    return F.when(p["right"] & s["left"] & (p["end"] < s["start"]), s["start"] - p["end"]).when(p["left"] & s["right"] & (s["start"] < p["start"]), p["start"] - s["end"])


def read_support(primary: Column, supplementary: Column, start: Column, end: Column, cushion: int) -> Column:
    """(kind, insert) of the first supplementary alignment (an array in order; chrom, reverse, start,
    end, left, right) that lies at the other bound of the interval and fits DUP or DEL."""
    near = lambda x, bound: x.between(bound - cushion, bound + cushion)

    def fits(s: Column) -> Column:
        at_start, at_end = near(s["start"], start), near(s["start"], end)
        crossed = ~(near(primary["start"], start) & ~at_end) & ~(near(primary["start"], end) & ~at_start)
        return (s["chrom"] == primary["chrom"]) & (s["reverse"] == primary["reverse"]) & (at_start | at_end) & crossed

    each = F.transform(F.filter(supplementary, fits), lambda s: F.struct(F.when(duplication_insert(primary, s).isNotNull(), "DUP").when(deletion_insert(primary, s).isNotNull(), "DEL").alias("kind"), F.coalesce(duplication_insert(primary, s), deletion_insert(primary, s)).alias("insert")))
    return F.get(F.filter(each, lambda x: x["kind"].isNotNull()), F.lit(0))


def gc_bucket(gc: Column) -> Column:
    """The middle of the GC bucket; a share of 1 is in the last one."""
    n = round(1 / GC_WIDTH)
    return (F.least(F.floor(gc / GC_WIDTH), F.lit(n - 1)) + 0.5) * GC_WIDTH


def repeat_copies(normal: DataFrame, repeat: DataFrame, repeats: int, gc: str = "gc", depth: str = "depth") -> DataFrame:
    """(copies): the repeat's mean depth, each bin scaled by its GC bucket's baseline, over the
    baseline of all normal bins (trimmed means), times two times the reference's ``repeats``."""
    bins = normal.select(gc_bucket(F.col(gc)).alias("bucket"), F.col(depth).alias("depth"))
    per = ordered.trimmed_mean(bins, ["bucket"], "depth", TRIM).select("bucket", F.col("trimmed_mean").alias("base"))
    whole = ordered.trimmed_mean(bins.withColumn("all", F.lit(1)), ["all"], "depth", TRIM).select(F.col("trimmed_mean").alias("overall"))
    own = repeat.select(gc_bucket(F.col(gc)).alias("bucket"), F.col(depth).alias("depth")).join(per, "bucket", "left").join(F.broadcast(whole), how="cross")  # one row
    base = F.when(F.coalesce(F.col("base"), F.lit(0.0)) > 0, F.col("base")).otherwise(F.col("overall"))
    return own.agg((F.avg(F.col("depth") * F.col("overall") / base) / F.max("overall") * 2.0 * repeats).alias("copies"))


def marker_call(alt: Column, informative: Column, copies: Column) -> Column:
    """(ref, alt, kind) from the counts at linked markers (arrays): copies are split by the share of
    the alternative where all markers are heterozygous."""
    shares = F.filter(F.zip_with(alt, informative, lambda a, n: F.when(n > 0, a / n)), lambda x: x.isNotNull())
    states = F.array_distinct(F.transform(shares, lambda f: F.when(f < HET_LOW, "hom_ref").when(f > HET_HIGH, "hom_alt").otherwise("het")))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    state = F.get(states, F.lit(0))
    kind = F.when(F.size(shares) == 0, "No coverage at marker sites").when(F.size(states) > 1, "Marker sites disagree").when(state == "hom_ref", "Homozygous REF markers call").when(state == "hom_alt", "Homozygous ALT markers call").otherwise("Heterozygous markers call")
    split = copies * F.try_divide(total(alt), total(informative))
    het = kind == "Heterozygous markers call"
    return F.struct(F.when(het, copies - split).alias("ref"), F.when(het, split).alias("alt"), kind.alias("kind"))


def small_variant(n: int, alt: int, copies: float) -> tuple[int, float, float]:
    """(copies of the alternative, quality against none, quality of the number) of ``alt`` reads in
    ``n``, over all whole numbers up to ``copies`` with equal priors."""
    if n == 0:
        return 0, 0.0, 0.0
    most = max(1, round(copies))
    logs = [log_binomial(n, alt, (k / most) * (1 - NOISE) + (1 - k / most) * NOISE) for k in range(most + 1)]
    post = [math.exp(x - max(logs)) for x in logs]
    post = [x / sum(post) for x in post]
    best = max(range(most + 1), key=lambda k: (post[k], -k))
    qual = lambda p: min(-10 * math.log10(min(max(p, 1e-15), 1 - 1e-15)), MOST_QUAL)
    return best, 0.0 if best == 0 else qual(post[0]), qual(1 - post[best])


def small_variants(df: DataFrame, n: str, alt: str, copies: str) -> DataFrame:
    """``df`` with ``alt_copies``, ``qual`` and ``copies_qual``; one value a distinct input is worked out."""
    schema = T.StructType([T.StructField(n, df.schema[n].dataType), T.StructField(alt, df.schema[alt].dataType), T.StructField(copies, df.schema[copies].dataType), T.StructField("alt_copies", T.IntegerType()), T.StructField("qual", T.DoubleType()), T.StructField("copies_qual", T.DoubleType())])

    def run(batches):
        for batch in batches:
            made = [small_variant(int(a), int(b), float(c)) for a, b, c in zip(batch[n], batch[alt], batch[copies])]
            yield batch.assign(alt_copies=[m[0] for m in made], qual=[m[1] for m in made], copies_qual=[m[2] for m in made])

    return df.join(df.select(n, alt, copies).distinct().mapInPandas(run, schema), [n, alt, copies])
