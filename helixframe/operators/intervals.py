"""Interval operators on half-open intervals [start, end) from 0.

Spark has no interval join; a join on the sequence alone compares all pairs of it. Here
each interval falls into the bins of ``bin_size`` that it touches, bins join by hash,
and a pair counts in the one bin where the later of the two begins, so none is repeated.
Long intervals cost rows, short bins cost replication: choose ``bin_size`` near the
usual length. A crowded sequence is spread over its bins.

Sweeps (``islands``, ``merged``, ``depth_runs``, ``intersected``, ``nearest``) use one window
a sequence, or with ``region`` one a region of that many positions: what earlier regions
leave behind is one small row a region, summed up along the sequence and joined back, so
that few long sequences are still many tasks. What is read twice is written first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def _bins(start: Column, end: Column, size: int) -> Column:
    low = F.floor(start / size)
    return F.sequence(low, F.greatest(low, F.floor((end - 1) / size)))


def overlaps(a: DataFrame, b: DataFrame, bin_size: int, key: str = "chrom", a_cols: tuple[str, str] = ("start", "end"), b_cols: tuple[str, str] = ("start", "end"), how: str = "inner") -> DataFrame:
    """Pairs of overlapping intervals; columns of ``b`` get the prefix ``b_``. ``how``: inner,
    or left_semi and left_anti for rows of ``a`` with or without an overlap."""
    (a0, a1), (b0, b1) = a_cols, b_cols
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    left = a.withColumn("__bin", F.explode(_bins(F.col(a0), F.col(a1), bin_size)))
    right = right.withColumn("__b_bin", F.explode(_bins(F.col(f"b_{b0}"), F.col(f"b_{b1}"), bin_size)))
    meet = (F.col(key) == F.col(f"b_{key}")) & (F.col("__bin") == F.col("__b_bin")) & (F.col(a0) < F.col(f"b_{b1}")) & (F.col(f"b_{b0}") < F.col(a1))
    if how == "inner":
        once = F.col("__bin") == F.floor(F.greatest(F.col(a0), F.col(f"b_{b0}")) / bin_size)
        return left.join(right, meet & once).drop("__bin", "__b_bin")
    hit = left.join(right, meet, "left_semi").select(*a.columns).distinct()
    return a.join(hit, [a[c].eqNullSafe(hit[c]) for c in a.columns], how)


def points_in(points: DataFrame, intervals: DataFrame, bin_size: int, key: str = "chrom", pos: str = "pos", left_open: bool = False) -> DataFrame:
    """Points joined with the intervals that hold them: start <= pos < end, or start < pos <= end."""
    shift = 1 if left_open else 0
    moved = points.withColumn("__s", F.col(pos) - shift).withColumn("__e", F.col(pos) - shift + 1)
    return overlaps(moved, intervals, bin_size, key, ("__s", "__e")).drop("__s", "__e")


def map_overlaps(a: DataFrame, b: DataFrame, column: str, bin_size: int, ids: list[str], key: str = "chrom") -> DataFrame:
    """Each row of ``a`` with sum, mean, min, max, count, median and sample deviation of
    ``column`` over the overlapping rows of ``b``; nulls and a zero count without any.
    ``ids`` identify rows of ``a``."""
    value = F.col(f"b_{column}")
    found = overlaps(a, b, bin_size, key).groupBy(*ids).agg(
        F.sum(value).alias("map_sum"), F.avg(value).alias("map_mean"), F.min(value).alias("map_min"), F.max(value).alias("map_max"), F.count(value).alias("map_count"), F.percentile(value, F.lit(0.5)).alias("map_median"), F.stddev_samp(value).alias("map_stdev")
    )
    return a.join(found, ids, "left").withColumn("map_count", F.coalesce("map_count", F.lit(0)))


def _carried(df: DataFrame, keys: list[str], back: bool = False, **sums: tuple) -> DataFrame:
    """``df`` (with ``__region``) and for each of ``sums``, name=(fold, value), the fold of the value
    over all earlier regions of the keys, or all later ones. ``df`` is read twice."""
    w = Window.partitionBy(*keys).orderBy(F.col("__region").desc() if back else F.col("__region")).rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(*keys, "__region").agg(*[fold(value).alias(name) for name, (fold, value) in sums.items()])
    along = parts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__region").alias("__r"), *[fold(F.col(name)).over(w).alias(name) for name, (fold, _) in sums.items()])
    meet = [df[k].eqNullSafe(along[f"__k{i}"]) for i, k in enumerate(keys)] + [df["__region"].eqNullSafe(along["__r"])]
    return df.join(along, meet, "left").drop(*[f"__k{i}" for i in range(len(keys))], "__r")


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, region: int | None = None) -> DataFrame:
    """``df`` with ``island``: rows of a key whose intervals touch or lie within ``gap`` share it."""
    at = [*keys]
    carried = F.lit(None)
    if region:
        df = _carried(df.withColumn("__region", F.floor(F.col(start) / region)), keys, __reach=(F.max, F.col(end)))
        at, carried = [*keys, "__region"], F.col("__reach")
    w = Window.partitionBy(*at).orderBy(start, end)
    reach = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), carried) if region else F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    marked = df.withColumn("__new", fresh)
    number = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    if not region:
        return marked.withColumn("island", number).drop("__new")
    before = _carried(written(marked, "islands"), keys, __before=(F.sum, F.col("__new")))
    return before.withColumn("island", number + F.coalesce("__before", F.lit(0))).drop("__new", "__region", "__reach", "__before")


def merged(df: DataFrame, key: str = "chrom", start: str = "start", end: str = "end", gap: int = 0, region: int | None = None) -> DataFrame:
    """The union of the intervals as disjoint ones, with how many went into each."""
    return islands(df.select(key, start, end), [key], start, end, gap, region).groupBy(key, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("island")


def coverage(a: DataFrame, b: DataFrame, bin_size: int, ids: list[str], key: str = "chrom") -> DataFrame:
    """Each row of ``a`` with the number of overlapping rows of ``b``, covered bases and share."""
    hits = overlaps(a, b, bin_size, key).select(*ids, "start", "end", F.greatest("start", "b_start").alias("lo"), F.least("end", "b_end").alias("hi"))
    runs = islands(hits, ids, "lo", "hi").groupBy(*ids, "island").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.count(F.lit(1)).alias("k"))
    sums = runs.groupBy(*ids).agg(F.sum("k").alias("n_overlaps"), F.sum(F.col("hi") - F.col("lo")).alias("covered"))
    out = a.join(sums, ids, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_overlaps", "covered")})
    return out.withColumn("share", F.try_divide(F.col("covered").cast("double"), F.col("end") - F.col("start")))


def subtract_covered(a: DataFrame, b: DataFrame, cutoff: float, bin_size: int, ids: list[str], tag: str | None = None) -> DataFrame:
    """Rows of ``a`` whose summed overlap with ``b`` is under ``cutoff`` of their length; with
    ``tag``, all rows and a column ``filter`` that holds it for the others."""
    part = overlaps(a, b, bin_size).withColumn("__o", F.least("end", "b_end") - F.greatest("start", "b_start")).groupBy(*ids).agg(F.sum("__o").alias("__o"))
    share = F.coalesce(F.col("__o"), F.lit(0)) / (F.col("end") - F.col("start"))
    joined = a.join(part, ids, "left")
    if tag:
        return joined.withColumn("filter", F.when(share >= cutoff, tag)).drop("__o")
    return joined.where(share < cutoff).drop("__o")


def _sweep(steps: DataFrame, key: str, counts: list[str], region: int | None) -> DataFrame:
    """(key, start, end, counts) between neighbouring places ``at``, with running sums of the counts."""
    if not region:
        w = Window.partitionBy(key).orderBy("at")
        return steps.select(key, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), *[F.sum(c).over(w).alias(c) for c in counts])
    steps = written(steps.withColumn("__region", F.floor(F.col("at") / region)), "sweep")
    steps = _carried(steps, [key], **{f"__{c}": (F.sum, F.col(c)) for c in counts})
    steps = _carried(steps, [key], back=True, __next=(F.min, F.col("at")))
    w = Window.partitionBy(key, "__region").orderBy("at")
    sums = [(F.sum(c).over(w) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in counts]
    return steps.select(key, F.col("at").alias("start"), F.coalesce(F.lead("at").over(w), "__next").alias("end"), *sums)


def depth_runs(frames: list[DataFrame], key: str = "chrom", region: int | None = None) -> DataFrame:
    """(key, start, end, depth): stretches of even depth, by a sweep over all ends.

    Each frame's own intervals are merged first, so depth counts frames."""
    events = None
    for df in frames:
        flat = merged(df.select(key, "start", "end"), key, region=region)
        part = flat.select(key, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("depth")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("depth")))).alias("e")).select(key, "e.*")
        events = part if events is None else events.union(part)
    steps = events.groupBy(key, "at").agg(F.sum("depth").alias("depth"))
    return _sweep(steps, key, ["depth"], region).where("end IS NOT NULL AND depth > 0")


def intersected(include: list[DataFrame], exclude: list[DataFrame] = (), key: str = "chrom", region: int | None = None) -> DataFrame:
    """Bases in every table of ``include`` and in none of ``exclude``, as disjoint intervals."""
    marked = depth_runs(list(include), key, region).where(F.col("depth") == len(include)).select(key, "start", "end")
    if exclude:
        out = None
        for df in exclude:
            out = df.select(key, "start", "end") if out is None else out.union(df.select(key, "start", "end"))
        ends = lambda df, i, x: df.select(key, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(i).alias("i"), F.lit(x).alias("x")), F.struct(F.col("end").alias("at"), F.lit(-i).alias("i"), F.lit(-x).alias("x")))).alias("e")).select(key, "e.*")
        events = ends(marked, 1, 0).union(ends(merged(out, key, region=region), 0, 1))
        steps = events.groupBy(key, "at").agg(F.sum("i").alias("i"), F.sum("x").alias("x"))
        marked = _sweep(steps, key, ["i", "x"], region).where("end IS NOT NULL AND i > 0 AND x = 0").select(key, "start", "end")
    return merged(marked, key, region=region).select(key, "start", "end")


def nearest(points: DataFrame, intervals: DataFrame, key: str = "chrom", pos: str = "pos", name: str = "name", region: int | None = None) -> DataFrame:
    """Each point with the nearest interval (distance 0 inside; ties to the one that begins at
    or before the point): of those before it the one with the furthest end (then the smaller
    start, then the larger name), of those after it the first (then the nearer end, the
    smaller name). Two running windows over the union, one in reverse, instead of a join."""
    cols = [c for c in points.columns if c not in (key,)]
    own = points.select(key, F.col(pos).cast("long").alias("__at"), F.lit(1).alias("__k"), F.struct(*cols).alias("__p"), F.lit(None).cast("struct<far:bigint,lo:bigint,name:string>").alias("__far"), F.lit(None).cast("struct<lo:bigint,hi:bigint,name:string>").alias("__next"))
    other = intervals.select(key, F.col("start").cast("long").alias("__at"), F.lit(0).alias("__k"), F.lit(None).cast(own.schema["__p"].dataType).alias("__p"), F.struct(F.col("end").cast("long").alias("far"), (-F.col("start")).cast("long").alias("lo"), F.col(name).cast("string").alias("name")).alias("__far"), F.struct(F.col("start").cast("long").alias("lo"), F.col("end").cast("long").alias("hi"), F.col(name).cast("string").alias("name")).alias("__next"))
    swept, at = own.union(other), [key]
    if region:
        swept = swept.withColumn("__region", F.floor(F.col("__at") / region))
        swept = _carried(_carried(written(swept, "sweep"), [key], __b=(F.max, F.col("__far"))), [key], back=True, __a=(F.min, F.col("__next")))
        at = [key, "__region"]
    b = F.max("__far").over(Window.partitionBy(*at).orderBy("__at", "__k").rowsBetween(Window.unboundedPreceding, 0))
    a = F.min("__next").over(Window.partitionBy(*at).orderBy(F.col("__at").desc(), F.col("__k").desc()).rowsBetween(Window.unboundedPreceding, -1))
    if region:
        b, a = F.greatest(b, "__b"), F.least(a, "__a")
    swept = swept.withColumn("b", b).withColumn("a", a).where("__k = 1")
    before = F.greatest(F.col("__at") - F.col("b.far") + 1, F.lit(0))
    after = F.greatest(F.col("a.lo") - F.col("__at"), F.lit(0))
    left = F.col("b").isNotNull() & (F.col("a").isNull() | (before <= after))
    return swept.select(key, "__p.*", F.when(left, F.col("b.name")).otherwise(F.col("a.name")).alias("nearest"), F.when(left, before).when(F.col("a").isNotNull(), after).cast("long").alias("distance"))


def band_pairs(df: DataFrame, id_col: str, max_gap: int, scale: float, key: str = "chrom", kind: str | None = None) -> DataFrame:
    """(a, b): pairs with b starting at a's end or up to min(max_gap, scale * longer) after it."""
    cols = [id_col, key, "start", "end"] + ([kind] if kind else [])
    a = df.select(*cols).withColumn("__bin", F.explode(F.array(F.floor(F.col("end") / max_gap), F.floor(F.col("end") / max_gap) + 1)))
    b = df.select(*[F.col(c).alias(f"b_{c}") for c in cols]).withColumn("__b_bin", F.floor(F.col("b_start") / max_gap))
    gap = F.col("b_start") - F.col("end")
    room = F.least(F.lit(max_gap), F.floor(scale * F.greatest(F.col("end") - F.col("start"), F.col("b_end") - F.col("b_start"))))
    meet = (F.col(key) == F.col(f"b_{key}")) & (F.col("__bin") == F.col("__b_bin")) & (F.col(id_col) != F.col(f"b_{id_col}")) & (gap >= 0) & (gap <= room)
    if kind:
        meet &= F.col(kind) == F.col(f"b_{kind}")
    return a.join(b, meet).select(F.col(id_col).alias("a"), F.col(f"b_{id_col}").alias("b"))


def windows_of(sizes: DataFrame, width: int, key: str = "chrom", length: str = "length") -> DataFrame:
    """Windows of ``width`` over each sequence, from 0, the last one shorter."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(length) - 1, F.lit(0)), F.lit(width).cast("long")))
    return sizes.where(F.col(length) > 0).select(key, length, at.alias("start")).select(key, "start", F.least(F.col("start") + width, length).alias("end"))


def bases(df: DataFrame, closed: bool = False) -> DataFrame:
    """Bases in all intervals; ``closed``: from 1 with the end included."""
    return df.agg(F.coalesce(F.sum(F.col("end") - F.col("start") + (1 if closed else 0)), F.lit(0)).alias("bases"))
