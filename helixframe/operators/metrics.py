"""Classification metrics, histograms, quantiles and category tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precision(fp: Column, tp: Column) -> Column:
    """1 - fp / (fp + tp); 1 without any."""
    return F.coalesce(1 - F.try_divide(fp.cast("double"), (fp + tp).cast("double")), F.lit(1.0))


def recall(fn: Column, tp: Column) -> Column:
    return F.coalesce(1 - F.try_divide(fn.cast("double"), (fn + tp).cast("double")), F.lit(1.0))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


#: Strata of variants by kind and homopolymer length: name, SQL predicate over indel, hmer.
STRATA = (
    ("SNP", "NOT indel"),
    ("Non-hmer INDEL", "indel AND hmer = 0"),
    ("HMER indel <= 4", "indel AND hmer > 0 AND hmer <= 4"),
    ("HMER indel (4,8)", "indel AND hmer > 4 AND hmer < 8"),
    ("HMER indel [8,10]", "indel AND hmer >= 8 AND hmer <= 10"),
    ("HMER indel 11,12", "indel AND hmer >= 11 AND hmer <= 12"),
    ("HMER indel > 12", "indel AND hmer > 12"),
)


def stratum(indel: str, hmer: str) -> Column:
    """The name of the stratum; a later one wins where several hold."""
    out = F.lit(None).cast("string")
    for name, predicate in STRATA:
        text = predicate.replace("indel", f"`{indel}`").replace("hmer", f"`{hmer}`")
        out = F.when(F.expr(text), name).otherwise(out)
    return out


def after_filter(classified: Column, is_filtered: Column) -> Column:
    """A filtered false positive is a true negative, a filtered true positive a miss."""
    return F.when(is_filtered & (classified == "fp"), "tn").when(is_filtered & (classified == "tp"), "fn").otherwise(classified)


def filter_call(filters: Column) -> Column:
    """tp if every filter token is PASS (or there is none), else fp."""
    return F.when(F.forall(F.split(F.coalesce(filters, F.lit("PASS")), ";"), lambda t: t.isin("PASS", "", ".")), "tp").otherwise("fp")


def accuracy(df: DataFrame, keys: list[str], classified: str, digits: int = 5) -> DataFrame:
    n = lambda k: F.coalesce(F.sum((F.col(classified) == k).cast("long")), F.lit(0)).alias(k)
    out = df.groupBy(*keys).agg(n("tp"), n("fp"), n("fn")) if keys else df.agg(n("tp"), n("fp"), n("fn"))
    out = out.withColumns({"precision": precision(F.col("fp"), F.col("tp")), "recall": recall(F.col("fn"), F.col("tp"))})
    return out.withColumn("f1", F.round(f1(F.col("precision"), F.col("recall")), digits)).withColumns({c: F.round(c, digits) for c in ("precision", "recall")})


def pr_curve(df: DataFrame, keys: list[str], score: str, label: str, missed: str | None = None, skip_top: int = 0) -> DataFrame:
    """(keys, threshold, precision, recall) at each distinct score, calls being score >=
    threshold. ``label``: 1 for true. Rows of ``missed`` were never called: they count as
    true in the recall only. Thresholds above the ``skip_top``-th highest score are left out."""
    called = df.where(~F.col(missed)) if missed else df
    by = called.groupBy(*keys, score).agg(F.sum(label).alias("t"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc())
    run = by.withColumns({"tp": F.sum("t").over(w), "called": F.sum("n").over(w), "true": F.sum("t").over(Window.partitionBy(*keys))})
    if missed:
        lost = df.groupBy(*keys).agg(F.sum((F.col(missed) & (F.col(label) == 1)).cast("long")).alias("lost"))
        run = run.join(lost, keys) if keys else run.join(F.broadcast(lost))
    else:
        run = run.withColumn("lost", F.lit(0))
    return run.where(F.col("called") >= skip_top).select(*keys, F.col(score).alias("threshold"), (F.col("tp") / F.col("called")).alias("precision"), F.coalesce(F.try_divide(F.col("tp"), F.col("true") + F.col("lost")), F.lit(0.0)).alias("recall"))


def area_under_pr(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Trapezoids over the recall-ordered curve; 0 for fewer than two points."""
    w = Window.partitionBy(*keys).orderBy("recall", F.col("precision").desc())
    step = (F.col("recall") - F.lag("recall").over(w)) * (F.col("precision") + F.lag("precision").over(w)) / 2
    return curve.withColumn("__a", step).groupBy(*keys).agg(F.coalesce(F.sum("__a"), F.lit(0.0)).alias("aucpr"))


def roc_auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve from counts by score (ties count half); null for one class."""
    by = df.groupBy(*keys, score).agg(F.sum(label).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("n"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    under = F.coalesce(F.sum("n").over(w), F.lit(0.0))
    return by.withColumn("__w", F.col("p") * (under + F.col("n") / 2)).groupBy(*keys).agg(F.try_divide(F.sum("__w"), F.sum("p") * F.sum("n")).alias("auc"))


def rates_at(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """True and false positive rates of score > threshold, in one pass (0 for an empty class)."""
    pos, neg = F.sum(label), F.sum(1 - F.col(label))
    hit = lambda t, y: F.sum(((F.col(score) > t) & (F.col(label) == y)).cast("long"))
    one = df.agg(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(F.try_divide(hit(t, 1), pos), F.lit(0.0)).alias("tpr"), F.coalesce(F.try_divide(hit(t, 0), neg), F.lit(0.0)).alias("fpr")) for t in thresholds]).alias("r"))
    return one.select(F.explode("r").alias("r")).select("r.*")


def histogram(df: DataFrame, keys: list[str], value: str, width: float, top: float, cumulative: bool = True) -> DataFrame:
    """Counts by bins of ``width`` up to ``top`` (values beyond are capped into the last bin,
    which is closed), with their share and the share up to the bin; empty bins included."""
    last = int(top / width) - 1
    b = F.least(F.floor(F.least(F.col(value), F.lit(top)) / width), F.lit(last)).cast("int")
    found = df.where(F.col(value).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    groups = found.select(*keys).distinct() if keys else df.sparkSession.range(1).drop("id")
    grid = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(last))))
    full = grid.join(found, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = Window.partitionBy(*keys)
    out = full.withColumn("share", F.col("n") / F.sum("n").over(whole)).withColumn("upper", (F.col("bin") + 1) * F.lit(width))
    if cumulative:
        out = out.withColumn("up_to", F.sum("n").over(whole.orderBy("bin")) / F.sum("n").over(whole))
    return out


def histogram_quantiles(hist: DataFrame, keys: list[str], value: str, count: str, quantiles: list[float]) -> DataFrame:
    """Quantiles of a histogram: the first value whose cumulative share reaches each."""
    w = Window.partitionBy(*keys)
    run = hist.withColumn("__c", F.sum(count).over(w.orderBy(value)) / F.sum(count).over(w))
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("__c") >= q, F.col(value))).alias(f"q{round(100 * q)}") for q in quantiles])


def interpolated_quantile(hist: DataFrame, keys: list[str], value: str, count: str, q: float) -> DataFrame:
    """A weighted quantile, linear between the midpoints of the cumulative weights."""
    w = Window.partitionBy(*keys)
    run = hist.withColumn("__t", F.sum(count).over(w)).withColumn("__m", (F.sum(count).over(w.orderBy(value)) - F.col(count) / 2) / F.col("__t"))
    ends = run.groupBy(*keys).agg(
        F.max(F.when(F.col("__m") <= q, F.struct(F.col("__m").alias("m"), F.col(value).cast("double").alias("v")))).alias("lo"), F.min(F.when(F.col("__m") >= q, F.struct(F.col("__m").alias("m"), F.col(value).cast("double").alias("v")))).alias("hi")
    )
    part = F.try_divide(F.lit(q) - F.col("lo.m"), F.col("hi.m") - F.col("lo.m"))
    return ends.select(*keys, F.coalesce(F.when(F.col("lo").isNull(), F.col("hi.v")).when(F.col("hi").isNull(), F.col("lo.v")), F.col("lo.v") + F.coalesce(part, F.lit(0.0)) * (F.col("hi.v") - F.col("lo.v"))).alias("quantile"))


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    aggs = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def cost_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, median, population deviation, extremes and sum."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("total"))


def within_iqr(df: DataFrame, keys: list[str], value: str, times: float = 1.5) -> DataFrame:
    """Rows within ``times`` the interquartile range of their group's quartiles."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
    lo, hi = F.col("__q")[0], F.col("__q")[1]
    joined = df.join(q, keys) if keys else df.join(F.broadcast(q))
    return joined.where((F.col(value) >= lo - times * (hi - lo)) & (F.col(value) <= hi + times * (hi - lo))).drop("__q")


def capped_at_quantile(df: DataFrame, value: str, q: float, factor: float) -> DataFrame:
    """Values over the ``q`` quantile become ``factor`` times the quantile."""
    cut = df.agg(F.percentile(value, F.lit(q)).alias("__cut"))
    return df.join(F.broadcast(cut)).withColumn(value, F.when(F.col(value) > F.col("__cut"), factor * F.col("__cut")).otherwise(F.col(value))).drop("__cut")


def crosstab(df: DataFrame, a: str, b: str, values: list[str], count: str | None = None) -> DataFrame:
    """Every pair of ``values`` with its count and share, zeros included."""
    n = F.sum(count) if count else F.count(F.lit(1))
    found = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(n.alias("n"))
    each = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, values))).alias("a"))
    grid = each.withColumn("b", F.explode(F.array(*map(F.lit, values))))
    full = F.broadcast(grid).join(found, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy())), F.lit(0.0)))


def agreement(table: DataFrame) -> DataFrame:
    """From a crosstab: the share of each agreed category, and DISCORDANT for the rest."""
    same = table.where("a = b").select(F.col("a").alias("category"), "share")
    rest = table.agg((1 - F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("share"))), F.lit(0.0))).alias("share")).select(F.lit("DISCORDANT").alias("category"), "share")
    return same.union(rest)


def flag_counts(df: DataFrame, flag: str) -> DataFrame:
    """Primary mapped reads, and those of them that are no duplicates, by SAM flag bits."""
    has = lambda bits: F.col(flag).bitwiseAND(bits) != 0
    primary = ~has(0x4 | 0x100 | 0x800)
    return df.agg(F.coalesce(F.sum(primary.cast("long")), F.lit(0)).alias("reads"), F.coalesce(F.sum((primary & ~has(0x400)).cast("long")), F.lit(0)).alias("distinct_reads"))


def group_rates(df: DataFrame, keys: list[str], failed: str, total: str) -> DataFrame:
    """Failed rows by group with their percentage of the group's largest total."""
    return df.groupBy(*keys).agg(F.sum(failed).alias("failed"), F.max(total).alias("total")).withColumn("pct", F.try_divide(100.0 * F.col("failed"), F.col("total")))


def any_of(masks: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, masks)
