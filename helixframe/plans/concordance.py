"""Calls against a truth set: which records count, how they are classified, and labels.

Genotypes are arrays of allele numbers; (null) or (null, null) is no genotype. ``call`` and
``base`` are the marks that a comparison of call sets leaves on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEFT_OUT = ("IGN", "OUT")
#: Labels of alleles that lie outside of the comparison, or that the call set doesn't hold.
IGNORE, MISS = -1, -2


def compared(call: Column, base: Column) -> Column:
    """False for records that both sides left out."""
    out = lambda x: F.coalesce(x.isin(*_LEFT_OUT), F.lit(False))
    return ~((out(call) & (base.isNull() | out(base))) | (call.isNull() & out(base)))


def no_genotype(gt: Column) -> Column:
    return gt.isNull() | (F.size(F.filter(gt, lambda g: g.isNotNull())) == 0)


def agreed_truth(call: Column, base: Column, called: Column, truth: Column) -> Column:
    """The truth's genotype where the marks say more than it does: the called one for TP, and for
    a wrong genotype one that shares a single allele with the call."""
    a, b = F.get(called, F.lit(0)), F.get(called, F.lit(1))
    half = F.when((F.size(called) < 2) | (b == 0), F.array(a, a)).when(a == 0, F.array(b, b)).otherwise(F.array(a, F.lit(0)))
    return F.when((call == "TP") & (base.isNull() | (base == "TP")), called).when((call == "FP_CA") & (base.isNull() | (base == "FN_CA")), half).otherwise(truth)


def allele_class(called: Column, truth: Column) -> Column:
    """tp if some other allele is shared, fp for an allele that the truth lacks, else fn."""
    others = lambda gt: F.array_except(gt, F.array(F.lit(0)))
    return F.when(no_genotype(called), "fn").when(no_genotype(truth), "fp").when(F.size(F.array_intersect(others(called), others(truth))) > 0, "tp").when(F.size(F.array_except(others(called), others(truth))) > 0, "fp").otherwise("fn")


def genotype_class(called: Column, truth: Column) -> Column:
    """tp for the same genotype; fewer reference alleles than the truth is fp, more is fn."""
    refs = lambda gt: F.size(F.filter(gt, lambda g: g == 0))
    return F.when(no_genotype(called), "fn").when(no_genotype(truth), "fp").when(refs(truth) < refs(called), "fn").when(refs(truth) > refs(called), "fp").when(called != truth, "fp").otherwise("tp")


def classified(records: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """``records`` (keys, alleles, gt_called, gt_truth, call, base) that count, with ``classify`` and
    ``classify_gt`` and the columns of ``calls``; what ``calls`` doesn't hold is a miss."""
    rows = records.where(compared(F.col("call"), F.col("base"))).withColumn("gt_truth", agreed_truth(F.col("call"), F.col("base"), F.col("gt_called"), F.col("gt_truth")))
    rows = rows.withColumns({"classify": allele_class(F.col("gt_called"), F.col("gt_truth")), "classify_gt": genotype_class(F.col("gt_called"), F.col("gt_truth"))})
    rows = rows.withColumn("classify_gt", F.when((F.col("classify_gt") == "tp") & (F.col("classify") == "fp"), "fp").otherwise(F.col("classify_gt")))
    was_missed = F.coalesce(F.col("base").isin("FN", "FN_CA"), F.lit(False))
    both = ("classify", "classify_gt")
    rows = rows.withColumns({c: F.when(was_missed & (F.col(c) == "fp"), "fn").otherwise(F.col(c)) for c in both})
    own = calls.select(*keys, *[c for c in calls.columns if c not in records.columns], F.lit(True).alias("__held"))
    joined = rows.where(F.size("alleles") > 1).join(own, keys, "left")
    # A miss by genotype goes with one by allele.
    lost = F.col("__held").isNull() & (F.col("classify") != "fn")
    return joined.withColumns({c: F.when(lost, "fn").otherwise(F.col(c)) for c in both}).drop("__held")


def labelled(calls: DataFrame, evaluated: DataFrame, keys: list[str], suffix: str = "_eval") -> DataFrame:
    """Calls with the columns of the evaluation at their keys; names that both have get ``suffix``."""
    renamed = evaluated.select(*keys, *[F.col(c).alias(c + suffix if c in calls.columns else c) for c in evaluated.columns if c not in keys])
    return calls.join(renamed, keys, "left")


def unmatched(calls: DataFrame, evaluated: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """(mark, n): evaluated records that no call matches."""
    return evaluated.join(calls.select(*keys), keys, "left_anti").groupBy(mark).agg(F.count(F.lit(1)).alias("n"))


def true_genotype(call: Column, gt: Column, alleles: Column, gt_eval: Column, alleles_eval: Column) -> Column:
    """The label of a call: its own genotype for TP, (0, 0) for FP; for a wrong genotype the places
    of the evaluated alleles among its own (``MISS`` if not there); else ``IGNORE`` twice."""
    whole = (F.size(gt_eval) == 2) & (F.size(F.filter(gt_eval, lambda g: g.isNull())) == 0)
    used = F.when(whole, gt_eval).otherwise(F.array(F.lit(0), F.lit(0)))
    found = F.transform(used, lambda g: F.array_position(alleles, F.get(alleles_eval, g)).cast("int"))
    places = F.transform(found, lambda p: F.when(p > 0, p - 1).otherwise(MISS))
    twice = lambda x: F.array(F.lit(x), F.lit(x))
    return F.when(call == "TP", gt).when(call == "FP", twice(0)).when(call == "FP_CA", places).otherwise(twice(IGNORE))
