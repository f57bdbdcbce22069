"""Folds, deterministic splits and samples."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_fraction(key: Column, seed: int) -> Column:
    """A number in [0, 1): the first eight bytes of SHA-256 of ``seed::key``, over 2^64."""
    digest = F.sha2(F.concat(F.lit(f"{seed}::"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.pow(F.lit(2.0), F.lit(64.0))


def hash_role(chrom: Column, key: Column, seed: int, validation: float, holdout: list[str]) -> Column:
    return F.when(chrom.isin(holdout), "test").when(hash_fraction(key, seed) < validation, "val").otherwise("train")


def chrom_role(chrom: Column, holdout: list[str], validation: list[str]) -> Column:
    return F.when(chrom.isin(holdout), "test").when(chrom.isin(validation), "val").otherwise("train")


def role_fold(role: Column) -> Column:
    """train 0, val 1, test null."""
    return F.when(role == "train", 0).when(role == "val", 1)


def greedy_folds(sizes: dict[str, int], folds: int) -> dict[str, int]:
    """Largest first into the lightest fold; ties go to the lower fold, then the name."""
    load = [0] * folds
    out = {}
    for name in sorted(sizes, key=lambda n: (-sizes[n], n)):
        k = min(range(folds), key=lambda i: (load[i], i))
        out[name] = k
        load[k] += sizes[name]
    return out


def fold_column(chrom: Column, folds: dict[str, int]) -> Column:
    pairs = [x for name, k in folds.items() for x in (F.lit(name), F.lit(k))]
    return F.try_element_at(F.create_map(*pairs), chrom) if pairs else F.lit(None).cast("int")


def manifest(sizes: dict[str, int], folds: int, holdout: list[str] | None = None, leave_out: int = 1) -> dict:
    """Test sequences (given, or the smallest) and the folds of the others."""
    if holdout is None:
        holdout = sorted(sizes, key=lambda n: (sizes[n], n))[:leave_out]
    rest = {n: s for n, s in sizes.items() if n not in holdout}
    return {"test": list(holdout), "folds": greedy_folds(rest, folds)}


def check_manifest(m: dict, sizes: dict[str, int]) -> None:
    both = set(m["test"]) & set(m["folds"])
    lost = set(sizes) - set(m["test"]) - set(m["folds"])
    if both or lost:
        raise ValueError(f"in test and a fold: {sorted(both)}; in neither: {sorted(lost)}")


def stratified(df: DataFrame, strata: list[str], order: list[str], size: int, seed: int = 0) -> DataFrame:
    """Up to ``size`` rows of each stratum, the same for a seed, by a hash of ``order``."""
    w = Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), *order), *order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= size).drop("__r")


def matched_draws(targets: DataFrame, pool: DataFrame, stratum: str, ids: list[str], draws: int) -> DataFrame:
    """``draws`` samples of ``pool`` with as many rows of each stratum as ``targets`` has."""
    need = targets.groupBy(stratum).agg(F.count(F.lit(1)).alias("__need"))
    each = pool.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = Window.partitionBy(stratum, "draw").orderBy(F.xxhash64("draw", *ids), *ids)
    return each.withColumn("__r", F.row_number().over(w)).join(need, stratum).where("__r <= __need").drop("__r", "__need")


def labelled_union(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Both tables with a boolean label; their columns and types must be the same."""
    if sorted(positive.dtypes) != sorted(negative.dtypes):
        raise ValueError("the tables differ in columns or types")
    return positive.withColumn("label", F.lit(True)).unionByName(negative.withColumn("label", F.lit(False)))


