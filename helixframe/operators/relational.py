"""Joins, grouping sets and rankings, each as the plan that Spark runs best."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_match(a: DataFrame, b: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Rows of ``a`` that some row of ``b`` matches on ``pairs`` (column of a: of b); null matches nothing."""
    return a.join(b.select(*pairs.values()), _equal(a, b, pairs), "left_semi")


def without_match(a: DataFrame, b: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Rows of ``a`` that no row of ``b`` matches; those with a null key stay."""
    return a.join(b.select(*pairs.values()), _equal(a, b, pairs), "left_anti")


def _equal(a: DataFrame, b: DataFrame, pairs: dict[str, str]) -> Column:
    return reduce(lambda x, y: x & y, [a[x] == b[y] for x, y in pairs.items()])


def with_each(df: DataFrame, values: list, name: str) -> DataFrame:
    """Each row once for every one of a few ``values``: a cross join without a join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def rolled_up(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Aggregates by all keys, by ever fewer of them, and over all; ``level`` says how many
    are left out, so that a null key is told from one left out."""
    return df.rollup(*keys).agg(*[a.alias(n) for n, a in aggregates.items()], F.bit_count(F.grouping_id()).cast("int").alias("level"))


def cubed(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Aggregates by every subset of the keys; ``level`` says how many are left out."""
    return df.cube(*keys).agg(*[a.alias(n) for n, a in aggregates.items()], F.bit_count(F.grouping_id()).cast("int").alias("level"))


def grouped_by_sets(df: DataFrame, sets: list[list[str]], **aggregates: Column) -> DataFrame:
    """Aggregates by each of the given sets of keys, in one pass; keys not in a set are null."""
    keys = sorted({k for s in sets for k in s})
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(*[a.alias(n) for n, a in aggregates.items()])


def top(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; groups are cut before they travel."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def last_before(a: DataFrame, b: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """As-of join: each row of ``a`` with ``values`` of the last row of ``b`` at or before its ``time``.

    Both sides in one sorted pass with a running last value instead of a join by range. Of
    several rows of ``b`` at one time the one with the greatest values counts."""
    value = F.struct(*values)
    left = a.withColumns({"__row": F.struct(*a.columns), "__v": F.lit(None).cast(b.select(value.alias("v")).schema["v"].dataType)}).select(*keys, time, F.lit(1).alias("__side"), "__row", "__v")
    right = b.select(*keys, time, F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), value.alias("__v"))
    w = Window.partitionBy(*keys).orderBy(time, "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    joined = left.union(right).withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return joined.select("__row.*", *[F.col("__last")[v].alias(v) for v in values])


def looked_up(value: Column, table: dict, default=None) -> Column:
    """The entry of a small map, as a literal in the plan."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(default))
