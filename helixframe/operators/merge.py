"""Union of call sets, collapsing of near calls and aggregation of groups of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .intervals import band_pairs
from .ordered import unique_ids


def combined(frames: dict[str, DataFrame], id_col: str, order: list[str]) -> DataFrame:
    """The union by name with a ``source`` column and unique ids; columns that share a name
    must share a type."""
    kinds: dict[str, str] = {}
    out = None
    for source, df in frames.items():
        for name, kind in df.dtypes:
            if kinds.setdefault(name, kind) != kind:
                raise ValueError(f"column {name}: {kinds[name]} and {kind}")
        part = df.withColumn("source", F.lit(source))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return unique_ids(out, id_col, ["source", *order])


def weighted_avg(value: str, weight: Column) -> Column:
    """Mean of the values that are there, by weight, to three places."""
    w = F.when(F.col(value).isNotNull(), weight)
    return F.round(F.try_divide(F.sum(F.col(value) * w), F.sum(w)), 3)


def value_set(value: str) -> Column:
    return F.array_sort(F.collect_set(value))


def shortest(value: str) -> Column:
    """The pair with the least extent (ties: the smaller pair)."""
    return F.min(F.struct((F.col(value)[1] - F.col(value)[0]).alias("d"), F.col(value).alias("v")))["v"]


def weighted_majority(df: DataFrame, keys: list[str], value: str, weight: Column, nulls: bool = False) -> DataFrame:
    """(keys, value): the value with the largest summed weight; ties to the smaller value. With
    ``nulls`` a missing value is one of the values, the last of a tie. Values without any weight
    come last."""
    votes = df if nulls else df.where(F.col(value).isNotNull())
    sums = votes.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    # ranked where they are: sums of doubles that are made a second time, in another order, need not be equal
    w = Window.partitionBy(*keys).orderBy(F.col("__w").desc_nulls_last(), F.col(value).asc_nulls_last())
    return sums.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__w")


ACTIONS = {"max": F.max, "min": F.min, "sum": F.sum, "set": value_set, "first": lambda c: F.first(c, ignorenulls=True), "shortest": shortest}


def aggregated(df: DataFrame, group: str, actions: dict[str, str], start: str = "start", end: str = "end") -> DataFrame:
    """One row a group: its extent, members, and each column by its action (``ACTIONS``,
    weighted_avg, weighted_majority; weights are interval lengths)."""
    length = (F.col(end) - F.col(start)).cast("double")
    aggs = [F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("members")]
    votes = [c for c, a in actions.items() if a == "weighted_majority"]
    aggs += [(weighted_avg(c, length) if a == "weighted_avg" else ACTIONS[a](c)).alias(c) for c, a in actions.items() if c not in votes]
    out = df.groupBy(group).agg(*aggs)
    for c in votes:
        out = out.join(weighted_majority(df, [group], c, length), group, "left")
    return out


def smoothed(calls: DataFrame, id_col: str, max_gap: int, scale: float, actions: dict[str, str], key: str = "chrom", kind: str | None = None) -> DataFrame:
    """Chains of calls whose gaps are small for their size become one call each."""
    found = components(band_pairs(calls, id_col, max_gap, scale, key, kind))
    grouped = calls.join(found, calls[id_col] == found["node"], "left").withColumn("group", F.coalesce("component", F.col(id_col))).drop("node", "component")
    return aggregated(grouped, "group", {key: "first", **actions})


def collapsed(calls: DataFrame, id_col: str, distance: int, size_share: float, better: list[Column], key: str = "chrom", kind: str | None = None) -> DataFrame:
    """Calls whose ends lie within ``distance`` and whose sizes are alike are one call, of
    which the best in the order ``better`` stays, with ``members`` ids."""
    cols = [id_col, key, "start", "end"] + ([kind] if kind else [])
    bins = F.floor(F.col("start") / max(distance, 1))
    a = calls.select(*cols).withColumn("__bin", F.explode(F.array(bins - 1, bins, bins + 1)))
    b = calls.select(*[F.col(c).alias(f"b_{c}") for c in cols]).withColumn("__b_bin", F.floor(F.col("b_start") / max(distance, 1)))
    size, other = F.col("end") - F.col("start"), F.col("b_end") - F.col("b_start")
    meet = (F.col(key) == F.col(f"b_{key}")) & (F.col("__bin") == F.col("__b_bin")) & (F.col(id_col) < F.col(f"b_{id_col}")) & (F.abs(F.col("start") - F.col("b_start")) <= distance) & (F.abs(F.col("end") - F.col("b_end")) <= distance) & (F.least(size, other) >= size_share * F.greatest(size, other))
    if kind:
        meet &= F.col(kind) == F.col(f"b_{kind}")
    pairs = a.join(b, meet).select(F.col(id_col).alias("a"), F.col(f"b_{id_col}").alias("b")).distinct()
    found = components(pairs)
    grouped = calls.join(found, calls[id_col] == found["node"], "left").withColumn("group", F.coalesce("component", F.col(id_col))).drop("node", "component")
    w = Window.partitionBy("group")
    return grouped.withColumn("members", F.array_sort(F.collect_list(id_col).over(w))).withColumn("__r", F.row_number().over(w.orderBy(*better, id_col))).where("__r = 1").drop("__r", "group")


def filter_tokens(columns: list[str], known: list[str] | None = None) -> Column:
    """The union of ``;``-separated tokens of several columns, sorted; PASS if there is none."""
    tokens = F.flatten(F.array(*[F.split(F.coalesce(F.col(c), F.lit("")), ";") for c in columns]))
    clean = F.array_sort(F.array_distinct(F.filter(tokens, lambda t: ~t.isin("", ".", "PASS"))))
    text = F.when(F.size(clean) > 0, F.array_join(clean, ";")).otherwise("PASS")
    if known is None:
        return text
    return F.when(F.forall(clean, lambda t: t.isin(known)), text).otherwise(F.raise_error(F.lit("unknown filter")).cast("string"))


def annotate_known(df: DataFrame, known: DataFrame, keys: list[str], name: str = "annotation") -> DataFrame:
    """``df`` with the known annotations of its key joined by ``;``, or PASS."""
    marks = known.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(name)), ";").alias(name))
    return df.join(marks, keys, "left").withColumn(name, F.coalesce(name, F.lit("PASS")))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, as often, in any order."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def replaced(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``df`` with all rows of the keys that ``new`` has replaced by those of ``new``."""
    return df.join(new.select(key).distinct(), key, "left_anti").select(*df.columns).unionByName(new)
