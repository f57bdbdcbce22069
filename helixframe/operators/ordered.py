"""Operators over ordered rows. Order always comes from columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def shifted(value: str, by: int, keys: list[str], order: list[str], fill=None) -> Column:
    """The value ``by`` rows before (negative: after), ``fill`` beyond the ends."""
    w = _w(keys, order)
    return F.lag(value, by, fill).over(w) if by >= 0 else F.lead(value, -by, fill).over(w)


def last_nonzero(value: str, place: str, keys: list[str], order: list[str]) -> Column:
    """``place`` of the row itself or the nearest before it whose value isn't 0."""
    return F.last(F.when(F.col(value) != 0, F.col(place)), ignorenulls=True).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def _backward(keys: list[str], order: list[str]):
    """The window in reverse: Spark keeps a running value up to a row, but computes what
    follows a row anew for each row."""
    return Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])


def next_nonzero(value: str, place: str, keys: list[str], order: list[str]) -> Column:
    """``place`` of the row itself or the nearest after it whose value isn't 0."""
    return F.last(F.when(F.col(value) != 0, F.col(place)), ignorenulls=True).over(_backward(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def true_runs(df: DataFrame, flag: str, place: str, keys: list[str]) -> DataFrame:
    """(keys, start, end, n): half-open runs of consecutive places whose flag holds."""
    held = df.where(F.col(flag)).withColumn("__g", F.col(place) - F.row_number().over(_w(keys, [place])))
    return held.groupBy(*keys, "__g").agg(F.min(place).alias("start"), (F.max(place) + 1).alias("end"), F.count(F.lit(1)).alias("n")).drop("__g")


def running_id(df: DataFrame, group: str, order: list[str], prefix: str, name: str = "id") -> DataFrame:
    """``prefix_<group>_<k>``, k counting from 0 within the group."""
    return df.withColumn(name, F.concat_ws("_", F.lit(prefix), F.col(group), (F.row_number().over(_w([group], order)) - 1).cast("string")))


def unique_ids(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Ids that occur again get a suffix ``_1``, ``_2``.. in order."""
    n = F.row_number().over(_w([id_col], order))
    return df.withColumn("__n", n).withColumn(id_col, F.when(F.col("__n") == 1, F.col(id_col)).otherwise(F.concat_ws("_", F.col(id_col), (F.col("__n") - 1).cast("string")))).drop("__n")


def repeated_ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def trimmed_mean(df: DataFrame, keys: list[str], value: str, trim: float) -> DataFrame:
    """Mean without round(n * trim) rows at either end (halves to even)."""
    w = _w(keys, [value])
    ranked = df.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    cut = F.bround(F.col("__n") * trim)
    return ranked.where((F.col("__r") > cut) & (F.col("__r") <= F.col("__n") - cut)).groupBy(*keys).agg(F.avg(value).alias("trimmed_mean"))


def rolling_rate(df: DataFrame, keys: list[str], order: list[str], top: str, bottom: str, width: int) -> DataFrame:
    """``df`` with the sums of both columns over ``width`` rows centred on each, and their ratio."""
    before, after = width // 2, width - 1 - width // 2
    w = _w(keys, order).rowsBetween(-before, after)
    return df.withColumns({"local_top": F.sum(top).over(w), "local_bottom": F.sum(bottom).over(w)}).withColumn("local_rate", F.try_divide(F.col("local_top").cast("double"), F.col("local_bottom").cast("double")))


def chunk_number(order: list[str], size: int, keys: list[str]) -> Column:
    return F.floor((F.row_number().over(_w(keys, order)) - 1) / size)


def row_buffer(value: str, rows: int, keys: list[str], order: list[str]) -> Column:
    """The last ``rows`` values up to this row, as an array."""
    return F.collect_list(value).over(_w(keys, order).rowsBetween(-(rows - 1), 0))


def skyline(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Points that no other point of their group beats in ``x`` and ``y`` (equal in one counts
    if better in the other)."""
    best = df.groupBy(*keys, x).agg(F.max(y).alias("__y"))
    above = F.max("__y").over(_backward(keys, [x]).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("__a", above).where("__a IS NULL OR __y > __a").select(*keys, x, F.col("__y").alias(y))
    return df.join(front, [*keys, x, y], "left_semi")


def fill_forward(value: str, order: list[str], keys: list[str]) -> Column:
    return F.last(value, ignorenulls=True).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def ordered_split(df: DataFrame, keys: list[str], order: list[str], share: float) -> DataFrame:
    """``train`` for the first ``share`` of each group's rows in order, else ``test``."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("role", F.when(F.row_number().over(_w(keys, order)) <= n * share, "train").otherwise("test"))
