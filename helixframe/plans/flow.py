"""Flow-space matrices and motif error tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sparse(df: DataFrame, matrix: str, threshold: float) -> DataFrame:
    """(other columns, row, col, p): cells of an array of arrays over ``threshold``."""
    rest = [c for c in df.columns if c != matrix]
    rows = df.select(*rest, F.posexplode(matrix).alias("row", "__r"))
    return rows.select(*rest, "row", F.posexplode("__r").alias("col", "p")).where(F.col("p") > threshold)


def dense(cells: Column, rows: int, cols: int, filler: float) -> Column:
    """An array of (row, col, p) as an array of arrays."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.coalesce(F.get(F.transform(F.filter(cells, lambda x: (x["row"] == r) & (x["col"] == c)), lambda x: x["p"]), F.lit(0)), F.lit(filler))))


def best_path(matrix: Column) -> Column:
    """The most likely row of each column; the first on a tie."""
    cols = F.size(F.get(matrix, F.lit(0)))
    column = lambda c: F.transform(matrix, lambda r: F.get(r, c))
    return F.transform(F.sequence(F.lit(0), cols - 1), lambda c: (F.array_position(column(c), F.array_max(column(c))) - 1).cast("int"))


def path_log2(matrix: Column, path: Column) -> Column:
    """Sum of log2 of the probabilities along a path."""
    return F.aggregate(F.transform(path, lambda r, c: F.log2(F.get(F.get(matrix, r), c))), F.lit(0.0), lambda a, x: a + x)


def off_path(df: DataFrame, ids: list[str], matrix: str, path: str, n: int, threshold: float) -> DataFrame:
    """The ``n`` likeliest cells off the path of at least ``threshold``, ties with the n-th included."""
    cells = sparse(df.select(*ids, matrix, path), matrix, -1.0).where(F.col("row") != F.get(path, F.col("col"))).where(F.col("p") >= threshold)
    return cells.withColumn("__k", F.rank().over(Window.partitionBy(*ids).orderBy(F.col("p").desc()))).where(F.col("__k") <= n).drop("__k", path)


def marginal(df: DataFrame, left: str, right: str, others: list[str], counts: list[str], drop_left: int, drop_right: int) -> DataFrame:
    """Counts summed over motifs without the outer ``drop_left`` and ``drop_right`` letters."""
    a = F.expr(f"substring({left}, {drop_left + 1}, length({left}))")
    b = F.expr(f"substring({right}, 1, greatest(length({right}) - {drop_right}, 0))")
    return df.groupBy(a.alias(left), b.alias(right), *others).agg(*[F.sum(c).alias(c) for c in counts])


def as_shares(df: DataFrame, counts: list[str], floor: float = 0.01) -> DataFrame:
    """Each row's counts as shares, zeros counted as ``floor``."""
    fixed = [F.when(F.col(c) == 0, floor).otherwise(F.col(c).cast("double")) for c in counts]
    total = sum(fixed[1:], fixed[0])
    return df.withColumns({c: f / total for c, f in zip(counts, fixed)})


def given_read(df: DataFrame, keys: list[str], length: str, errors: dict[str, int]) -> DataFrame:
    """P(read = length + d given length) turned to rows by the read's length."""
    long = df.unpivot([*keys, length], list(errors), "error", "p")
    moved = F.lit(0)
    for name, d in errors.items():
        moved = F.when(F.col("error") == name, d).otherwise(moved)
    return long.withColumn("__to", F.col(length) + moved).groupBy(*keys, F.col("__to").alias(length)).pivot("error", list(errors)).agg(F.first("p"))
