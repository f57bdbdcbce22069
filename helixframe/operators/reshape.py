"""Ragged lists, wide and long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"^-?[0-9]+\.?[0-9]*$"


def missing(text: Column) -> Column:
    """Empty strings and lone dots as null."""
    return F.when(~text.isin("", "."), text)


def cast_tag(text: Column, kind: str) -> Column:
    """A tag's text by its declared type: numbers get 0 for null, flags keep null."""
    clean = missing(text)
    if kind == "Integer":
        return F.coalesce(clean.try_cast("bigint"), F.lit(0).cast("bigint"))
    if kind == "Float":
        return F.coalesce(clean.try_cast("double"), F.lit(0.0))
    return clean


def explode_ragged(df: DataFrame, columns: list[str], sep: str = ",", place: str = "place") -> DataFrame:
    """A row for each place of parallel lists (arrays, or texts split at ``sep``); shorter
    lists give null, other columns repeat."""
    split = lambda c: F.coalesce(F.col(c), F.array(F.lit(""))) if df.schema[c].dataType.typeName() == "array" else F.split(F.coalesce(F.col(c), F.lit("")), sep)
    lists = F.arrays_zip(*[split(c).alias(c) for c in columns])
    rest = [c for c in df.columns if c not in columns]
    out = df.select(*rest, F.posexplode(lists).alias(place, "__v"))
    return out.select(*rest, place, *[missing(F.col("__v")[c]).alias(c) for c in columns])


def list_stats(df: DataFrame, column: str, sep: str = ",") -> DataFrame:
    """``df`` with mean, min, max, count and count_zero of a list of numbers in text.

    Entries that are no plain decimal number are skipped; without any, the first three are
    null. Values are rounded to six places."""
    numbers = F.transform(F.filter(F.split(F.coalesce(F.col(column), F.lit("")), sep), lambda x: x.rlike(_NUMBER)), lambda x: x.cast("double"))
    return array_stats(df.withColumn("__n", numbers), "__n", column).drop("__n")


def array_stats(df: DataFrame, array: str, name: str) -> DataFrame:
    n, a = F.size(array), F.col(array)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return df.withColumns(
        {
            f"{name}_mean": F.round(F.try_divide(total, n.cast("double")), 6),
            f"{name}_min": F.round(F.array_min(a).cast("double"), 6),
            f"{name}_max": F.round(F.array_max(a).cast("double"), 6),
            f"{name}_count": n.cast("long"),
            f"{name}_count_zero": F.size(F.filter(a, lambda x: x == 0)).cast("long"),
        }
    )


def expand_list(df: DataFrame, column: str, size: int, sep: str = ",") -> DataFrame:
    """The first ``size`` places of a list (an array, or a text split at ``sep``) as columns
    ``column_0``..; null where it ends."""
    if df.schema[column].dataType.typeName() == "array":
        return df.withColumns({f"{column}_{i}": F.get(column, F.lit(i)) for i in range(size)})
    parts = F.split(F.coalesce(F.col(column), F.lit("")), sep)
    return df.withColumns({f"{column}_{i}": missing(F.get(parts, F.lit(i))) for i in range(size)})


def to_long(df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def to_wide(df: DataFrame, keys: list[str], name: str, value: str, names: list) -> DataFrame:
    """One column for each of ``names``; giving them saves a pass over the data."""
    return df.groupBy(*keys).pivot(name, names).agg(F.first(value, ignorenulls=True))


def flat_columns(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct columns as top-level columns with joined names."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct":
            out += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}{sep}{g.name}") for g in f.dataType.fields]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def allele_subset(field: Column, places: Column) -> Column:
    """The entries of an allele-indexed array at ``places`` (from 0)."""
    return F.transform(places, lambda i: F.get(field, i))


def outer_join_samples(frames: dict[str, DataFrame], keys: list[str], shared: list[str] = ()) -> DataFrame:
    """Full outer join of per-sample tables; sample columns get the sample's name as suffix,
    ``shared`` ones come from the first table that has them."""
    out = None
    for sample, df in frames.items():
        own = [c for c in df.columns if c not in keys and c not in shared]
        part = df.select(*keys, *[F.col(c).alias(f"{c}_{sample}") for c in own], *[F.col(c).alias(f"__{c}") for c in shared])
        if out is None:
            out = part.withColumnsRenamed({f"__{c}": c for c in shared})
        else:
            out = out.join(part, keys, "full")
            out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in shared}).drop(*[f"__{c}" for c in shared]) if shared else out
    return out
