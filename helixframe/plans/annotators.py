"""Plug-ins that turn a table of records into one with more columns, applied in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Annotator:
    """Say which columns come (``fields``) and either give expressions or work on batches."""

    def fields(self, schema: T.StructType) -> list[T.StructField]:
        return []

    def expressions(self, df: DataFrame) -> dict | None:
        """Columns as Spark expressions; None to work on batches."""
        return None

    def batch(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows


class Scorer(Annotator):
    """A model's score: ``predict`` gets the feature columns of a batch."""

    def __init__(self, predict: Callable[[pd.DataFrame], "pd.Series"], features: list[str], name: str = "score"):
        self.predict, self.features, self.name = predict, features, name

    def fields(self, schema: T.StructType) -> list[T.StructField]:
        return [T.StructField(self.name, T.DoubleType())]

    def batch(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(**{self.name: self.predict(rows[self.features])})


def annotate(df: DataFrame, annotators: list[Annotator]) -> DataFrame:
    """Expression plug-ins stay in the plan; runs of batch plug-ins share one pass."""
    waiting: list[Annotator] = []
    for a in [*annotators, None]:
        exprs = a.expressions(df) if a is not None else {}
        if exprs is None:
            waiting.append(a)
            continue
        if waiting:
            schema = df.schema
            for w in waiting:
                schema = T.StructType([*schema.fields, *w.fields(schema)])
            chain, names = list(waiting), schema.names

            def run(batches: Iterator[pd.DataFrame], chain=chain, names=names) -> Iterator[pd.DataFrame]:
                for rows in batches:
                    for w in chain:
                        rows = w.batch(rows)
                    yield rows[names]

            df, waiting = df.mapInPandas(run, schema), []
        if exprs:
            df = df.withColumns(exprs)
    return df
