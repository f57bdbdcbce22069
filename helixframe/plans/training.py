"""Training by folds, and scores from models that haven't seen a row."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with ``__features``; nulls are NaN, which trees treat as a value."""
    filled = df.withColumns({f"__x_{f}": F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features})
    return VectorAssembler(inputCols=[f"__x_{f}" for f in features], outputCol="__features", handleInvalid="keep").transform(filled).drop(*[f"__x_{f}" for f in features])


def fold_models(df: DataFrame, features: list[str], label: str, fold: str, folds: int, rounds: int = 20, depth: int = 4, seed: int = 0) -> list[GBTClassificationModel]:
    """Boosted trees for each fold from the rows of the other folds; rows without a fold (the test
    set) train none. Trees are grown over the cluster's partitions, rows are never collected."""
    rows = assembled(df.where(F.col(fold).isNotNull()), features).select(F.col(label).cast("double").alias("__label"), fold, "__features")
    make = GBTClassifier(labelCol="__label", featuresCol="__features", maxIter=rounds, maxDepth=depth, seed=seed)
    return [make.fit(rows.where(F.col(fold) != k)) for k in range(folds)]


def scored(df: DataFrame, models: list[GBTClassificationModel], features: list[str], fold: str, name: str = "score") -> DataFrame:
    """``df`` with ``name``_0.. (every model's probability), ``name`` (the model that has not seen the
    row, or the mean in log odds for rows in no fold) and its quality ``name``_phred."""
    out = assembled(df, features)
    for k, model in enumerate(models):
        own = model.copy({model.predictionCol: "__p", model.rawPredictionCol: "__raw", model.probabilityCol: "__prob"})
        out = own.transform(out).withColumn(f"{name}_{k}", vector_to_array("__prob")[1]).drop("__p", "__raw", "__prob")
    probs = F.array(*[F.col(f"{name}_{k}") for k in range(len(models))])
    return out.withColumn(name, numeric.out_of_fold(probs, F.col(fold))).withColumn(f"{name}_phred", numeric.capped_phred(F.col(name))).drop("__features")


def call_qualities(probs: list[str]) -> dict:
    """Genotype quality (the best over the second best) and call quality (the best other call over the
    reference) from the columns of class probabilities, reference first, in phred units."""
    plausible = [10 * F.log10(F.greatest(F.col(p), F.lit(1e-300))) for p in probs]
    order = F.array_sort(F.array(*plausible))
    return {"gq": F.element_at(order, -1) - F.element_at(order, -2), "qual": F.array_max(F.array(*plausible[1:])) - plausible[0]}
