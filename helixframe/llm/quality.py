"""Quality classifier with hierarchical empirical Bayes priors.

A document's own evidence is two logistic models over the words and marks it holds, one
for low quality and one for toxic text. They are fitted on the driver from a sample of
labelled documents of at most ``fit_rows`` rows (those with the least hash of their id)
and a vocabulary of at most ``vocabulary`` tokens. Everything else covers all documents.

Hosts and paths then shift the odds: the mean evidence of a host is shrunk toward the
global mean by a strength that comes from how far hosts differ beyond chance, and the
mean of a path toward its host's in the same way, so a site with few documents stays
near the prior and one with many speaks for itself.

Nulls: a null text is empty, holds no token and is judged by the priors; null hosts and
paths are a group of their own. Without labels, or with one class only, a model gives
the share of its class among the labels (0 without any) to every document. Repeated rows
count each. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .tokens import in_slices

_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")
_CLIP = 12.0


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case words and runs of marks, and tokens for repetition and capitals."""
    if not text:
        return set()
    words = _TOKEN.findall(text)
    if not words:
        return set()
    plain = [w for w in words if w[0].isalpha()]
    out = {w.lower() for w in words}
    if plain:
        again = sum(a == b for a, b in zip(plain, plain[1:])) / len(plain)
        capital = sum(w.isupper() and len(w) > 1 for w in plain) / len(plain)
        out |= {f"\0again{min(5, int(20 * again))}", f"\0capital{min(5, int(10 * capital))}"}
    out.add(f"\0marks{min(5, int(10 * (1 - len(plain) / len(words))))}")
    return out


def fit(rows: list[tuple[list[int], int]], size: int, rounds: int = 300, rate: float = 0.5, shrink: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic model over sets of token numbers (batch Adagrad)."""
    y = np.array([r[1] for r in rows], np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return np.zeros(size), float(np.clip(math.log((share + 1e-6) / (1 - share + 1e-6)), -_CLIP, _CLIP))
    cols = np.concatenate([np.array(r[0], np.int64) for r in rows])
    line = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    w, b = np.zeros(size), math.log(y.mean() / (1 - y.mean()))
    seen_w, seen_b = np.full(size, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(line, w[cols], len(rows)) + b, -30, 30)))
        off = p - y
        grad = np.bincount(cols, off[line], size) + shrink * len(rows) * w
        seen_w += grad**2
        seen_b += off.sum() ** 2
        w -= rate * grad / np.sqrt(seen_w)
        b -= 0.1 * rate * off.sum() / math.sqrt(seen_b)
    return w, b


def telling(rows: list[tuple[list[int], int]], size: int, least_z: float) -> np.ndarray:
    """Which tokens' share of positive rows is ``least_z`` standard errors from the overall
    share; all others would add noise that grows with a text's length."""
    y = np.array([r[1] for r in rows], np.float64)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(size, bool)
    n = np.bincount(np.concatenate([np.array(r[0], np.int64) for r in rows]), minlength=size)
    hits = np.bincount(np.concatenate([np.array(r[0], np.int64) for r in rows if r[1]]), minlength=size)
    p = y.mean()
    return np.abs(hits - n * p) >= least_z * np.sqrt(np.maximum(n, 1) * p * (1 - p))


class Evidence:
    """The fitted models: token -> (weight for low quality, weight for toxic), and offsets."""

    def __init__(self, weights: dict[str, tuple[float, float]], offsets: tuple[float, float]):
        self.weights, self.offsets = weights, offsets

    def of(self, text: str | None) -> tuple[float, float]:
        low, toxic = self.offsets
        for pair in map(self.weights.get, tokens(text)):
            if pair:
                low, toxic = low + pair[0], toxic + pair[1]
        return 1 / (1 + math.exp(-max(-_CLIP, min(_CLIP, low)))), 1 / (1 + math.exp(-max(-_CLIP, min(_CLIP, toxic))))


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = 8000, vocabulary: int = 50_000, least_docs: int = 4, least_z: float = 4.0, id_col: str = "doc_id", text_col: str = "text") -> Evidence:
    """Fit both models on at most ``fit_rows`` labelled documents."""
    chosen = labels.where(F.col(id_col).isNotNull()).select(id_col, "quality", "toxic").orderBy(F.xxhash64(id_col), "quality", "toxic").limit(fit_rows)
    found = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType()), T.StructField("tokens", T.StringType())])

    def run(batches):
        for batch in in_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int32()), batch.column(3).cast(pa.int32()), pa.array(["\n".join(sorted(tokens(t))) for t in batch.column(1).to_pylist()])], names=schema.names)

    rows = sorted(found.select(id_col, text_col, "quality", "toxic").mapInArrow(run, schema).orderBy("id", "quality", "toxic", F.xxhash64("tokens")).limit(fit_rows).collect(), key=lambda r: (r[0], str(r[1:])))
    df: Counter = Counter()
    for r in rows:
        df.update(r[3].split("\n"))
    names = [t for t, n in sorted(df.items(), key=lambda x: (-x[1], x[0]))[:vocabulary] if n >= least_docs and t]
    number = {t: i for i, t in enumerate(names)}
    sets = [[number[t] for t in r[3].split("\n") if t in number] for r in rows]
    fits = []
    for values in ([None if r[1] is None else 1 - r[1] for r in rows], [r[2] for r in rows]):
        known = [(t, y) for t, y in zip(sets, values) if y is not None]
        chosen = telling(known, len(names), least_z)
        fits.append(fit([([i for i in t if chosen[i]], y) for t, y in known], len(names)))
    (low, low_0), (toxic, toxic_0) = fits
    return Evidence({t: (float(low[i]), float(toxic[i])) for t, i in number.items() if low[i] or toxic[i]}, (low_0, toxic_0))


def evidence(docs: DataFrame, model: Evidence, keys: list[Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keys, e_low, e_toxic): the models' probabilities for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken = docs.select(id_col, *keys, text_col)
    at_text = len(keys) + 1
    schema = T.StructType([*taken.schema.fields[:-1], T.StructField("e_low", T.DoubleType()), T.StructField("e_toxic", T.DoubleType())])

    def run(batches):
        model = shared.value
        for batch in in_slices(batches):
            pairs = [model.of(t) for t in batch.column(at_text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([p[0] for p in pairs], pa.float64()), pa.array([p[1] for p in pairs], pa.float64())], names=schema.names)

    return taken.mapInArrow(run, schema)


def _strength(sums: DataFrame, n: str, total: str, prior: Column) -> Column:
    """How many documents the prior is worth: p(1-p) over the groups' variance beyond chance."""
    rate, chance = F.col(total) / F.col(n), prior * (1 - prior)
    beyond = F.sum(F.col(n) * (rate - prior) ** 2) - F.sum(chance)
    between = F.greatest(beyond / F.sum(n), F.lit(1e-6))
    return F.least(F.greatest(F.max(chance) / between, F.lit(1.0)), F.lit(1e6))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5, fit_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, carried columns, e_low, e_toxic (own evidence), prior_low, prior_toxic (its path's
    posterior means), p_low, p_toxic (combined), keep (both under ``threshold``)."""
    host = F.coalesce(F.col("source") if host is None else host, F.lit("\0")).alias("host")
    path = F.coalesce(F.concat_ws("/", F.col("source"), F.col("lang")) if path is None else path, F.lit("\0")).alias("path")
    scored = written(evidence(docs, learn(docs, labels, fit_rows, id_col=id_col, text_col=text_col), [host, path, *map(F.col, carried)], id_col, text_col), "evidence")
    paths = written(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("e_low").alias("low"), F.sum("e_toxic").alias("toxic")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("low").alias("hlow"), F.sum("toxic").alias("htoxic"))
    priors = paths
    every = paths.agg(F.sum("n").alias("gn"), F.sum("low").alias("glow"), F.sum("toxic").alias("gtoxic")).select(*[(F.col(f"g{k}") / F.col("gn")).alias(f"g_{k}") for k in ("low", "toxic")])
    hosts = hosts.join(F.broadcast(every))  # one row
    worth = hosts.agg(*[_strength(hosts, "hn", f"h{k}", F.col(f"g_{k}")).alias(f"hs_{k}") for k in ("low", "toxic")])
    hosts = hosts.join(F.broadcast(worth)).select("host", "g_low", "g_toxic", *[((F.col(f"h{k}") + F.col(f"hs_{k}") * F.col(f"g_{k}")) / (F.col("hn") + F.col(f"hs_{k}"))).alias(f"h_{k}") for k in ("low", "toxic")])
    priors = written(paths.join(hosts, "host"), "hosts")
    worth = priors.agg(*[_strength(priors, "n", k, F.col(f"h_{k}")).alias(f"ps_{k}") for k in ("low", "toxic")])
    priors = priors.join(F.broadcast(worth)).select("host", "path", "g_low", "g_toxic", *[((F.col(k) + F.col(f"ps_{k}") * F.col(f"h_{k}")) / (F.col("n") + F.col(f"ps_{k}"))).alias(f"prior_{k}") for k in ("low", "toxic")])

    def logit(p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(p / (1 - p))

    def joined(k: str) -> Column:
        odds = logit(F.col(f"e_{k}")) + logit(F.col(f"prior_{k}")) - logit(F.col(f"g_{k}"))
        return (1 / (1 + F.exp(-odds))).alias(f"p_{k}")

    done = scored.join(priors, ["host", "path"]).select(id_col, *carried, "e_low", "e_toxic", "prior_low", "prior_toxic", joined("low"), joined("toxic"))
    return done.withColumn("keep", (F.col("p_low") < threshold) & (F.col("p_toxic") < threshold))
