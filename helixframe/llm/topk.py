"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors are integers (each component times ``scale``, rounded down). The index is a table
of blocks of candidates. A block keeps, for each dimension, its candidates in posting
segments by quantised value: one segment a value, or ``LEVELS`` equal steps where values
spread wider. A segment's impact for a query is the most that it can add to a score, over
the least that its dimension adds to any candidate of the block.

A query goes through a block's segments of all dimensions in descending impact, some
``ROUNDS`` equal shares of the postings one after the other, and adds impacts to its
candidates' accumulators. What a candidate has not met yet can add no more than the impact
reached, dimension by dimension; candidates that can't reach the k-th best score known for
the query are out. The block ends early once those left hold no more components than there
are postings to come; these, and at the end those whose quantised score may lie among the
best, are rescored exactly.

Queries form blocks too. Each task takes one block of queries and a group of index blocks,
by shuffle; neither queries nor candidates pass through the driver. A task holds one block
of either and the best of its queries.

Vectors that are null or empty, or hold null or non-finite components, take no part, nor do
candidates of another length than the query. Ties go to the smaller id. A candidate with
the query's own id is left out. Repeated candidate rows count each; of a repeated query
id the valid row with the least vector is the query. Other columns are not looked at.
Empty tables give no rows. Scores are exact within 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

#: Candidates of an index block, queries of a query block, index blocks of a group at most.
BLOCK, QUERIES, GROUP = 8192, 512, 4
#: Segments of a dimension at most, and shares of the postings between two looks at the bounds.
LEVELS, ROUNDS = 128, 8
_NONE, _LAST = np.int64(-(2**62)), np.iinfo(np.int64).max
#: An accumulator counts the dimensions met below and adds impacts above this.
_UNIT = 4096.0


def integer_vectors(ids: pa.Array, vectors: pa.Array, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer vectors) by length, valid rows only."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero((lengths == n) & ids.is_valid().to_numpy(zero_copy_only=False))
        taken = vectors.take(pa.array(rows)).flatten().cast(pa.float64())
        flat = taken.fill_null(math.nan).to_numpy(zero_copy_only=False).reshape(-1, n)
        ok = np.isfinite(flat).all(axis=1)
        if ok.any():
            out.append((ids.take(pa.array(rows[ok])).to_numpy(zero_copy_only=False).astype(np.int64), np.floor(scale * flat[ok]).astype(np.int64)))
    return out


class Best:
    """The best ``k`` (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), _NONE)
        self.ids = np.full((queries, k), _LAST)

    def merge(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        able = scores >= self.scores[row, -1]
        if np.count_nonzero(able) > self.k:
            able &= scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
        s, i = np.append(self.scores[row], scores[able]), np.append(self.ids[row], ids[able])
        order = np.lexsort((i, -s))[: self.k]
        self.scores[row], self.ids[row] = s[order], i[order]


class IndexBlock:
    """Candidates of one length with their posting segments."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n, dims = vectors.shape
        low = vectors.min(axis=0)
        width = (vectors.max(axis=0) - low) // LEVELS + 1
        level = (vectors - low) // width
        order = np.argsort(level, axis=0, kind="stable")
        line = np.take_along_axis(level, order, 0).T
        self.postings = order.T.ravel()  # dimension by dimension, each by ascending level
        fresh = np.ones((dims, n), bool)
        fresh[:, 1:] = line[:, 1:] != line[:, :-1]
        self.start = np.flatnonzero(fresh.ravel())
        self.count = np.diff(np.append(self.start, n * dims))
        self.dim = self.start // n
        value = np.take_along_axis(vectors, order, 0).T.ravel()
        self.least = np.minimum.reduceat(value, self.start)
        self.most = np.maximum.reduceat(value, self.start)
        self.first = np.searchsorted(self.dim, np.arange(dims))

    def search(self, best: Best, row: int, q_id: int, q: np.ndarray) -> None:
        """Update ``best`` with what this block has for the query ``q``."""
        n, dims = self.vectors.shape
        weight = q[self.dim].astype(np.float64)
        ends = weight * self.least, weight * self.most
        upper, lower = np.maximum(*ends), np.minimum(*ends)
        base = np.minimum.reduceat(lower, self.first)
        impact = upper - base[self.dim]
        slack = float(np.maximum.reduceat(upper - lower, self.first).sum())
        floor = float(base.sum())
        known = float(best.scores[row, -1])
        if dims >= _UNIT or (float(np.maximum.reduceat(impact, self.first).sum()) + abs(floor)) * _UNIT >= 2.0**52:
            return self._rescore(best, row, q_id, q, np.arange(n))  # beyond what accumulators hold
        order = np.argsort(-impact, kind="stable")
        done = np.cumsum(self.count[order])
        cuts = np.unique(np.append(np.searchsorted(done, done[-1] * np.arange(1, ROUNDS) / ROUNDS) + 1, len(order)))
        kept = np.zeros(n)
        a = 0
        for b in cuts.tolist():
            taken = np.sort(order[a:b])  # a dimension's segments by value, and so by impact, are neighbours
            counts = self.count[taken]
            gaps = np.flatnonzero(np.diff(taken) > 1)
            runs = zip(self.start[taken[np.append(0, gaps + 1)]].tolist(), (self.start + self.count)[taken[np.append(gaps, -1)]].tolist())
            met = np.concatenate([self.postings[x:y] for x, y in runs])
            kept += np.bincount(met, np.repeat(impact[taken] * _UNIT + 1, counts), n)
            a = b
            score = np.floor(kept / _UNIT)
            if b < len(order) and known > _NONE:
                # What has not been met adds no more than the impact that comes next.
                may = score + floor + impact[order[b]] * (dims - (kept - score * _UNIT)) >= known
                left = int(np.count_nonzero(may))
                if left * dims <= n * dims - done[b - 1]:
                    return self._rescore(best, row, q_id, q, np.flatnonzero(may))
        score = np.where(self.ids == q_id, -math.inf, score + floor)
        sure = np.partition(score, n - best.k)[n - best.k] - slack if n > best.k else -math.inf
        return self._rescore(best, row, q_id, q, np.flatnonzero(score >= max(sure, known)))

    def _rescore(self, best: Best, row: int, q_id: int, q: np.ndarray, who: np.ndarray) -> None:
        who = who[self.ids[who] != q_id]
        if len(who):
            best.merge(row, self.vectors[who] @ q, self.ids[who])


_ROW = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("dims", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("vectors", T.BinaryType())])


def _blocks(vectors: DataFrame, part: Column, id_col: str, vec_col: str, scale: float, rows: int) -> DataFrame:
    """(part, dims, ids, vectors): blocks of at most ``rows`` integer vectors of a part."""

    def run(batches):
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[tuple[int, int], int] = {}

        def block(key: tuple[int, int]) -> pa.RecordBatch:
            ids, values = (np.concatenate(x) for x in zip(*held.pop(key)))
            sizes.pop(key)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=_ROW.names)

        for batch in batches:
            parts = np.asarray(batch.column(0))
            for p in np.unique(parts).tolist():
                mine = batch.filter(pa.array(parts == p))
                for ids, values in integer_vectors(mine.column(1), mine.column(2), scale):
                    for a in range(0, len(ids), rows):
                        key = p, values.shape[1]
                        if sizes.get(key, 0) + len(ids[a : a + rows]) > rows:
                            yield block(key)
                        held.setdefault(key, []).append((ids[a : a + rows], values[a : a + rows]))
                        sizes[key] = sizes.get(key, 0) + len(ids[a : a + rows])
        for key in list(held):
            yield block(key)

    kept = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0))
    dealt = kept.select(part.cast("int").alias("part"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vector")).repartition("part").sortWithinPartitions("part")
    return written(dealt.mapInArrow(run, _ROW), "vector-blocks")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK, query_rows: int = QUERIES) -> DataFrame:
    """(query_id, rank from 1, id, score) of each query's ``k`` best among ``vectors``."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != math.inf))
    valid = queries.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite)
    asked = valid.groupBy(id_col).agg(F.min(vec_col).alias(vec_col))
    n_parts = max(1, -(-asked.count() // query_rows))
    n_blocks = max(1, -(-vectors.count() // block_rows))
    deal = lambda n: F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(n))
    query_blocks = _blocks(asked, deal(n_parts), id_col, vec_col, scale, query_rows)
    index = _blocks(vectors, deal(n_blocks), id_col, vec_col, scale, block_rows)
    groups = -(-n_blocks // GROUP)
    # Blocks of queries meet every group of the index, groups every block of queries.
    left = query_blocks.select(F.col("part").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(0).alias("kind"), F.lit(0).alias("block"), "dims", "ids", "vectors")
    right = index.select(F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("queries"), (F.col("part") % groups).alias("group"), F.lit(1).alias("kind"), F.col("part").alias("block"), "dims", "ids", "vectors")
    pairs = left.union(right).repartition(n_parts * groups, "queries", "group").sortWithinPartitions("queries", "group", "dims", "kind", "block")
    part = T.StructType([T.StructField("query_id", T.LongType()), T.StructField(id_col, T.LongType()), T.StructField("score", T.LongType())])

    def rows(batches) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, group, kind, _, dims, ids, data = (c[i].as_py() for c in batch.columns)
                yield (number, group, dims), kind, np.frombuffer(ids, np.int64), np.frombuffer(data, np.int64).reshape(-1, dims)

    def run(batches):
        now, q_ids, q, best, fresh = None, None, None, None, True

        def done():
            at, place = np.nonzero(best.scores > _NONE)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(best.ids[at, place]), pa.array(best.scores[at, place])], names=part.names)

        for key, kind, ids, values in rows(batches):
            if key != now:
                if best is not None:
                    yield from done()
                now, q_ids, q, best = key, None, None, None
            if kind == 0:  # a block of queries may come in several rows
                q_ids = ids if q_ids is None else np.append(q_ids, ids)
                q = values if q is None else np.concatenate([q, values])
                continue
            if q is None:
                continue  # no query of this length
            best = best or Best(len(q), k)
            block = IndexBlock(ids, values)
            for row in range(len(q)):
                block.search(best, row, q_ids[row], q[row])
        if best is not None:
            yield from done()

    found = pairs.mapInArrow(run, part)
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col))
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
