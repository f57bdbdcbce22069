"""Best-fit-decreasing packing of token sequences, exact over the whole corpus.

Best fit treats pieces of one length alike, so it needs only how many pieces there are
of each length, at most ``capacity`` numbers whatever the corpus. The driver packs those
counts, many bins at a step, with a segment tree over remaining capacities; what comes
out is a list of runs: the pieces of length L with ranks lo to hi go to bins from b on,
k in each, from offset o on. Its size is bounded by ``capacity`` alone. Executors then
rank the pieces of each length and look up their bins.

Nulls: a null text is empty and gives one piece, the end id. Repeated rows are packed
each for itself. An empty table gives no rows. Columns of ``docs`` other than the two
that are named play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import rows_of, written
from .tokens import encoder, in_slices


class TightestBin:
    """A segment tree over remaining capacities 1..capacity: which of them open bins have."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def put(self, remaining: int, has: bool) -> None:
        at = remaining + self.leaves
        self.any[at] = has
        at >>= 1
        while at:
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]
            at >>= 1

    def first(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that an open bin has."""
        at = least + self.leaves
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_runs(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Runs (length, lo, hi, k, bin, offset) of best-fit decreasing, and the number of bins."""
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    tree, runs, bins = TightestBin(capacity), [], 0

    def put(first: int, many: int, remaining: int) -> None:
        if many and remaining:
            open_bins[remaining].append((first, many))
            tree.put(remaining, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.first(length)
            if room is None:
                room, first, many = capacity, bins, -(-left // (capacity // length))
                bins += many
            else:
                first, many = open_bins[room].pop()
                if not open_bins[room]:
                    tree.put(room, False)
            per = room // length
            full = min(many, left // per)
            if full:
                runs.append((length, rank, rank + full * per, per, first, capacity - room))
                put(first, full, room - per * length)
                rank, left = rank + full * per, left - full * per
            if full < many and left:  # fewer than a bin holds
                runs.append((length, rank, rank + left, left, first + full, capacity - room))
                put(first + full, 1, room - left * length)
                full, left = full + 1, 0
            put(first + full, many - full, room)
    return runs, bins


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", plain: bool = True, keep: int = 1_600_000) -> DataFrame:
    """Token ids of each text and the end id, cut into pieces of at most ``capacity``.

    All pieces of a longer document but its first hold ``capacity`` ids. Columns: the id,
    piece, start, length, ids (little-endian unsigned 32-bit). ``plain`` and ``keep``: see ``ChunkEncoder``.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def cut(batches):
        enc, end = encoder(tokenizer, keep, plain), np.array([end_id], "<u4").tobytes()
        for batch in in_slices(batches):
            rows, piece, start, length, ids = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                all_ids = enc.encode(text or "") + end
                n, at, k = len(all_ids) // 4, 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if k == 0 else capacity
                    rows.append(row), piece.append(k), start.append(at), length.append(size)
                    ids.append(all_ids[4 * at : 4 * (at + size)])
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def pack_best_fit(pieces: DataFrame, capacity: int, length_col: str = "length", rows_per_block: int = 8_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; lengths must be 1 to ``capacity``.
    Columns of these names that ``pieces`` has are replaced.

    ``pieces`` is read twice, so it should be a written table. Ranks within a length come
    from the counts of hashed blocks and a rank within the block, so that a length that
    most pieces share (the full ones) is spread like any other. The counts grow with the
    pieces, so they are joined by the partitioning that ranking needs, not broadcast.
    """
    spark = pieces.sparkSession
    pieces = pieces.select(*[F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset")])
    blocks = max(1, -(-rows_of(pieces) // rows_per_block))
    own = [c for c in pieces.columns]
    keyed = pieces.withColumn("__block", F.pmod(F.xxhash64(*[c for c, t in pieces.dtypes if not t.startswith("map")]), F.lit(blocks)))
    per_block = written(keyed.groupBy(F.col(length_col).alias("__length"), F.col("__block").alias("__in")).agg(F.count(F.lit(1)).alias("__n")), "pack-counts")
    counts = {int(r[0]): int(r[1]) for r in per_block.groupBy("__length").agg(F.sum("__n")).collect()}  # at most `capacity` rows
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"a piece must have 1 to {capacity} tokens")
    runs, _ = best_fit_runs(counts, capacity)
    before = per_block.withColumn("__before", F.sum("__n").over(Window.partitionBy("__length").orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy(length_col, "__block").orderBy(*[F.col(c) for c, t in pieces.dtypes if not t.startswith("map")])
    ranked = (
        keyed.withColumn("__row", F.row_number().over(within))
        .join(before.hint("merge"), (F.col(length_col) == F.col("__length")) & (F.col("__block") == F.col("__in")))
        .withColumn("__rank", F.coalesce("__before", F.lit(0)) + F.col("__row") - 1)
        .select(*own, "__rank")
    )
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at_length = own.index(length_col)

    def place(batches):
        runs = shared.value
        step = np.int64(1) << 44
        keys = runs[:, 0] * step + runs[:, 1]
        for batch in batches:
            length = np.asarray(batch.column(at_length)).astype(np.int64)
            rank = np.asarray(batch.column(len(own))).astype(np.int64)
            run = runs[np.searchsorted(keys, length * step + rank, side="right") - 1]
            nth = rank - run[:, 1]
            placed = [pa.array(run[:, 4] + nth // run[:, 3]), pa.array(run[:, 5] + nth % run[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *placed], names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack; the ids of each piece come with its place."""
    return pack_best_fit(written(tokenized_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_pieces, ids in order of offset."""
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select("sequence_id", F.size("parts").alias("n_pieces"), F.expr("aggregate(parts.ids, X'', (a, b) -> concat(a, b))").alias("ids"))
