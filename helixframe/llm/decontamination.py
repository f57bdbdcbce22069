"""Benchmark decontamination by winnowing.

Of every ``window - kgram + 1`` consecutive k-grams of words the one with the least hash
is kept, on either side; two texts that share ``window`` words share a kept k-gram, so
no shared span of that length is missed. Items with fewer words than ``window`` are one
window of all their words, and their hash is their fingerprint among all runs of as many
words.

Fingerprints of documents and items are joined by hash. Before, documents drop those that
can't match by a bit map of all item fingerprints, of ``BITS`` bits however many there
are; it may let some through that match nothing, and the join drops these. What is left
are pairs of a document and a block of items. They are dealt out by block and salt, and
around each shared fingerprint the document's windows are compared with the block's, first
by hash and then word by word: hits extend over all windows that occur.

Only documents with a fingerprint in the bit map are written with their texts, and move.
Nulls: a null text has no words; an item without an id or words matches nothing; a null
document id stays. Repeated items count once, repeated documents each give a row. Other
columns are not looked at. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .tokens import in_slices

#: Bytes of words after A-Z became a-z: digits, letters and all bytes above 0x7F.
_WORD = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the map of item fingerprints, and of one of its pages; words that a worker keeps.
BITS, PAGE, KEPT_WORDS = 1 << 26, 1 << 15, 1 << 18


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` word ids."""
    count = len(ids) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    word = _stir(ids.astype(np.uint64) + _MIX)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x100000001B3) + word[i : i + count]
    return _stir(out)


def winnow(hashes: np.ndarray, span: int) -> np.ndarray:
    """Places of the least hash of each ``span`` consecutive ones (the last of equals)."""
    if len(hashes) == 0:
        return np.empty(0, np.int64)
    if len(hashes) <= span:
        return np.flatnonzero(hashes == hashes.min())[-1:]
    rows = np.lib.stride_tricks.sliding_window_view(hashes, span)
    return np.unique(np.arange(len(rows)) + span - 1 - rows[:, ::-1].argmin(axis=1))


class ItemBlock:
    """A block of items: vocabulary, kept k-grams and windows."""

    def __init__(self, items: list[tuple], window: int, kgram: int):
        self.window, self.kgram = window, kgram
        self.vocab: dict[bytes, int] = {}
        self.names: list = []
        kept: list[np.ndarray] = []
        windows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for name, words in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int64)
            n = min(window, len(ids))
            rows = np.lib.stride_tricks.sliding_window_view(ids, n)
            windows.setdefault(n, []).append((rows, np.full(len(rows), len(self.names))))
            self.names.append(name)
            if n == window:
                hashes = gram_hashes(ids, kgram)
                kept.append(hashes[winnow(hashes, window - kgram + 1)])
        self.kept = np.unique(np.concatenate(kept)) if kept else np.empty(0, np.uint64)
        self.by_length: dict[int, tuple] = {}
        for n, parts in windows.items():
            rows, owner = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            texts, first, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
            which = which.ravel()
            order = np.lexsort((owner, which))
            hashes = gram_hashes(texts.ravel(), n)[::n]
            by_hash = np.argsort(hashes, kind="stable")
            self.by_length[n] = (hashes[by_hash], by_hash, texts, owner[order], np.searchsorted(which[order], np.arange(len(texts) + 1)))

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Whether each word lies in an occurring window, and the items that occur."""
        ids = np.array(list(map(self.vocab.get, words, [0] * len(words))), np.int64)
        marks = np.zeros(len(ids) + 1, np.int64)
        found: set = set()
        for n in self.by_length:
            if len(ids) < n:
                continue
            if n == self.window:
                hashes = gram_hashes(ids, self.kgram)
                places = winnow(hashes, n - self.kgram + 1)
                places = places[_among(hashes[places], self.kept)]
                starts = (places[:, None] - np.arange(n - self.kgram + 1)).ravel()
                starts = np.unique(starts[(starts >= 0) & (starts <= len(ids) - n)])
            else:
                known = np.append(0, np.cumsum(ids > 0))
                starts = np.flatnonzero(known[n:] - known[:-n] == n)
            self._compare(ids, starts, n, marks, found)
        return np.cumsum(marks[:-1]) > 0, found

    def _compare(self, ids, starts, n, marks, found) -> None:
        if len(starts) == 0:
            return
        hashes, by_hash, texts, owner, cuts = self.by_length[n]
        rows = ids[starts[:, None] + np.arange(n)]
        own = gram_hashes(rows.ravel(), n)[::n]
        at = np.searchsorted(hashes, own)
        live = np.flatnonzero(at < len(hashes))
        hit = np.full(len(starts), -1)
        while len(live):  # more than one step only where two windows share a hash
            live = live[(at[live] < len(hashes))]
            live = live[hashes[at[live]] == own[live]]
            same = (texts[by_hash[at[live]]] == rows[live]).all(axis=1)
            hit[live[same]] = by_hash[at[live[same]]]
            live = live[~same]
            at[live] += 1
        ok = hit >= 0
        np.add.at(marks, starts[ok], 1)
        np.add.at(marks, starts[ok] + n, -1)
        for k in np.unique(hit[ok]):
            found.update(self.names[i] for i in owner[cuts[k] : cuts[k + 1]])


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if len(table) == 0:
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


_HASHES: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word; a worker keeps the words that it has met."""
    got = list(map(_HASHES.get, words))
    if None in got:
        if len(_HASHES) > KEPT_WORDS:
            _HASHES.clear()
        for i, known in enumerate(got):
            if known is None:
                got[i] = _HASHES[words[i]] = xxhash.xxh64_intdigest(words[i])
    return np.array(got, np.uint64)


def fingerprints(words: np.ndarray, window: int, kgram: int, short: list[int]) -> np.ndarray:
    """The different fingerprints of a text's word hashes: kept k-grams, and all runs of the lengths ``short``."""
    parts = [_run_hashes(words, n) for n in short]
    if len(words) >= window:
        hashes = gram_hashes(words, kgram)
        parts.append(hashes[winnow(hashes, window - kgram + 1)])
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    return _stir(gram_hashes(words, n) + np.uint64(n))


def _item_fingerprints(items: DataFrame, window: int, kgram: int) -> DataFrame:
    """(hash, block, n): ``items`` is block, name, text; n is the number of words of a short item, else 0."""
    schema = T.StructType([T.StructField("hash", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("n", T.IntegerType())])

    def run(batches):
        for batch in in_slices(batches):
            parts, blocks, sizes = [np.empty(0, np.uint64)], [], []
            for block, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                words = word_hashes(words_of(text))
                n = len(words) if len(words) < window else 0
                if len(words):
                    parts.append(fingerprints(words, window, kgram, [n] if n else []))
                    blocks += [block] * len(parts[-1])
                    sizes += [n] * len(parts[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(blocks, pa.int32()), pa.array(sizes, pa.int32())], names=schema.names)

    return written(items.mapInArrow(run, schema).distinct(), "item-fingerprints")


def _bit_map(hashes: DataFrame) -> np.ndarray:
    """``BITS`` bits, of which those that the hashes end in are set; its pages are made apart."""
    schema = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("bits", T.BinaryType())])
    bit = F.col("hash").bitwiseAND(F.lit(BITS - 1))
    rows = hashes.select(F.floor(bit / PAGE).cast("int").alias("page"), (bit % PAGE).cast("int").alias("bit")).distinct()

    def run(batches):
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            page, bits = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for p in np.unique(page).tolist():
                pages.setdefault(p, np.zeros(PAGE, bool))[bits[page == p]] = True
        for p, bits in pages.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=schema.names)

    out = np.zeros(BITS // 8, np.uint8)
    for page, bits in rows.repartition("page").mapInArrow(run, schema).toLocalIterator():
        out[page * PAGE // 8 : (page + 1) * PAGE // 8] |= np.frombuffer(bits, np.uint8)
    return out


def _spans_of(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


_SPAN = T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])
_ARROW_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def contamination(docs: DataFrame, items: DataFrame, window: int = 8, kgram: int = 4, least_items: int = 2, block_words: int = 500_000, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", salt_rows: int = 2000) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, item_ids (strings, sorted), spans (hit runs
    of words, [from, to)), contaminated (at least ``least_items`` items). ``salt_rows``: pairs
    of documents and one block of items that a task compares, or about as many."""
    spark = docs.sparkSession
    named = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("name"), F.col(item_text).alias("text")).distinct()
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // (6 * block_words)))
    blocks = written(named.select(F.pmod(F.xxhash64("name", "text"), F.lit(n_blocks)).cast("int").alias("block"), "name", "text"), "items")
    prints = _item_fingerprints(blocks, window, kgram)
    short = sorted(r[0] for r in prints.where("n > 0").select("n").distinct().collect())  # under ``window`` numbers
    bits = spark.sparkContext.broadcast(_bit_map(prints))  # BITS bits
    seen = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("text", T.StringType())])

    def scan(batches):
        table, number = bits.value, TaskContext.get().partitionId() << 33
        for batch in in_slices(batches):
            n_words, hashes, texts = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                n_words.append(len(words))
                own = fingerprints(word_hashes(words), window, kgram, short) if words else np.empty(0, np.uint64)
                bit = own & np.uint64(BITS - 1)
                own = own[(table[(bit >> np.uint64(3)).astype(np.int64)] << (bit & np.uint64(7)).astype(np.uint8)) & 0x80 != 0]
                hashes.append(own.view(np.int64) if len(own) else None)
                texts.append(text if len(own) else None)
            rows = np.arange(number, number + batch.num_rows)
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0), pa.array(n_words, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(texts, pa.string())], names=seen.names)

    table = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, seen), "document-fingerprints")
    shared = table.where("hashes IS NOT NULL").select("row", F.explode("hashes").alias("hash")).join(prints.select("hash", "block").distinct(), "hash").select("row", "block").distinct()
    shared = written(shared, "shared-fingerprints")
    salts = max(1, -(-shared.count() // (salt_rows * n_blocks)))
    pairs = shared.join(table.where("hashes IS NOT NULL").select("row", "text"), "row")
    left = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("row"), "name", "text")
    right = pairs.select("block", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "row", F.lit(None).cast("string").alias("name"), "text")
    dealt = left.union(right).repartition(salts * n_blocks, "block", "salt").sortWithinPartitions("block", "salt", "kind")
    hit = T.StructType([T.StructField("row", T.LongType()), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(_SPAN))])

    def compare(batches):
        now, own, block = None, [], None
        for batch in in_slices(batches):
            rows, names, spans = [], [], []
            for number, salt, kind, row, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (number, salt) != now:
                    now, own, block = (number, salt), [], None
                words = words_of(text)
                if kind == 0:
                    if words:
                        own.append((name, words))
                    continue
                block = block or ItemBlock(own, window, kgram)
                mask, found = block.hits(words)
                if found:
                    rows.append(row), names.append(sorted(found)), spans.append(_spans_of(mask))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, _ARROW_SPANS)], names=hit.names)

    found = dealt.mapInArrow(compare, hit).groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("item_ids"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("__spans"))
    zero = F.lit([]).cast(T.ArrayType(_SPAN))

    def joined(acc, x):
        last = F.element_at(acc, -1)
        meets = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["first"])
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(meets, longer).otherwise(F.concat(acc, F.array(x)))

    # The spans of one block are apart already.
    spans = F.coalesce(F.aggregate("__spans", zero, joined) if n_blocks > 1 else F.col("__spans"), zero)
    out = table.select("row", "id", "n_words").join(found, "row", "left").withColumn("item_ids", F.coalesce("item_ids", F.lit([]).cast("array<string>"))).withColumn("spans", spans)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])
    n_items = F.size("item_ids").cast("long")
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), "item_ids", "spans", (n_items >= least_items).alias("contaminated"))
