"""SimHash near-duplicates: fingerprints, exact links within a radius, components.

Links are found among distinct fingerprints only. ``keyed_by_blocks`` gives each
fingerprint of one word a key for every choice of ``blocks - radius`` of its ``blocks``
bit blocks: two fingerprints within the radius agree in at least one choice, so none is
lost. Fingerprints of a key are compared in tiles, sorted by population count, by numpy
exclusive-or and bit counts; a tile is dropped once the counts that follow differ by more
than the radius. Of the links of a key only those that join two groups are emitted, at
most one fewer than it has fingerprints.

Nulls: a null text has no words. A text without words has fingerprint zero and is linked
like any other. Repeated ids are one node; rows with a null id go by their fingerprint.
An empty table gives no rows.
"""

from __future__ import annotations

import os
import tempfile
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import text_key, written
from .tokens import in_slices

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
TILE = 2048


def shingles(text: str | None, size: int) -> list[bytes]:
    """Runs of ``size`` words; all words if there are fewer; none without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(w) for w in zip(*(words[i:] for i in range(size)))]


def majority_bits(digests: bytes, width: int) -> bytes:
    """``width`` bytes whose bits are set in over half of the ``width``-byte digests."""
    n = len(digests) // width
    if n == 0:
        return bytes(width)
    rows = np.frombuffer(digests, np.uint8).reshape(n, width)
    if n < 64:
        ones = np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    else:
        counts = np.bincount((rows + np.arange(0, 256 * width, 256, dtype=np.int64)).ravel(), minlength=256 * width)
        ones = (counts.reshape(width, 256) @ _BITS).ravel()
    return np.packbits(2 * ones > n).tobytes()


def _stir(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30)) ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint): 8 bytes, from the XXH64 (seed 42) of the shingles, repeats included."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fingerprint", T.BinaryType())])

    def run(batches):
        for batch in in_slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                digests = b"".join([xxhash.xxh64_digest(p, 42) for p in shingles(text, shingle_words)])
                out.append(majority_bits(digests, 8))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keyed_by_blocks(nodes: DataFrame, radius: int, blocks: int = 5) -> DataFrame:
    """(key, node, fingerprint): ``nodes`` with one-word fingerprints, by each choice of blocks."""
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in choice) for choice in combinations(range(blocks), blocks - radius)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    word = F.conv(F.hex("fingerprint"), 16, -10).cast("long")
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("__word").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(masks)])
    return nodes.withColumn("__word", word).select(F.explode(keys).alias("key"), "node", "fingerprint").select(F.xxhash64("key.choice", "key.bits").alias("key"), "node", "fingerprint")


class _Groups:
    """Union-find over the fingerprints of a key."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = self.parent[up]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True

    def joined(self, left: np.ndarray, left_nodes: np.ndarray, right: np.ndarray, right_nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
        """Links that join groups of two tiles; a pair of tiles in one group is dropped."""
        roots = [np.array([self.root(int(x)) for x in nodes]) for nodes in (left_nodes, right_nodes)]
        if (roots[0] == roots[0][0]).all() and (roots[1] == roots[0][0]).all():
            return []
        i, j = _close(left, right, radius)
        pairs = np.stack([roots[0][i], roots[1][j]], axis=1)[roots[0][i] != roots[1][j]]
        return [(x, y) for x, y in np.unique(pairs, axis=0).tolist() if self.join(x, y)]


def _close(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``left`` and ``right`` (words a column) within the radius."""
    apart = np.zeros((len(left), len(right)), np.uint16)
    for w in range(left.shape[1]):
        apart += np.bitwise_count(left[:, w][:, None] ^ right[:, w][None, :])
    return np.nonzero(apart <= radius)


def tiled_links(keyed: DataFrame, radius: int, words: int = 1) -> DataFrame:
    """Links (a, b) between nodes of one key within ``radius`` bits: of each key a spanning
    forest, so that components are whole. ``keyed``: key, node (long), fingerprint."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    ones = sum((F.bit_count(F.conv(F.hex(F.substring("fingerprint", 8 * i + 1, 8)), 16, -10).cast("long")) for i in range(words)), F.lit(0))
    shared = keyed.withColumn("ones", ones)
    ordered = shared.repartition("key").sortWithinPartitions("key", "ones", "fingerprint").select("key", "node", "fingerprint")

    def run(batches):
        key, tiles, groups = None, [], _Groups()
        for batch in in_slices(batches, TILE):
            if batch.num_rows == 0:
                continue
            keys = np.asarray(batch.column(0))
            nodes = np.asarray(batch.column(1))
            raw = batch.column(2).to_pylist()
            rows = np.frombuffer(b"".join(raw), ">u8").reshape(len(raw), -1).astype(np.uint64)
            ones = np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            out: list[tuple[int, int]] = []
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != key:
                    key, tiles, groups = keys[a], [], _Groups()
                elif b - a == 1 and not tiles:
                    continue
                own = (rows[a:b], nodes[a:b], ones[b - 1])
                tiles = [t for t in tiles if t[2] >= ones[a] - radius]  # what follows has as many ones or more
                tiles.append(own)
                for left, left_nodes, _ in tiles if b - a > 1 else tiles[:-1]:
                    out += groups.joined(left, left_nodes, own[0], own[1], radius)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=schema.names)

    return ordered.mapInArrow(run, schema)


def grouped(marked: DataFrame, links_of, id_col: str = "doc_id") -> DataFrame:
    """``marked`` (id, fingerprint; a written table) with ``component_id``: the smallest id
    that links reach, null where they reach null ids alone. ``links_of`` maps nodes (node,
    fingerprint) to links (a, b); a fingerprint of null ids only goes by its hash."""
    least = marked.groupBy("fingerprint").agg(F.min(id_col).alias("least"))
    nodes = written(least.withColumn("node", F.coalesce("least", F.xxhash64("fingerprint"))), "nodes")
    found = written(components(links_of(nodes.select("node", "fingerprint"))), "components")
    ids = found.join(nodes, "node").groupBy("component").agg(F.min("least").alias("reached"))
    reached = found.join(ids, "component").select("node", "component", "reached")
    named = nodes.join(reached, "node", "left").select("fingerprint", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("reached")).alias("component_id"))
    return marked.join(named, "fingerprint").select(id_col, "fingerprint", "component_id")


def simhash_components(docs: DataFrame, shingle_words: int = 3, radius: int = 2, blocks: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of 64-bit fingerprints linked within ``radius`` bits."""
    marked = written(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    return grouped(marked, lambda nodes: tiled_links(keyed_by_blocks(nodes, radius, blocks), radius), id_col)


#: Two texts are near copies from this similarity of their shingle sets on.
SIMILARITY = 0.8
#: Words of a near-copy fingerprint, and the bits that may differ for a pair to be looked
#: at. Where the similarity is 0.8 a bit differs with a probability of at most 0.1875 (four
#: of five shingles), so that one such pair in a million or fewer lies beyond the radius.
WORDS, RADIUS = 4, 80
#: Keys of a text and the least hashes in each: two texts of similarity 0.8 share none of
#: the keys once in a million.
BANDS, ROWS = 20, 3
#: Nodes of a component of candidates that a task takes together, besides the first ones.
BLOCK = 512
#: Bytes of shingle sets that a task holds in memory; more of them lie in a file.
HELD = 64 << 20


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles as XXH64 (seed 42), ascending."""
    digests = b"".join([xxhash.xxh64_digest(p, 42) for p in set(shingles(text, size))])
    return np.unique(np.frombuffer(digests, ">u8").astype(np.uint64))


def wide_fingerprints(docs: DataFrame, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, text_key, fingerprint, set_key, keys): ``WORDS`` words of SimHash
    over the distinct shingles, 128-bit hashes of the text and of the set of shingles, and
    ``BANDS`` keys from the least hashes under as many orders, which near copies share."""
    fields = [("text_key", T.BinaryType()), ("fingerprint", T.BinaryType()), ("set_key", T.BinaryType()), ("keys", T.ArrayType(T.LongType()))]
    taken = docs.select(id_col, *carried, text_key(text_col).alias("text_key"), text_col)
    schema = T.StructType([*taken.schema.fields[:-2], *[T.StructField(*f) for f in fields]])
    odd = np.random.default_rng(7).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)

    def run(batches):
        for batch in in_slices(batches):
            prints, sets, keys = [], [], []
            for text in batch.columns[-1].to_pylist():
                base = shingle_set(text, shingle_words)
                sets.append(xxhash.xxh3_128_digest(base.tobytes()))
                prints.append(b"".join(majority_bits(_stir(base, salt).astype(">u8").tobytes(), 8) for salt in range(1, WORDS + 1)))
                if len(base) == 0:
                    keys.append([0])
                    continue
                least = np.array([(base * o).min() for o in odd]).reshape(BANDS, ROWS)
                mixed = np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    mixed = _stir(mixed + least[:, r], 11 + r)
                keys.append(mixed.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints, pa.binary()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return taken.mapInArrow(run, schema)


class _Sets:
    """Shingle sets of a group, in memory up to ``HELD`` bytes and then in a file."""

    def __init__(self):
        self.ends, self.parts, self.file = [0], [], None

    def add(self, data: bytes) -> None:
        self.ends.append(self.ends[-1] + len(data))
        if self.file is None and self.ends[-1] > HELD:
            self.file = tempfile.TemporaryFile()
            self.file.writelines(self.parts)
            self.parts = []
        if self.file is None:
            self.parts.append(data)
        else:
            self.file.write(data)

    def get(self, i: int) -> np.ndarray:
        if self.file is None:
            return np.frombuffer(self.parts[i], np.uint64)
        return np.frombuffer(os.pread(self.file.fileno(), self.ends[i + 1] - self.ends[i], self.ends[i]), np.uint64)

    def sizes(self) -> np.ndarray:
        if self.file is not None:
            self.file.flush()
        return np.diff(self.ends) // 8


def _alike(sets: _Sets, sizes: np.ndarray, i: int, others: np.ndarray, least: float) -> np.ndarray:
    """Which of ``others`` have a set whose Jaccard similarity to that of ``i`` is ``least`` or more."""
    own = sets.get(i)
    parts = [sets.get(j) for j in others]
    flat = np.concatenate(parts)
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    both = np.add.reduceat(hit, np.append(0, np.cumsum([len(p) for p in parts])[:-1]), dtype=np.int64)
    return both >= least * (sizes[i] + sizes[others] - both) - 1e-9


def group_links(nodes: np.ndarray, rows: np.ndarray, sets: _Sets, radius: int, least: float, labels: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs within ``radius`` bits whose sets are ``least`` alike, as many as join
    what they can; nodes of one of the ``labels`` are joined already."""
    sizes = sets.sizes()
    order = np.argsort(sizes, kind="stable")
    group = np.unique(labels, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    for a in range(0, len(order), TILE):
        left = order[a : a + TILE]
        for b in range(a, len(order), TILE):
            right = order[b : b + TILE]
            if sizes[left[-1]] < least * sizes[right[0]] - 1e-9:
                break  # what follows is larger still
            if (group[left] == group[left[0]]).all() and (group[right] == group[left[0]]).all():
                continue
            at, to = _close(rows[left], rows[right], radius)
            cuts = np.searchsorted(at, np.arange(len(left) + 1))
            for k, i in enumerate(left):
                others = right[to[cuts[k] : cuts[k + 1]]]
                others = others[(sizes[others] >= sizes[i]) & (sizes[i] >= least * sizes[others] - 1e-9) & (sizes[i] > 0)]
                chunk = 1
                while len(others := others[group[others] != group[i]]):
                    tried, others = others[:chunk], others[chunk:]
                    for j in tried[_alike(sets, sizes, i, tried, least)]:
                        if group[j] != group[i]:
                            group[group == group[j]] = group[i]
                            out.append((int(nodes[i]), int(nodes[j])))
                    chunk = min(2 * chunk, 64)
    return out


def compared(docs: DataFrame, members: DataFrame, shingle_words: int, radius: int, least: float, text_col: str = "text") -> DataFrame:
    """Links (a, b) between nodes of one part, after a check of their shingle sets, as far as
    they join two labels. ``members``: text_key, node, fingerprint, label, parts (array)."""
    found = docs.select(text_key(text_col).alias("text_key"), text_col).join(members, "text_key").select("node", "fingerprint", "label", "parts", text_col)
    schema = T.StructType([*found.schema.fields[:-1], T.StructField("grams", T.BinaryType())])
    links = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def with_sets(batches):
        seen: set[int] = set()  # a text that occurs often goes once from each task
        for batch in in_slices(batches):
            fresh = []
            for i, node in enumerate(batch.column(0).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    fresh.append(i)
            batch = batch.take(pa.array(fresh, pa.int64()))
            grams = [shingle_set(text, shingle_words).tobytes() for text in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(grams, pa.binary())], names=schema.names)

    def run(batches):
        key, nodes, prints, labels, sets = None, [], [], [], _Sets()

        def done():
            if len(nodes) > 1:
                rows = np.frombuffer(b"".join(prints), ">u8").reshape(len(prints), -1).astype(np.uint64)
                out = group_links(np.array(nodes), rows, sets, radius, least, np.array(labels))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=links.names)

        for batch in in_slices(batches):
            for part, node, fingerprint, label, grams in zip(*[c.to_pylist() for c in batch.columns]):
                if part != key:
                    yield from done()
                    key, nodes, prints, labels, sets = part, [], [], [], _Sets()
                if not nodes or nodes[-1] != node:
                    nodes.append(node), prints.append(fingerprint), labels.append(label), sets.add(grams)
        yield from done()

    dealt = found.mapInArrow(with_sets, schema).select(F.explode("parts").alias("part"), "node", "fingerprint", "label", "grams")
    return dealt.repartition("part").sortWithinPartitions("part", "node").mapInArrow(run, links)


def alike_links(docs: DataFrame, near: DataFrame, shingle_words: int, radius: int, least: float, text_col: str = "text", block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join what is alike in one component of candidates, after a check of
    the shingle sets. ``near``: text_key, component, node, fingerprint.

    A component is dealt out in blocks of about ``block`` nodes; each meets itself and the
    first block, so that the rows grow with the nodes. Where that leaves more than one
    group, the nodes outside of the largest one meet all others, in pairs of tiles.
    """
    part = lambda *at: F.xxhash64("component", *at)
    in_tile = lambda n, size: F.pmod(F.xxhash64("node", F.lit(size)), F.ceil(F.col(n) / size))
    until = lambda n, of: F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / tile) - 1), of)
    sizes = near.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    dealt = near.join(sizes, "component").withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("at", in_tile("n", block))
    first = F.when(F.col("at") > 0, F.array(part("at"))).when(F.col("blocks") == 1, F.array(part(F.lit(1).cast("long"))))
    parts = F.coalesce(first, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest("blocks", F.lit(2)) - 1), lambda i: part(i)))
    found = written(compared(docs, dealt.select("text_key", "node", "fingerprint", F.col("node").alias("label"), parts.alias("parts")), shingle_words, radius, least, text_col), "links")
    crowded = dealt.where("blocks > 1").drop("n", "blocks", "at")
    if crowded.isEmpty():
        return found
    labels = components(found).toDF("node", "label")
    state = written(crowded.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labels")
    groups = state.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    apart = groups.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    apart = written(apart, "apart")
    if apart.isEmpty():
        return found
    inside = F.col("label") == F.col("main")
    left = state.join(apart, "component").withColumn("at", F.when(inside, in_tile("most", tile)).otherwise(in_tile("rest", tile)))
    with_main = lambda i, m: part(F.lit("main"), i, m)
    rest = F.filter(until("rest", lambda j: F.when(j != F.col("at"), part(F.least("at", j), F.greatest("at", j)))), lambda p: p.isNotNull())
    parts = F.when(inside, until("rest", lambda i: with_main(i, F.col("at")))).otherwise(F.concat(rest, until("most", lambda m: with_main(F.col("at"), m))))
    more = compared(docs, left.select("text_key", "node", "fingerprint", "label", parts.alias("parts")), shingle_words, radius, least, text_col)
    return found.union(more)


def near_copies(docs: DataFrame, shingle_words: int = 5, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, carried: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, fingerprint, component, component_id): groups of texts that links
    of similarity ``least`` or more on word shingles join; component_id is the smallest id.

    So wide a radius leaves no bit block that must agree, so the tiles are formed from keys
    of least hashes instead. They and the fingerprints only choose candidates: what is linked
    is decided by the shingle sets, component by component of the candidates.
    """
    marked = written(wide_fingerprints(docs, shingle_words, id_col, text_col, carried), "fingerprints")
    firsts = marked.groupBy("set_key").agg(F.min("text_key").alias("text_key"), F.first("fingerprint").alias("fingerprint"), F.first("keys").alias("keys"), F.min(id_col).alias("least"))
    nodes = written(firsts.withColumn("node", F.monotonically_increasing_id()), "nodes")
    near = components(tiled_links(nodes.select(F.explode("keys").alias("key"), "node", "fingerprint"), radius, WORDS))
    near = written(near.join(nodes.select("node", "text_key", "fingerprint"), "node"), "candidates")
    found = components(alike_links(docs, near, shingle_words, radius, least, text_col))
    named = nodes.join(found, "node", "left").select("set_key", "least", F.coalesce("component", "node").alias("component"))
    named = written(named, "components")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(ids, "component").drop("least"), "set_key").select(id_col, *carried, "fingerprint", "component", "component_id")
