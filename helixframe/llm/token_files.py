"""Token ids in binary files of fixed-width fields.

A file holds the documents of one range of ids in ascending order:

    blocks | doc ids | null flags | lengths | block offsets | footer

A block packs ``block_ids`` ids (the last one fewer), each in the least number of bits
that the vocabulary needs, lowest bit first, and starts at a whole byte whose place is
in the block offsets; so any range of ids is one seek and one vectorised unpacking.
The footer is ``FOOTER``: number of documents, of ids, bits an id, ids a block, where
the doc ids begin, and the magic bytes. All integers are little-endian.

Files are named by attempt and only those listed in the manifest, which Spark commits,
count: a task that is run again leaves an unlisted file and no doubled documents.

Nulls: a null text is empty; a null id sorts first. Repeated ids are written each, in
the order of their ids' bytes. An empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import _WRITTEN, rows_of, scratch_path, written
from .tokens import encoder, in_slices

MAGIC = b"HXTOKEN1"
FOOTER = struct.Struct("<QQIIQ8s")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def _open(path: str, mode: str):
    """A file of any store that Arrow knows, local ones included, by its whole URI."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if mode == "r":
        return store.open_input_file(at)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    return store.open_output_stream(at)


class TokenFileWriter:
    def __init__(self, path: str, width: int, block_ids: int):
        self.out, self.width, self.block_ids = _open(path, "w"), width, block_ids
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.offsets: list[int] = []
        self.rest = np.empty(0, np.uint32)
        self.at, self.total = 0, 0

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.width)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: list, lengths: list[int], ids: np.ndarray) -> None:
        self.ids += doc_ids
        self.lengths += lengths
        self.total += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // self.block_ids * self.block_ids
        for at in range(0, whole, self.block_ids):
            self._block(ids[at : at + self.block_ids])
        self.rest = ids[whole:].copy()

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        self.out.write(np.array([x or 0 for x in self.ids], "<i8").tobytes())
        self.out.write(np.array([x is None for x in self.ids], np.uint8).tobytes())
        self.out.write(np.array(self.lengths, "<i8").tobytes())
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(FOOTER.pack(len(self.ids), self.total, self.width, self.block_ids, self.at, MAGIC))
        self.out.close()


class TokenFile:
    """Random access to a token file."""

    def __init__(self, path: str):
        self.file = _open(path, "r")
        size = self.file.size()
        self.n_docs, self.n_ids, self.width, self.block_ids, at, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {path}")
        index = self.file.read_at(size - FOOTER.size - at, at)
        ids = np.frombuffer(index, "<i8", self.n_docs)
        null = np.frombuffer(index, np.uint8, self.n_docs, 8 * self.n_docs)
        self.doc_ids = [None if gone else int(x) for x, gone in zip(ids, null)]
        self.lengths = np.frombuffer(index, "<i8", self.n_docs, 9 * self.n_docs)
        blocks = -(-self.n_ids // self.block_ids)
        self.offsets = np.append(np.frombuffer(index, "<u8", blocks, 17 * self.n_docs), np.uint64(at)).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def range(self, first: int, end: int) -> np.ndarray:
        """Ids at places ``first`` to ``end`` of the file, by one read."""
        if end <= first:
            return np.empty(0, "<u4")
        a, b = first // self.block_ids, (end - 1) // self.block_ids
        data = self.file.read_at(int(self.offsets[b + 1] - self.offsets[a]), int(self.offsets[a]))
        out = []
        for k in range(a, b + 1):
            n = min(self.block_ids, self.n_ids - k * self.block_ids)
            out.append(unpack_bits(data[self.offsets[k] - self.offsets[a] : self.offsets[k + 1] - self.offsets[a]], self.width, n))
        return np.concatenate(out)[first - a * self.block_ids : end - a * self.block_ids]

    def document(self, nth: int) -> np.ndarray:
        return self.range(int(self.starts[nth]), int(self.starts[nth] + self.lengths[nth]))


#: Files at most; beyond, each holds more documents than ``docs_per_file``.
MOST_FILES = 1 << 16
MANIFEST = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", docs_per_file: int = 8192, block_ids: int = 65_536, plain: bool = True) -> DataFrame:
    """Write the files; returns the manifest (shard, path, n_docs, n_ids), a written table.

    Files hold ranges of ids whose bounds are quantiles of all ids, found in a scan of
    that column alone. Texts are encoded where they are read and only narrow ids travel.
    ``plain``: see ``ChunkEncoder``.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    _WRITTEN.append(folder)
    files = max(1, min(-(-rows_of(docs) // docs_per_file), MOST_FILES))
    marks = [i / files for i in range(1, files)]
    bounds = docs.agg(F.percentile_approx(id_col, F.array(*map(F.lit, marks)), 10 * files + 1000).alias("b")).first()["b"] if marks else []
    bounds = np.array(sorted(set(bounds or [])), np.int64)
    width_of = lambda enc: bits_for(enc.vocab_size)
    encoded = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("narrow", T.BinaryType())])

    def encode(batches):
        enc, end = encoder(tokenizer, plain=plain), np.array([end_id], "<u4").tobytes()
        kind = "<u2" if width_of(enc) <= 16 else "<u4"
        for batch in in_slices(batches):
            ids = batch.column(0).cast(pa.int64())
            data = [np.frombuffer(enc.encode(x or "") + end, "<u4").astype(kind).tobytes() for x in batch.column(1).to_pylist()]
            size = int(kind[-1])
            where = np.searchsorted(bounds, np.asarray(ids.fill_null(0)), side="right").astype(np.int32)
            where[np.asarray(ids.is_null())] = 0
            yield pa.RecordBatch.from_arrays([ids, pa.array(where), pa.array([len(x) // size for x in data], pa.int64()), pa.array(data, pa.binary())], names=encoded.names)

    def write(batches):
        enc = encoder(tokenizer, plain=plain)
        kind, width = "<u2" if width_of(enc) <= 16 else "<u4", width_of(enc)
        shard = out = path = None
        done: list[tuple] = []

        def close():
            if out is not None:
                out.close()
                done.append((shard, path, len(out.ids), out.total))

        for batch in in_slices(batches):
            doc_ids, shards, lengths, data = (batch.column(i).to_pylist() for i in range(4))
            at = 0
            while at < len(shards):
                to = at
                while to < len(shards) and shards[to] == shards[at]:
                    to += 1
                if shards[at] != shard:
                    close()
                    shard = shards[at]
                    path = f"{folder}/part-{shard:06d}-{uuid.uuid4().hex}.tok"
                    out = TokenFileWriter(path, width, block_ids)
                out.add(doc_ids[at:to], lengths[at:to], np.frombuffer(b"".join(data[at:to]), kind).astype(np.uint32))
                at = to
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done) if done else [[]] * 4, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=MANIFEST.names)

    dealt = docs.select(id_col, text_col).mapInArrow(encode, encoded).repartitionById(len(bounds) + 1, F.col("shard"))
    return written(dealt.sortWithinPartitions("shard", F.col(id_col).asc_nulls_first(), "narrow").mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame, id_col: str = "doc_id", ids_a_read: int = 1 << 21) -> DataFrame:
    """Documents of the listed files: id, start (ids before it over all files), n_tokens, ids."""
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])
    return files.repartitionById(max(1, manifest.agg(F.max("shard")).first()[0] or 0) + 1, F.col("shard")).mapInArrow(_reader(schema, ids_a_read, True), schema)


def read_token_digests(manifest: DataFrame, id_col: str = "doc_id", ids_a_read: int = 1 << 21) -> DataFrame:
    """As ``read_token_files`` with the CRC-32 of the ids in their place."""
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return files.repartitionById(max(1, manifest.agg(F.max("shard")).first()[0] or 0) + 1, F.col("shard")).mapInArrow(_reader(schema, ids_a_read, False), schema)


def _reader(schema: T.StructType, ids_a_read: int, with_ids: bool):
    def read(batches):
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                file = TokenFile(path)
                ends = file.starts + file.lengths
                at = 0
                while at < file.n_docs:
                    to = max(at + 1, int(np.searchsorted(ends, file.starts[at] + ids_a_read, side="right")))
                    base = int(file.starts[at])
                    data = file.range(base, int(ends[to - 1])).tobytes()
                    cuts = [data[4 * (int(a) - base) : 4 * (int(b) - base)] for a, b in zip(file.starts[at:to], ends[at:to])]
                    out = [pa.array(file.doc_ids[at:to], pa.int64()), pa.array(file.starts[at:to] + before), pa.array(file.lengths[at:to].astype(np.int64)), pa.array([zlib.crc32(x) for x in cuts], pa.int64())]
                    yield pa.RecordBatch.from_arrays(out + [pa.array(cuts, pa.binary())] * with_ids, names=schema.names)
                    at = to

    return read
