"""Removal of byte strings that also start in a document with a smaller id.

Documents are gathered in slices of a few megabytes, written once. Every ``length``-byte
window has a minimizer: the least hash of its ``GRAM``-byte strings. Equal windows have
equal minimizers, so the corpus falls into buckets by minimizer that are worked on apart,
each of bounded size however large the corpus. Three rounds follow, each a message from
slices to buckets or back:

1. a slice names each of its minimizers once; a bucket answers by one bit which of them
   lie in several documents (or slices), and by another which lie in very many slices;
2. a slice sends the stretches (consecutive windows with one minimizer) of the shared
   minimizers, equal ones once, with their smallest document. A minimizer of very many
   slices is split by the bytes around it first, so that no bucket gets all of them;
3. the bucket answers by one bit a window whether it starts in a smaller document than
   the slice's smallest, and the slice cuts its documents.

So a passage that a third of all documents share is one record a slice, not one a
document, and rows and bytes grow with the corpus: a slice sends a bucket one row, and no
more rows than it has minimizers.

Within a bucket, equal stretches are held once, with their smallest document. Windows
whose minimizer of ``LONG`` bytes no other stretch has are settled. Over blocks of the
rest the Burrows-Wheeler transform is built from suffixes ordered by their first 64
bytes, and intervals are extended backward breadth first: step l finds the places where
neighbouring suffixes share just l bytes. It stops at ``length``; what has no such place
between shares ``length`` bytes or more, and the smallest document of each such run
decides. Stretches of one minimizer that would fill a block many times are split by longer
minimizers (up to two bytes under ``length``, where few different windows are left).

Windows lie within a document and are judged on the input. Nulls: a null text is empty
and comes back with no bytes; a null id is smaller than all others. Rows with one id do
not remove each other's strings. A very long text is a slice by itself. Other columns are
not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from zstandard import ZstdCompressor, ZstdDecompressor

from .shared import written

GRAM, LONG, ORDER = 20, 40, 64
#: Windows a stretch and bytes a block at most; bytes of text that a slice holds, that a
#: bucket stands for and that a task reads; window places looked at together.
STRETCH, BLOCK, SLICE, BUCKET, TASK, CHUNK = 128, 1 << 18, 4 << 20, 16 << 20, 16 << 20, 1 << 15
#: Slices that hold a minimizer from which on it is split, and tasks over buckets at most.
HOT, TASKS = 4096, 50_000
_NULL_ID = -(2**63)
_TOP = np.iinfo(np.int64).max


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on, as a number."""
    return np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).copy().view("<u8").ravel()


def _hash(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    x = first * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x += second
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x += third
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(28)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes (from 16 to 24, or 8 more for each round) from each place of ``data`` on."""
    count = len(data) - gram + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    eight = _words(data)
    h = _hash(eight[:count], eight[8 : 8 + count], eight[gram - 8 : gram - 8 + count])
    for at in range(16, gram - 8, 8):
        h = _hash(h, eight[at : at + count], eight[at : at + count])
    return h


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` consecutive hashes."""
    width = 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (span - width)], h[span - width :]) if width < span else h


def window_minima(data: np.ndarray, length: int, gram: int = GRAM) -> np.ndarray:
    """The minimizer of the window at each place of ``data`` (bytes)."""
    if len(data) < length:
        return np.empty(0, np.uint64)
    return _least(gram_hashes(data, gram), length - gram + 1)


def equal_runs(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, run): places of ``text`` ordered by what follows them (as a ring), and the
    number of the run of places that share their first ``length`` bytes (at most 64)."""
    n = len(text)
    ring = np.concatenate([text, text[np.arange(8) % n]])
    key = _words(ring)[:n].byteswap()
    order = np.argsort(key)
    known = 8
    while True:
        line = key[order]
        fresh = np.concatenate([[0], line[1:] != line[:-1]]).cumsum()
        if known >= ORDER or fresh[-1] == n - 1:
            break
        rank = np.empty(n, np.uint64)
        rank[order] = fresh
        key = (rank << np.uint64(32)) | np.roll(rank, -(known % n))
        order = np.argsort(key)
        known *= 2
    before = text[order - 1]  # the transform
    back = np.empty(n, np.int64)
    back[np.argsort(before, kind="stable")] = np.arange(n)
    first = text[order]
    cut = np.zeros(n + 1, bool)  # places whose common prefix with the one before is known
    edge = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    cut[edge] = cut[n] = True
    low, high = edge, np.append(edge[1:], n)
    owner = np.full(n, -1, np.int64)
    for _ in range(1, length):
        if len(low) == 0:
            break
        sizes = high - low
        total = int(sizes.sum())
        source = np.repeat(np.arange(len(low)), sizes)
        places = np.arange(total) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        to = back[places]
        if total * 8 > n:
            owner.fill(-1)
            owner[to] = source
            change = np.flatnonzero((owner[1:] != owner[:-1]) | (first[1:] != first[:-1])) + 1
            starts = np.append(0, change)
            ends = np.append(change, n)
            live = owner[starts] >= 0
            starts, ends = starts[live], ends[live]
        else:
            by = np.argsort(to)
            to, source = to[by], source[by]
            change = np.flatnonzero((source[1:] != source[:-1]) | (np.diff(to) != 1) | (first[to[1:]] != first[to[:-1]])) + 1
            starts, ends = to[np.append(0, change)], to[np.append(change, total) - 1] + 1
        new = ~cut[ends]
        low, high = starts[new], ends[new]
        cut[high] = True
    return order, np.cumsum(cut[:n]) - 1


def _flat(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each of ``starts`` on, as many as ``counts`` says, in a row."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def smallest_owners(data: np.ndarray, starts: np.ndarray, windows: np.ndarray, owners: np.ndarray, length: int) -> np.ndarray:
    """For each window of each stretch (a place in ``data`` and a number of windows), the
    smallest owner among all equal windows."""
    sizes = windows + length
    text = data[np.minimum(_flat(starts, sizes), len(data) - 1)]
    begin = np.cumsum(sizes) - sizes
    text[begin + sizes - 1] = 0  # between stretches
    text = np.concatenate([text, np.zeros(ORDER, np.uint8)])
    order, run = equal_runs(text, length)
    at = _flat(begin, windows)
    owner = np.full(len(text), _TOP)
    owner[at] = np.repeat(owners, windows)
    least = np.minimum.reduceat(owner[order], np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])))
    out = np.empty(len(text), np.int64)
    out[order] = least[run]
    return out[at]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a value of ``keys`` differs from the one before."""
    fresh = np.zeros(len(keys[0]), bool)
    fresh[:1] = True
    for key in keys:
        fresh[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(fresh)


def settled(data: np.ndarray, starts: np.ndarray, windows: np.ndarray, keys: np.ndarray, owners: np.ndarray, length: int) -> np.ndarray:
    """For each window of some different stretches, in order, the smallest owner among all
    equal windows; stretches that share no key share no window."""
    out = np.repeat(owners, windows)
    by = np.argsort(keys)
    cuts = _runs(keys[by])
    many = np.repeat(np.diff(np.append(cuts, len(by))) > 1, np.diff(np.append(cuts, len(by))))
    todo = [(by[many], LONG)]
    base = np.cumsum(windows) - windows
    while todo:
        which, gram = todo.pop()
        if len(which) == 0:
            continue
        # The windows of these stretches, with the minimizers of longer strings.
        sizes = windows[which] + length - 1
        text = data[_flat(starts[which], sizes)]
        at = _flat(np.cumsum(sizes) - sizes, windows[which])
        least = np.concatenate([window_minima(text[a : a + CHUNK + length - 1], length, gram) for a in range(0, len(text) - length + 1, CHUNK)])[at]
        place, of = _flat(base[which], windows[which]), np.repeat(np.arange(len(which)), windows[which])
        cuts = _runs(least, of)
        line = least[cuts]
        order = np.argsort(line)
        edge = _runs(line[order])
        counts = np.diff(np.append(edge, len(order)))
        live = np.zeros(len(cuts), bool)
        live[order] = np.repeat(counts > 1, counts)
        run = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(of))))
        live = live[run]
        split = gram > LONG
        begin = _runs(live, of, *([run] if split else []))
        n = np.diff(np.append(begin, len(of)))[live[begin]]
        begin = begin[live[begin]]
        piece = of[begin]
        key = least[begin] if split else keys[which][piece]
        byte = starts[which][piece] + place[begin] - base[which][piece]
        if split:
            order = np.argsort(key, kind="stable")
            key, begin, n, piece, byte = key[order], begin[order], n[order], piece[order], byte[order]
        edge = np.append(_runs(key), len(key))
        a = 0
        weight = np.append(0, np.cumsum(n + length))
        while a < len(edge) - 1:  # blocks end where the key changes
            b = max(a + 1, int(np.searchsorted(weight[edge], weight[edge[a]] + BLOCK, "right")) - 1)
            lo, hi = edge[a], edge[b]
            if weight[hi] - weight[lo] > 4 * BLOCK and gram < length - 2:
                todo.append((np.unique(which[piece[lo:hi]]), length - 2))
            else:
                least_owner = smallest_owners(data, byte[lo:hi], n[lo:hi], owners[which][piece[lo:hi]], length)
                to = _flat(place[begin[lo:hi]], n[lo:hi])
                out[to] = np.minimum(out[to], least_owner)
            a = b
    return out


def stretches_of(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, gram): where the stretches of some documents (in a row, ended at ``ends``)
    start, and how far on the minimizer lies."""
    begins = np.append(0, ends[:-1])
    span = length - GRAM + 1
    found, offsets = [], []
    for a in range(0, len(data) - length + 1, CHUNK):
        part = data[a : a + CHUNK + length - 1]
        h = gram_hashes(part)
        least = _least(h, span)
        fresh = np.ones(len(least), bool)
        fresh[1:] = least[1:] != least[:-1]
        # A document's first window is fresh; windows over an end don't count.
        lo, hi = np.searchsorted(ends, [a, a + len(least) + length], "right")
        inside = np.ones(len(least), bool)
        for k in range(lo, min(hi, len(ends) - 1) + 1):
            inside[max(0, ends[k] - length + 1 - a) : max(0, ends[k] - a)] = False
            if 0 <= begins[k] - a < len(fresh):
                fresh[begins[k] - a] = True
        at = np.flatnonzero(fresh & inside)
        runs = np.diff(np.append(at, len(least)))
        long = np.flatnonzero(runs > STRETCH)
        if len(long):
            pieces = -(-runs // STRETCH)
            at = np.repeat(at, pieces) + STRETCH * _flat(np.zeros(len(at), np.int64), pieces)
            at = at[inside[at]]
        found.append(a + at)
        offsets.append(np.argmin(np.lib.stride_tricks.sliding_window_view(h, span)[at], axis=1).astype(np.uint8) if len(at) else np.empty(0, np.uint8))
    return (np.concatenate(found), np.concatenate(offsets)) if found else (np.empty(0, np.int64), np.empty(0, np.uint8))


class Slice:
    """A slice's documents, its stretches and its part of the messages."""

    def __init__(self, row: dict, buckets: int, length: int):
        self.number, self.length, self.buckets = row["slice"], length, buckets
        self.ids = np.frombuffer(row["ids"], "<i8")
        sizes = np.frombuffer(row["sizes"], "<i8")
        self.ends = np.cumsum(sizes)
        self.sizes = sizes
        self.bytes = ZstdDecompressor().decompress(row["packed"], max_output_size=int(sizes.sum()) + 1) if sizes.sum() else b""
        self.data = np.frombuffer(self.bytes, np.uint8)
        self.start = np.flatnonzero(np.unpackbits(np.frombuffer(row["marks"], np.uint8), count=len(self.data))) if len(self.data) else np.empty(0, np.int64)
        gram = self.start + np.frombuffer(row["grams"], np.uint8)
        self.row = np.searchsorted(self.ends, self.start, "right")
        stop = np.minimum(np.append(self.start[1:], len(self.data)), self.ends[self.row] - length + 1)
        self.windows = np.minimum(stop - self.start, STRETCH)
        if len(gram):
            at = [_gathered(self.data, gram + k) for k in (0, 8, GRAM - 8)]
            least = _hash(*at)
        else:
            least = np.empty(0, np.uint64)
        self.key = _keys(least, buckets)
        self.order = np.argsort(self.key, kind="stable")
        self.cuts = _runs(self.key[self.order])
        self.names = self.key[self.order][self.cuts]

    def asked(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, minimizers, bits: those in several of the slice's documents)."""
        if len(self.names) == 0:
            return
        ids = self.ids[self.row[self.order]]
        many = np.minimum.reduceat(ids, self.cuts) < np.maximum.reduceat(ids, self.cuts)
        for bucket, a, b in _by_bucket(self.names):
            yield bucket, self.names[a:b].astype(np.uint32).tobytes(), np.packbits(many[a:b]).tobytes()

    def shared(self, answers: list[tuple[int, bytes, bytes]]) -> None:
        """What is sent, after the buckets' answers (bucket, shared bits, hot bits)."""
        live, hot = np.zeros(len(self.names), bool), np.zeros(len(self.names), bool)
        place = {bucket: (a, b) for bucket, a, b in _by_bucket(self.names)}
        for bucket, bits, hots in answers:
            a, b = place[bucket]
            live[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
            if hots:
                hot[a:b] = np.unpackbits(np.frombuffer(hots, np.uint8), count=b - a)
        counts = np.diff(np.append(self.cuts, len(self.order)))
        taken = self.order[np.repeat(live & ~hot, counts)]
        start, windows, key, row = self.start[taken], self.windows[taken], self.key[taken], self.row[taken]
        if hot.any():
            split = [self._split(i) for i in self.order[np.repeat(live & hot, counts)].tolist()]
            more = [np.concatenate(x) for x in zip(*split)]
            start, windows, key, row = (np.concatenate(x) for x in zip((start, windows, key, row), more))
            by = np.argsort(key, kind="stable")
            start, windows, key, row = start[by], windows[by], key[by], row[by]
        # Equal stretches are one piece, with the smallest document.
        names: dict[tuple[int, bytes], int] = {}
        text, length = self.bytes, self.length
        self.at, self.n, self.doc = start, windows, row
        self.piece = np.array([names.setdefault((k, text[s : s + w + length - 1]), len(names)) for s, w, k in zip(start.tolist(), windows.tolist(), key.tolist())], np.int64)
        self.pieces = list(names)
        self.least = np.full(len(names), _TOP)
        np.minimum.at(self.least, self.piece, self.ids[row])
        self.piece_key = np.array([k for k, _ in self.pieces], np.uint64)
        self.piece_n = np.array([len(p) - length + 1 for _, p in self.pieces], np.int64)

    def _split(self, i: int) -> tuple[np.ndarray, ...]:
        """The parts (start, windows, key, row) of a stretch of a hot minimizer: their
        windows hold the same bytes around it, all but seven of a window at least."""
        length, start, n = self.length, int(self.start[i]), int(self.windows[i])
        h = gram_hashes(self.data[start : start + n + length - 1])
        off = np.argmin(np.lib.stride_tricks.sliding_window_view(h, length - GRAM + 1)[:n], axis=1)
        place, part = off + np.arange(n), off // 8
        cuts = _runs(place, part)
        keys = []
        for c in cuts.tolist():
            lo = 8 * int(part[c])
            p = start + int(place[c])
            keys.append(xxhash.xxh64_intdigest(self.bytes[p - lo : p - min(lo + 7, length - GRAM) + length], int(part[c]) + 1))
        n_of = np.diff(np.append(cuts, n))
        return start + cuts, n_of, _keys(np.array(keys, np.uint64), self.buckets), np.full(len(cuts), self.row[i])

    def sent(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, records, bytes) of the pieces."""
        tight = ZstdCompressor(level=1)
        for bucket, a, b in _by_bucket(self.piece_key):
            record = self.piece_key[a:b].astype(np.uint32).tobytes() + self.piece_n[a:b].astype(np.uint8).tobytes() + self.least[a:b].tobytes()
            yield bucket, tight.compress(record), tight.compress(b"".join([p for _, p in self.pieces[a:b]]))

    def gone(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """Which bytes are to go, after the buckets' answers (bucket, window bits)."""
        bits = np.zeros(int(self.piece_n.sum()), bool)
        base = np.cumsum(self.piece_n) - self.piece_n
        place = {bucket: (a, b) for bucket, a, b in _by_bucket(self.piece_key)}
        for bucket, blob in answers:
            a, b = place[bucket]
            n = int(self.piece_n[a:b].sum())
            bits[base[a] : base[a] + n] = np.unpackbits(np.frombuffer(blob, np.uint8), count=n)
        go = bits[_flat(base[self.piece], self.n)] | np.repeat(self.ids[self.doc] > self.least[self.piece], self.n)
        at = _flat(self.at, self.n)[go]
        step = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(step, at, 1)
        np.add.at(step, at + self.length, -1)
        return np.cumsum(step[:-1]) > 0


def _gathered(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return data[at[:, None] + np.arange(8)].view("<u8").ravel()


def _keys(least: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 32 | the rest of the minimizer, of which 32 bits are kept: where two
    minimizers share them they are taken for one, and both are looked at."""
    least = least.astype(np.uint64)
    return ((least % np.uint64(buckets)) << np.uint64(32)) | ((least // np.uint64(buckets)) & np.uint64(0xFFFFFFFF))


def _by_bucket(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending keys."""
    if len(keys) == 0:
        return []
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    cuts = _runs(bucket)
    return list(zip(bucket[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(keys)]))


_TO_BUCKET = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("slice", T.LongType()), T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
_FROM_BUCKET = T.StructType([T.StructField("slice", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.BinaryType: pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[type(f.dataType)]) for x, f in zip(zip(*rows), schema.fields)], names=schema.names)


def _in_batches(rows: Iterable[tuple], schema: T.StructType, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= most:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(bucket, [(slice, a, b)]) of rows in order of bucket."""
    now, rows = None, []
    for batch in batches:
        for bucket, *rest in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if bucket != now:
                if rows:
                    yield now, rows
                now, rows = bucket, []
            rows.append(tuple(rest))
    if rows:
        yield now, rows


def _asked_answers(bucket: int, rows: list[tuple], most: int) -> Iterator[tuple]:
    """(slice, bucket, bits of shared minimizers, bits of hot ones)."""
    names = np.concatenate([np.frombuffer(a, np.uint32) for _, a, _ in rows])
    sizes = np.array([len(a) // 4 for _, a, _ in rows])
    many = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for (_, _, b), n in zip(rows, sizes.tolist())])
    order = np.argsort(names)
    cuts = _runs(names[order])
    counts = np.diff(np.append(cuts, len(order)))
    shared, hot = np.empty(len(order), bool), np.empty(len(order), bool)
    shared[order] = np.repeat((counts > 1) | np.logical_or.reduceat(many[order], cuts), counts)
    hot[order] = np.repeat(counts > most, counts)
    ends = np.cumsum(sizes)
    for (number, _, _), n, end in zip(rows, sizes.tolist(), ends.tolist()):
        mine = shared[end - n : end]
        if mine.any():
            hots = hot[end - n : end]
            yield number, bucket, np.packbits(mine).tobytes(), np.packbits(hots).tobytes() if hots.any() else b""


def _sent_answers(bucket: int, rows: Iterable[tuple], length: int) -> Iterator[tuple]:
    """(slice, bucket, bits of windows that start in a smaller document, nothing)."""
    loose = ZstdDecompressor()
    names: dict[tuple[int, bytes], int] = {}
    seen: list[tuple[int, np.ndarray, np.ndarray]] = []
    for number, records, data in rows:
        records, data = loose.decompress(records), loose.decompress(data)
        n = len(records) // 13
        keys, windows, least = np.frombuffer(records, np.uint32, n), np.frombuffer(records, np.uint8, n, 4 * n), np.frombuffer(records, "<i8", n, 5 * n)
        ends = np.cumsum(windows.astype(np.int64) + length - 1).tolist()
        which = np.array([names.setdefault((k, data[a:b]), len(names)) for k, a, b in zip(keys.tolist(), [0, *ends[:-1]], ends)], np.int64)
        seen.append((number, which, least))
    owners = np.full(len(names), _TOP)
    for _, which, least in seen:
        owners[which] = np.minimum(owners[which], least)  # a slice has a piece once
    windows = np.array([len(p) - length + 1 for _, p in names], np.int64)
    data = np.frombuffer(b"".join([p for _, p in names]), np.uint8)
    keys = np.array([k for k, _ in names], np.uint32)
    names.clear()
    sizes = windows + length - 1
    go = settled(data, np.cumsum(sizes) - sizes, windows, keys, owners, length) < np.repeat(owners, windows)
    base = np.cumsum(windows) - windows
    for number, which, least in seen:
        later = least > owners[which]
        n = windows[which]
        bits = go[_flat(base[which], n)] | np.repeat(later, n)
        if bits.any():
            yield number, bucket, np.packbits(bits).tobytes(), b""


def _sliced(docs: DataFrame, length: int, id_col: str, text_col: str, most: int) -> DataFrame:
    """The written table of slices."""
    own = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("slice", T.LongType()), T.StructField("own", T.ArrayType(own)), *[T.StructField(n, T.BinaryType()) for n in ("ids", "sizes", "packed", "marks", "grams")]])

    def run(batches):
        part, number, tight = TaskContext.get().partitionId(), 0, ZstdCompressor(level=3)
        owns, ids, texts, size = [], [], [], 0

        def done():
            sizes = np.array([len(t) for t in texts], np.int64)
            data = b"".join(texts)
            flat = np.frombuffer(data, np.uint8)
            start, grams = stretches_of(flat, np.cumsum(sizes), length)
            marks = np.zeros(len(flat), bool)
            marks[start] = True
            blobs = [np.array(ids, "<i8").tobytes(), sizes.astype("<i8").tobytes(), tight.compress(data), np.packbits(marks).tobytes(), grams.tobytes()]
            first = pa.array([(part << 32) | number], pa.int64())
            held = pa.concat_arrays(owns)
            return pa.RecordBatch.from_arrays([first, pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), *[pa.array([b], pa.binary()) for b in blobs]], names=schema.names)

        for batch in batches:
            column = batch.column(2)
            long_ids = batch.column(1).to_pylist()
            a = 0
            for b in range(batch.num_rows):
                text = (column[b].as_py() or "").encode("utf-8", "surrogatepass")
                texts.append(text)
                ids.append(long_ids[b])
                size += len(text)
                if size >= most:
                    owns.append(batch.column(0).slice(a, b + 1 - a))
                    yield done()
                    owns, ids, texts, size, number, a = [], [], [], 0, number + 1, b + 1
            if a < batch.num_rows:
                owns.append(batch.column(0).slice(a))
        if ids:
            yield done()

    keyed = docs.select(F.col(id_col).alias("own"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    return written(keyed.mapInArrow(run, schema), "slices")


def _from_buckets(to: DataFrame, buckets: int, answers) -> DataFrame:
    """The answers of all buckets; ``answers`` maps (bucket, rows) to rows."""

    def run(batches):
        yield from _in_batches((row for bucket, rows in _grouped(batches) for row in answers(bucket, rows)), _FROM_BUCKET)

    tasks = min(buckets, TASKS)
    dealt = to.repartitionById(tasks, F.col("bucket") % tasks)
    return (dealt if buckets == tasks else dealt.sortWithinPartitions("bucket")).mapInArrow(run, _FROM_BUCKET)


def _with_answers(slices: DataFrame, tasks: int, *rounds: DataFrame) -> DataFrame:
    """The slices, each followed by the buckets' answers to it, round by round."""
    none = [F.lit(None).cast("binary").alias(n) for n in ("a", "b")]
    out = slices.select("slice", F.lit(0).alias("round"), F.lit(0).alias("bucket"), *none, *slices.columns[1:])
    for k, answers in enumerate(rounds, 1):
        rest = [F.lit(None).cast(slices.schema[n].dataType).alias(n) for n in slices.columns[1:]]
        out = out.union(answers.select("slice", F.lit(k), "bucket", "a", "b", *rest))
    return out.repartition(tasks, "slice").sortWithinPartitions("slice", "round", "bucket")


def _slices_of(batches: Iterable[pa.RecordBatch], buckets: int, length: int) -> Iterator[tuple[Slice, pa.Array, dict[int, list]]]:
    """(slice, its documents' ids, answers by round)."""
    now = None
    for batch in batches:
        numbers, rounds, of, a, b = (batch.column(k).to_pylist() for k in range(5))
        for i in range(batch.num_rows):
            if rounds[i] == 0:
                if now is not None:
                    yield Slice(now[0], buckets, length), now[1], now[2]
                row = {"slice": numbers[i], **{n: batch.column(n)[i].as_py() for n in ("ids", "sizes", "packed", "marks", "grams")}}
                now = row, batch.column("own")[i].values, {1: [], 2: []}
            else:
                now[2][rounds[i]].append((of[i], a[i], b[i]))
    if now is not None:
        yield Slice(now[0], buckets, length), now[1], now[2]


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE, bucket_bytes: int = BUCKET, hot_slices: int = HOT) -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_removed, n_spans, spans (array of from, to), kept (bytes).

    ``length``: from 42 (a minimizer of ``LONG`` bytes must fit) to 64 (suffixes are ordered by
    as many). The sizes bound what a task holds; results don't depend on them.
    """
    if not LONG + 2 <= length <= ORDER:
        raise ValueError(f"length must be from {LONG + 2} to {ORDER}")
    slices = _sliced(docs, length, id_col, text_col, slice_bytes)
    size = slices.agg(F.sum(F.octet_length("marks"))).first()[0] or 0
    buckets, tasks = max(1, -(-8 * size // bucket_bytes)), max(1, -(-8 * size // TASK))

    def ask(batches):
        def rows():
            for batch in batches:
                for row in batch.to_pylist():
                    for bucket, names, many in Slice(row, buckets, length).asked():
                        yield bucket, row["slice"], names, many

        yield from _in_batches(rows(), _TO_BUCKET)

    def send(batches):
        def rows():
            for part, _, answers in _slices_of(batches, buckets, length):
                if answers[1]:
                    part.shared(answers[1])
                    for bucket, records, data in part.sent():
                        yield bucket, part.number, records, data

        yield from _in_batches(rows(), _TO_BUCKET)

    pair = T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("spans", T.ArrayType(pair)), T.StructField("kept", T.BinaryType())])

    def cut(batches):
        for part, own, answers in _slices_of(batches, buckets, length):
            part.shared(answers[1])
            gone = part.gone([(k, bits) for k, bits, _ in answers[2]])
            ends, begins = part.ends, part.ends - part.sizes
            total = np.append(0, np.cumsum(gone))
            removed = total[ends] - total[begins]
            edge = np.zeros(len(gone) + 1, bool)  # where a document ends or the next begins
            edge[ends] = True
            first = np.flatnonzero(gone & (edge[:-1] | ~np.append(False, gone[:-1]))) if len(gone) else np.empty(0, np.int64)
            end = np.flatnonzero(gone & (edge[1:] | ~np.append(gone[1:], False))) + 1 if len(gone) else np.empty(0, np.int64)
            row = np.searchsorted(ends, first, "right")
            spans = np.append(0, np.cumsum(np.bincount(row, minlength=len(ends))))
            kept = part.data[~gone].tobytes()
            stops = np.append(0, np.cumsum(part.sizes - removed))
            pairs = pa.StructArray.from_arrays([pa.array(first - begins[row]), pa.array(end - begins[row])], names=["first", "end"])
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(kept)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([own, pa.array(part.sizes), pa.array(removed), pa.array(np.diff(spans)), pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pairs), texts], names=schema.names)

    asked = slices.select("slice", "ids", "sizes", "packed", "marks", "grams").mapInArrow(ask, _TO_BUCKET)
    shared = written(_from_buckets(asked, buckets, lambda bucket, rows: _asked_answers(bucket, rows, hot_slices)), "shared-minimizers")
    sent = _with_answers(slices.drop("own").withColumn("own", F.lit(None).cast(slices.schema["own"].dataType)), tasks, shared).mapInArrow(send, _TO_BUCKET)
    smaller = written(_from_buckets(sent, buckets, lambda bucket, rows: _sent_answers(bucket, rows, length)), "repeated")
    return _with_answers(slices, tasks, shared, smaller).mapInArrow(cut, schema)
