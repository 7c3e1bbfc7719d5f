"""Removal of repeated substrings by sorting suffixes bucket by bucket, with a difference-cover sample.

A difference cover D modulo v meets every pair of positions: some shift below v takes both into D. So two equal
windows of ``length`` bytes share an equal string of length - v + 1 bytes at cover positions: hashes of the cover's
strings, compared over all blocks of texts, tell where windows can repeat at all. They only leave out what cannot repeat.

Suffixes in the places left are sorted (up to ``length`` bytes), one bucket at a time, the bucket being that of the window's
smallest 16-byte string, its anchor. In a bucket the cover is laid from the anchors, and the suffixes at cover positions are
ranked first. All suffixes are then sorted by a head of a few words, and long ties by the rank of the next cover position:
equal windows have their anchor, and so the cover, in the same place. A rank stands for the remaining bytes whatever their
number, as it is cut by the bytes that neighbours in the sample's order share. So equality is that of bytes throughout.

Within a block of texts equal windows meet first, so a bucket gets each window once a block. Memory is bounded by a block
and a bucket, whose number grows with the input. Texts move as compressed blocks.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweft.llm.common import hashed_spans, materialize, mix64, prefix_hashes, span_hashes, text_bytes
from lumenweft.session import ship

#: Bytes of text in a block and of hashing at a time; bytes of the string that names a bucket.
BLOCK_BYTES, PART_BYTES, ANCHOR = 5 << 19, 1 << 19, 16
#: Text bytes a bucket of suffixes, a bucket of hashes (4 bytes for each of the cover's strings), and a task, unless these
#: would be too many; a task takes its blocks or buckets one at a time.
BUCKET_BYTES, RANK_BYTES, TASK_BYTES, MOST_TASKS = 4 << 20, 32 << 20, 8 << 20, 100_000
LEAST_BUCKETS = 32
LAST = np.int64((1 << 63) - 1)


def difference_cover(v: int) -> np.ndarray:
    """Residues modulo v whose differences are all residues; powers of two where they do, else chosen greedily."""
    powers, x = set(), 1
    while x not in powers:
        powers.add(x)
        x = x * 2 % v
    if len({(a - b) % v for a in powers for b in powers}) == v:
        return np.array(sorted(powers))
    cover, met = [0], {0}
    while len(met) < v:
        best = max((c for c in range(v) if c not in cover), key=lambda c: (len(({(c - a) % v for a in cover} | {(a - c) % v for a in cover}) - met), -c))
        met |= {(best - a) % v for a in cover} | {(a - best) % v for a in cover}
        cover.append(best)
    return np.array(sorted(cover))


def period_for(length: int) -> int:
    """About three quarters of the window, from the moduli with small covers (powers of two)."""
    return next((v for v in (73, 31, 15, 7, 3) if v <= 3 * length // 4), 1)


# --- packing --------------------------------------------------------------------------------------------------------


#: By level; under -1 what decompresses.
_compressors: dict = {}


def compress(data: bytes, level: int) -> bytes:
    """With one compressor a process and level: its tables take longer to make than a small packet to compress."""
    if level not in _compressors:
        _compressors[level] = zstandard.ZstdCompressor(level=level)
    return _compressors[level].compress(data)


def decompress(data: bytes) -> bytes:
    if -1 not in _compressors:
        _compressors[-1] = zstandard.ZstdDecompressor()
    return _compressors[-1].decompress(data)


def pack(*arrays: np.ndarray, level: int = 5) -> bytes:
    parts = [struct.pack("<q", len(arrays))]
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        parts += [struct.pack("<2sq", a.dtype.str[1:].encode(), len(raw)), raw]
    return compress(b"".join(parts), level)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = decompress(data)
    (n,), at, out = struct.unpack_from("<q", raw), 8, []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sq", raw, at)
        at += 10
        out.append(np.frombuffer(raw[at : at + size], kind.decode()))
        at += size
    return out


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as differences, byte plane by byte plane."""
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers in a sorted array."""
    if not len(values):
        return values, values
    cut = np.flatnonzero(np.diff(values) != 1)
    return values[np.append(0, cut + 1)], values[np.append(cut, len(values) - 1)]


# --- blocks ---------------------------------------------------------------------------------------------------------

BLOCK = "block long, n_bytes long, payload binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in compressed blocks, sorted by doc_id (null last) within a block."""
    block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    held: list[tuple[int, bytes]] = []
    size = 0

    def emit() -> pa.RecordBatch:
        held.sort(key=lambda x: x[0])
        payload = pack(np.array([x[0] for x in held], np.int64), np.array([len(x[1]) for x in held], np.int64), np.frombuffer(b"".join(x[1] for x in held), np.uint8))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], ["block", "n_bytes", "payload"])

    for batch in batches:
        ids = batch.column(0).fill_null(int(LAST)).to_pylist()
        offsets, data = text_bytes(batch.column(1))
        for k, doc in enumerate(ids):
            held.append((doc, data[offsets[k] : offsets[k + 1]].tobytes()))
            size += len(held[-1][1])
            if size >= BLOCK_BYTES:
                yield emit()
                block, held, size = block + 1, [], 0
    if held:
        yield emit()


def parts(lengths: np.ndarray, most: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of documents with about ``most`` bytes (one document at least)."""
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        base = ends[first] - lengths[first]
        end = max(first + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield first, end
        first = end


def cover_positions(lengths: np.ndarray, cover: np.ndarray, v: int, size: int) -> np.ndarray:
    """Positions, in the documents laid end to end, of the cover's suffixes of ``size`` bytes at least."""
    longest = int(lengths.max()) if len(lengths) else 0
    grid = (np.arange(0, longest + v, v)[:, None] + cover).ravel()
    counts = np.searchsorted(grid, lengths - size, side="right")
    starts = np.cumsum(lengths) - lengths
    return np.concatenate([grid[:n] + s for n, s in zip(counts.tolist(), starts.tolist(), strict=True)] or [grid[:0]])


class Plan:
    """Window length, cover and numbers of buckets (powers of two) and tasks."""

    def __init__(self, length: int, n_bytes: int):
        self.length, self.v = length, period_for(length)
        self.cover = difference_cover(self.v)
        self.size = length - self.v + 1
        self.anchor = min(ANCHOR, length)
        self.buckets, self.rank_buckets = (1 << max(LEAST_BUCKETS - 1, n_bytes // b).bit_length() for b in (BUCKET_BYTES, RANK_BYTES))
        self.bits = 32 + self.rank_buckets.bit_length() - 1
        self.tasks = min(MOST_TASKS, max(LEAST_BUCKETS, n_bytes // TASK_BYTES))
        # From a window whose anchor is at ``a``: bytes to the next cover position, as the cover is laid from the anchor.
        residues = set((self.cover % self.v).tolist())
        self.to_cover = np.array([next(d for d in range(self.v) if (d - a) % self.v in residues) for a in range(length - self.anchor + 1)])
        self.head_words = max(1, -(-int(self.to_cover.max()) // 8))

    def ranks(self, lengths: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and hash of every cover suffix of a block; the hash's upper bits name its bucket."""
        positions, hashes, at = [], [], 0
        for a, b in parts(lengths):
            size = int(lengths[a:b].sum())
            own = cover_positions(lengths[a:b], self.cover, self.v, self.size)
            hashes.append(span_hashes(prefix_hashes(data[at : at + size]), own, own + self.size) >> np.uint64(64 - self.bits))
            positions.append(own + at)
            at += size
        return np.concatenate(positions or [np.zeros(0, np.int64)]), np.concatenate(hashes or [np.zeros(0, np.uint64)])


def _cover_suffixes(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, lengths, data = unpack(payload.as_py())
                found = np.unique(plan.ranks(lengths, data)[1])
                cuts = np.searchsorted(found, np.arange(plan.rank_buckets + 1, dtype=np.uint64) << np.uint64(32))
                some = np.flatnonzero(np.diff(cuts))
                packed = [pack_sorted(found[cuts[r] : cuts[r + 1]].astype(np.uint32)) for r in some.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([block] * len(some), pa.int64()), pa.array(packed, pa.binary())], ["bucket", "block", "payload"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by their first column, gathered by it."""
    key, held = None, []
    for batch in batches:
        columns = [batch.column(k) for k in range(width)]
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in columns)
            if row[0] != key and held:
                yield key, held
                held = []
            key = row[0]
            held.append(row)
    if held:
        yield key, held


def _shared_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket and block one bit a rank: whether another block has it."""
    for bucket, rows in _grouped(batches, 3):
        lists = [unpack_sorted(r[2]) for r in rows]
        every = np.sort(np.concatenate(lists))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for (_, block, _), values in zip(rows, lists, strict=True):
            at = np.minimum(np.searchsorted(twice, values), max(0, len(twice) - 1))
            bits = twice[at] == values if len(twice) else np.zeros(len(values), bool)
            if bits.any():
                out.append((block, bucket, compress(np.packbits(bits).tobytes(), 1)))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["block", "bucket", "payload"])


def sliding_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] for every i with a whole window."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(table, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def first_of_equal(values: np.ndarray) -> np.ndarray:
    """For each value the first place that has the same."""
    order = np.argsort(values)
    new = np.append(True, values[order[1:]] != values[order[:-1]])[: len(values)]
    out = np.empty(len(values), np.int64)
    if len(values):
        out[order] = np.minimum.reduceat(order, np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def _mark(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions below ``size`` that lie in one of the spans (ends excluded)."""
    steps = np.bincount(starts, minlength=size + 1)[: size + 1] - np.bincount(ends, minlength=size + 1)[: size + 1]
    return np.cumsum(steps)[:size] > 0


def _suffixes_of_block(plan: Plan, payload: bytes, bits: dict[int, bytes]) -> tuple[list[tuple[int, bytes]], bytes]:
    """(bucket, packet) of windows that may repeat elsewhere; the spans of windows that repeat within the block."""
    ids, lengths, data = unpack(payload)
    positions, ranks = plan.ranks(lengths, data)
    found, inverse, counts = np.unique(ranks, return_inverse=True, return_counts=True)
    elsewhere = np.zeros(len(found), bool)
    cuts = np.searchsorted(found, np.arange(plan.rank_buckets + 1, dtype=np.uint64) << np.uint64(32))
    for bucket, packed in bits.items():
        a, b = cuts[bucket], cuts[bucket + 1]
        elsewhere[a:b] = np.unpackbits(np.frombuffer(decompress(packed), np.uint8))[: b - a]
    shared = (counts > 1)[inverse] | elsewhere[inverse]
    positions, outer = positions[shared], elsewhere[inverse][shared]
    del ranks, found, inverse, counts, shared
    if not len(positions):
        return [], pack(*runs(positions))
    # Only documents with a shared rank are looked at; they are laid end to end anew.
    home_begins = np.cumsum(lengths) - lengths
    doc = np.searchsorted(home_begins + lengths, positions, side="right")
    touched = np.unique(doc)
    data = np.concatenate([data[home_begins[d] : home_begins[d] + lengths[d]] for d in touched.tolist()])
    ids, lengths, home_begins = ids[touched], lengths[touched], home_begins[touched]
    ends = np.cumsum(lengths)
    begins = ends - lengths
    doc = np.searchsorted(touched, doc)
    positions += (begins - home_begins)[doc]
    length, width = plan.length, plan.length - plan.anchor + 1
    starts_, hashes_, anchors_, keys_, outer_ = [], [], [], [], []
    at = 0
    for a, b in parts(lengths):
        size = int(lengths[a:b].sum())
        low, high = np.searchsorted(positions, (at, at + size))
        own, mine = positions[low:high] - at, doc[low:high]
        first, last = np.maximum(own - plan.v + 1, begins[mine] - at), np.minimum(own, ends[mine] - at - length)
        fits = first <= last
        if fits.any():
            where = np.flatnonzero(_mark(size, first[fits], last[fits] + 1))
            far = outer[low:high] & fits
            beyond = _mark(size, first[far], last[far] + 1)
            prefix = prefix_hashes(data[at : at + size])
            short = np.arange(size - plan.anchor + 1)
            strings = span_hashes(prefix, short, short + plan.anchor)
            place = np.uint64((1 << 30) - 1)
            least = sliding_minima((strings & ~place) | short.astype(np.uint64), width)[where]
            anchor = (least & place).astype(np.int64)
            starts_.append(where + at)
            hashes_.append(span_hashes(prefix, where, where + length))
            anchors_.append(anchor + at)
            # Smallest hashes crowd at the low end; mixed again they fill all buckets alike.
            keys_.append(mix64(strings[anchor] + np.uint64(1)))
            outer_.append(beyond[where])
        at += size
    if not starts_:
        return [], pack(*runs(positions[:0]))
    hashes = np.concatenate(hashes_)
    del hashes_
    starts, anchors, keys, far = (np.concatenate(x) for x in (starts_, anchors_, keys_, outer_))
    leader = first_of_equal(hashes)
    del hashes
    # Windows with the hash of an earlier one: consecutive ones with consecutive leaders are compared as one string.
    again = leader != np.arange(len(leader))
    some = np.flatnonzero(again)
    if len(some):
        new = np.append(True, (np.diff(starts[some]) != 1) | (np.diff(starts[leader[some]]) != 1))
        heads = np.flatnonzero(new)
        same = same_bytes(data, starts[some[heads]], starts[leader[some[heads]]], np.diff(np.append(heads, len(some))) + length - 1)
        other = some[~same[np.cumsum(new) - 1]]
        again[other], far[other] = False, True
    del leader

    def home(x: np.ndarray) -> np.ndarray:
        return x + (home_begins - begins)[np.searchsorted(ends, x, side="right")]

    # A run of repeats that goes on into the next document is two runs at home.
    local = pack(*runs(home(starts[again])))
    sent = ~again & far
    s, p, k = starts[sent], anchors[sent], keys[sent]
    packets: list[tuple[int, bytes]] = []
    if len(s):
        new = np.append(True, (np.diff(s) != 1) | (np.diff(p) != 0))
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(s)))
        s, k = s[heads], k[heads]
        anchored = (p[heads] - s).astype(np.uint16)
        bucket = (k >> np.uint64(64 - (plan.buckets.bit_length() - 1))).astype(np.int64)
        mine = np.searchsorted(ends, s, side="right")
        by = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[by], np.arange(plan.buckets + 1))
        for r in np.flatnonzero(np.diff(edges)).tolist():
            own = by[edges[r] : edges[r + 1]]
            texts = b"".join(data[x : x + n + length - 1].tobytes() for x, n in zip(s[own].tolist(), sizes[own].tolist(), strict=True))
            packets.append((r, pack(ids[mine[own]], home(s[own]), s[own] - begins[mine[own]], sizes[own].astype(np.int32), anchored[own], np.frombuffer(texts, np.uint8))))
    return packets, local


#: Packets of windows are of kind 0, spans of repeats (first starts, last starts) of kind 1.
SORTED = "bucket long, kind int, block long, payload binary"


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (("bucket", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("payload", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def _suffixes(plan: Plan):
    """Rows (block, bucket, payload) sorted by block; under bucket -1 the block itself, after it come the others' bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _grouped(batches, 3):
            bits = {bucket: payload for _, bucket, payload in rows if bucket >= 0}
            for _, bucket, payload in rows:
                if bucket < 0:
                    packets, local = _suffixes_of_block(plan, payload, bits)
                    yield _rows([(r, 0, block, p) for r, p in packets] + [(block % plan.buckets, 1, block, local)])

    return run


#: The first k bytes of a big-endian word of eight.
FIRST_BYTES = np.array([((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(9)], np.uint64)
_BYTE_STEPS = np.array([1 << 8 * k for k in range(1, 8)], np.uint64)


def big_endian_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number, zeros beyond the end."""
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def sort_strings(word: Callable[[int, np.ndarray], np.ndarray], n: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of n strings by their words 0 to depth - 1 (``word(j, which)``); for each place in it, how many bytes its string
    has in common with the one before, and whether they differ at all. Only ties are looked at again."""
    order, shared, differs = np.arange(n), np.full(n, 8 * depth), np.zeros(n, bool)
    differs[:1], shared[:1] = True, 0
    tied = order.copy() if n > 1 else order[:0]
    for j in range(depth):
        if not len(tied):
            break
        key = word(j, order[tied])
        by = np.argsort(key)
        number = np.empty(len(by), np.int64)
        number[by] = np.cumsum(np.append(False, key[by[1:]] != key[by[:-1]]))
        place = np.argsort(np.cumsum(differs[tied]) * (int(number.max()) + 1) + number)
        order[tied], key = order[tied[place]], key[place]
        new = np.flatnonzero(~differs[tied][1:] & (key[1:] != key[:-1])) + 1
        differs[tied[new]] = True
        shared[tied[new]] = 8 * j + 7 - np.searchsorted(_BYTE_STEPS, key[new] ^ key[new - 1], side="right")
        last = np.append(differs, True)[tied + 1]
        tied = tied[~(differs[tied] & last)]
    return order, shared, differs


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, most: int = PART_BYTES) -> np.ndarray:
    """Whether the strings of ``sizes`` bytes (one at least) at a and at b are the same, for each pair."""
    out = np.empty(len(a), bool)
    for first, end in parts(sizes, most):
        n = sizes[first:end]
        starts = np.cumsum(n) - n
        steps = np.arange(int(n.sum())) - np.repeat(starts, n)
        out[first:end] = np.logical_and.reduceat(data[np.repeat(a[first:end], n) + steps] == data[np.repeat(b[first:end], n) + steps], starts)
    return out


def sorted_bucket(plan: Plan, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, anchored: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorts the windows of runs: run and start of each window, their order, and whether a place begins a new string.

    A run has ``sizes`` consecutive windows from ``begin`` on in ``data``; its first one's anchor is ``anchored`` bytes on.
    Windows are in order of their first ``head_words`` words, equal ones together.
    """
    run = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts, at = begin[run] + step, anchored[run] - step
    shift = plan.to_cover[at]
    # The cover's suffixes that windows lead to, ranked by all their bytes in the run, up to the length.
    sampled = np.zeros(len(data), bool)
    sampled[starts + shift] = True
    cover = np.flatnonzero(sampled)
    place = np.cumsum(sampled) - 1
    ends = np.zeros(len(data) + 1, np.int64)
    ends[begin] = begin + sizes + plan.length - 1
    left = np.minimum(np.maximum.accumulate(ends)[cover] - cover, plan.length)
    words = big_endian_words(data)
    depth = -(-plan.length // 8)

    def of_cover(j: int, which: np.ndarray) -> np.ndarray:
        if j == depth:  # the shorter of two that are equal as far as they go
            return left[which].astype(np.uint64)
        return words[np.minimum(cover[which] + 8 * j, len(data) - 1)] & FIRST_BYTES[np.clip(left[which] - 8 * j, 0, 8)]

    order, shared, _ = sort_strings(of_cover, len(cover), depth + 1)
    shared[1:] = np.minimum(shared[1:], np.minimum(left[order[1:]], left[order[:-1]]))
    tie = np.empty(len(starts), np.uint64)
    for d in np.unique(shift).tolist():
        ranks = np.empty(len(cover), np.int64)
        ranks[order] = np.cumsum(shared < plan.length - d)
        own = np.flatnonzero(shift == d)
        tie[own] = at[own] * (len(cover) + 1) + ranks[place[starts[own] + d]]

    def of_window(j: int, which: np.ndarray) -> np.ndarray:
        if j == plan.head_words:
            return tie[which]
        return words[np.minimum(starts[which] + 8 * j, len(data) - 1)] & FIRST_BYTES[min(8, max(0, plan.length - 8 * j))]

    order, _, differs = sort_strings(of_window, len(starts), plan.head_words + 1)
    return run, starts, order, differs


def _sort_buckets(plan: Plan):
    """Windows of a bucket are sorted; of equal ones all but the first by (doc_id, block, place) repeat.

    Whole runs come first: a run equal to an earlier one repeats in all its windows and is done.
    """

    def repeats(rows: list[tuple]) -> Iterator[tuple[int, int, int, bytes]]:
        opened = [unpack(r[3]) for r in rows]
        ids, starts, offsets, sizes, anchored, data = (np.concatenate([x[k] for x in opened]) for k in range(6))
        packet = np.repeat(np.arange(len(rows)), [len(x[0]) for x in opened])
        del opened
        sizes, blocks = sizes.astype(np.int64), np.array([r[2] for r in rows], np.int64)
        spans = sizes + plan.length - 1
        begin = np.cumsum(spans) - spans
        order = np.lexsort((offsets, blocks[packet], ids))
        leader = np.empty(len(order), np.int64)
        leader[order] = order[first_of_equal(mix64(hashed_spans(data, begin, begin + spans) + sizes.astype(np.uint64))[order])]
        done = (leader != np.arange(len(leader))) & (sizes == sizes[leader])
        some = np.flatnonzero(done)
        done[some] = same_bytes(data, begin[some], begin[leader[some]], spans[some])
        # Runs in the order of their texts, so that windows are numbered in that order.
        left = order[~done[order]]
        run, place, by, differs = sorted_bucket(plan, data, begin[left], sizes[left], anchored[left].astype(np.int64))
        again = np.ones(len(by), bool)
        again[np.minimum.reduceat(by, np.flatnonzero(differs))] = False
        again = np.flatnonzero(again)
        run = left[run[again]]
        where, home = starts[run] + place[again] - begin[run], packet[run]
        for k in np.unique(np.concatenate([home, packet[done]])).tolist():
            own = done & (packet == k)
            firsts, lasts = runs(np.sort(where[home == k]))
            yield 0, 1, int(blocks[k]), pack(np.concatenate([firsts, starts[own]]), np.concatenate([lasts, starts[own] + sizes[own] - 1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 4):
            packets = [r for r in rows if r[1] == 0]
            yield _rows([r for r in rows if r[1] == 1] + (list(repeats(packets)) if packets else []))

    return run


KEPT = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept_sha256 string, kept binary"


def _removal(plan: Plan, with_kept: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 3):
            spans = [unpack(payload) for _, order, payload in rows if order == 0]
            for _, order, payload in rows:
                if order == 0:
                    continue
                ids, lengths, data = unpack(payload)
                firsts, lasts = (np.concatenate([s[k] for s in spans] or [np.zeros(0, np.int64)]) for k in range(2))
                gone = _mark(len(data), firsts, lasts + plan.length)
                edges = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
                opens, closes = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
                at, removed, digests, kept = 0, [], [], []
                begins = np.cumsum(lengths) - lengths
                low, high = np.searchsorted(closes, begins, side="right"), np.searchsorted(opens, begins + lengths)
                for d, n in enumerate(lengths.tolist()):
                    # A run over the border of two documents belongs to both.
                    own = [(max(0, int(opens[k]) - at), min(n, int(closes[k]) - at)) for k in range(low[d], high[d])] if n else []
                    body = data[at : at + n]
                    rest = body[~gone[at : at + n]].tobytes() if own else body.tobytes()
                    removed.append([{"start": a, "end": b} for a, b in own])
                    digests.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest if with_kept else None)
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if x == LAST else x for x in ids.tolist()], pa.int64()), pa.array(lengths), pa.array(removed, schema.field("spans").type), pa.array(digests), pa.array(kept, pa.binary())],
                    schema=schema,
                )

    return run


def _dealt(rows: DataFrame, plan: Plan, step: Callable, ddl: str) -> DataFrame:
    """``step`` over rows dealt by their first column and sorted by them all but the last."""
    return rows.repartition(plan.tasks, rows.columns[0]).sortWithinPartitions(*rows.columns[:-1]).mapInArrow(step, ddl)


def substring_dedup(docs: DataFrame, length: int = 100, with_kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256, kept) for each row of ``docs`` (doc_id: integer, text).

    ``spans`` are the maximal runs of bytes, from 0, covered by a string of ``length`` bytes that also starts earlier:
    in a smaller doc_id or earlier in the same text; all strings are judged on the input. Texts are UTF-8; null counts
    as empty. Rows that repeat a doc_id come in the order of the input's blocks, rows without one last. An empty table
    gives an empty result; more columns are ignored. ``kept`` holds the remaining bytes unless ``with_kept`` is false.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = materialize(read.mapInArrow(_blocks, BLOCK), "blocks")
    plan = Plan(length, blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])
    texts = blocks.select("block", F.lit(-1).cast("long").alias("bucket"), "payload")
    ranks = blocks.select("block", "payload").mapInArrow(_cover_suffixes(plan), "bucket long, block long, payload binary")
    shared = _dealt(ranks, plan, _shared_ranks, "block long, bucket long, payload binary")
    suffixes = _dealt(shared.unionByName(texts), plan, _suffixes(plan), SORTED)
    spans = _dealt(suffixes, plan, _sort_buckets(plan), SORTED).select("block", F.lit(0).alias("part"), "payload")
    rows = spans.unionByName(blocks.select("block", F.lit(1).alias("part"), "payload"))
    return _dealt(rows, plan, _removal(plan, with_kept, to_arrow_schema(StructType.fromDDL(KEPT))), KEPT)


def op6(docs: DataFrame) -> DataFrame:
    """Strings of 100 bytes; counts and digest of what remains of each document."""
    found = substring_dedup(docs, 100, with_kept=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
