"""Shared pieces of the corpus operators: Arrow batches as byte arrays, word hashing, scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweft.session import delete_at_exit, shared_folder

#: Space, tab, line feed, vertical tab, form feed and carriage return: everything else is part of a word.
BLANKS = b" \t\n\x0b\x0c\r"
#: A word for Java and DuckDB regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(BLANKS)] = False

CHUNK_BYTES = 1 << 20


# --- scratch tables -------------------------------------------------------------------------------------------------


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes when the driver ends.
    """
    path = f"{shared_folder(df.sparkSession)}/lumenweft/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    delete_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """``name``, made longer until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Slots of the filter that tells rows apart by id before a join: a fixed size, whatever the input.
FILTER_SLOTS = 1 << 20


def slot(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_SLOTS)).cast("int")


def slots_of(ids: DataFrame, column: str) -> DataFrame:
    """The slots of some ids, to be broadcast: FILTER_SLOTS numbers at most."""
    return F.broadcast(ids.select(slot(F.col(column)).alias("slot")).distinct())


def split_by(docs: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose ``column`` is surely none of ``ids`` (the same column), and those that may be. None is shuffled.

    With very many ids all slots are taken and every row may be one; nothing but the saving is lost then. Null is an id.
    """
    slots = slots_of(ids, column)
    same = slot(docs[column]) == slots["slot"]
    return docs.join(slots, same, "left_anti"), docs.join(slots, same, "left_semi")


# --- Arrow batches as bytes -----------------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and UTF-8 bytes of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``most`` bytes of text each (one row at least): first row, end, offsets, bytes."""
    offsets, data = text_bytes(batch.column(batch.schema.get_field_index(column)))
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, offsets[first : end + 1] - offsets[first], data[offsets[first] : offsets[end]]
        first = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def stream64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = stream64(256, 1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """C with (C[j] - C[i]) * BASE**-i a hash of data[i:j]."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * down[starts])


def hashed_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 16) -> np.ndarray:
    """Hashes of ascending spans of some bytes, taken in slices: tables stay short, for very long texts and for the cache."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + most, side="right")))
        out[i:j] = span_hashes(prefix_hashes(data[a : int(ends[j - 1])]), starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def word_spans(offsets: np.ndarray, data: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each document the index of its first word (n + 1 values)."""
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased (A-Z) word, and each document's first word."""
    starts, ends, first = word_spans(offsets, data)
    return hashed_spans(LOWER[data], starts, ends), first


def crc32_mod(column, n: int):
    """crc32 of a value's text, modulo n, as a Spark expression."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)
