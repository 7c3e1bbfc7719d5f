"""One JSON array in one file, read by many tasks.

Spark's text source cuts a file into byte ranges at any sign; here the sign is ``}``, so that no task reads more than a range
and the rest of an object, and no row is longer than what stands between two of them. A range by itself does not know whether
it begins inside a string. So a first pass lets an automaton over strings, escapes and depth run over each range from each of
its three states, and the results are put together range by range: one small row a range reaches the driver. The second pass
knows how every range begins and gives out the elements' texts; an element over several ranges is put together by its first
one's number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenweft.session import scratch, ship

QUOTE, BACKSLASH, COMMA = 0x22, 0x5C, 0x2C
CUT = "}"
#: States between two signs: outside of strings, inside one, inside one after a backslash.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
DEPTH = np.zeros(256, np.int8)
DEPTH[[ord("["), ord("{")]] = 1
DEPTH[[ord("]"), ord("}")]] = -1
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
BOM = b"\xef\xbb\xbf"


class ArrayError(ValueError):
    """What is wrong with a file; ``kind`` is one of empty, not an array, unclosed, trailing data, trailing comma, missing
    comma, missing value, malformed."""

    def __init__(self, kind: str, where: str):
        super().__init__(f"{kind}: {where}")
        self.kind = kind


def strings(data: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Whether each sign is part of a string (both quotes are), and the state after the last."""
    slash = data == BACKSLASH
    # Signs that a backslash before them escapes: of a run of backslashes every second one counts.
    run = np.arange(len(data)) - np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))
    if state == ESCAPED and len(data):
        first = int(np.argmin(slash)) if not slash.all() else len(data)
        run[:first] -= 1  # the first sign is escaped, so a backslash there escapes nothing
    escaped = np.append(state == ESCAPED, run[:-1] % 2 == 1)
    quotes = (data == QUOTE) & ~escaped
    count = np.cumsum(quotes) + (state != OUTSIDE)
    inside = count % 2 == 1
    end = OUTSIDE if not len(data) and state == OUTSIDE else INSIDE if (inside[-1] if len(data) else True) else OUTSIDE
    if end == INSIDE and len(data) and run[-1] % 2 == 1:
        end = ESCAPED
    return inside | quotes, (state if not len(data) else end)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
    """(file, begin of the range, bytes) of each batch (value, path, start): pieces with the sign after each."""
    for batch in batches:
        paths, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        first = 0
        for k in range(1, batch.num_rows + 1):
            if k == batch.num_rows or (paths[k], starts[k]) != (paths[first], starts[first]):
                pieces = batch.column(0).slice(first, k - first).to_pylist()
                yield paths[first], starts[first], np.frombuffer(b"".join(p + CUT.encode() for p in pieces), np.uint8)
                first = k


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part of a range in a batch, in order: where it leads from each state (state, depth), its size, and the first
    and last sign that is not blank."""
    for nth, (path, start, data) in enumerate(_ranges(batches)):
        ends, deltas = [], []
        for state in (OUTSIDE, INSIDE, ESCAPED):
            inside, end = strings(data, state)
            ends.append(end)
            deltas.append(int(DEPTH[data[~inside]].sum()))
        signs = data[~IS_BLANK[data]]
        row = [path, start, nth, ends, deltas, len(data), bytes(signs[:4].tobytes())]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["path", "start", "nth", "ends", "deltas", "size", "head"])


class _Range:
    """What a range has given out so far, and what it holds of the element that is not closed yet."""

    def __init__(self, state: int, depth: int, left: int, first: bool):
        self.state, self.depth, self.left, self.first = state, depth, left, first
        self.nth, self.opens, self.held = 0, False, []
        self.closings = self.stray = 0

    def read(self, data: np.ndarray) -> Iterator[tuple]:
        """(nth, text, opens, closes, last, closings, stray, error) of the elements closed by these bytes."""
        data = data[: max(0, self.left)]  # the sign after the last piece of a file may not be there
        self.left -= len(data)
        if self.first and data[:3].tobytes() == BOM:
            data = data[3:]
        if not len(data):
            return
        self.first = False
        inside, self.state = strings(data, self.state)
        moves = np.where(inside, 0, DEPTH[data]).astype(np.int64)
        depths = self.depth + np.cumsum(moves)  # after each sign
        before = depths - moves
        solid = ~IS_BLANK[data]
        opens = ~inside & (moves > 0) & (before == 0)
        ends = ~inside & (moves < 0) & (depths == 0)
        commas = ~inside & (data == COMMA) & (depths == 1)
        if (depths < 0).any() or (solid & (before == 0) & ~opens).any():
            yield 0, b"", True, True, False, 0, 0, "trailing data"
            return
        closings = (~inside & (moves < 0) & (depths == 1)).astype(np.int64)
        stray = (solid & (before == 1) & (depths == 1) & ~commas).astype(np.int64)
        cuts = np.flatnonzero(commas | opens | ends)
        bounds = np.concatenate([[0], cuts + 1])
        sums = [np.add.reduceat(np.append(x, 0), bounds) if len(data) else [] for x in (closings, stray)]
        raw, begin = data.tobytes(), 0
        for k, c in enumerate(cuts.tolist()):
            self.closings += int(sums[0][k])
            self.stray += int(sums[1][k])
            if not opens[c]:
                self.held.append(raw[begin:c])
                yield self.nth, b"".join(self.held), self.opens, True, bool(ends[c]), self.closings, self.stray, None
                self.nth += 1
            begin, self.opens, self.held, self.closings, self.stray = c + 1, not ends[c], [], 0, 0
        if begin < len(raw) and depths[-1] > 0:  # outside of the array there are only blanks
            self.held.append(raw[begin:])
            self.closings += int(sums[0][-1])
            self.stray += int(sums[1][-1])
        self.depth = int(depths[-1])

    def rest(self) -> Iterator[tuple]:
        if self.depth > 0 or self.held:
            yield self.nth, b"".join(self.held), self.opens, False, False, self.closings, self.stray, None


PIECES = "path string, start long, nth long, text binary, opens boolean, closes boolean, last boolean, closings long, stray long, error string"


def _pieces(begins: dict[tuple[str, int], tuple[int, int, int, bool]]):
    """PIECES: the elements of each range, whole, and what it holds of those that begin or end elsewhere."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in PIECES.split(", ")]

    def batch(at: tuple[str, int], rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*((*at, *r) for r in rows), strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[str, int] | None = None
        now: _Range | None = None
        for path, start, data in _ranges(batches):
            if (path, start) != at:
                if now:
                    yield batch(at, list(now.rest()))
                at = (path, start)
                now = _Range(*begins[at])
            yield batch(at, list(now.read(data)))
        if now:
            yield batch(at, list(now.rest()))

    return run


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, nth, value): the text of each element of the array in each file at ``path``; where it begins gives order.

    ArrayError, before any row is given out, for what is no JSON array. The driver holds a row for each range of a file and
    the place (not the text) of what lies over two of them. An element is in one task whole, as is what stands between two
    braces, which is all of an array that has none.
    """
    ship(spark)
    lines = spark.read.option("lineSep", CUT).text(path)
    cut = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    sizes = {r.path: r.size for r in lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.max("_metadata.file_size").alias("size")).collect()}
    if not sizes:
        raise ArrayError("empty", path)
    maps = cut.mapInArrow(_maps, "path string, start long, nth long, ends array<long>, deltas array<long>, size long, head binary").collect()
    begins: dict[tuple[str, int], tuple[int, int, int, bool]] = {}
    for file, size in sizes.items():
        state, depth, seen, head = OUTSIDE, 0, 0, b""
        own = sorted((m for m in maps if m.path == file), key=lambda m: (m.start, m.nth))
        read = sum(m.size for m in own)
        # The last piece has no sign after it if the file doesn't end with one. The reader leaves a byte order mark out.
        added = read - size in (1, 1 - len(BOM))
        for m in own:
            begins.setdefault((file, m.start), (state, depth, read - added - seen, seen == 0))
            depth += m.deltas[state]
            state = m.ends[state]
            seen += m.size
            head = head or bytes(m.head).removeprefix(BOM)
        depth += added and state == OUTSIDE
        if not head or (added and head == CUT.encode()):
            raise ArrayError("empty", file)
        if head[:1] != b"[":
            raise ArrayError("not an array", file)
        if state != OUTSIDE or depth > 0:
            raise ArrayError("unclosed", file)
    folder = scratch(spark, "pieces")
    cut.mapInArrow(_pieces(begins), PIECES).write.parquet(folder)
    pieces = spark.read.schema(PIECES).parquet(folder)
    broken = pieces.where("error is not null").select("path", "start", "error").first()
    if broken:
        raise ArrayError(broken.error, f"{broken.path}, after byte {broken.start}")
    parts = pieces.where("not (opens and closes)").select("path", "start", "nth", "opens", "closes").collect()
    groups, group = [], None
    for r in sorted(parts, key=lambda r: (r.path, r.start, r.nth)):
        group = (r.start, r.nth) if r.opens or group is None else group
        groups.append((r.path, r.start, r.nth, *group))
        group = None if r.closes else group
    whole = pieces.where("opens and closes").select("path", "start", "nth", F.col("text").cast("string").alias("value"), "last", "closings", "stray")
    if groups:
        to = F.broadcast(spark.createDataFrame(groups, "path string, start long, nth long, first long, first_nth long"))
        own = pieces.where("not (opens and closes)").join(to, ["path", "start", "nth"]).groupBy("path", "first", "first_nth")
        ordered = F.sort_array(F.collect_list(F.struct("start", "nth", "text")))
        # Pieces of one sign's bytes may lie on both sides of a cut, so they are put together as bytes.
        joined = own.agg(F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x.text)).cast("string").alias("value"), F.max("last").alias("last"), F.sum("closings").alias("closings"), F.sum("stray").alias("stray"))
        whole = whole.unionByName(joined.withColumnsRenamed({"first": "start", "first_nth": "nth"}))
    return _checked(whole, folder)


#: One number, word or string and nothing more.
SCALAR = r'^\s*("(?:[^"\\]|\\.)*"|[^\s",]+)\s*$'


def _checked(found: DataFrame, folder: str) -> DataFrame:
    blank = F.trim(F.translate("value", "\t\n\r", "   ")) == ""
    kind = (
        F.when(blank, F.when(F.col("last"), "trailing comma").otherwise("missing value"))
        .when((F.col("closings") > 1) | ((F.col("closings") == 1) & (F.col("stray") > 0)), "missing comma")
        .when((F.col("closings") == 0) & ~F.col("value").rlike(SCALAR), "missing comma")
        .when(F.try_parse_json("value").isNull(), "malformed")
    )
    path = folder + "-elements"
    found.select("path", "start", "nth", "value", kind.alias("error")).write.parquet(path)
    checked = found.sparkSession.read.parquet(path)
    per_file = checked.groupBy("path").agg(F.count("*").alias("n"), F.count("error").alias("bad"), F.min_by("error", F.when(F.col("error").isNotNull(), F.struct("start", "nth"))).alias("error"), F.min(F.when(F.col("error").isNotNull(), F.col("start"))).alias("start"))
    empty = []
    for r in per_file.where("bad > 0").collect():
        if r.n > 1 or r.error != "trailing comma":
            raise ArrayError(r.error, f"{r.path}, after byte {r.start}")
        empty.append(r.path)  # an array of nothing
    return checked.where(~F.col("path").isin(empty)).drop("error") if empty else checked.drop("error")


def read_array(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The rows of one JSON array of objects, read by as many tasks as the file has ranges; columns from the data if no schema
    is given. ArrayError says what is wrong with a file; an array of nothing has no rows (and, without schema, no columns)."""
    values = elements(spark, path).select("value")
    texts = getattr(values._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    reader = spark.read.option("mode", "FAILFAST")
    return DataFrame((reader.schema(schema) if schema else reader)._jreader.json(texts), spark)
