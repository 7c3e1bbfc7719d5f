"""Benchmark decontamination by latent semantic retrieval.

Passages of the documents and of the benchmark become TF-IDF vectors over the corpus' words, in a fixed number of slots by
hash, with document frequencies of the whole corpus. A distributed randomised SVD of all passages gives the leading directions;
the benchmark's passages, which are the queries, take part in it with as much weight as the corpus. Kept are RANK directions
in all, whatever the sizes. Passages near a benchmark passage there are candidates; a longest common subsequence of words
and a check of the answer confirm them. With up to RANK - CORPUS_RANK passages of the benchmark all of its directions fit;
beyond that the smallest are cut.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweft.llm.common import LOWER, chunks, hashed_spans, word_spans
from lumenweft.llm.licenses import IS_TOKEN
from lumenweft.session import ship

#: Words of a benchmark passage; document passages are as long and start every half of it.
PIECE = 64
STRIDE = PIECE // 2
#: Slots of words (their hashes' upper bits): the width of all vectors, whatever the vocabulary.
SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
#: Words in more than this share of the documents say nothing about a passage.
COMMON = 0.05
#: Directions of the latent space; those of the corpus before the benchmark joins, with some in excess for accuracy.
RANK, CORPUS_RANK, EXTRA = 128, 64, 32
#: A task that fits the decomposition sums up about so many documents (its sums have a row for each slot, 25 MB), this many
#: passages at a time.
FIT_DOCUMENTS, FIT_PASSAGES = 40_000, 64
#: Rows of these sums that leave a task at a time (1.5 MB): together they would be held again, as rows, as bytes and as Arrow.
ROWS_AT_ONCE = 4096
#: Cosine of a candidate, and how much of the benchmark passage's own length its vector must reach along it.
COSINE, REACH = 0.3, 0.3
LCS_SURE, LCS_LIKELY, ANSWER = 0.8, 0.6, 0.6
#: Words whose weighted latent vector is shorter than this share of the longest do not tell where a passage lies.
FAINT = 0.05
#: Benchmark passages that are merged into the decomposition, and that a pass over the documents looks for, at a time.
MERGED_AT_ONCE, PIECES_AT_ONCE = 64, 8192
#: Strides whose vectors are held at a time.
STRIDES_AT_ONCE = 1024


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, begin = word_spans(offsets, low, IS_TOKEN)
    return hashed_spans(low, starts, ends), begin


def _hash_text(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return tokens(np.array([0, len(data)]), data)[0]


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel over ``a``)."""
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << k)
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        m = where.get(y, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def answer_of(text: str) -> np.ndarray:
    """Words of the last sentence with three words or more: what a model would have to answer."""
    for sentence in reversed(text.replace("?", ".").replace("!", ".").split(".")):
        words = _hash_text(sentence)
        if len(words) >= 3:
            return words
    return _hash_text(text)


def pieces_of(words: np.ndarray) -> list[np.ndarray]:
    """A benchmark text in passages of PIECE words; a rest of up to half of that stays with the last."""
    out = []
    for at in range(0, max(1, len(words) - PIECE // 2), PIECE):
        out.append(words[at : at + PIECE if at + PIECE + PIECE // 2 < len(words) else len(words)])
    return [p for p in out if len(p)]


class Benchmark:
    """Passages of the benchmark: item, words, and those of them that are in the answer."""

    def __init__(self, items: list[tuple[int, np.ndarray, set[int]]]):
        self.items, self.words, self.answers = [], [], []
        for item, words, answer in items:
            for piece in pieces_of(words):
                self.items.append(item)
                self.words.append(piece)
                self.answers.append([w for w in piece.tolist() if w in answer])

    def part(self, first: int, end: int) -> Benchmark:
        out = Benchmark([])
        out.items, out.words, out.answers = self.items[first:end], self.words[first:end], self.answers[first:end]
        return out

    def slots(self) -> list[np.ndarray]:
        """The distinct slots of each passage."""
        return [np.unique(w >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for w in self.words]


def weights(benchmark: Benchmark, df: np.ndarray, n: int) -> np.ndarray:
    """Weight of each slot: its inverse document frequency, none if it is common; a passage of common words only keeps them."""
    idf = np.log((n + 1.0) / (df + 1.0))
    rare = df <= max(1.0, COMMON * n)
    for slots in benchmark.slots():
        if rare[slots].sum() < 3:
            rare[slots] = True
    return np.where(rare, np.maximum(idf, 0.05), 0.0).astype(np.float32)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, documents that have it); under slot -1 the documents."""
    df, rows = np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        for first, end, offsets, data in chunks(batch):
            hashes, begin = tokens(offsets, data)
            doc = np.repeat(np.arange(end - first, dtype=np.uint64), np.diff(begin))
            pairs = np.unique((doc << np.uint64(SLOT_BITS)) | (hashes >> np.uint64(64 - SLOT_BITS)))
            df += np.bincount((pairs & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
            rows += end - first
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], rows))], ["word", "n"])


def strided(hashes: np.ndarray, begin: np.ndarray, idf: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted words by stride of ``width`` words, each once a stride: stride and slot, sorted; and each document's first
    stride (n + 1). However often a word is repeated, it adds no more to a passage."""
    first = np.append(0, np.cumsum(-(-np.diff(begin) // width)))
    slot = hashes >> np.uint64(64 - SLOT_BITS)
    at = np.flatnonzero(idf[slot.astype(np.int64)] > 0)
    doc = np.searchsorted(begin, at, side="right") - 1
    stride = (first[doc] + (at - begin[doc]) // width).astype(np.uint64)
    pairs = np.unique((stride << np.uint64(SLOT_BITS)) | slot[at])
    return (pairs >> np.uint64(SLOT_BITS)).astype(np.int64), (pairs & np.uint64(SLOTS - 1)).astype(np.int64), first


def _omega() -> np.ndarray:
    return np.random.default_rng(17).standard_normal((SLOTS, CORPUS_RANK + EXTRA), np.float32)


def _sketcher(idf: np.ndarray):
    """Rows of the sum over passages of x (x' omega), x being a passage's TF-IDF vector of length one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = _omega()
        total = np.zeros(omega.shape, np.float32)
        for batch in batches:
            for _, _, offsets, data in chunks(batch):
                row, word, first = strided(*tokens(offsets, data), idf, PIECE)
                for low in range(0, int(first[-1]), FIT_PASSAGES):
                    a, b = np.searchsorted(row, (low, low + FIT_PASSAGES))
                    slots, at = np.unique(word[a:b], return_inverse=True)
                    x = np.zeros((FIT_PASSAGES, len(slots)), np.float32)
                    x[row[a:b] - low, at] = idf[word[a:b]]
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
                    total[slots] += x.T @ (x @ omega[slots])
        for low in range(0, SLOTS, ROWS_AT_ONCE):
            some = low + np.flatnonzero(total[low : low + ROWS_AT_ONCE].any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([r.tobytes() for r in total[some]], pa.binary())], ["word", "row"])

    return run


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the rows of each word; the input is sorted by word."""
    word, total = None, None
    done: list[tuple[int, bytes]] = []
    for batch in batches:
        for w, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            values = np.frombuffer(row, np.float32).astype(np.float64)
            if w == word:
                total += values
            else:
                if word is not None:
                    done.append((word, total.astype(np.float32).tobytes()))
                word, total = w, values
    if word is not None:
        done.append((word, total.astype(np.float32).tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.binary())], ["word", "row"])


def leading(columns: np.ndarray, rank: int) -> np.ndarray:
    """The first left singular vectors of ``columns``, each times its singular value."""
    values, vectors = np.linalg.eigh((columns.T @ columns).astype(np.float64))
    good = np.flatnonzero(values > 1e-6 * max(values[-1], 1e-30))[::-1][:rank]
    return columns @ vectors[:, good].astype(np.float32)


def latent_basis(docs: DataFrame, benchmark: Benchmark, idf: np.ndarray) -> np.ndarray:
    """RANK orthonormal directions (SLOTS x RANK at most): leading ones of the passages of ``docs`` (text) and the benchmark.

    With a random ``omega`` every task sums its share of A'A omega; the sums, a row for each slot at most, are all that
    reaches the driver. It completes the decomposition of the corpus (Nystrom) and merges the benchmark's rows into it, some
    at a time. These are scaled to weigh as much, in all, as the corpus' directions.
    """
    sums = docs.mapInArrow(_sketcher(idf), "word long, row binary").repartition("word").sortWithinPartitions("word").mapInArrow(_adder, "word long, row binary")
    y = np.zeros((SLOTS, CORPUS_RANK + EXTRA), np.float32)
    for r in sums.toLocalIterator():
        y[r.word] = np.frombuffer(r.row, np.float32)
    basis = np.zeros((SLOTS, 0), np.float32)
    if y.any():
        omega = _omega()
        core = (omega.T @ y).astype(np.float64)
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        good = values > 1e-6 * values[-1]
        basis = leading(y @ (vectors[:, good] / np.sqrt(values[good])).astype(np.float32), CORPUS_RANK)
        del y, omega
    energy = float((basis.astype(np.float64) ** 2).sum()) or 1.0
    slots = benchmark.slots()
    scale = np.float32(np.sqrt(energy / max(1, len(slots))))
    table = np.zeros((SLOTS, RANK + MERGED_AT_ONCE), np.float32)
    for at in range(0, len(slots), MERGED_AT_ONCE):
        some, width = slots[at : at + MERGED_AT_ONCE], basis.shape[1]
        table[:, :width], table[:, width:] = basis, 0
        del basis
        for k, own in enumerate(some):
            table[own, width + k] = idf[own] * scale / max(1e-9, float(np.linalg.norm(idf[own])))
        basis = leading(table[:, : width + len(some)], RANK)
    return basis / np.maximum(np.linalg.norm(basis, axis=0), 1e-30)


MATCH = "doc_id {id}, item_id long, passage long, cosine double, lcs double, answer double, contaminated boolean"


def passage_vectors(rows: np.ndarray, stride: np.ndarray, slot: np.ndarray, first: np.ndarray, low: int, high: int) -> np.ndarray:
    """Vectors of the passages that begin at strides ``low`` to ``high``: each is its stride and the next of its document."""
    sums = np.zeros((high - low + 1, rows.shape[1]), np.float32)
    a, b = np.searchsorted(stride, (low, high + 1))
    if a < b:
        starts = np.flatnonzero(np.append(True, stride[a + 1 : b] != stride[a : b - 1]))
        sums[stride[a:b][starts] - low] = np.add.reduceat(rows[slot[a:b]], starts, axis=0)
    last = np.zeros(high - low + 1, bool)
    ends = first[np.searchsorted(first, low, side="right") : np.searchsorted(first, high, side="right")]
    last[ends - low - 1] = True
    return sums[:-1] + np.where(last[:-1, None], np.float32(0), sums[1:])


def telling_words(idf: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots that are not FAINT, and their weighted latent vectors."""
    long = np.linalg.norm(basis, axis=1) * idf
    some = np.flatnonzero(long >= FAINT * long.max())
    return some, basis[some] * idf[some, None]


def _retriever(benchmark: Benchmark, some: np.ndarray, rows: np.ndarray, cosine: float, schema: pa.Schema):
    items, words, answers = benchmark.items, benchmark.words, benchmark.answers
    place = np.full(SLOTS, -1, np.int32)
    place[some] = np.arange(len(some))
    told = (place >= 0).astype(np.float32)
    own = np.array([rows[place[s][place[s] >= 0]].sum(axis=0) for s in benchmark.slots()], np.float32)
    lengths = np.maximum(np.linalg.norm(own, axis=1), 1e-9)
    queries = np.ascontiguousarray((own / lengths[:, None]).T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = [w.tolist() for w in words]
        counts = [list(Counter(w).items()) for w in listed]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, _, offsets, data in chunks(batch):
                hashes, begin = tokens(offsets, data)
                stride, slot, strides = strided(hashes, begin, told, STRIDE)
                slot = place[slot]
                best: dict[tuple[int, int], list] = {}
                for low in range(0, int(strides[-1]), STRIDES_AT_ONCE):
                    high = min(low + STRIDES_AT_ONCE, int(strides[-1]))
                    vectors = passage_vectors(rows, stride, slot, strides, low, high)
                    along = vectors @ queries
                    near = along / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                    for k, p in zip(*(x.tolist() for x in np.nonzero((near >= cosine) & (along >= REACH * lengths))), strict=True):
                        d = int(np.searchsorted(strides, low + k, side="right")) - 1
                        a = (low + k - int(strides[d])) * STRIDE
                        # The passage, with half of one to either side.
                        window = hashes[int(begin[d]) + max(0, a - STRIDE) : min(int(begin[d + 1]), int(begin[d]) + a + PIECE + STRIDE)].tolist()
                        there = set(window)
                        # No subsequence is longer than the item's words that are there at all.
                        need = LCS_LIKELY * len(listed[p])
                        if sum(n for w, n in counts[p] if w in there) < need or (common := lcs(listed[p], window)) < need:
                            continue
                        common /= len(listed[p])
                        answer = lcs(answers[p], window) / len(answers[p]) if answers[p] else 0.0
                        sure = common >= LCS_SURE or answer >= ANSWER
                        row = [ids[first + d], items[p], a, float(near[k, p]), common, answer, sure]
                        if (d, items[p]) not in best or (row[6], row[4], row[3]) > (best[d, items[p]][6], best[d, items[p]][4], best[d, items[p]][3]):
                            best[d, items[p]] = row
                columns = list(zip(*best.values(), strict=True)) or [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Candidates with LCS_LIKELY at least: doc_id, item_id, passage (its first word), cosine, lcs, answer, contaminated.

    The best passage stands for a document and an item (a block of PIECES_AT_ONCE of its passages, if it is that long).
    ``docs`` has doc_id and text, ``benchmark`` item_id and text; null and empty texts match nothing; texts of any length are
    searched whole, a stride of words at a time; more columns are ignored. An empty corpus or benchmark gives an empty result. Rows that repeat are matched each, rows without doc_id
    have none in the result. The benchmark is the stated query set: the driver reads it, and its passages are held by every
    task, PIECES_AT_ONCE in each pass over the documents; document frequencies and the decomposition are made once. A
    document is contaminated if a passage shares LCS_SURE of an item's passage in order, or LCS_LIKELY and ANSWER of the
    answer's words. The decomposition is fitted on the passages of all documents, and all are searched.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = ship(docs.sparkSession)
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ddl = MATCH.format(id=read.schema["doc_id"].dataType.simpleString())
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    texts = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    sought = Benchmark([(r[0], _hash_text(r[1]), set(answer_of(r[1]).tolist())) for r in texts.toLocalIterator()])
    if not sought.words:
        return spark.createDataFrame([], ddl)
    df, n = np.zeros(SLOTS, np.int64), 0
    for r in read.mapInArrow(_document_frequencies, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        if r.word < 0:
            n = r.n
        else:
            df[r.word] = r.n
    idf = weights(sought, df, n)
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // FIT_DOCUMENTS))
    some, rows = telling_words(idf, latent_basis(read.select("text").coalesce(tasks), sought, idf))
    parts = [sought.part(at, at + PIECES_AT_ONCE) for at in range(0, len(sought.words), PIECES_AT_ONCE)]
    found = [read.mapInArrow(_retriever(part, some, rows, cosine, schema), ddl) for part in parts]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op10(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contaminated documents, a row for each benchmark item found in one."""
    found = benchmark_matches(docs, benchmark).where("contaminated")
    return found.groupBy("doc_id", "item_id").agg(F.max("lcs").alias("lcs"), F.max("answer").alias("answer"), F.max("cosine").alias("cosine"), F.min("passage").alias("passage"))
