"""Ranked lexical search over an index of blocks, by windows of documents.

A block holds the documents of a batch in the order of their ids, and the postings of every term in them: the term's hash,
the documents that have it and how often. Blocks are independent, so an index grows by appending those of later documents;
what depends on all documents (their number, their length, how many have a term) is summed when a search begins. A search
goes through a block window by window: the postings of an item's terms are added into an array with a place for each
document of the window, places that were touched are flagged, and only those are harvested into the item's best.

Equality of terms is that of 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lumenweft.llm.common import LOWER, chunks, hashed_spans, materialize, word_spans
from lumenweft.llm.lm import _planes as planes
from lumenweft.llm.lm import _values as values_of
from lumenweft.llm.substrings import pack, unpack
from lumenweft.session import ship

#: Bytes of a term: ASCII letters and digits, and all of other scripts.
IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Text of a block in bytes; documents of a window, whose scores take 32 kB; items of a pass over the index.
BLOCK, WINDOW, ITEMS = 8 << 20, 4096, 4096
K = 20


def term_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term, and the first term of each text (n + 1)."""
    starts, ends, first = word_spans(offsets, data, IS_TERM)
    return hashed_spans(LOWER[data], starts, ends), first


def _by_id(ids: list) -> np.ndarray:
    """Places of ids in ascending order, nulls last."""
    return np.array(sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] if ids[k] is not None else 0, k)), np.int64)


def _blocks(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, offsets, data in chunks(batch, most=BLOCK):
                hashes, at = term_hashes(offsets, data)
                lengths = np.diff(at)
                ids = batch.column(0).slice(first, end - first)
                order = _by_id(ids.to_pylist())
                order = order[lengths[order] > 0]  # a document without a term is in no list
                slot = np.full(end - first, -1, np.int64)
                slot[order] = np.arange(len(order))
                doc = np.repeat(slot, lengths)
                by = np.lexsort((doc, hashes))
                hashes, doc = hashes[by], doc[by]
                new_term = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
                new = np.flatnonzero(new_term | np.append(True, doc[1:] != doc[:-1])[: len(doc)])
                tf = np.diff(np.append(new, len(hashes)))
                terms = np.flatnonzero(new_term[new])
                df = np.diff(np.append(terms, len(new)))
                small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
                columns = [
                    pa.array([len(order)], pa.int64()), pa.array([len(hashes)], pa.int64()),
                    pa.array([pack(planes(hashes[new[terms]]), small(df), level=1)], pa.binary()),
                    pa.array([pack(small(doc[new]), small(tf), level=1)], pa.binary()),
                    pa.array([pack(small(lengths[order]), level=1)], pa.binary()),
                    pa.array([ids.take(pa.array(order)).to_pylist()], schema.field("ids").type),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


INDEX = "n_docs long, n_terms long, terms binary, postings binary, lengths binary, ids array<{id}>"


def build_index(docs: DataFrame) -> DataFrame:
    """The blocks (INDEX) of the rows of ``docs`` (doc_id, text), each row in one block; null texts have no terms."""
    ship(docs.sparkSession)
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame([], INDEX.format(id=kind)).schema
    return read.mapInArrow(_blocks(to_arrow_schema(schema)), schema)


class Items:
    """Search items as term numbers with repeats counted, over the sorted hashes of all their terms."""

    def __init__(self, texts: list[str | None]):
        offsets = np.append(0, np.cumsum([len((t or "").encode()) for t in texts])).astype(np.int64)
        hashes, first = term_hashes(offsets, np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8))
        self.vocabulary, place = np.unique(hashes, return_inverse=True)
        self.terms = [np.unique(place[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the vocabulary that are among a block's sorted hashes, and where."""
        at = np.minimum(np.searchsorted(hashes, self.vocabulary), max(0, len(hashes) - 1))
        some = np.flatnonzero(hashes[at] == self.vocabulary) if len(hashes) else np.zeros(0, np.int64)
        return some, at[some]


def _frequencies(shared):
    """(term, df) of the vocabulary, summed over a task's blocks (terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        df = np.zeros(len(items.vocabulary), np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                hashes, n = unpack(packed)
                some, at = items.found(values_of(hashes))
                df[some] += n[at]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    return run


def length_factors(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 25 + (25 * length * documents) div terms, in whole numbers of any size."""
    if 25 * int(lengths.max(initial=0)) * n_docs < 1 << 63:
        return 75 + 25 * lengths.astype(np.int64) * n_docs // n_terms
    return np.array([75 + 25 * int(x) * n_docs // n_terms for x in lengths], np.int64)


def _scorer(shared, weights: np.ndarray, n_docs: int, n_terms: int, k: int, schema: pa.Schema):
    """The k best documents of a task's blocks for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best: list[list[tuple]] = [[] for _ in items.terms]
        scores, touched = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, bool)
        for batch in batches:
            for row in range(batch.num_rows):
                hashes, df = unpack(batch.column(0)[row].as_py())
                docs, tf = unpack(batch.column(1)[row].as_py())
                factors = length_factors(unpack(batch.column(2)[row].as_py())[0], n_docs, n_terms)
                ids = batch.column(3)[row].values
                begin = np.append(0, np.cumsum(df, dtype=np.int64))
                windows = np.arange(0, len(factors) + WINDOW, WINDOW)
                lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
                for term, at in zip(*items.found(values_of(hashes)), strict=True):
                    here = docs[begin[at] : begin[at + 1]].astype(np.int64)
                    n = tf[begin[at] : begin[at + 1]].astype(np.int64)
                    lists[int(term)] = here, weights[term] * (1_000_000_000 * n // (1000 * n + 12 * factors[here])), np.searchsorted(here, windows)
                for item, (terms, times) in enumerate(items.terms):
                    own = [(*lists[t], int(c)) for t, c in zip(terms.tolist(), times, strict=True) if t in lists]
                    for w in range(len(windows) - 1) if own else ():
                        for here, gains, cuts, c in own:
                            part = slice(cuts[w], cuts[w + 1])
                            places = here[part] - windows[w]
                            scores[places] += c * gains[part]
                            touched[places] = True
                        places = np.flatnonzero(touched)
                        found = scores[places]
                        scores[places], touched[places] = 0, False
                        # Once there are k, only what is not below the last of them can enter.
                        some = found >= max(1, -best[item][-1][0] if len(best[item]) == k else 1)
                        places, found = places[some], found[some]
                        first = np.lexsort((places, -found))[:k]
                        new = [(-int(found[j]), (x := ids[int(windows[w] + places[j])].as_py()) is None, x) for j in first]
                        if new:
                            best[item] = sorted(best[item] + new, key=lambda r: (*r[:2], 0 if r[1] else r[2]))[:k]
        rows = [(item, doc_id, -score) for item, found in enumerate(best) for score, _, doc_id in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def search(index: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each row of ``items`` (item_id, text).

    Ranks begin at 1 and are unique; equal scores go by ascending doc_id, nulls last. Every row of the index is a document of
    its own, every row of ``items`` an item, whatever ids they share. An item without terms, a null one among them, has no
    rows, as have all over an empty index. Items are the query set: ITEMS of them at a time are held by the driver and every
    task, in a pass over the index. A task keeps k rows for each.
    """
    spark = ship(index.sparkSession)
    kind = index.schema["ids"].dataType.elementType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    if not total.n:
        return out
    found_schema = to_arrow_schema(spark.createDataFrame([], f"item int, doc_id {kind}, score long").schema)

    def one_pass(rows: list) -> DataFrame:
        own = Items([r.text for r in rows])
        shared = spark.sparkContext.broadcast(own)
        df = np.zeros(len(own.vocabulary), np.int64)
        for r in index.select("terms").mapInArrow(_frequencies(shared), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r.term] = r.df
        weights = np.array([math.floor(1000 * math.log((2 * total.n + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        found = index.select("terms", "postings", "lengths", "ids").mapInArrow(_scorer(shared, weights, total.n, total.l, k, found_schema), f"item int, doc_id {kind}, score long")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, r.item_id) for n, r in enumerate(rows)], f"item int, item_id {item_kind}")
        return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")

    held: list = []
    for r in items.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        held.append(r)
        if len(held) == ITEMS:
            out, held = out.unionByName(one_pass(held)), []
    return out.unionByName(one_pass(held)) if held else out


def op13(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(materialize(build_index(docs), "index"), items)
