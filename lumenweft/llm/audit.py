"""Audit of how five document filters act on each other, in every order.

A row's failures are a mask of five bits; counts by mask tell all that any order of the filters does. Four filters look at
one text alone. The fifth drops a text that a smaller doc_id has as well: texts are routed by their fingerprint, a task
keeps the full texts of a fingerprint in a chain, each with its least id, and gives out all others. What a task reads is
chained before it is routed, so a text that very many rows share leaves a task once, whatever its copies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweft.session import ship

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
MASKS = 1 << len(LETTERS)
REPEATED = 1 << LETTERS.index("E")
CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Bytes of text that a task chains before it routes them, and that a routed part has about.
HELD, PART = 64 << 20, 16 << 20


def failures(text: bytes, n_characters: int) -> int:
    """The filters that a text fails by itself, as bits: too short, too few different words, capitals, signs."""
    words = text.split()
    short = len(words) < 200
    repetitive = 100 * len(set(words)) < 50 * len(words)
    capitals = 100 * (len(text) - len(text.translate(None, CAPITALS))) > 3 * n_characters
    signs = len(text.translate(None, SIGNS)) < len(text)
    return short | repetitive << 1 | capitals << 2 | signs << 3


class Chains:
    """Full texts by fingerprint, each with its least id and, for every part, the number of rows that have that id."""

    def __init__(self):
        self.held: dict[int, list[list]] = {}
        self.size = 0

    def add(self, fingerprint: int, text: bytes, doc_id, mask: int, parts: dict[str, int]) -> Iterator[tuple]:
        """Takes rows of one text and id in; gives out (doc_id, part, mask, n) for those that are not of the least id."""
        chain = self.held.setdefault(fingerprint, [])
        for link in chain:
            if link[0] == text:
                break
        else:
            chain.append([text, doc_id, mask, dict(parts)])
            self.size += len(text) + 200
            return
        if doc_id == link[1]:
            for part, n in parts.items():
                link[3][part] = link[3].get(part, 0) + n
            return
        if doc_id < link[1]:
            link[1], doc_id = doc_id, link[1]
            link[3], parts = dict(parts), link[3]
        for part, n in parts.items():
            yield doc_id, part, mask | REPEATED, n

    def links(self) -> Iterator[tuple]:
        """(fingerprint, text, least id, mask, parts) of all that is held."""
        for fingerprint, chain in self.held.items():
            for link in chain:
                yield fingerprint, *link


def _routed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, row): chained texts by fingerprint, and rows whose mask is known, spread evenly."""
    chains, count = Chains(), 0

    def known(row: tuple) -> tuple:
        return zlib.crc32(repr(row).encode()) + count, row

    for doc_id, lang, text, fingerprint in rows:
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        mask = failures(data, len(text))
        count += 1
        if doc_id is None:
            yield known((None, lang or "", mask, 1))
            continue
        for row in chains.add(fingerprint, data, doc_id, mask, {lang or "": 1}):
            yield known(row)
        if chains.size > HELD:
            yield from ((link[0], link) for link in chains.links())
            chains = Chains()
    yield from ((link[0], link) for link in chains.links())


def _resolved(pairs: Iterator[tuple]) -> Iterator[tuple]:
    """(doc_id, part, mask, n) of every row: what was known, what is not of its text's least id, and at last what is."""
    chains = Chains()
    for _, row in pairs:
        if len(row) == 4:
            yield row
        else:
            yield from chains.add(*row)
    for _, _, doc_id, mask, parts in chains.links():
        for part, n in parts.items():
            yield doc_id, part, mask, n


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): the failures of the rows of ``docs`` (doc_id, text, lang), n of them alike.

    A row fails E if another row of the same text (null: empty) has a smaller doc_id; a row without doc_id does not fail E
    and makes none fail. ``part`` is lang, null as empty.
    """
    spark = ship(docs.sparkSession)
    read = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    n_bytes = read.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = read.withColumn("fingerprint", F.xxhash64(F.coalesce("text", F.lit("")))).rdd
    parts = max(spark.sparkContext.defaultParallelism, rows.getNumPartitions(), n_bytes // PART)
    found = rows.mapPartitions(_routed).partitionBy(parts, lambda key: key & 0x7FFFFFFFFFFFFFFF).mapPartitions(_resolved)
    return spark.createDataFrame(found, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, part string, mask int, n long", verifySchema=False)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n) of the rows whose text a smaller doc_id has as well."""
    return masks(docs).where(F.col("mask").bitwiseAND(REPEATED) != 0).groupBy("doc_id").agg(F.sum("n").alias("n"))


#: For each order and step: the masks that are kept, removed and redundant then, and its filter.
_EVERY = np.arange(MASKS)
_FILTER = np.array([[LETTERS.index(c) for c in order] for order in ORDERS])
_BIT = 1 << _FILTER
_EARLIER = np.cumsum(_BIT, axis=1) - _BIT
_FAILS = (_EVERY & _BIT[..., None]) != 0
_GONE = (_EVERY & _EARLIER[..., None]) != 0


def report(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """Rows of a part from its counts of documents, good and toxic ones (3 x 32) by mask."""
    removed, redundant = _FAILS & ~_GONE, _FAILS & _GONE
    n_removed = removed @ counts[0]
    shapley = np.bincount(_FILTER.ravel(), n_removed.ravel(), len(LETTERS)).astype(np.int64)
    columns = [(~_FAILS & ~_GONE) @ counts[0], n_removed, redundant @ counts[0], counts[0][_BIT], removed @ counts[1], removed @ counts[2], shapley[_FILTER]]
    for k, order in enumerate(ORDERS):
        for step in range(len(LETTERS)):
            yield part, order, step + 1, *(int(c[k, step]) for c in columns)


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _vector(row: tuple) -> np.ndarray:
    out = np.zeros((3, MASKS), np.int64)
    out[:, row[0]] = row[1:]
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """AUDIT for each part, order of the five filters and step.

    A document is good or toxic if some row of ``labels`` (doc_id, quality, toxic) with its doc_id says 1; rows without doc_id
    have no label. Null texts are empty; repeated rows count each, as they are (rows of one doc_id and text do not make each
    other fail). Other columns, clashing names among them, are ignored. An empty table gives no rows. Counts are sums, so ties
    do not arise. A text of any length is in one task whole, once as read and once as routed.
    """
    spark = docs.sparkSession
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(says("quality"), says("toxic")).withColumn("own", F.lit(0).cast("long"))
    # Rows without doc_id would meet in one task of the join.
    rows = masks(docs).withColumn("own", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0))
    joined = rows.join(known, ["doc_id", "own"], "left")
    of = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    counted = joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("quality"), of("toxic"))
    add = lambda a, b: a + b
    vectors = counted.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(_vector, lambda v, row: v + _vector(row), add)
    return spark.createDataFrame(vectors.flatMap(lambda x: report(*x)), AUDIT, verifySchema=False)


def op12(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return filter_audit(docs, labels)
