"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's signature is a row of minima under K hash functions. Documents are posted under each (coordinate, value)
pair. Two signatures that agree on m of K coordinates share one of the K - m + 1 rarest pairs of either, so only
these prefixes are merged; documents with fewer than m shared pairs are skipped outright. Collisions are counted on
the whole signature, pairs below m are dropped, and the rest is confirmed on the full shingle sets.

Copies collapse to one class first. Within a posting list every document is paired with the list's smallest one only;
in lists that such stars leave apart, signatures are compared blockwise. Families are what agreeing signatures connect, not
what shares a posting list: lists meet by chance in large corpora and would make one family of most documents. Within a family
texts are compared, stars first and then blockwise what these leave apart, so that no link is lost and no list is expanded
into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweft.llm.common import chunks, materialize, mix64, slot, slots_of, stream64, word_hashes
from lumenweft.llm.components import components
from lumenweft.session import ship

COORDINATES = 64
#: The chance that a pair just at the threshold has fewer matches than are asked for, and is lost.
MISS = 1e-9
#: Load of a block of the exact comparison: its shingles, and so many more for each document; two blocks and the matrix
#: of their documents are held at once.
BLOCK_LOAD, DOCUMENT_LOAD = 240_000, 300
#: Load of a signature, so that a block has about 2,000, and bytes of the matrix of agreements that is held at once.
SIGNATURE_LOAD, MATRIX_BYTES = 120, 1 << 22


def matches_for(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most matches to ask for so that a pair of that similarity has fewer with a chance of ``miss`` at most."""
    chance = 0.0
    for m in range(coordinates + 1):
        chance += math.comb(coordinates, m) * similarity**m * (1 - similarity) ** (coordinates - m)
        if chance > miss:
            return max(1, m)
    return coordinates


def shingle_sets(offsets: np.ndarray, data: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, and where each document's begin (n + 1)."""
    hashes, first = word_hashes(offsets, data)
    n = np.diff(first)
    seeds = stream64(words, 2) | np.uint64(1)
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        rolled += hashes[k : k + len(rolled)] * seeds[k]
    rolled = mix64(rolled)
    parts = []
    for a, size in zip(first[:-1].tolist(), n.tolist(), strict=True):
        if size >= words:
            parts.append(np.unique(rolled[a : a + size - words + 1]))
        elif size:
            parts.append(mix64((hashes[a : a + size] * seeds[:size]).sum(dtype=np.uint64, keepdims=True) + np.uint64(size)))
        else:
            parts.append(rolled[:0])
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return (np.concatenate(parts) if parts else rolled[:0]), at


def signatures(sets: np.ndarray, at: np.ndarray, coordinates: int) -> np.ndarray:
    """The upper 32 bits of each coordinate's minimum, one row per non-empty set."""
    some = np.flatnonzero(np.diff(at))
    out = np.empty((len(some), coordinates), np.int32)
    factors, shifts = stream64(coordinates, 5) | np.uint64(1), stream64(coordinates, 6)
    if len(some):
        for k in range(coordinates):
            out[:, k] = (np.minimum.reduceat(sets * factors[k] + shifts[k], at[some]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _signer(words: int, coordinates: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = stream64(1, 9)
        for batch in batches:
            for first, end, offsets, data in chunks(batch):
                sets, at = shingle_sets(offsets, data, words)
                sizes = np.diff(at)
                some = sizes > 0
                rows = signatures(sets, at, coordinates)
                key = np.zeros((end - first, 2), np.uint64)
                if some.any():
                    begins = at[:-1][some]
                    key[some, 0] = mix64(np.add.reduceat(sets, begins) + sizes[some].astype(np.uint64))
                    key[some, 1] = np.add.reduceat(mix64(sets ^ salt), begins)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), end - first, [None, pa.py_buffer(key.tobytes())]).cast(pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some)]).astype(np.int32) * coordinates), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(sizes), packed, lists], ["id", "n_shingles", "cls", "sig"])

    return sign


def _confirmer(words: int, num: int, den: int):
    """Rows sorted by (lead, salt, role): a leader's texts come first, then those to compare with it, one at a time."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, held = None, []
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            found = []
            for first, end, offsets, data in chunks(batch):
                sets, at = shingle_sets(offsets, data, words)
                for k in range(first, end):
                    own = sets[at[k - first] : at[k - first + 1]]
                    a, salt, role, v = (int(c[k]) for c in columns)
                    if lead != (a, salt):
                        lead, held = (a, salt), []
                    if role == 0:
                        held.append(own.copy())
                    else:
                        for other in held:
                            both = len(np.intersect1d(own, other, assume_unique=True))
                            if den * both >= num * (len(own) + len(other) - both):
                                found.append((a, v))
                                break
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["u", "v"])

    return confirm


def linked_pairs(sets: list[np.ndarray], groups: np.ndarray, sides: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """All pairs (i < j) of different groups and, if there are two sides, of different sides, that are similar enough.

    Intersections are counted exactly, as a product of 0/1 matrices over the shingles that two sets share at least.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    ids = np.cumsum(new) - 1
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    shared = counts >= 2
    column = np.cumsum(shared) - 1
    keep = shared[ids] if len(ids) else np.zeros(0, bool)
    rows, cols = owner[keep], column[ids[keep]]
    both = np.zeros((n, n), np.float32)
    width = 4096
    cuts = np.searchsorted(cols, np.arange(0, (cols[-1] if len(cols) else -1) + width + 1, width))
    for k in range(len(cuts) - 1):
        part = np.zeros((n, width), np.float32)
        part[rows[cuts[k] : cuts[k + 1]], cols[cuts[k] : cuts[k + 1]] - k * width] = 1
        both += part @ part.T
    two, out = len(np.unique(sides)) > 1, []
    for i in range(n):
        row = both[i, i + 1 :].astype(np.int64)
        ok = (den * row >= num * (sizes[i] + sizes[i + 1 :] - row)) & (groups[i + 1 :] != groups[i])
        if two:
            ok &= sides[i + 1 :] != sides[i]
        out += [(i, i + 1 + j) for j in np.flatnonzero(ok).tolist()]
    return out


def linking_signatures(rows: np.ndarray, groups: np.ndarray, sides: np.ndarray, matches: int) -> list[tuple[int, int]]:
    """Pairs that agree on ``matches`` coordinates at least, of different groups and, if there are two sides, of different
    sides: only so many as connect the groups that all such pairs connect."""
    n = len(rows)
    columns = np.ascontiguousarray(rows.T)
    label = np.unique(groups, return_inverse=True)[1]
    two, out, step = len(np.unique(sides)) > 1, [], max(1, MATRIX_BYTES // max(1, n))
    for a in range(0, n, step):
        b = min(n, a + step)
        same = np.zeros((b - a, n), np.uint8)
        for column in columns:
            same += column[a:b, None] == column
        for i in range(a, b):
            ok = same[i - a] >= matches
            if two:
                ok &= sides != sides[i]
            near = np.flatnonzero(ok)
            while len(near := near[label[near] != label[i]]):
                out.append((i, int(near[0])))
                label[label == label[near[0]]] = label[i]
    return out


def _signature_comparer(matches: int):
    """As ``_block_comparer``, of signatures."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def finish() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            sides, comps, nodes, rows = zip(*held, strict=True)
            pairs = linking_signatures(np.array(rows), np.array(comps, np.int64), np.array(sides, np.int64), matches)
            return [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for i, j in pairs]

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["u", "v"])

        for batch in batches:
            found = []
            flat, at = batch.column(6).flatten().to_numpy(), np.append(0, np.cumsum(batch.column(6).value_lengths().to_numpy()))
            for k, (*pair, side, comp, v) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True)):
                if pair != key:
                    found += finish()
                    key, held = pair, []
                held.append((side, comp, v, flat[at[k] : at[k + 1]]))
            yield batch_of(found)
        yield batch_of(finish())

    return compare


def _block_comparer(words: int, num: int, den: int):
    """Rows sorted by block pair; a pair of blocks is compared as soon as all its rows are there."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def finish() -> pa.RecordBatch:
            nodes = [x[2] for x in held]
            pairs = linked_pairs([x[3] for x in held], np.array([x[1] for x in held], np.int64), np.array([x[0] for x in held], np.int64), num, den) if held else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in pairs], pa.int64()), pa.array([nodes[j] for _, j in pairs], pa.int64())], ["u", "v"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for first, end, offsets, data in chunks(batch):
                sets, at = shingle_sets(offsets, data, words)
                for k in range(first, end):
                    *pair, side, comp, v = (c[k] for c in columns)
                    if pair != key:
                        yield finish()
                        key, held = pair, []
                    held.append((side, comp, v, sets[at[k - first] : at[k - first + 1]].copy()))
        yield finish()

    return compare


def _between_blocks(nodes: DataFrame, contents: DataFrame, column: str, comparer) -> DataFrame:
    """Links (u, v) between the components of a family: ``nodes`` (family, component, v, n) are dealt to blocks of bounded
    load, and each pair of blocks of a family is compared, but for those of one and the same component. ``contents`` has id
    and the ``column`` to compare."""
    loads = nodes.groupBy("family", "component").agg(F.sum("n").alias("load")).withColumn("own", F.ceil(F.col("load") / BLOCK_LOAD))
    small = loads.where("own <= 1").groupBy("family").agg(F.ceil(F.sum("load") / BLOCK_LOAD).alias("slots"))
    placed = nodes.join(loads, ["family", "component"]).join(small, "family", "left")
    placed = placed.select(
        "family", "component", "v",
        F.when(F.col("own") > 1, F.col("component")).otherwise(-1).alias("sole"),
        F.when(F.col("own") > 1, F.pmod(F.xxhash64("v"), "own")).otherwise(F.pmod(F.xxhash64("component"), F.coalesce("slots", F.lit(1)))).alias("slot"),
    ).withColumn("block", F.xxhash64("sole", "slot"))
    placed = materialize(placed, "placed")
    blocks = placed.select("family", "block", "sole").distinct()
    one, two = blocks.select("family", F.col("block").alias("i"), F.col("sole").alias("one")), blocks.select("family", F.col("block").alias("j"), F.col("sole").alias("two"))
    tasks = one.join(two, "family").where("i <= j and (one <> two or one = -1)").select("family", "i", "j")
    seated = placed.join(contents, placed.v == contents.id).select("family", "block", "component", "v", column)
    left = tasks.join(seated.withColumnRenamed("block", "i"), ["family", "i"]).select("family", "i", "j", F.lit(0).alias("side"), "component", "v", column)
    right = tasks.where("i < j").join(seated.withColumnRenamed("block", "j"), ["family", "j"]).select("family", "i", "j", F.lit(1).alias("side"), "component", "v", column)
    return left.union(right).repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(comparer, "u long, v long")


def _agreeing_in_lists(prefix: DataFrame, joined: DataFrame, sig: DataFrame, matches: int) -> DataFrame:
    """Links (u, v) of agreeing signatures between the components (``joined``) of each posting list. Lists of the same
    documents are compared once. Compared is a byte of each coordinate, which agrees wherever the whole does."""
    listed = prefix.join(joined.withColumnRenamed("node", "v"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    lists = listed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("v")).alias("one"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("two"),
    )
    apart = lists.where("low <> high").groupBy("n", "one", "two").agg(F.min("key").alias("key")).select("key")
    nodes = materialize(listed.join(apart, "key").select(F.col("key").alias("family"), "component", "v", F.lit(SIGNATURE_LOAD).alias("n")), "lists")
    short = sig.select(F.col("v").alias("id"), F.transform("sig", lambda x: (x.bitwiseAND(255) - 128).cast("tinyint")).alias("sig"))
    return _between_blocks(nodes, short, "sig", _signature_comparer(matches))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, coordinates: int = COORDINATES, matches: int | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; more columns are ignored).

    Documents are linked if ``den * intersection >= num * union`` of their distinct shingles of ``words`` words; with
    fewer words the whole sequence is one shingle. Null or blank texts have no shingles and no links. Rows of the same
    text are one node, named by its smallest doc_id, and so are the rows of one doc_id: if it stands with several texts, they
    are linked. Repeated rows change nothing. A row without doc_id is returned
    with a null component and kept. An empty table gives an empty result. doc_id is a whole number. Two signatures have to
    agree on ``matches`` coordinates to be compared, ``matches_for`` the threshold unless given.
    """
    matches = matches or matches_for(num / den, coordinates)
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    signed = materialize(rows.mapInArrow(_signer(words, coordinates), "id long, n_shingles long, cls binary, sig array<int>"), "signed")
    some = signed.where("n_shingles > 0 and id is not null")
    classes = materialize(some.groupBy("cls").agg(F.min("id").alias("v"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")), "classes")

    # Postings of each signature, those without a partner skipped, each document's rarest first.
    posted = classes.select("v", F.posexplode("sig").alias("at", "value")).select("v", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long") + F.lit(1 << 31)).alias("key"))
    # Stored, so that a pair that very many documents have is a skewed part of a join by itself, which Spark cuts up.
    counted = materialize(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counted")
    shared = posted.join(counted, "key").groupBy("v").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("keys")).where(F.size("keys") >= matches)
    # A signature's pairs of its own are the rarest of all and take up prefix places.
    prefix = materialize(shared.select("v", F.explode(F.slice("keys", F.lit(1), F.size("keys") - (matches - 1))).alias("k")).select("v", "k.key"), "prefix")

    # Stars: each list's smallest document against the others; collisions counted on the whole signature.
    leads = materialize(prefix.groupBy("key").agg(F.min("v").alias("u")), "leads")
    stars = materialize(prefix.join(leads, "key").where("u <> v").select("u", "v").distinct(), "stars")
    sig = classes.select("v", "sig")
    agreeing = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda same: same))
    starred = slots_of(stars.select("u").union(stars.select(F.col("v").alias("u"))), "u")
    sig = materialize(sig.join(starred, slot(sig.v) == starred.slot, "left_semi"), "sig")
    pairs = (
        stars.join(sig.select("v", F.col("sig").alias("a")), "v")
        .join(sig.select(F.col("v").alias("u"), F.col("sig").alias("b")), "u")
        .where(agreeing >= matches)
        .select("u", "v")
        .distinct()
    )
    pairs = materialize(pairs, "pairs")

    # Families: what agreeing signatures connect, of the stars and then of the lists that these leave apart.
    agreed = materialize(components(pairs, "agreed"), "agreed")
    pairs = materialize(pairs.union(_agreeing_in_lists(prefix, agreed, sig, matches)).distinct(), "pairs")
    families = materialize(components(pairs, "families"), "families")
    slots = slots_of(families, "node")

    # Texts of documents that agree with another one; the others need no further look.
    likely = rows.join(slots, slot(rows.id) == slots.slot, "left_semi")
    texts = materialize(likely.join(families.select(F.col("node").alias("id")), "id", "left_semi"), "texts")
    weights = pairs.groupBy("u").agg(F.ceil(F.count("*") / 64).alias("salts"))
    salted = pairs.join(weights, "u").withColumn("salt", F.pmod(F.xxhash64("v"), "salts"))
    members = salted.join(texts, salted.v == texts.id).select("u", "salt", F.lit(1).alias("role"), "v", "text")
    own = salted.select("u", "salt").distinct()
    own = own.join(texts, own.u == texts.id).select("u", "salt", F.lit(0).alias("role"), F.col("u").alias("v"), "text")
    edges = own.union(members).repartition("u", "salt").sortWithinPartitions("u", "salt", "role").mapInArrow(_confirmer(words, num, den), "u long, v long")
    joined = materialize(components(materialize(edges, "edges"), "joined"), "joined")

    # What the stars left apart within a family is compared block by block; blocks of one component skip each other.
    nodes = families.withColumnRenamed("node", "v").withColumnRenamed("component", "family").join(joined.withColumnRenamed("node", "v"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    nodes = nodes.join(classes.groupBy("v").agg((F.max("n") + DOCUMENT_LOAD).alias("n")), "v")
    apart = nodes.groupBy("family").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("family")
    nodes = materialize(nodes.join(apart, "family").select("family", "component", "v", "n"), "apart")
    of = joined.withColumnRenamed("node", "u").withColumnRenamed("component", "c")
    every = families.select(F.col("node").alias("v")).join(joined.withColumnRenamed("node", "v"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    if nodes.isEmpty():
        final = every
    else:
        late = materialize(_between_blocks(nodes, texts, "text", _block_comparer(words, num, den)), "late")
        bridges = late.join(of, "u", "left").select(F.coalesce("c", "u").alias("a"), "v").join(of.select(F.col("u").alias("v"), "c"), "v", "left").select(F.col("a").alias("u"), F.coalesce("c", "v").alias("v"))
        merged = components(bridges, "merged").select(F.col("node").alias("component"), F.col("component").alias("final"))
        final = every.join(merged, "component", "left").select("v", F.coalesce("final", "component").alias("component"))
    named = classes.select("cls", "v").join(final, "v", "left").select("cls", F.coalesce("component", "v").alias("component"))
    out = signed.select("id", "n_shingles", "cls").join(named, "cls", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op1(docs: DataFrame) -> DataFrame:
    """Three-word shingles, linked at a similarity of 85 of 100; see ``near_duplicates``."""
    return near_duplicates(docs, words=3, num=85, den=100).withColumnRenamed("id", "doc_id")
