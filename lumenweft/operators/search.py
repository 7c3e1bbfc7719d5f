"""Vector and lexical retrieval."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweft.functions import text as T
from lumenweft.functions import vectors as V
from lumenweft.session import scratch, ship

#: Vectors up to this width are scored with an unrolled expression.
UNROLLED = 256
MOST_QUERY_CHARACTERS, MOST_CANDIDATES = 4000, 5


def check_search(prompt: object, top_k: object) -> str:
    """The canonical query, or ValueError."""
    if not isinstance(prompt, str):
        raise ValueError("The query must be text.")
    if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 1:
        raise ValueError("top_k must be a positive integer.")
    query = T.canonical_query(prompt)
    if not query:
        raise ValueError("The query is empty.")
    if len(query) > MOST_QUERY_CHARACTERS:
        raise ValueError(f"The query is longer than {MOST_QUERY_CHARACTERS} characters.")
    return query


def accepted(query: Column, top_k: Column) -> Column:
    """The same guards for columns: a canonical query that is not empty nor too long, and a positive number of results."""
    return F.coalesce(F.length(query).between(1, MOST_QUERY_CHARACTERS) & (top_k >= 1), F.lit(False))


def vector_top_k(store: DataFrame, query: list[float], k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows of largest dot product with one query vector, ties by id; ``vector_similarity`` is clipped to [-1, 1].

    The query is a literal, so the plan is one scan and a top-k merge. Rows without a valid vector of its width (null, not
    finite, of length zero) are none of the results.
    """
    v = F.col(vector)
    score = V.dot_literal(v, query) if len(query) <= UNROLLED else V.dot(v, F.array(*(F.lit(float(q)) for q in query)))
    some = F.exists(v, lambda x: x != 0)
    scored = store.where((F.size(v) == len(query)) & some).withColumn("_score", score).where(F.abs("_score") < float("inf"))
    return scored.orderBy(F.desc("_score"), id_col).limit(k).withColumn("vector_similarity", V.clamp(F.col("_score"), -1.0)).drop("_score")


#: Bytes of queries that a task holds at a time; queries whose scores are held at a time.
QUERY_BYTES, SCORED_AT_ONCE = 32 << 20, 256
BATCHED = "query_id long, id long, score double"


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of each row with their ids, ties by smaller id."""
    if scores.shape[1] > k:
        # Rows whose k-th score is tied over the cut are cut by id, the others by score alone.
        part = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(scores, part, 1).min(axis=1, keepdims=True)
        for row in np.flatnonzero((scores >= least).sum(axis=1) > k):
            part[row] = np.lexsort((ids[row], -scores[row]))[:k]
        ids, scores = np.take_along_axis(ids, part, 1), np.take_along_axis(scores, part, 1)
    order = np.lexsort((ids, -scores), axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _batch_scorer(k: int):
    """Rows (part of the queries, kind, id, vector), sorted: the queries of a part come first, then the store's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, asked, queries, held = None, [], [], np.zeros((0, 0)), []

        def finish() -> Iterator[pa.RecordBatch]:
            for at, (found, scores) in held:
                own = np.repeat(asked[at : at + SCORED_AT_ONCE], found.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(found.ravel()), pa.array(scores.ravel())], ["query_id", "id", "score"])

        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            vectors = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for p in np.unique(keys[0]).tolist():
                if p != part:
                    yield from finish()
                    part, ids, asked, held = p, [], [], []
                mine = keys[0] == p
                new = mine & (keys[1] == 0)
                if new.any():
                    ids.append((keys[2][new], vectors[new]))
                rows = mine & (keys[1] == 1)
                if not rows.any():
                    continue
                if ids and not len(asked):
                    asked, queries = np.concatenate([i for i, _ in ids]), np.concatenate([v for _, v in ids])
                    held = [(at, (np.zeros((len(queries[at : at + SCORED_AT_ONCE]), 0), np.int64), np.zeros((len(queries[at : at + SCORED_AT_ONCE]), 0)))) for at in range(0, len(queries), SCORED_AT_ONCE)]
                for n, (at, best) in enumerate(held):
                    scores = queries[at : at + SCORED_AT_ONCE] @ vectors[rows].T
                    own = best_of(np.broadcast_to(keys[2][rows], scores.shape), scores, k)
                    held[n] = at, best_of(np.hstack([best[0], own[0]]), np.hstack([best[1], own[1]]), k)
        yield from finish()

    return run


def vector_top_k_batch(store: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", store_parts: int | None = None) -> DataFrame:
    """(query_id, id, rank, score): the k best rows of ``store`` for each row (query_id, vector) of ``queries``.

    A query that is null, invalid or of another width than the store has no result; invalid rows of the store are none of
    the results. Queries of one id that repeat count once. Both sides are cut into parts that meet pairwise, each pair in one
    task: a part of the queries has QUERY_BYTES at most and is sent to ``store_parts`` tasks, the store once for each part of
    the queries. Nothing passes through the driver; a task keeps k rows for each of its queries.
    """
    spark = ship(store.sparkSession)
    facts = store.agg(F.max(F.size(vector)).alias("width"), F.count("*").alias("n")).first()
    width = facts.width or 0
    good = V.valid(F.col(vector)) & (F.size(vector) == F.lit(width))
    asked = queries.where(good & F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("id"), V.doubles(F.col(vector)).alias("v")).dropDuplicates(["id"])
    n_asked = asked.count()
    if not n_asked or width < 1:
        return spark.createDataFrame([], "query_id long, id long, rank int, score double")
    query_parts = -(-n_asked * 8 * width // QUERY_BYTES)
    parts = store_parts or max(1, min(spark.sparkContext.defaultParallelism, -(-facts.n // 10_000)), -(-facts.n * 8 * width // (256 << 20)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = asked.select(own(query_parts).alias("q"), every(parts).alias("s"), F.lit(0).alias("kind"), "id", "v")
    rows = store.where(good).select(F.col(id_col).cast("long").alias("id"), V.doubles(F.col(vector)).alias("v"))
    right = rows.select(every(query_parts).alias("q"), own(parts).alias("s"), F.lit(1).alias("kind"), "id", "v")
    both = left.unionByName(right).withColumn("part", F.col("q") * F.lit(parts) + F.col("s"))
    dealt = both.repartition(query_parts * parts, "part").sortWithinPartitions("part", "kind").select("part", "kind", "id", "v")
    out = dealt.mapInArrow(_batch_scorer(k), BATCHED)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "id", "rank", "score")


def term_frequencies(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, term, tf) of every term of every row."""
    return docs.select(F.col(id_col).alias("id"), F.explode(tokens).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(docs: DataFrame, tokens: Column) -> DataFrame:
    """(term, df): in how many rows a term is. Rows send each of their terms once, tasks each of theirs once."""
    return docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(total: Column, df: Column) -> Column:
    return F.log((1.0 + total) / (1.0 + df)) + 1.0


def story_tokens(title: Column, *others: Column) -> Column:
    """Terms of title and other texts; the title's count twice."""
    return F.concat(T.terms(F.concat_ws(" ", title, *others)), T.terms(title))


def lexical_top_k(docs: DataFrame, prompt: str, k: int, id_col: str, tokens: Column) -> DataFrame:
    """(id, score): TF-IDF cosine with one query over all rows, rows without a shared term included at 0.

    Ties go to the larger sha256 of query, null byte and id. Query terms that no row has count in the query's length.
    A query without terms gives no rows. Texts are cut into terms once: each row's terms are stored, and
    both document frequencies and lengths come from there; the query's own terms never leave their row.
    Frequencies are stored as well, so that they meet the terms in a join by itself: a very common term is a skewed part of
    that, which Spark cuts up.
    """
    spark = docs.sparkSession
    words = [w for w in spark.range(1).select(T.terms(F.lit(prompt)).alias("t")).first()[0]]
    if not words:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).where("false")
    counts = Counter(words)
    path = scratch(spark, "terms")
    docs.select(F.col(id_col).alias("id"), tokens.alias("tokens")).write.parquet(path)
    listed = spark.read.parquet(path)
    own = {t: F.col(f"c{j}") for j, t in enumerate(counts)}

    def times(term: str) -> Column:
        return F.size(F.filter("tokens", lambda x: x == term))

    of_query = [times(t).alias(f"c{j}") for j, t in enumerate(counts)]
    seen = listed.select(*of_query).agg(F.count("*").alias("n"), *(F.count_if(c > 0).alias(f"d{j}") for j, c in enumerate(own.values()))).first()
    weight = {t: math.log((1.0 + seen["n"]) / (1.0 + seen[f"d{j}"])) + 1.0 for j, t in enumerate(counts)}
    length = max(math.sqrt(sum((c * weight[t]) ** 2 for t, c in counts.items())), 1e-8)
    tf = term_frequencies(listed, "id", F.col("tokens"))
    frequencies = scratch(spark, "frequencies")
    document_frequencies(listed, F.col("tokens")).write.parquet(frequencies)
    squares = tf.join(spark.read.parquet(frequencies), "term").groupBy("id").agg(F.sum((F.col("tf") * idf(F.lit(float(seen["n"])), F.col("df"))) ** 2).alias("squares"))
    dot = sum((F.lit(counts[t] * weight[t] ** 2) * own[t] for t in counts), F.lit(0.0))
    scored = listed.select("id", *of_query).select("id", dot.alias("dot"))
    # Only rows that share a term need their length.
    matched = scored.where("dot > 0").join(squares, "id").select("id", (F.col("dot") / (F.lit(length) * F.greatest(F.sqrt("squares"), F.lit(1e-8)))).alias("score"))
    tie = F.sha2(F.concat(F.lit(prompt), F.lit("\x00"), F.col("id").cast("string")), 256)
    none = scored.where("dot = 0").select("id", F.lit(0.0).alias("score")).orderBy(F.desc(tie), F.desc("id")).limit(k)
    return matched.unionByName(none).orderBy(F.desc("score"), F.desc(tie), F.desc("id")).limit(k)
