"""Building a vector store: validation, import, incremental rebuild, fingerprints, model boundaries."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweft import fixed
from lumenweft.functions import text as T
from lumenweft.functions import vectors as V
from lumenweft.session import ship

#: Texts embedded at a time.
BATCH = 96


def clean_features(paragraph: Column, keywords: Column, scores: Column) -> tuple[Column, Column, Column, Column]:
    """(valid, paragraph, keywords, scores): trimmed and lower-cased; scores is a map of axis to number.

    Valid: a paragraph, five to eight keywords and none blank, exactly the axes, all between 0 and 1.
    """
    text = T.strip(paragraph)
    words = F.transform(keywords, lambda k: F.lower(T.strip(k)))
    axes = F.array(*(F.lit(a) for a in fixed.AXES))
    same = (F.size(F.array_except(F.map_keys(scores), axes)) == 0) & (F.size(F.array_except(axes, F.map_keys(scores))) == 0)
    inside = F.forall(F.map_values(scores), lambda v: F.coalesce(~F.isnan(v) & v.between(0.0, 1.0), F.lit(False)))
    good = (text != "") & F.size(keywords).between(5, 8) & F.forall(words, lambda w: F.coalesce(w != "", F.lit(False))) & same & inside
    return F.coalesce(good, F.lit(False)), text, words, scores


def inspect(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """One row: rows, invalid vectors, least and largest width, ids that occur more than once."""
    ids = df.groupBy(id_col).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_ids"))
    sizes = df.agg(F.count("*").alias("n_rows"), F.count_if(~V.valid(F.col(vector))).alias("invalid"), F.min(F.size(vector)).cast("long").alias("least_width"), F.max(F.size(vector)).cast("long").alias("largest_width"))
    return sizes.crossJoin(F.broadcast(ids))


def repeated_ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, id_col: str) -> DataFrame:
    """``df``, or ValueError if an id repeats."""
    if repeated_ids(df, id_col).limit(1).count():
        raise ValueError(f"{id_col} has repeated values.")
    return df


def import_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``df`` with unit vectors as floats; ValueError for invalid or ragged vectors or repeated ids."""
    seen = inspect(df, id_col, vector).first()
    if not seen.n_rows or seen.invalid or seen.least_width != seen.largest_width or seen.repeated_ids:
        raise ValueError(f"The vectors can't be imported: {seen.asDict()}")
    return df.withColumn(vector, V.normalized(F.col(vector)))


def last_per_hash(prior: DataFrame, order: str) -> DataFrame:
    return prior.withColumn("_rn", F.row_number().over(Window.partitionBy("hash").orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")


def reusable(prior: DataFrame, metadata: dict | None, version: int, model: str, width: int) -> DataFrame:
    """Rows of an earlier store (hash, ordinal, payload) that may be taken over: none if version, model or width differ,
    else those with a valid vector, at unit length."""
    same = metadata is not None and (metadata.get("version"), metadata.get("model"), metadata.get("width")) == (version, model, width)
    good = V.valid(F.col("payload")) & (F.size("payload") == width) & F.col("hash").isNotNull()
    return prior.where(good if same else F.lit(False)).withColumn("payload", V.normalized(F.col("payload")))


def incremental(source: DataFrame, prior: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """``source`` (ordinal, hash, ...) with ``status``: reused from ``prior``, cached in ``checkpoint``, or pending.

    Prior and checkpoint (hash, ordinal, payload) count once a hash, the last row; the prior store goes first.
    """
    old = last_per_hash(prior, "ordinal").select("hash", F.col("payload").alias("old"), F.lit(True).alias("has_old"))
    saved = last_per_hash(checkpoint, "ordinal").select("hash", F.col("payload").alias("saved"), F.lit(True).alias("has_saved"))
    joined = source.join(old, "hash", "left").join(saved, "hash", "left")
    status = F.when(F.col("has_old"), "reused").when(F.col("has_saved"), "cached").otherwise("pending")
    return joined.withColumn("status", status).withColumn("payload", F.coalesce("old", "saved")).drop("old", "saved", "has_old", "has_saved")


def build_stats(built: DataFrame) -> DataFrame:
    return built.agg(F.count_if(F.col("status") == "reused").alias("reused"), F.count_if(F.col("status") == "cached").alias("cached"), F.count_if(F.col("status") == "pending").alias("pending"), F.count("*").alias("total"))


#: From texts to vectors, or to pairs (index of the text, vector) in any order.
Model = Callable[[list[str]], list]


def stub_embedder(width: int = 16) -> Model:
    """A deterministic stand-in for a model: digest bytes as coordinates."""

    def embed(texts: list[str]) -> list[list[float]]:
        return [[b / 127.5 - 1.0 for b in (hashlib.sha256(t.encode()).digest() * (width // 32 + 1))[:width]] for t in texts]

    return embed


def in_order(answers: list, n: int) -> list:
    """A model's answers in the order of its texts; pairs (index, answer) are put in order. ValueError unless there is
    exactly one for each text."""
    if answers and all(isinstance(a, tuple) and len(a) == 2 and isinstance(a[0], int) for a in answers):
        answers = sorted(answers, key=lambda a: a[0])
        if [i for i, _ in answers] != list(range(n)):
            raise ValueError("The model's answers don't match its texts: an index is missing, repeated or out of range.")
        return [v for _, v in answers]
    if len(answers) != n:
        raise ValueError("The model's answers don't match its texts.")
    return list(answers)


def answer_order(answers: DataFrame) -> DataFrame:
    """(batch, n, contiguous, answers) for answers (batch, index, answer) in any order: sorted by index, and whether the
    indexes are exactly 0 to n - 1. Null indexes never are."""
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col("index").alias("index"), F.col("answer").alias("answer"))))
    n, kinds = F.count("*"), F.count_distinct("index")
    good = F.coalesce((F.min("index") == 0) & (F.max("index") == n - 1) & (kinds == n), F.lit(False))
    return answers.groupBy("batch").agg(n.alias("n"), good.alias("contiguous"), F.transform(sorted_, lambda a: a.answer).alias("answers"))


def _unit_vectors(vectors: list, width: int | None) -> list[list[float]]:
    out = []
    for v in vectors:
        length = sum(x * x for x in v) ** 0.5
        if not 0 < length < float("inf") or len(v) != (width or len(v)):
            raise ValueError("The model returned an invalid vector.")
        out.append([x / length for x in v])
    return out


def embed(df: DataFrame, payload: str, model: Model, batch: int = BATCH, width: int | None = None, keep_errors: bool = False) -> DataFrame:
    """``df`` with ``embedding``, the model called on ``batch`` texts at a time; its answers must match its texts.

    With ``keep_errors`` a call that fails gives its rows a null vector and the reason in ``embedding_error``; else it fails
    the query.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

    ship(df.sparkSession)
    added = [StructField("embedding", ArrayType(FloatType())), *[StructField("embedding_error", StringType())] * keep_errors]
    place = df.columns.index(payload)
    schema = StructType([*df.schema.fields, *added])
    arrow = to_arrow_schema(StructType(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[list[float] | None] = []
            errors: list[str | None] = []
            texts = [t or "" for t in rows.column(place).to_pylist()]
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch]
                try:
                    out += _unit_vectors(in_order(model(some), len(some)), width)
                    errors += [None] * len(some)
                except Exception as why:
                    if not keep_errors:
                        raise
                    out += [None] * len(some)
                    errors += [f"{type(why).__name__}: {why}"] * len(some)
            new = [pa.array(c, f.type) for c, f in zip((out, errors), arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *new], names=schema.names)

    return df.mapInArrow(run, schema)


def fingerprint(**parts: object) -> str:
    """sha256 of versions, models and widths, whatever their order."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def store_is_current(store: DataFrame, metadata: DataFrame, expected: str, id_col: str, vector: str) -> DataFrame:
    """One row, ``current``: fingerprint and count as in the metadata, ids unique, vectors of one width and unit length."""
    meta = metadata.select("fingerprint", "n").limit(1)
    seen = inspect(store, id_col, vector).crossJoin(store.agg(F.count_if(~F.coalesce(V.unit(F.col(vector)), F.lit(False))).alias("not_unit")))
    same = (F.col("fingerprint") == expected) & (F.col("n") == F.col("n_rows")) & (F.col("repeated_ids") == 0) & (F.col("invalid") == 0) & (F.col("not_unit") == 0) & (F.col("least_width") == F.col("largest_width"))
    return seen.crossJoin(meta).select(F.coalesce(same, F.lit(False)).alias("current"))
