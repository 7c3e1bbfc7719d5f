"""The full build of a store of stories: features and vectors by models, with everything reused that has not changed.

Results of the feature model are durable before any vector is made: they are appended to a checkpoint that the next build
reads, so a build that fails is taken up where it stopped. Each call to a model is made once, as its results are stored
before they are looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweft.functions import text as T
from lumenweft.functions import vectors as V
from lumenweft.operators import build
from lumenweft.plans import assistant
from lumenweft.plans import store as stores
from lumenweft.session import delete, scratch

CHECKPOINT_VERSION = 1
FEATURES = ("rich_descriptive_paragraph", "keywords", "emotional_scores")
#: Failures that an error names.
EXAMPLES = 5


@dataclass(frozen=True)
class Models:
    """What makes features and vectors, by name; a store is only reused where the names and the width are the same."""

    generate: assistant.Generate
    embed: build.Model
    feature_model: str
    embedding_model: str
    width: int


def source_fingerprint(source: DataFrame, models: Models) -> str:
    """Changes with any row of ``source``, the models, the width or the store's format; not with the order of rows."""
    columns = [F.col(f"`{c}`") for c in sorted(source.columns)]
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    seen = source.agg(F.count("*").alias("n"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), row)).alias("b")).first()
    return build.fingerprint(version=stores.VERSION, n=seen.n, a=str(seen.a), b=seen.b, features=models.feature_model, embedding=models.embedding_model, width=models.width)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _payload(rows: DataFrame, embedding) -> DataFrame:
    """(hash, ordinal, payload) of the rows whose features are valid, cleaned."""
    good, paragraph, keywords, scores = build.clean_features(*(F.col(c) for c in FEATURES))
    payload = F.struct(*(c.alias(n) for c, n in zip((paragraph, keywords, scores), FEATURES, strict=True)), embedding.alias("embedding"))
    return rows.where(good).select("hash", "ordinal", payload.alias("payload"))


def reusable_entries(spark: SparkSession, path: str, models: Models) -> DataFrame:
    """(hash, ordinal, payload) that the published store has to offer: none if it was made in another way, else the rows with
    valid features, a search text and a valid vector."""
    empty = spark.createDataFrame([], "hash string, ordinal long, payload struct<rich_descriptive_paragraph:string,keywords:array<string>,emotional_scores:map<string,double>,embedding:array<float>>")
    meta = stores.published(spark, path)
    same = meta is not None and (meta.version, meta.feature_model, meta.model, meta.width) == (stores.VERSION, models.feature_model, models.embedding_model, models.width)
    if not same:
        return empty
    rows = spark.read.parquet(meta.rows).withColumn("hash", F.col("source_record_hash"))
    good = V.valid(F.col("embedding")) & (F.size("embedding") == models.width) & (T.blank(F.col("hash")) != "") & (T.strip(T.blank(F.col("search_payload"))) != "")
    return _payload(rows.where(good), V.normalized(F.col("embedding")))


def compact_checkpoint(spark: SparkSession, path: str) -> int:
    """Rewrites the checkpoint's many small tables as one, the last good row of each hash and model; returns its rows.

    The builds that append to the checkpoint meanwhile lose nothing: only the tables that were read are deleted, once the
    new one is in place, and rows that stand in both count once anyway.
    """
    folder = f"{path}/checkpoint"
    table = stores.table_or_none(spark, folder)
    if table is None:
        return 0
    old = table.inputFiles()
    last = Window.partitionBy("hash", "feature_model", "cache_version").orderBy(F.desc("ordinal"))
    kept = spark.read.schema(table.schema).parquet(*old).withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth")
    kept = _stored(kept, "compacted")
    n = kept.count()
    kept.coalesce(max(1, len(old) // 64)).write.mode("append").parquet(folder)
    for file in old:
        delete(spark, file)
    return n


def cached_entries(spark: SparkSession, path: str, models: Models) -> DataFrame:
    """(hash, ordinal, payload) of the checkpoint: valid features of the same model and format, without vectors."""
    table = stores.table_or_none(spark, f"{path}/checkpoint")
    if table is None:
        table = spark.createDataFrame([], f"hash string, ordinal long, {assistant.FEATURES}, cache_version int, feature_model string")
    mine = table.where((F.col("cache_version") == CHECKPOINT_VERSION) & (F.col("feature_model") == models.feature_model) & F.col("hash").isNotNull())
    return _payload(mine, F.lit(None).cast("array<float>"))


def _fail(rows: DataFrame, error: str, what: str, kept: str) -> None:
    failed = rows.where(F.col(error).isNotNull())
    n = failed.count()
    if n:
        examples = "; ".join(f"#{r.ordinal} {r.title!r}: {r[error]}" for r in failed.orderBy("ordinal").limit(EXAMPLES).collect())
        raise ValueError(f"{what} failed for {n} stories. {kept} Examples: {examples}")


def build_store(source: DataFrame, path: str, models: Models, batch: int = build.BATCH) -> dict:
    """Builds the store at ``path`` from stories (ordinal, title, summary; record_id and cmu_id if given); returns counts.

    Nothing is done if the published store was made from the same rows in the same way. Else each story's features come from
    that store, from the checkpoint, or from the feature model, its vector from that store or the embedding model, and all
    are published together. If a call fails, ValueError: what the feature model made so far is in the checkpoint, the store
    stays as it was. Repeated record ids and an empty source are errors as well.
    """
    spark = source.sparkSession
    for c in ("record_id", "cmu_id"):
        if c not in source.columns:
            source = source.withColumn(c, F.lit(None).cast("string"))
    mark = source_fingerprint(source, models)
    meta = stores.published(spark, path)
    if meta is not None and meta.fingerprint == mark:
        rows = spark.read.parquet(meta.rows)
        facts = spark.range(1).select(F.lit(meta.fingerprint).alias("fingerprint"), F.lit(meta.n).alias("n"))
        if build.store_is_current(rows, facts, mark, "record_id", "embedding").first().current:
            return {"current": True, "reused": meta.n, "cached": 0, "pending": 0, "total": meta.n}
    title, summary = F.col("title"), F.col("summary")
    named = source.withColumn("hash", T.content_hash(title, summary)).withColumn("record_id", T.stable_id(F.col("record_id"), F.col("cmu_id"), F.col("ordinal"), title, summary))
    if not build.require_unique(named, "record_id").limit(1).count():
        raise ValueError("There are no stories.")
    state = _stored(build.incremental(named, reusable_entries(spark, path, models), cached_entries(spark, path, models)), "state")
    pending = state.where("status = 'pending'").drop("payload")
    made = _stored(assistant.extract_features(pending, models.generate), "features")
    good = made.where("error is null").dropDuplicates(["hash"])
    good = good.select("hash", "ordinal", *FEATURES, "error", F.lit(CHECKPOINT_VERSION).alias("cache_version"), F.lit(models.feature_model).alias("feature_model"))
    if good.limit(1).count():
        good.write.mode("append").parquet(f"{path}/checkpoint")
    _fail(made, "error", "Feature extraction", "The store is as it was; the features made are in the checkpoint.")
    known = state.where("status <> 'pending'").select(*named.columns, "status", *(F.col("payload")[c].alias(c) for c in FEATURES), F.col("payload")["embedding"].alias("embedding"))
    new = made.drop("error").withColumn("embedding", F.lit(None).cast("array<float>"))
    done = assistant.processed(known.unionByName(new)).drop("hash")
    fresh = build.embed(done.where("embedding is null").drop("embedding"), "search_payload", models.embed, batch, models.width, keep_errors=True)
    fresh = _stored(fresh, "embedded")
    _fail(fresh, "embedding_error", "Embedding", "The store is as it was; the features are in the checkpoint.")
    rows = done.where("embedding is not null").unionByName(fresh.drop("embedding_error").select(*done.columns))
    stores.write_store(rows, path, models.embedding_model, mark, feature_model=models.feature_model)
    return {"current": False} | build.build_stats(state).first().asDict()
