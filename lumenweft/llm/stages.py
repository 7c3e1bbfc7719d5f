"""Stages of corpus preparation: each takes a table of documents and returns what it keeps of it, the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from lumenweft.llm import decontamination, minhash, mixing, quality, secrets
from lumenweft.llm.common import materialize, split_by, unused


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go: null and empty texts as well, as they are short.

    Repeated rows are judged each. Other columns, nulls in them included, change nothing. An empty table stays empty.
    """
    return quality.keep_good(docs)


def _sortable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _sortable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_sortable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the smallest doc_id stays, of its repeated rows one.

    Where a doc_id stands with different texts, each of them is a document of its own. Rows without doc_id, and texts
    without words, all stay. Of repeated rows the first by the other columns stays, as far as these can be sorted. An empty
    table stays empty.
    """
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    repeated = materialize(repeated, "repeated")
    node, digest, nth = (unused(docs.columns, c) for c in ("node", "digest", "nth"))

    def with_nodes(rows: DataFrame) -> DataFrame:
        """The number that a row's text goes by: its doc_id, or a hash of both if the doc_id is repeated."""
        again = repeated.withColumn(node, F.lit(True))
        return rows.join(again, "doc_id", "left").withColumn(node, F.when(F.col(node), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long")))

    clear, doubtful = split_by(docs, repeated, "doc_id")
    doubtful = with_nodes(doubtful)
    nodes = clear.select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(doubtful.select(F.col(node).alias("doc_id"), "text"))
    moved = minhash.near_duplicates(nodes).where("not kept").select("id", F.col("component_id").alias("component"))
    moved = materialize(moved.distinct(), "moved")
    members = moved.union(moved.select(F.col("component").alias("id"), "component").distinct())
    of = doubtful.select(F.col(node).alias("id"), F.col("doc_id").cast("long").alias("doc")).where("id <> doc").distinct()
    members = materialize(members.join(of, "id", "left").withColumn("doc", F.coalesce("doc", "id")), "members")
    best = members.groupBy("component").agg(F.min(F.struct("doc", "id")).alias("best"))
    gone = materialize(members.join(best, "component").where("id <> best.id").select("id", "doc"), "gone")
    # Only rows that may go or repeat are moved.
    clear, doubtful = split_by(docs, gone.select(F.col("doc").cast(docs.schema["doc_id"].dataType).alias("doc_id")).union(repeated), "doc_id")
    rest = with_nodes(doubtful).join(gone.select(F.col("id").alias(node)).distinct(), node, "left_anti")
    others = [F.col(f"`{f.name}`") for f in docs.schema if f.name not in ("doc_id", "text") and _sortable(f.dataType)]
    same = Window.partitionBy("doc_id", digest).orderBy(*(others or [F.col(digest)]))
    once = rest.withColumn(digest, F.xxhash64("text")).withColumn(nth, F.row_number().over(same)).where((F.col(nth) == 1) | F.col("doc_id").isNull())
    return clear.select(*docs.columns).unionByName(once.select(*docs.columns))


def _row_key() -> Column:
    """Stands for a doc_id with a text: rows without doc_id, and different texts of one doc_id, are told apart."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.lit("|"), F.col("text").cast("string"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, with or without doc_id, and all their repeated rows.

    Of a doc_id with several texts only those go that hold one. Null and empty texts stay. Nulls in other columns change
    nothing. An empty table or benchmark changes nothing.
    """
    key = unused(docs.columns, "key")
    found = decontamination.op10(docs.select(_row_key().alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = materialize(found.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    clear, doubtful = split_by(docs.withColumn(key, _row_key()), found, key)
    return clear.select(*docs.columns).unionByName(doubtful.join(found, key, "left_anti").select(*docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays, repeated rows and null texts too, in an empty table none."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents to train on with size and copies to take: complete epochs, and one more where sampled.

    Columns of ``docs`` that are called size or copies give way to these. Null is a source of its own; null texts have no
    words. Rows of one doc_id, source and text are taken alike. An empty table stays empty.
    """
    mixed = mixing.mix(docs, whole=True).withColumn("copies", F.col("epochs") + F.col("extra").cast("long")).where("copies > 0")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("size", "copies")]
    return mixed.select(*kept, "size", "copies")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``; what a stage kept is stored before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
