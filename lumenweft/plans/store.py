"""A vector store on disk: rows in a folder of their own, and a log of versions, the last of which names the folder that counts.

Publishing adds one version to the log, so a reader finds the store before or the new one, complete, and never a mixture; of
two who publish at once the second sees the first's version and adds its own after that.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lumenweft.functions import vectors as V
from lumenweft.operators import build
from lumenweft.session import delete, hadoop_path
from lumenweft.sources import commits

VERSION, LEGACY_MODEL = 1, "unknown"


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None if there is nothing at that path."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as why:
        if why.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _log(path: str) -> str:
    return f"{path}/_log"


def published(spark: SparkSession, path: str) -> Row | None:
    """The version of the store that counts: the last."""
    _, entry = commits.latest(spark, _log(path))
    return None if entry is None else Row(**entry)


def _written(df: DataFrame, path: str, id_col: str, vector: str) -> dict:
    """Writes rows to a folder of their own; what a version says of them. ValueError, and no folder, if they are no store."""
    spark = df.sparkSession
    folder = f"{path}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    rows = spark.read.parquet(folder)
    ends = rows.agg(F.count_if(~F.coalesce(V.unit(F.col(vector)), F.lit(False))).alias("not_unit"), F.min(id_col).cast("string").alias("least"), F.max(id_col).cast("string").alias("largest"))
    facts = build.inspect(rows, id_col, vector).crossJoin(ends).first()
    if not facts.n_rows or facts.repeated_ids or facts.invalid or facts.not_unit or facts.least_width != facts.largest_width:
        delete(spark, folder)
        raise ValueError(f"The rows are no store: {facts.asDict()}")
    fs, target = hadoop_path(spark, folder)
    size = fs.getContentSummary(target)
    return {"rows": folder, "n": facts.n_rows, "width": facts.largest_width, "least": facts.least, "largest": facts.largest, "files": size.getFileCount(), "bytes": size.getLength()}


def write_store(df: DataFrame, path: str, model: str, fingerprint: str, id_col: str = "record_id", vector: str = "embedding", feature_model: str = "") -> dict:
    """Writes rows with unit vectors once, checks what was written and publishes it; returns the version.

    ValueError if there are no rows, an id repeats or a vector is not of the one width and unit length: nothing is published
    then. The folders of earlier stores stay until ``forget`` is called, for those who still read them.
    """
    return update_store(df.sparkSession, path, lambda _: df, model, fingerprint, id_col, vector, feature_model)


def update_store(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], model: str, fingerprint: str, id_col: str = "record_id", vector: str = "embedding", feature_model: str = "") -> dict:
    """Publishes what ``change`` makes of the rows that count (None if there are none); returns the version.

    If another version is published meanwhile, ``change`` is called again with its rows and its own earlier result is deleted,
    so that concurrent updates come one after the other and none is lost. A ``change`` that gives the same DataFrame again is
    written once.
    """
    made: tuple[DataFrame, dict] | None = None

    def version(number: int, before: dict | None) -> dict:
        nonlocal made
        df = change(spark.read.parquet(before["rows"]) if before else None)
        if made is None or made[0] is not df:
            if made is not None:
                delete(spark, made[1]["rows"])
            made = df, _written(df, path, id_col, vector)
        named = {"number": number, "version": VERSION, "fingerprint": fingerprint, "model": model, "feature_model": feature_model, "normalized": True, "created_at": datetime.now(UTC).isoformat()}
        return named | made[1]

    try:
        return commits.transact(spark, _log(path), version)
    except commits.Contended:
        delete(spark, made[1]["rows"])
        raise


def forget(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes the rows and versions of all but the last ``keep`` stores; returns how many folders went."""
    return sum(delete(spark, old["rows"]) for old in commits.forget(spark, _log(path), keep))


def load_store(spark: SparkSession, path: str, id_col: str = "record_id", vector: str = "embedding") -> tuple[DataFrame, dict]:
    """Rows and metadata, or ValueError if they don't agree. Without metadata the vectors are normalized on the way."""
    meta = published(spark, path)
    if meta is None:
        return build.import_vectors(spark.read.parquet(path), id_col, vector), {"version": 0, "model": LEGACY_MODEL, "normalized": True}
    rows = spark.read.parquet(meta.rows)
    seen = build.inspect(rows, id_col, vector).first()
    if meta.version != VERSION or meta.n != seen.n_rows or not meta.normalized or seen.repeated_ids or seen.invalid or {seen.least_width, seen.largest_width} != {meta.width}:
        raise ValueError("The store and its metadata don't agree.")
    return rows, meta.asDict()
