"""Settings from KEY=VALUE files, and remote files brought into the shared folder."""

from __future__ import annotations

import hashlib
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweft.functions import text as T
from lumenweft.session import shared_folder

#: Copies that a driver remembers.
MOST_COPIES = 4
_copies: OrderedDict[str, str] = OrderedDict()


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the lines KEY=VALUE of a file; the first value of a key counts.

    Quotes around a value go; without them a comment (a blank and #) ends it. Lines without =, comments, empty values and
    keys that are no names are left out. A byte order mark is skipped.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), T.strip(F.regexp_replace("value", "^﻿", "")).alias("line"))
    split = lines.where(~F.col("line").startswith("#") & F.col("line").contains("=")).select("n", T.strip(F.substring_index("line", "=", 1)).alias("key"), T.strip(F.regexp_replace("line", "^[^=]*=", "")).alias("raw"))
    quoted = F.col("raw").rlike("^(?s)(\".*\"|'.*')$") & (F.length("raw") >= 2)
    value = F.when(quoted, F.expr("substring(raw, 2, length(raw) - 2)")).otherwise(F.regexp_replace(F.regexp_replace("raw", "(?s) #.*$", ""), T.SPACES + "$", ""))
    kept = split.withColumn("value", value).where(F.col("key").rlike("^[A-Za-z_][A-Za-z0-9_]*$") & (F.col("value") != ""))
    return kept.groupBy("key").agg(F.min_by("value", "n").alias("value"))


def shared_copy(spark: SparkSession, path: str) -> str:
    """A path that driver and executors can read: ``path`` itself on the file system of the shared folder, else a copy there.

    A copy is made once; it is put in place by renaming, so a reader never finds half of it. ValueError if it is empty.
    """
    if path in _copies:
        _copies.move_to_end(path)
        return _copies[path]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    source = hadoop.Path(path)
    folder = hadoop.Path(f"{shared_folder(spark)}/lumenweft/copies")
    here, there = folder.getFileSystem(conf), source.getFileSystem(conf)
    if here.getUri().equals(there.getUri()):
        return path
    name = f"{hashlib.sha256(path.encode()).hexdigest()[:16]}-{source.getName()}"
    target, part = hadoop.Path(folder, name), hadoop.Path(folder, name + ".part")
    if not here.exists(target):
        here.mkdirs(folder)
        here.delete(part, True)
        hadoop.FileUtil.copy(there, source, here, part, False, True, conf)
        if here.getContentSummary(part).getLength() == 0:
            here.delete(part, True)
            raise ValueError(f"{path} is empty.")
        if not here.rename(part, target) and not here.exists(target):
            raise OSError(f"{target} can't be put in place.")
        here.deleteOnExit(target)
    _copies[path] = target.toString()
    while len(_copies) > MOST_COPIES:
        _copies.popitem(last=False)
    return _copies[path]
