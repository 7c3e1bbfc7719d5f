"""File sources and sinks around the native readers and writers."""

from __future__ import annotations

import csv
import io
import warnings
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lumenweft import fixed
from lumenweft.functions import text as T
from lumenweft.session import hadoop_path, scratch, ship
from lumenweft.sources import arrays


def read_csv(spark: SparkSession, path: str, comma: str = ",") -> DataFrame:
    """Header, all strings, quoted line breaks; a byte order mark is skipped."""
    return spark.read.options(header=True, multiLine=True, escape='"', sep=comma).csv(path)


def read_records(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Records of JSON, an object a line, in any number of files that are split; ValueError if there is none.

    What is not an object fails when the rows are read (FAILFAST).
    """
    reader = spark.read.option("mode", "FAILFAST")
    df = (reader.schema(schema) if schema else reader).json(path)
    if not df.columns or df.isEmpty():
        raise ValueError("There are no records.")
    return df


def _shape(spark: SparkSession, path: str) -> tuple[str, str]:
    """First and last character that are not blank, over the file's lines."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).where(F.trim("value") != "")
    ends = lines.agg(F.min_by("value", "n").alias("a"), F.max_by("value", "n").alias("b")).first()
    return ((ends.a or "").strip().lstrip("﻿")[:1], (ends.b or "").strip()[-1:]) if ends.a else ("", "")


def read_json_array(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The rows of a top-level JSON array; ValueError (ArrayError) that names what is wrong if the file is empty, no array, not
    closed, goes on after it, or has a comma too many or too few. Files are read by ranges."""
    return arrays.read_array(spark, path, schema)


def read_enveloped(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON list, of the first list under a known key, or the one object itself."""
    df = spark.read.option("multiLine", True).json(path)
    first, _ = _shape(spark, path)
    if first == "{":
        for key in fixed.ENVELOPE_KEYS:
            if key in df.columns and isinstance(df.schema[key].dataType, ArrayType):
                inner = df.select(F.explode(key).alias("row"))
                return inner.select("row.*") if isinstance(inner.schema["row"].dataType, StructType) else inner.where("false")
    return df


def as_strings(df: DataFrame, source: Column | str) -> DataFrame:
    """All columns as strings, null as empty, and where a row comes from."""
    return df.select(*(T.blank(F.col(f"`{c}`") if not isinstance(df.schema[c].dataType, (StructType, ArrayType)) else F.to_json(f"`{c}`")).alias(c) for c in df.columns), (F.lit(source) if isinstance(source, str) else source).alias("source_file"))


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by name; columns that a table lacks are empty."""
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("There is nothing to unite.")
    return out.select(*(T.blank(F.col(f"`{c}`")).alias(c) for c in out.columns))


def _listed(spark: SparkSession, folder: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder by name, from one listing."""
    fs, path = hadoop_path(spark, folder)
    found = [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(path) if s.isFile()]
    return sorted((f for f in found if f[0].lower().endswith(endings)), key=lambda f: f[0].rsplit("/", 1)[-1])


def list_files(spark: SparkSession, folder: str, endings: tuple[str, ...] = (".csv", ".json")) -> list[str]:
    """Files of a folder by name, on any file system that Spark reads."""
    return [f for f, _ in _listed(spark, folder, endings)]


#: Files up to this size are read whole, many a task; larger JSON arrays by ranges.
WHOLE_BYTES = 64 << 20
ROWS = "source_file string, nth long, fields map<string,string>"


def _csv_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ROWS of whole CSV files (name, content), each under its own header, which is row -1. A name that is blank or repeats
    gets its place."""
    for batch in batches:
        for name, content in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
            rows = [r for r in csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline="")) if r]
            header: list[str] = []
            for k, c in enumerate(rows[0] if rows else []):
                header.append(c + str(k) if c in header else c or f"_c{k}")
            fields = [[(c, "") for c in header], *([(c, r[k] if k < len(r) else "") for k, c in enumerate(header)] for r in rows[1:])] if header else []
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(fields), pa.string()), pa.array(range(-1, len(fields) - 1), pa.int64()), pa.array(fields, pa.map_(pa.string(), pa.string()))], ["source_file", "nth", "fields"])


def _json_rows(value: Column) -> Column:
    """The objects of a JSON text, as maps of texts: of a list, of the first list under a known key, or the one object."""
    many = lambda c: F.from_json(c, "array<map<string,string>>")
    is_list = lambda c: F.startswith(F.ltrim(c), F.lit("["))
    of_object = F.array(F.from_json(value, "map<string,string>"))
    for key in reversed(fixed.ENVELOPE_KEYS):
        inner = F.get_json_object(value, f"$.{key}")
        of_object = F.when(is_list(inner), many(inner)).otherwise(of_object)
    return F.when(F.try_parse_json(value).isNull(), None).when(is_list(value), many(value)).otherwise(of_object)


def folder_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(ROWS of all CSV and JSON files of a folder, (source_file, reason) of those that hold no table).

    One scan of the CSV files and one of the JSON files, however many there are, in one plan; JSON files of more than
    WHOLE_BYTES are read by ranges, each by itself. Rows are stored, so files are read once. A file is a row of the listing
    on the driver, and whole in one task (but for the large ones).
    """
    ship(spark)
    sizes = dict(_listed(spark, folder, (".csv", ".json")))
    found = list(sizes)
    name = lambda c: F.url_decode(F.replace(F.element_at(F.split(c, "/"), -1), F.lit("+"), F.lit("%2B")))
    of = lambda end, large: [f for f in found if f.lower().endswith(end) and (sizes[f] > WHOLE_BYTES) == large]
    large, small = of(".json", True), of(".json", False)
    parts: list[DataFrame] = []
    if small:
        texts = spark.read.text(small, wholetext=True).select(name(F.col("_metadata.file_path")).alias("source_file"), F.ltrim(F.replace("value", F.lit("\ufeff"), F.lit(""))).alias("value"))
        rows = texts.select("source_file", F.coalesce(_json_rows(F.col("value")), F.array().cast("array<map<string,string>>")).alias("rows"))
        parts.append(rows.select("source_file", F.posexplode_outer("rows").alias("nth", "fields")).select("source_file", F.col("nth").cast("long").alias("nth"), "fields"))
    bad = []
    for path in large:
        own = path.rsplit("/", 1)[-1]
        try:
            values = arrays.elements(spark, path)
            # Numbered by the byte where their range begins: in order, but not one after the other.
            parts.append(values.select(F.lit(own).alias("source_file"), (F.col("start") * 2**20 + F.col("nth")).alias("nth"), F.from_json("value", "map<string,string>").alias("fields")))
        except arrays.ArrayError as why:
            bad.append((own, str(why)))
    tables_csv = [f for f in found if f.lower().endswith(".csv")]
    if tables_csv:
        raw = spark.read.format("binaryFile").load(tables_csv).select(name(F.col("path")).alias("source_file"), "content")
        parts.append(raw.mapInArrow(_csv_rows, ROWS))
    path = scratch(spark, "folder")
    empty = spark.createDataFrame([], ROWS)
    reduce(DataFrame.unionByName, parts, empty).where("fields is not null").write.parquet(path)
    rows = spark.read.schema(ROWS).parquet(path)
    names = spark.createDataFrame([(f.rsplit("/", 1)[-1],) for f in found], "source_file string")
    without = names.join(rows.select("source_file").distinct(), "source_file", "left_anti").join(spark.createDataFrame(bad, "source_file string, why string"), "source_file", "left")
    return rows, without.select("source_file", F.coalesce("why", F.when(F.endswith(F.lower("source_file"), F.lit(".csv")), "no columns").otherwise("not JSON, or no objects")).alias("reason"))


def read_folder(spark: SparkSession, folder: str, skipped: Callable[[str, Exception], None] | None = None) -> DataFrame:
    """All CSV and JSON files of a folder in order of name, as strings with ordinal: every column that any row has (first
    seen, first), empty where a row lacks it.

    Files that hold no table (not JSON, or empty) are left out, and named: by ``skipped``, or as a warning. Every other
    failure, of the file system for instance, is raised.
    """
    rows, without = folder_rows(spark, folder)
    for r in without.orderBy("source_file").collect():
        (skipped or (lambda file, reason: warnings.warn(f"{file} is left out: {reason}", stacklevel=3)))(r.source_file, ValueError(r.reason))
    columns = rows.select("source_file", F.posexplode(F.map_keys("fields")).alias("place", "column")).groupBy("column").agg(F.min(F.struct("source_file", "place")).alias("first"))
    names = [r.column for r in columns.orderBy("first").collect()]
    if not names:
        raise ValueError("There is nothing to unite.")
    ranks = spark.createDataFrame([(f.rsplit("/", 1)[-1], k) for k, f in enumerate(list_files(spark, folder))], "source_file string, file int")
    ordinal = F.concat_ws("-", F.lpad(F.col("file").cast("string"), 6, "0"), F.lpad(F.col("nth").cast("string"), 20, "0"))
    own = rows.where("nth >= 0").join(F.broadcast(ranks), "source_file")
    return own.select(*(T.blank(F.col("fields")[c]).alias(c) for c in names if c != "source_file"), "source_file", ordinal.alias("ordinal"))


# --- sinks --------------------------------------------------------------------------------------------------------------


def write_delimited(df: DataFrame, path: str, comma: str = ",") -> None:
    """CSV or TSV with a header in every part, written by all tasks; null is empty, as is an empty text."""
    df.select(*(T.blank(F.col(f"`{c}`")).alias(c) for c in df.columns)).write.options(header=True, sep=comma, escape='"', quoteAll=True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """A JSON object a line, written by all tasks; null is an empty text."""
    df.select(*(T.blank(F.col(f"`{c}`")).alias(c) for c in df.columns)).write.json(path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file on any file system that Spark writes, put in place by renaming. Tables go through ``sinks``."""
    jvm = spark.sparkContext._jvm
    target, temporary = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(temporary, True)
    stream.write(bytearray(data))
    stream.close()
    fs.delete(target, False)
    fs.rename(temporary, target)

