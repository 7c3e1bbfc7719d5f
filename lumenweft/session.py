"""Session set-up shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


#: What goes to a Python worker at a time, in bytes: rows of long texts would make very large batches by their number alone.
BATCH_BYTES = "8m"


def ship(spark: SparkSession) -> SparkSession:
    """Give this package's code to the executors' Python workers, once a context, and bound the batches they get.

    A size of batches that the session was given stays.
    """
    sc = spark.sparkContext
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, BATCH_BYTES)
    if not getattr(sc, "_lumenweft_shipped", False):
        path = Path(tempfile.mkdtemp(prefix="lumenweft-code-")) / "lumenweft_code.zip"
        with zipfile.ZipFile(path, "w") as archive:
            for source in sorted(PACKAGE.rglob("*.py")):
                archive.write(source, source.relative_to(PACKAGE.parent))
        sc.addPyFile(str(path))
        sc._lumenweft_shipped = True
    return spark


def local(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings that the results rely on (UTC)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lumenweft")
    for key, value in {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM's, for any file system that Spark knows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """What was written at ``path`` goes when the driver's JVM ends, on any file system."""
    fs, target = hadoop_path(spark, path)
    fs.deleteOnExit(target)


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder on any file system; whether there was one."""
    fs, target = hadoop_path(spark, path)
    return bool(fs.delete(target, True))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only where that is unset and the driver's own process runs
    the tasks, a temporary one of our own; on a cluster that is an error, as executors would not find it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    own = getattr(sc, "_lumenweft_scratch", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="lumenweft-")
        sc._lumenweft_scratch = own
        sc.setCheckpointDir(own)
        delete_at_exit(spark, own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver ends."""
    folder = f"{shared_folder(spark)}/lumenweft/{uuid.uuid4().hex}"
    fs, target = hadoop_path(spark, folder)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return f"{folder}/{name}"
