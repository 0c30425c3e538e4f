"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Names that staged() makes.
_MADE = re.compile(r"^[a-z-]+-[0-9a-f]{32}$")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master without it gets a fresh temporary folder, any other is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shiori-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: what hangs on it neither computes it again nor loses it with an executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _folder(spark, path)
    fs.delete(at, True)


def release(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again: all that hangs on them has itself been written."""
    for t in tables:
        if path := getattr(t, "_staged_path", None):
            remove(t.sparkSession, path)


def sweep(spark: SparkSession, older_than_seconds: float) -> int:
    """Deletes staged tables of that age: those behind results that callers held lazily.

    Call it when no job that began before that time is still running; nothing here calls it.
    """
    fs, at = _folder(spark, shared_folder(spark))
    old = [s.getPath() for s in fs.listStatus(at) if _MADE.search(s.getPath().getName()) and s.getModificationTime() < (time.time() - older_than_seconds) * 1000]
    for path in old:
        fs.delete(path, True)
    return len(old)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file of the shared folder, whatever its store."""
    fs, at = _folder(spark, path)
    stream = fs.create(at, False)
    stream.write(bytearray(content))
    stream.close()
