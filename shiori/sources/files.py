"""File collection: paths and directories to rows with content and hash."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiori.functions.text import extension, file_name
from shiori.schema import EXTENSIONS

FILE = "source string, doc_name string, ext string, file_hash string, error string"
#: A path with a scheme, as Spark names files of stores (``file:/x`` too).
URI = r"^[A-Za-z][A-Za-z0-9+.-]+:/"
#: Paths of a store that one reader is given.
REMOTE_PATHS = 100_000


def is_supported(path: str) -> bool:
    return os.path.splitext(path)[1].lower().removeprefix(".") in EXTENSIONS


def walk(path: str, supported_only: bool = True) -> Iterator[str]:
    """Files below a directory, children in order; unreadable directories are passed over; links are followed."""
    try:
        names = sorted(os.listdir(path))
    except OSError:
        return
    for name in names:
        child = os.path.join(path, name)
        if os.path.isdir(child):
            yield from walk(child, supported_only)
        elif os.path.isfile(child) and (not supported_only or is_supported(child)):
            yield child


def collect_files(paths: list[str]) -> list[str]:
    """Supported files among ``paths`` and below its directories; missing paths are skipped, repeats are dropped."""
    out = []
    for path in paths:
        if os.path.isdir(path):
            out += walk(path)
        elif os.path.isfile(path) and is_supported(path):
            out.append(path)
    return list(dict.fromkeys(out))


def expand_drop_paths(paths: list[str]) -> list[str]:
    """Directories become all their files, whatever the extension; anything else stays as it is written."""
    return [x for p in paths for x in (walk(p, supported_only=False) if os.path.isdir(p) else [p])]


def is_uri(path: str) -> bool:
    return re.match(URI, path) is not None


def _content(path: str) -> tuple[bytes, str | None]:
    try:
        with open(path, "rb") as f:
            return f.read(), None
    except OSError as e:
        return b"", str(e)


def _digest(path: str) -> tuple[str, str | None]:
    """The hash of a file, piece by piece."""
    own, error = hashlib.sha256(), None
    try:
        with open(path, "rb") as f:
            while piece := f.read(1 << 20):
                own.update(piece)
    except OSError as e:
        own, error = hashlib.sha256(), str(e)
    return own.hexdigest(), error


def read_files(spark: SparkSession, files: list[str], remote: list[str] | None = None) -> DataFrame:
    """Rows (source, doc_name, ext, file_hash, error) of listed files and of directories in stores, hashed by the executors.

    The listing of local paths alone is made on the driver; they must lie on storage that all executors see.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            found = [_digest(p) for p in paths]
            columns = [paths, list(map(os.path.basename, paths)), [os.path.splitext(p)[1].lower().removeprefix(".") for p in paths], [h for h, _ in found], [e for _, e in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=[x.split()[0] for x in FILE.split(", ")])

    parts = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    out = spark.createDataFrame([(f,) for f in files], "path string").repartition(parts).mapInArrow(read, FILE)
    for uri in remote or ():
        out = out.unionByName(read_remote(spark, uri).drop("content"))
    return out


def with_content(files: DataFrame) -> DataFrame:
    """Adds ``content`` to rows with ``source``, read again by path; a row that has no error so far may get one.

    Files of stores that only Spark reads are named to its reader, so many at a
    time, and joined by path; no other file is read.
    """
    spark = files.sparkSession
    far = F.col("source").rlike(URI)
    schema = files.drop("error").schema.add("content", "binary").add("error", "string")
    names = schema.fieldNames()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                content, error = _content(one.column("source")[0].as_py())
                columns = {n: one.column(n) for n in names if n not in ("content", "error")}
                columns |= {"content": pa.array([content], pa.binary()), "error": pa.array([one.column("error")[0].as_py() or error], pa.string())}
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    out = files.filter(~far).mapInArrow(read, schema)

    def joined(paths: list[str]) -> DataFrame:
        told = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("_path"), "content")
        return files.filter(far).join(told, F.col("source") == F.col("_path")).select(*names)

    part: list[str] = []
    for r in files.filter(far).select("source").toLocalIterator():
        part.append(r.source)
        if len(part) == REMOTE_PATHS:
            out, part = out.unionByName(joined(part)), []
    return out.unionByName(joined(part)) if part else out


def read_remote(spark: SparkSession, uri: str) -> DataFrame:
    """As :func:`read_files` with ``content``, for a file or directory in any store that Spark reads (hidden files are skipped there)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri)
    ext = extension(F.col("path"))
    return found.filter(ext.isin(*EXTENSIONS)).select(
        F.col("path").alias("source"), file_name(F.col("path")).alias("doc_name"), ext.alias("ext"), "content", F.sha2("content", 256).alias("file_hash"), F.lit(None).cast("string").alias("error"),
    )
