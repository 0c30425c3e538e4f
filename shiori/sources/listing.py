"""Files of directories as a batch data source, listed and read by the executors.

    spark.dataSource.register(DocumentFiles)
    spark.read.format("document_files").load("s3a://bucket/docs")

gives a row for each supported file: path, doc_name, ext, size, mtime.  With the option
``content`` (true) the file is read too: file_hash, chunks and error say what its
reader made of it.  The planner lists directories level by level until there are
PARTS subtrees, and no further; each is a partition, whose task lists the rest.  Filters on
``ext`` and ``path`` (equality, IN, prefix) are taken over with the option ``pushdown``
and where Spark hands them to Python sources
(``spark.sql.python.filterPushdown.enabled``): a subtree that no wanted path lies in
is not listed.

Edge cases: a missing or unreadable directory has no files; links are followed; a file
is its own subtree; files without a supported extension are passed over; a file that
can't be read or parsed has an error and no chunks; an empty file has no chunks.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import os
from collections.abc import Iterable, Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from shiori.schema import EXTENSIONS
from shiori.sources.formats import chunks_of_file

#: Subtrees that the planner looks for.
PARTS = 64
LISTED = "path string, doc_name string, ext string, size long, mtime timestamp"
READ = LISTED + ", file_hash string, chunks array<string>, error string"


def opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """A store, a path in it, and what stands before it in the name that Spark gives the path."""
    scheme, colon, rest = path.partition("://")
    if not colon:
        return pafs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")), ""
    fs, at = pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest)
    return fs, at, path[: len(path) - len(at)] if path.endswith(at) else f"{scheme}{colon}"


def children(fs: pafs.FileSystem, at: str) -> list[pafs.FileInfo]:
    try:
        return sorted(fs.get_file_info(pafs.FileSelector(at)), key=lambda f: f.base_name)
    except OSError:
        return []


def extension(path: str) -> str:
    return os.path.splitext(path)[1].lower().removeprefix(".")


class Wanted:
    """What the filters leave: extensions, and paths or the beginnings of paths."""

    def __init__(self) -> None:
        self.extensions, self.paths, self.prefixes = set(EXTENSIONS), None, []

    def take(self, f: Filter) -> bool:
        """Whether the filter is taken over."""
        values = {f.value} if isinstance(f, EqualTo | StringStartsWith) else set(f.value) if isinstance(f, In) else None
        if values is None or f.attribute not in (("ext",), ("path",)):
            return False
        if isinstance(f, StringStartsWith):
            if f.attribute == ("ext",):
                return False
            self.prefixes.append(f.value)
        elif f.attribute == ("ext",):
            self.extensions &= values
        else:
            self.paths = values if self.paths is None else self.paths & values
        return True

    def file(self, path: str) -> bool:
        return extension(path) in self.extensions and (self.paths is None or path in self.paths) and all(path.startswith(p) for p in self.prefixes)

    def below(self, folder: str) -> bool:
        """Whether a wanted path may lie below a folder."""
        folder = folder.rstrip("/") + "/"
        return (self.paths is None or any(p.startswith(folder) for p in self.paths)) and all(p.startswith(folder) or folder.startswith(p) for p in self.prefixes)


class Subtrees(InputPartition):
    def __init__(self, prefix: str, folders: list[str], files: list[str]) -> None:
        self.prefix, self.folders, self.files = prefix, folders, files


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], content: bool) -> None:
        self.roots, self.content, self.wanted = roots, content, Wanted()

    def partitions(self) -> list[Subtrees]:
        out = []
        for root in self.roots:
            fs, at, prefix = opened(root)
            info = fs.get_file_info(at)
            if info.type == pafs.FileType.File:
                out.append(Subtrees(prefix, [], [at]))
                continue
            folders, files = [at] if info.type == pafs.FileType.Directory else [], []
            # Level by level, while that gives more subtrees and they are few.
            while folders and len(folders) < PARTS:
                found = [c for f in folders if self.wanted.below(prefix + f) for c in children(fs, f)]
                files += [c.path for c in found if c.type == pafs.FileType.File]
                folders = [c.path for c in found if c.type == pafs.FileType.Directory]
            out += [Subtrees(prefix, [f], []) for f in folders]
            step = max(1, -(-len(files) // PARTS))
            out += [Subtrees(prefix, [], files[i : i + step]) for i in range(0, len(files), step)]
        return out or [Subtrees("", [], [])]

    def read(self, part: Subtrees) -> Iterator[tuple]:
        fs = opened(part.prefix + (part.folders or part.files)[0])[0] if part.folders or part.files else None
        for at in part.files:
            if self.wanted.file(part.prefix + at):
                yield self._row(fs, part.prefix, fs.get_file_info(at))
        left = list(part.folders)
        while left:
            folder = left.pop()
            if self.wanted.below(part.prefix + folder):
                for c in children(fs, folder):
                    if c.type == pafs.FileType.Directory:
                        left.append(c.path)
                    elif c.type == pafs.FileType.File and self.wanted.file(part.prefix + c.path):
                        yield self._row(fs, part.prefix, c)

    def _row(self, fs: pafs.FileSystem, prefix: str, info: pafs.FileInfo) -> tuple:
        ext = extension(info.path)
        row = (prefix + info.path, info.base_name, ext, info.size, info.mtime or datetime.datetime.fromtimestamp(0, datetime.timezone.utc))
        if not self.content:
            return row
        try:
            with fs.open_input_stream(info.path) as f:
                raw = f.read()
        except OSError as x:
            return (*row, None, None, str(x))
        try:
            return (*row, hashlib.sha256(raw).hexdigest(), chunks_of_file(raw, ext), None)
        except Exception as x:  # one bad file must not stop the others
            return (*row, hashlib.sha256(raw).hexdigest(), None, f"{type(x).__name__}: {x}")


class _FilteringReader(_Reader):
    """Spark refuses a reader with this method while the setting is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.wanted.take(f)]


class DocumentFiles(DataSource):
    """Options: ``path`` or ``paths`` (a JSON list), ``content`` (true: files are read and cut into chunks), ``pushdown`` (true: filters are taken over)."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return READ if self.options.get("content", "false") == "true" else LISTED

    def reader(self, schema) -> _Reader:
        roots = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        kind = _FilteringReader if self.options.get("pushdown", "false") == "true" else _Reader
        return kind(roots, self.options.get("content", "false") == "true")


def document_files(spark: SparkSession, paths: list[str], *, content: bool = False) -> DataFrame:
    """Supported files at and below paths of any store that pyarrow.fs opens; filters are taken over if the session allows it."""
    spark.dataSource.register(DocumentFiles)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("document_files").options(paths=json.dumps(paths), content=str(content).lower(), pushdown=pushdown).load()
