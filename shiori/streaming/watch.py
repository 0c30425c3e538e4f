"""Keeping a store in step with directories: a change feed as a streaming source.

The source's offset names a snapshot {path: (mtime, size)} kept in a side file
beside the query's checkpoint, in the same store (any that pyarrow.fs opens, by
Hadoop's name or its own), so that another driver can go on from it; a batch is
the difference of two snapshots, as rows (path, kind, seq).  Unlike
the built-in file source it sees removals and changes in place.  A rename is a
removal and an upsert in one batch; the removal of a directory removes each file.

A change that fails costs no other: it goes to a ledger beside the checkpoint, is tried
again by later batches and at the next start, and is listed by ``status``.
"""

from __future__ import annotations

import contextlib
import json
import logging
import os
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from shiori.operators.ingest import drop_files, update_files
from shiori.sources.files import walk
from shiori.sources.store import Conflict, Store

log = logging.getLogger(__name__)

SCHEMA = "path string, kind string, seq long"
UPSERT, REMOVE = "upsert", "remove"
#: Of a step of a batch that meets another writer.
TRIES = 3
#: Batches that try a change before it is left alone, and the name of the ledger that a retry leaves.
ATTEMPTS, RETRIES = 5, -1


def snapshot(dirs: list[str]) -> dict[str, list[int]]:
    out = {}
    for d in dirs:
        for path in walk(d):
            try:
                s = os.stat(path)
            except OSError:
                continue
            out[path] = [s.st_mtime_ns, s.st_size]
    return out


def difference(old: dict, new: dict) -> list[tuple[str, str]]:
    """Removals first, then upserts, each in path order."""
    return [(p, REMOVE) for p in sorted(old.keys() - new.keys())] + [(p, UPSERT) for p in sorted(new) if old.get(p) != new[p]]


def changes_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """:func:`difference` of two snapshots as tables (path, mtime, size): path and kind; a rename is a removal and an upsert."""
    was = old.select("path", F.struct("mtime", "size").alias("_old"))
    met = was.join(new.select("path", F.struct("mtime", "size").alias("_new")), "path", "full")
    kind = F.when(F.col("_new").isNull(), REMOVE).when(F.col("_old").isNull() | (F.col("_old") != F.col("_new")), UPSERT)
    return met.select("path", kind.alias("kind")).filter("kind is not null")


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, dirs: list[str], side: str, initial: bool) -> None:
        self.dirs, self.initial = dirs, initial
        scheme, colon, rest = side.partition("://")
        self.fs, self.side = pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest if colon else os.path.abspath(side.removeprefix("file:")))
        self.fs.create_dir(self.side, recursive=True)

    def _save(self, files: dict) -> dict:
        name = uuid.uuid4().hex
        with self.fs.open_output_stream(f"{self.side}/.{name}") as f:
            f.write(json.dumps(files).encode())
        self.fs.move(f"{self.side}/.{name}", f"{self.side}/{name}")
        return {"snapshot": name}

    def _load(self, offset: dict) -> dict:
        if not offset.get("snapshot"):
            return {}
        with self.fs.open_input_stream(f"{self.side}/{offset['snapshot']}") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"snapshot": ""} if self.initial else self._save(snapshot(self.dirs))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        old, new = self._load(start), snapshot(self.dirs)
        rows = difference(old, new)
        if not rows:
            return iter(()), start
        return iter([(p, k, i) for i, (p, k) in enumerate(rows)]), self._save(new)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(p, k, i) for i, (p, k) in enumerate(difference(self._load(start), self._load(end)))])

    def commit(self, end: dict) -> None:
        """Snapshots older than the committed one are of no more use."""
        keep = end.get("snapshot")
        found = {x.base_name: x for x in self.fs.get_file_info(pafs.FileSelector(self.side))} if keep else {}
        if keep in found:
            for name, x in found.items():
                if name != keep and x.mtime_ns < found[keep].mtime_ns:
                    self.fs.delete_file(x.path)


class DirectoryChanges(DataSource):
    """Options: ``dirs`` (a JSON list), ``side`` (folder of snapshots), ``initial`` (true: files that are there count as new)."""

    @classmethod
    def name(cls) -> str:
        return "directory_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(json.loads(self.options["dirs"]), self.options["side"], self.options.get("initial", "false") == "true")


def last_per_path(changes: DataFrame, key: str = "path", kind: str = "kind", order: str = "seq") -> DataFrame:
    """The change that counts for each path: its last."""
    return changes.groupBy(key).agg(F.max_by(kind, order).alias(kind))


LEDGER = "path string, kind string, attempts int, error string"


def failures(spark: SparkSession, ledger: str) -> DataFrame:
    """What could not be applied (LEDGER), as the last batch has left it."""
    try:
        return spark.read.schema(LEDGER + ", batch long").parquet(ledger).drop("batch")
    except AnalysisException as x:
        if x.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _attempt(paths: list[str], step) -> dict[str, str]:
    """Runs a step on paths and tells which failed and why.

    Where another writer has published the same sources, it is tried again.  Of other
    failures the half that fails is looked for, down to single paths; if both halves
    fail, what is wrong is not a path, and all have failed.
    """
    for left in reversed(range(TRIES)):
        try:
            return step(paths) or {}
        except Conflict as x:
            if not left:
                return dict.fromkeys(paths, str(x))
        except Exception as x:
            log.exception("a batch of %d changes failed", len(paths))
            why = f"{type(x).__name__}: {x}"[:2000]
            break
    if len(paths) == 1:
        return {paths[0]: why}
    halves = [paths[: len(paths) // 2], paths[len(paths) // 2 :]]
    done = _attempt_half(halves[0], step)
    if done is not None:
        return done | _attempt(halves[1], step)
    return dict.fromkeys(paths, why) if _attempt_half(halves[1], step) is None else _attempt(halves[0], step)


def _attempt_half(paths: list[str], step) -> dict[str, str] | None:
    """What failed of a half, or None if the step itself did."""
    try:
        return step(paths) or {}
    except Exception:
        return None


def apply_changes(store: Store, embedder, changes: DataFrame, ledger: str | None = None, batch: int = 0) -> dict[str, str]:
    """Drops and upserts of one batch, by the same functions as the commands; a repeat changes nothing.

    What fails is written to ``ledger`` (a table, replaced by each batch) with its
    error, and tried again by the batches after, ATTEMPTS times in all; then it stays
    there until its file changes.  Returns the paths that failed now.
    """
    spark = store.spark
    known = {r.path: r for r in failures(spark, ledger).collect()} if ledger else {}
    # One directory walk's worth, which the driver has listed itself.
    kinds = {p: r.kind for p, r in known.items() if r.attempts < ATTEMPTS} | {r.path: r.kind for r in last_per_path(changes).collect()}
    tried = {p: known[p].attempts if p in known and known[p].attempts < ATTEMPTS else 0 for p in kinds}
    removed, upserted = ([p for p, k in kinds.items() if k == kind] for kind in (REMOVE, UPSERT))
    steps = [(removed, lambda paths: drop_files(spark, store, paths) and None), (upserted, lambda paths: update_files(spark, store, paths, embedder).failed)]
    failed: dict[str, str] = {}
    for paths, step in steps:
        if paths:
            failed |= _attempt(sorted(paths), step)
    if ledger:
        rows = [(p, r.kind, r.attempts, r.error) for p, r in known.items() if p not in kinds] + [(p, kinds.get(p, UPSERT), tried.get(p, 0) + 1, why) for p, why in failed.items()]
        spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{ledger}/batch={batch}")
        forget(spark, ledger, batch)
    for path, why in sorted(failed.items()):
        log.error("not applied: %s (%s)", path, why)
    return failed


def forget(spark: SparkSession, ledger: str, but: int) -> None:
    """Deletes the ledgers of other batches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(at):
        if f.getPath().getName() != f"batch={but}":
            fs.delete(f.getPath(), True)


def retry(store: Store, embedder, checkpoint: str) -> dict[str, str]:
    """Tries what the ledger holds without waiting for another change."""
    ledger = os.path.join(checkpoint, "failed")
    if not failures(store.spark, ledger).head(1):
        return {}
    return apply_changes(store, embedder, store.spark.createDataFrame([], SCHEMA), ledger, RETRIES)


def watch(spark: SparkSession, store: Store, dirs: list[str], embedder, checkpoint: str, *, initial: bool = False, once: bool = False, every: str = "2 seconds"):
    """Starts the streaming query; ``once`` handles what has changed since the last run and ends.

    First what the last run could not apply is tried again.  After a batch the store is
    folded, if that is due.
    """
    spark.dataSource.register(DirectoryChanges)
    retry(store, embedder, checkpoint)

    def handle(rows: DataFrame, batch: int) -> None:
        apply_changes(store, embedder, rows, os.path.join(checkpoint, "failed"), batch)
        with contextlib.suppress(Conflict):  # another writer folds
            store.fold()

    feed = spark.readStream.format("directory_changes").options(dirs=json.dumps(dirs), side=os.path.join(checkpoint, "snapshots"), initial=str(initial).lower()).load()
    writer = feed.writeStream.option("checkpointLocation", os.path.join(checkpoint, "query")).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
