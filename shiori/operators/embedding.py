"""Embedders: texts to unit vectors.

:class:`StaticEmbedder` is the bag of token vectors: tokenise with special
tokens, look the rows up, mean, L2.  :class:`HashedEmbedder` needs no model: it
pools hashed character bigrams.  Both are small objects that executors load
lazily and keep.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from shiori.operators.chunking import by_parts
from shiori.schema import DIMENSION
from shiori.sources.staging import shared_folder

MODEL_FILES = ("tokenizer.json", "model.safetensors")


def bigrams(text: str) -> list[str]:
    low = text.lower()
    return [low[i : i + 2] for i in range(len(low) - 1)]


def bigram_counts(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct bigrams of texts in order, how many texts hold each, and bigram by bigram which (by place) and how often; and the texts' numbers of bigrams."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in low], np.int64)
    row = np.repeat(np.arange(len(low)), sizes)
    inside = row[1:] == row[:-1]
    # Two code points of 21 bits and the text's place: one number to sort.
    keys, tf = np.unique(((points[:-1] << 21 | points[1:]) * len(low) + row[:-1])[inside], return_counts=True)
    pair, at = keys // max(1, len(low)), keys % max(1, len(low))
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    n = np.diff(np.append(first, len(pair)))
    return [chr(x >> 21) + chr(x & 0x1FFFFF) for x in pair[first].tolist()], n, at, tf, np.maximum(sizes - 1, 0)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    norms = np.sqrt((rows * rows).sum(axis=-1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


@functools.lru_cache(maxsize=1 << 16)
def _slot(gram: str, dim: int) -> int:
    digits = hashlib.md5(gram.encode("utf-8", "replace")).hexdigest()
    return int(digits[:2] if dim <= 256 else digits[:8], 16) % dim


class HashedEmbedder:
    """Counts of lower-case character bigrams, hashed by md5 to ``dim`` slots, L2-normalised."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        grams, n, at, tf, _ = bigram_counts(texts)
        slots = np.array([_slot(g, self.dim) for g in grams], np.int64)
        out = np.bincount(at * self.dim + np.repeat(slots, n), tf, len(texts) * self.dim).astype(np.float64)  # of nothing, it is of whole numbers
        return unit(out.reshape(len(texts), self.dim))


@functools.lru_cache(maxsize=2)
def _static(prefix: str) -> tuple:
    """Tokenizer and memory-mapped weights of the files tokenizer.json and model.safetensors, whose paths begin with ``prefix``."""
    from tokenizers import Tokenizer

    path = prefix + "model.safetensors"
    with open(path, "rb") as f:
        size = int.from_bytes(f.read(8), "little")
        head = json.loads(f.read(size))
    told = head["embedding.weight"]
    rows, dim = told["shape"]
    start, end = told["data_offsets"]
    if told["dtype"] != "F32" or dim != DIMENSION or end - start != rows * dim * 4:
        raise ValueError(f"embedding.weight must be float32 with {DIMENSION} columns")
    weights = np.memmap(path, "<f4", "r", 8 + size + start, (rows, dim))
    return Tokenizer.from_file(prefix + "tokenizer.json"), weights


class StaticEmbedder:
    """``folder``: where the model lies on every machine.  :meth:`shipped` brings it there."""

    def __init__(self, folder: str) -> None:
        for name in MODEL_FILES:
            if not os.path.isfile(os.path.join(folder, name)):
                raise FileNotFoundError(f"{name} is missing in {folder}; run init first")
        self.folder, self.name, self.dim = folder, "", DIMENSION

    @classmethod
    def shipped(cls, spark: SparkSession, uri: str) -> StaticEmbedder:
        """A model in a folder of the driver or of any store: each machine fetches it once, when a task first asks.

        Spark ships files, and a local folder to a local master alone, and knows them by
        their last name; so the files go under names made of where they lie and when they were written.
        """
        jvm, at = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        fs = at.getFileSystem(conf)
        at = fs.makeQualified(at)
        told = [at.toString()]
        for name in MODEL_FILES:
            if not fs.exists(jvm.org.apache.hadoop.fs.Path(at, name)):
                raise FileNotFoundError(f"{name} is missing in {uri}; run init first")
            file = fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(at, name))
            told += [str(file.getLen()), str(file.getModificationTime())]
        mark = hashlib.sha256("\n".join(told).encode()).hexdigest()[:16]
        for name in MODEL_FILES:
            to = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/model-{mark}-{name}")
            held = to.getFileSystem(conf)
            if not held.exists(to):
                new = jvm.org.apache.hadoop.fs.Path(f"{to.toString()}-{uuid.uuid4().hex}")
                jvm.org.apache.hadoop.fs.FileUtil.copy(fs, jvm.org.apache.hadoop.fs.Path(at, name), held, new, False, conf)
                held.rename(new, to)
            spark.sparkContext.addFile(held.makeQualified(to).toString())
        out = cls.__new__(cls)
        out.folder, out.name, out.dim = "", f"model-{mark}-", DIMENSION
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        tokenizer, weights = _static(os.path.join(self.folder, "") if self.folder else SparkFiles.get(self.name))
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            ids = [t for t in tokenizer.encode(text or "").ids if t < len(weights)]
            if ids:
                out[i] = np.asarray(weights[ids]).mean(axis=0)
        return unit(out)


def embed(text: Column, embedder, kind: str = "float") -> Column:
    """``array<kind>`` of unit vectors, in Arrow batches."""
    of = {"float": pa.float32(), "double": pa.float64()}[kind]

    def vectors(texts: list[str | None]) -> pa.Array:
        found = embedder(texts)
        offsets = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()).cast(of, safe=False))

    @F.arrow_udf(f"array<{kind}>")
    def run(texts: pa.Array) -> pa.Array:
        return by_parts(texts, vectors)

    return run(text)


def mean_pool(vectors: Column, rows: Column) -> Column:
    """Relational twin of the lookup: the mean of ``array<array<double>>`` rows, position by position, and its L2 norm applied."""
    n = F.size(rows)
    total = F.aggregate(rows, F.transform(vectors, lambda _: F.lit(0.0)), lambda acc, r: F.zip_with(acc, r, lambda a, b: a + b))
    return l2(F.transform(total, lambda x: x / n))


def l2(vector: Column) -> Column:
    """A Column vector scaled to length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)
