"""Table functions for SQL: ``LATERAL chunks(text)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegralType, LongType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from shiori.operators.chunking import chunk_text
from shiori.schema import CHUNK_OVERLAP, CHUNK_SIZE, MIN_CHUNK

CHUNK_ROW = StructType().add("chunk_id", LongType()).add("chunk_text", StringType())


class Chunks:
    """``chunks(text [, size [, overlap [, least]]])``: a row (chunk_id from 0, chunk_text) per chunk; a null or blank text has none.

    The numbers must be constants, and the overlap shorter than the size.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, least: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType | NullType):
            raise ValueError("chunks: the first argument must be a string")
        numbers = []
        for name, given, default in (("size", size, CHUNK_SIZE), ("overlap", overlap, CHUNK_OVERLAP), ("least", least, MIN_CHUNK)):
            if given is not None and not (isinstance(given.dataType, IntegralType) and given.isConstantExpression and given.value is not None):
                raise ValueError(f"chunks: {name} must be a constant whole number")
            numbers.append(default if given is None else given.value)
        if numbers[0] < 1 or not 0 <= numbers[1] < numbers[0] or numbers[2] < 0:
            raise ValueError("chunks: size must be positive, overlap from 0 and less than it, least from 0")
        return AnalyzeResult(CHUNK_ROW)

    def eval(self, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, least: int = MIN_CHUNK) -> Iterator[tuple]:
        yield from enumerate(chunk_text(text, size, overlap, least) if text else [])


def register(spark: SparkSession) -> None:
    """Makes ``chunks`` known to the session's SQL."""
    spark.udtf.register("chunks", udtf(Chunks))
