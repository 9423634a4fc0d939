"""Files as compressed chunks in a table (token, start, end, size, data), and chunk folders as a source."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SIZE = 16 * 1024
SCHEMA = "token string, start long, end long, size long, data binary"


def chunked(files: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Chunks of (token, content) rows, one file in memory at a time; an empty file has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for token, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = content.as_py() or b""
                starts = range(0, len(body), chunk_size)
                parts = [body[s : s + chunk_size] for s in starts]
                yield pa.RecordBatch.from_arrays([pa.array([token] * len(parts), pa.string()), pa.array(list(starts), pa.int64()), pa.array([s + len(p) for s, p in zip(starts, parts)], pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array([zlib.compress(p) for p in parts], pa.binary())], ["token", "start", "end", "size", "data"])

    return files.select("token", "content").mapInArrow(run, SCHEMA)


def read_range(chunks: DataFrame, token: str, start: int = 0, end: int | None = None) -> DataFrame:
    """(start, data) of a file's bytes from start to end: only chunks that overlap are read, and they are cut."""
    found = chunks.where((F.col("token") == token) & (F.col("end") > start))
    if end is not None:
        found = found.where(F.col("start") < end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_pylist()
            bodies = [zlib.decompress(x) for x in batch.column(1).to_pylist()]
            cut = [b[max(0, start - a) : None if end is None else end - a] for a, b in zip(at, bodies)]
            yield pa.RecordBatch.from_arrays([pa.array([max(a, start) for a in at], pa.int64()), pa.array(cut, pa.binary())], ["start", "data"])

    return found.select("start", "data").mapInArrow(run, "start long, data binary")


def chunk_folder(spark: SparkSession, path: str) -> DataFrame:
    """Chunks laid out as <token>/<start>.chunk, each compressed; size and end are known when they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.chunk").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("token"), F.regexp_extract(F.element_at(parts, -1), r"^(\d+)\.chunk$", 1).cast("long").alias("start"), F.col("content").alias("data"))


def destroy(chunks: DataFrame, token: str) -> DataFrame:
    return chunks.where(F.col("token") != token)
