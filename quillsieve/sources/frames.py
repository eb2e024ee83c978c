"""Filters in storage: frames in files and tables, and envelopes in JSON lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsieve.errors import SerializationError
from quillsieve.functions import codec
from quillsieve.operators.filters import BloomFilter, Filter, _BinaryFuse, from_bytes

PARSED = "kind int, m long, k int, blocks long, seed long, n long, bits_set long, error string"


def write_frames(spark: SparkSession, path: str, filters: dict[str, Filter]) -> None:
    """A Parquet table (name, frame) of these filters."""
    rows = [(name, bytearray(f.to_bytes())) for name, f in filters.items()]
    spark.createDataFrame(rows, "name string, frame binary").coalesce(1).write.mode("overwrite").parquet(path)


def read_frames(spark: SparkSession, path: str) -> dict[str, Filter]:
    """The filters of a Parquet table (name, frame)."""
    return {r["name"]: from_bytes(bytes(r["frame"])) for r in spark.read.parquet(path).toLocalIterator()}


def frame_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame) of raw frame files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("frame"))


def write_envelopes(spark: SparkSession, path: str, frames: DataFrame, tag: str = codec.TAG) -> None:
    """JSON lines of the frames in frames(frame)."""
    frames.select(codec.envelope_column(F.col("frame"), tag).alias("value")).write.mode("overwrite").text(path)


def read_envelopes(spark: SparkSession, path: str, tag: str = codec.TAG) -> DataFrame:
    """(frame, error) of each JSON line."""
    frame, error = codec.from_envelope_column(F.col("value"), tag)
    return spark.read.text(path).select(frame.alias("frame"), error.alias("error"))


def _row(data: bytes | None) -> tuple:
    if data is None:
        return (None,) * 8
    try:
        f = from_bytes(data)
    except (SerializationError, ValueError) as e:
        return (*(None,) * 7, type(e).__name__)
    if isinstance(f, _BinaryFuse):
        return f.kind, None, None, None, f.seed, f.size, None, None
    if isinstance(f, BloomFilter):
        return f.kind, f.m, f.k, None, f.seed, f.n, f.length, None
    return f.kind, None, None, f.blocks, f.seed, f.n, f.length, None


def parse_frames(frames: DataFrame, column: str = "frame") -> DataFrame:
    """frames with the parts of each frame, or the name of the error that it gives; no frame fails the job."""
    names, at = frames.columns, frames.columns.index(column)
    kinds = [x.strip().split(" ") for x in PARSED.split(",")]
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_row(x.as_py()) for x in b.column(at)]
            parts = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            arrays = [pa.array(list(p), types[t]) for p, (_, t) in zip(parts, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*names, *[n for n, _ in kinds]])

    schema = T.StructType([*frames.schema.fields, *T.StructType.fromDDL(PARSED).fields])
    return frames.mapInArrow(run, schema)


def checked(frame: Column) -> Column:
    """The frame, where its length, magic, version and checksum are right; the job fails on any other."""
    error = codec.frame_error_column(frame)
    return F.when(error.isNull(), frame).otherwise(F.raise_error(error).cast("binary"))
