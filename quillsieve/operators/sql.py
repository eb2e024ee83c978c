"""The functions' names in SQL."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillsieve.functions import codec, columns, kernels
from quillsieve.operators.filters import BloomFilter, Filter, _BinaryFuse, from_bytes


def _hash(keys: pa.Array) -> pa.Array:
    words = kernels.murmur128(keys).astype("int64")
    return pa.StructArray.from_arrays([pa.array(words[:, i]) for i in range(4)], ["w0", "w1", "w2", "w3"], mask=keys.is_null())


@lru_cache(4)
def _opened(head: bytes, size: int) -> Filter:
    """The filter of a frame of so many bytes that begins with head, without what the frame holds; refused as the frame itself would be, its checksum apart."""
    if size < codec.HEADER + codec.TRAILER:
        return from_bytes(head)
    bare = (head + bytes(max(0, size - len(head))))[: size - codec.TRAILER]
    return from_bytes(bare + zlib.crc32(bare).to_bytes(4, "little"))


PLACES = pa.struct([("bits", pa.list_(pa.struct([("at", pa.int64()), ("mask", pa.int64())]))), ("wide", pa.int32()), ("fp", pa.int64())])


def _places_in(held: Filter, keys: pa.Array) -> pa.Array:
    """Where a filter's frame tells of each key: bytes (from 1) and masks of which all must meet, or of a fuse filter its slots, `wide` bytes each, whose exclusive or is fp."""
    words = kernels.murmur128(keys, held.hash_seed)
    n = len(words)
    if isinstance(held, _BinaryFuse):
        wide = held.width // 8
        mixed = kernels.mix_seed(kernels.key64(words), held.seed)
        at = kernels.fuse_positions(mixed, held.geometry.segment, held.geometry.segment_count_length).astype(np.int64) * wide + codec.HEADER + 17
        mask = np.zeros_like(at)
        fp = pa.array(kernels.fuse_fingerprint(mixed, held.width).view(f">u{wide}").astype(np.int64))  # as hex tells a slot
        if not held.size:
            at, mask = at[:, :0], mask[:, :0]
    else:
        index, bits = held.bit_words(words)
        bit = np.log2(bits).astype(np.int64)
        at = index.astype(np.int64) * 4 + bit // 8 + codec.HEADER + (15 if isinstance(held, BloomFilter) else 13)
        mask, wide, fp = 1 << bit % 8, 1, pa.nulls(n, pa.int64())
    each = pa.StructArray.from_arrays([pa.array(x.reshape(-1)) for x in (at, mask)], ["at", "mask"])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * at.shape[1], pa.int32()), each)
    return pa.StructArray.from_arrays([lists, pa.array(np.full(n, wide, np.int32)), fp], ["bits", "wide", "fp"])


def _places(heads: pa.Array, sizes: pa.Array, keys: pa.Array) -> pa.Array:
    """_places_in of each row's frame, of which its first bytes and its size are given; frames that are the same are opened once."""
    frames: dict[tuple[bytes, int], list[int]] = {}
    for k, (head, size, key) in enumerate(zip(heads.to_pylist(), sizes.to_pylist(), keys.is_valid().to_pylist(), strict=True)):
        if head is not None and key:
            frames.setdefault((head, size), []).append(k)
    if not frames:
        return pa.nulls(len(keys), PLACES)
    where, n = np.full(len(keys), -1), 0
    parts = []
    for (head, size), rows in frames.items():
        parts.append(_places_in(_opened(head, size), keys.take(pa.array(rows))).cast(PLACES))
        where[rows] = np.arange(n, n + len(rows))
        n += len(rows)
    return pa.concat_arrays(parts).take(pa.array(where, mask=where < 0))


PLACES_SQL = "struct<bits:array<struct<at:bigint,mask:bigint>>,wide:int,fp:bigint>"
_TAIL = "hex(substring(frame, -4, 4))"
_NUMBER = "cast(conv(hex(substring(frame, cast(b.at AS INT), {})), 16, 10) AS BIGINT)"
#: Only a frame's first bytes go to Python, for each row; its checksum and bits are looked at where the row is.
FUNCTIONS = (
    f"""
CREATE OR REPLACE TEMPORARY FUNCTION amq_found(frame BINARY, places {PLACES_SQL.upper()}) RETURNS BOOLEAN RETURN
CASE WHEN frame IS NULL OR places IS NULL THEN NULL
WHEN crc32(substring(frame, 1, octet_length(frame) - 4)) <> cast(conv({" || ".join(f"substring({_TAIL}, {k}, 2)" for k in (7, 5, 3, 1))}, 16, 10) AS BIGINT)
THEN cast(raise_error('ChecksumError') AS BOOLEAN)
WHEN places.fp IS NULL THEN forall(places.bits, b -> ({_NUMBER.format(1)} & b.mask) <> 0)
ELSE size(places.bits) > 0 AND aggregate(places.bits, 0L, (x, b) -> x ^ {_NUMBER.format("places.wide")}) = places.fp END
""",
    "CREATE OR REPLACE TEMPORARY FUNCTION amq_might_contain(frame BINARY, key BINARY) RETURNS BOOLEAN RETURN amq_found(frame, amq_places(substring(frame, 1, 28), octet_length(frame), key))",
)


def _parse(frames: pa.Array) -> pa.Array:
    rows = []
    for frame in frames:
        try:
            head = codec.read_frame(frame.as_py()) if frame.is_valid else None
            rows.append(head and {"kind": head.kind, "flags": head.flags, "error": None})
        except codec.SerializationError as e:
            rows.append({"kind": None, "flags": None, "error": type(e).__name__})
    return pa.array(rows, pa.struct([("kind", pa.int32()), ("flags", pa.int32()), ("error", pa.string())]))


def register(spark: SparkSession) -> None:
    """amq_hash128(key), amq_might_contain(frame, key) and amq_parse(frame) for SQL text."""
    for name, run, kind in (("amq_hash128", _hash, columns.HASH_TYPE), ("amq_places", _places, PLACES_SQL), ("amq_parse", _parse, "struct<kind:int,flags:int,error:string>")):
        spark.udf.register(name, F.arrow_udf(run, kind))
    for function in FUNCTIONS:
        spark.sql(function)
