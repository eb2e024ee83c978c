"""Hashing and index derivation as columns: one Arrow function for the hash, built-in arithmetic for the rest.

Numbers of 32 bits are held in longs. Products of two of them are split at 16
bits, as ANSI mode forbids overflow.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsieve.functions import kernels

LOW = 0xFFFFFFFF
HASH_TYPE = "struct<w0:long,w1:long,w2:long,w3:long>"


def hash128(key: Column, seed: int = 0) -> Column:
    """MurmurHash3_x86_128 of a text or binary column as struct<w0..w3: long>; null for null."""

    @F.arrow_udf(HASH_TYPE)
    def run(keys: pa.Array) -> pa.Array:
        words = kernels.murmur128(keys, seed).astype("int64")
        return pa.StructArray.from_arrays([pa.array(words[:, i]) for i in range(4)], ["w0", "w1", "w2", "w3"], mask=keys.is_null())

    return run(key)


def low_product(x: Column, y: int | Column) -> Column:
    """x * y modulo 2^32."""
    y = F.lit(y).cast("long") if isinstance(y, int) else y
    high = (F.shiftright(x, 16) * y).bitwiseAND(0xFFFF)
    return (x.bitwiseAND(0xFFFF) * y + F.shiftleft(high, 16)).bitwiseAND(LOW)


def reduce_range(x: Column, size: Column | int) -> Column:
    """x of [0, 2^32) to [0, size): the high 32 bits of the product."""
    size = F.lit(size).cast("long") if isinstance(size, int) else size
    return F.shiftright(F.shiftright(x, 16) * size + F.shiftright(x.bitwiseAND(0xFFFF) * size, 16), 16)


def probes(h: Column, count: Column | int, size: Column | int) -> Column:
    """The bit indices of a hashed key in a Bloom filter: array<long>."""
    last = (F.lit(count) if isinstance(count, int) else count).cast("long") - 1
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: reduce_range((h["w0"] + i * h["w1"] + i * i).bitwiseAND(LOW), size))


def bit_word(index: Column) -> tuple[Column, Column]:
    """(word, mask) of a bit index, in words of 32 bits."""
    return F.shiftright(index, 5), F.pow(F.lit(2.0), index.bitwiseAND(31)).cast("long")


def block_lanes(h: Column, blocks: Column | int) -> Column:
    """The eight lanes of a hashed key in a split-block filter: array<struct<word: long, mask: long>>."""
    first = reduce_range(h["w0"], blocks) * 8
    lane = lambda i, salt: F.struct(
        (first + i).alias("word"), F.pow(F.lit(2.0), F.shiftright(low_product(h["w1"], salt), 27)).cast("long").alias("mask")
    )
    return F.array(*[lane(i, int(s)) for i, s in enumerate(kernels.SALT)])


def fuse_positions(key: Column, seed: int, segment: int, segment_count_length: int) -> Column:
    """The three slots of a text or binary key in a binary fuse filter: struct<h0, h1, h2: long>."""

    @F.arrow_udf("struct<h0:long,h1:long,h2:long>")
    def run(keys: pa.Array) -> pa.Array:
        mixed = kernels.mix_seed(kernels.key64(kernels.murmur128(keys)), seed)
        at = kernels.fuse_positions(mixed, segment, segment_count_length).astype("int64")
        return pa.StructArray.from_arrays([pa.array(at[:, i]) for i in range(3)], ["h0", "h1", "h2"], mask=keys.is_null())

    return run(key)
