"""How full a filter given as words is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.functions import sizing
from quillsieve.operators.filters import BloomFilter, _Mutable


def stats(words: DataFrame, like: _Mutable) -> DataFrame:
    """One row: bits_set, rate (of false positives at this filling) and bits_per_key."""
    total, hashes = (like.m, like.k) if isinstance(like, BloomFilter) else (like.blocks * sizing.BLOCK_BITS, sizing.LANES)
    bits = F.coalesce(F.sum(F.bit_count("mask")), F.lit(0)).cast("long")
    one = words.agg(bits.alias("bits_set"))
    return one.select("bits_set", F.pow(F.col("bits_set") / float(total), F.lit(float(hashes))).alias("rate"), F.lit(float(like.bits_per_key)).alias("bits_per_key"))
