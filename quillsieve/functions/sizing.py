"""How large a filter must be: as Python numbers at plan time, and as columns for tables of requirements."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.errors import ParamError

BLOCK_BITS, LANES, LANE_BITS = 256, 8, 32
MOST_BLOCKED_BITS = 128


class BloomSize(NamedTuple):
    m: int
    k: int


class FuseGeometry(NamedTuple):
    segment: int
    segment_count_length: int
    array_length: int


def bloom_size(n: float, epsilon: float) -> BloomSize:
    """Bits and hash functions of a classic Bloom filter for n keys. No validation."""
    m = math.ceil(-n * math.log(epsilon) / math.log(2) ** 2)
    return BloomSize(m, max(1, math.floor(m / n * math.log(2) + 0.5)))


def bloom_rate(m: float, k: float, n: float) -> float:
    """The modelled false-positive rate of a classic Bloom filter that holds n keys."""
    return (1 - math.exp(-k * n / m)) ** k


def floor_bits_per_key(epsilon: float) -> float:
    """What no membership structure can go below."""
    return -math.log2(epsilon)


def blocked_rate(bits_per_key: float) -> float:
    """The modelled false-positive rate of a split-block filter.

    A block of 256 bits holds a Poisson number of keys, and answers true for an
    absent key if its bit is set in all 8 lanes.
    """
    mean = BLOCK_BITS / bits_per_key
    mass, total, load = math.exp(-mean), 0.0, 0
    while True:
        total += mass * (1 - (1 - 1 / LANE_BITS) ** load) ** LANES
        if load > mean and mass < 1e-15:
            return total
        load += 1
        mass *= mean / load


def blocked_bits_per_key(epsilon: float) -> int:
    """The fewest whole bits per key that meet epsilon."""
    for bits in range(1, MOST_BLOCKED_BITS + 1):
        if blocked_rate(bits) <= epsilon:
            return bits
    raise ParamError(f"epsilon: {epsilon!r} is below what {MOST_BLOCKED_BITS} bits a key give a blocked filter")


def blocked_count(bits_per_key: float, capacity: int) -> int:
    return max(1, math.ceil(bits_per_key * capacity / BLOCK_BITS))


def fuse_geometry(n: int) -> FuseGeometry:
    """Segments and array of a 3-wise binary fuse filter of n distinct keys."""
    if n <= 0:
        return FuseGeometry(1, 1, 3)
    segment = min(2 ** math.floor(math.log(n) / math.log(3.33) + 2.25), 2**18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    capacity = math.floor(n * factor + 0.5)
    count = max(1, -(-capacity // segment) - 2)
    return FuseGeometry(segment, count * segment, (count + 2) * segment)


def fuse_bits_per_key(n: int, width: int) -> float:
    return 0 if n == 0 else fuse_geometry(n).array_length * width / n


# The same for columns. Logarithms at the edge of a whole number may differ by
# one unit in the last place between runtimes, so builders size in Python.


def bloom_size_columns(n: Column, epsilon: Column) -> tuple[Column, Column]:
    ln2 = F.log(F.lit(2.0))
    m = F.ceil(-n * F.log(epsilon) / (ln2 * ln2))
    return m, F.greatest(F.lit(1), F.floor(m / n * ln2 + 0.5))


def bloom_rate_column(m: Column, k: Column, n: Column) -> Column:
    return F.pow(1 - F.exp(-k * n / m), k)


def fuse_geometry_columns(n: Column) -> tuple[Column, Column, Column]:
    """segment, segment_count_length and array_length for n >= 1."""
    segment = F.least(F.pow(F.lit(2.0), F.floor(F.log(n.cast("double")) / F.log(F.lit(3.33)) + 2.25)), F.lit(float(2**18))).cast("long")
    factor = F.greatest(F.lit(1.125), 0.875 + 0.25 * F.log(F.lit(1e6)) / F.log(F.greatest(n, F.lit(2)).cast("double")))
    capacity = F.floor(n * factor + 0.5)
    count = F.greatest(F.lit(1), F.floor((capacity + segment - 1) / segment) - 2)
    return segment, count * segment, (count + 2) * segment


def blocked_rates(spark: SparkSession) -> DataFrame:
    """bits_per_key 1 to 128 and its modelled rate, from the Poisson sum in columns."""
    bits = spark.range(1, MOST_BLOCKED_BITS + 1).withColumnRenamed("id", "bits_per_key")
    mean = BLOCK_BITS / F.col("bits_per_key")
    loads = F.sequence(F.lit(0), F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int"))
    step = lambda s, j: F.struct(
        F.when(j == 0, s["mass"]).otherwise(s["mass"] * mean / j).alias("mass"),
        (s["rate"] + F.when(j == 0, s["mass"]).otherwise(s["mass"] * mean / j) * F.pow(1 - F.pow(F.lit(31 / 32), j), F.lit(8.0))).alias("rate"),
    )
    rate = F.aggregate(loads, F.struct(F.exp(-mean).alias("mass"), F.lit(0.0).alias("rate")), step, lambda s: s["rate"])
    return bits.select("bits_per_key", rate.alias("rate"))
