"""Generated key pools for measuring and for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered(spark: SparkSession, n: int, prefix: str) -> DataFrame:
    """key: the prefix followed by 0, 1, ... Pools of different prefixes share no key."""
    return spark.range(n).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("key"))


def members(spark: SparkSession, n: int) -> DataFrame:
    return numbered(spark, n, "key-")


def misses(spark: SparkSession, n: int) -> DataFrame:
    return numbered(spark, n, "miss-")
