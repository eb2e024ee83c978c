"""Probing filters: as a predicate, as a join with a filter's words, and in front of exact joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsieve.errors import ParamError
from quillsieve.functions import columns, kernels
from quillsieve.operators import build
from quillsieve.operators.filters import BlockedBloomFilter, BloomFilter, Filter, _Mutable, from_bytes

_opened: dict = {}


def _value(shared) -> Filter:
    """The worker's copy of a broadcast filter."""
    if shared.value not in _opened:
        if len(_opened) > 8:
            _opened.clear()
        _opened[shared.value] = from_bytes(shared.value)
    return _opened[shared.value]


def might_contain(spark: SparkSession, held: Filter, key: Column, here: bool = False) -> Column:
    """Whether a filter may hold a text or binary column's key; false is certain. Null for null.

    here: keep the optimizer from repeating the probe elsewhere, as on the other
    side of a join, whose keys all pass.
    """
    frame = held.to_bytes()
    if len(frame) > build.DENSE_BYTES + 64:
        raise ParamError(f"a filter of {len(frame)} bytes is probed by probe_words, not broadcast")
    shared = spark.sparkContext.broadcast(frame)

    @F.arrow_udf("boolean")
    def run(keys: pa.Array) -> pa.Array:
        return pa.array(_value(shared).has_all(keys), mask=np.array(keys.is_null()))

    return (run.asNondeterministic() if here else run)(key)


def probe_words(keys: DataFrame, words: DataFrame, like: _Mutable) -> DataFrame:
    """keys(key) once each, with found: whether the filter of these words may hold it.

    For filters too large to broadcast: both sides are shuffled by word.
    """
    bare = build.template(like)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, mask = bare.bit_words(kernels.murmur128(b.column(0), bare.seed))
            n = index.shape[1]
            keys = b.column(0).take(pa.array(np.repeat(np.arange(len(index)), n)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(index.reshape(-1).astype(np.int64)), pa.array(mask.reshape(-1).astype(np.int64))], names=["key", "word", "bit"])

    kind = keys.schema["key"].dataType.simpleString()
    asked = keys.select("key").where("key is not null").distinct().mapInArrow(run, f"key {kind}, word long, bit long")
    hit = F.coalesce(F.col("mask").bitwiseAND(F.col("bit")) == F.col("bit"), F.lit(False))
    return asked.join(words, "word", "left").groupBy("key").agg(F.bool_and(hit).alias("found"))


#: Keys that meet a shard's frame in one task.
PROBED_KEYS = 500_000


def probe_shards(keys: DataFrame, frames: DataFrame, shards: int) -> DataFrame:
    """keys(key) with found, by the sharded fuse filter frames(shard, frame): each shard's keys meet its frame, in parts of about PROBED_KEYS."""
    parts = -(-keys.count() // (shards * PROBED_KEYS)) or 1
    part = F.pmod(F.monotonically_increasing_id(), F.lit(parts))
    asked = keys.select("key", F.pmod(columns.hash128(F.col("key"))["w2"], F.lit(shards)).alias("shard"), part.alias("part"))
    each = frames.select("shard", "frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return pa.table({"key": left["key"], "found": pa.array(np.zeros(left.num_rows, bool))})
        return pa.table({"key": left["key"], "found": pa.array(from_bytes(right["frame"][0].as_py()).has_all(left["key"]))})

    kind = keys.schema["key"].dataType.simpleString()
    return asked.where("key is not null").groupBy("shard", "part").cogroup(each.groupBy("shard", "part")).applyInArrow(run, f"key {kind}, found boolean")


def membership(asked: DataFrame, source: DataFrame, key: str | Column, kind: str = "bloom", epsilon: float = 0.01) -> DataFrame:
    """asked(key), its non-null rows, with found: whether a filter of source's column may hold the key.

    The filter is a value as long as it fits; a larger one stays a table, of
    words or of shards, with the same answers for bloom and blocked filters, and
    of the same rate for fuse filters.
    """
    held = build.keys_of(source, key)
    n = held.count()
    if build.fits(kind, n, epsilon):
        value = build.build(held, "key", kind, epsilon)
        return asked.select("key").where("key is not null").withColumn("found", might_contain(asked.sparkSession, value, F.col("key")))
    if kind in build.FUSES:
        distinct = build.key_hashes(held).count()
        shards = build.shards_for(distinct)
        return probe_shards(asked.select("key"), build.sharded_fuse(held, "key", shards, build.FUSES[kind]), shards)
    like = _sized_like(kind, n, epsilon)
    found = probe_words(asked, build.words_of(held, like), like)
    return asked.select("key").join(found, "key")


def _sized_like(kind: str, n: int, epsilon: float) -> _Mutable:
    """The parameters of a filter that stays a table of words."""
    return build.template((BloomFilter if kind == "bloom" else BlockedBloomFilter).create(max(1, n), epsilon))


# Keys of joins.


def common_type(left: DataFrame, right: DataFrame, on: str) -> T.DataType:
    """The type in which Spark compares both sides' keys; refused where there is none, or where equal keys may have unlike texts."""
    kinds = [df.schema[on].dataType for df in (left, right)]
    for kind in kinds:
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            raise ParamError(f"on: keys of type {kind.simpleString()} have no text to hash; join on their parts")
        if isinstance(kind, T.StringType) and getattr(kind, "collation", "UTF8_BINARY") != "UTF8_BINARY":
            raise ParamError(f"on: keys of collation {kind.collation} may be equal as unlike texts; use a plain join")
    if kinds[0] == kinds[1]:
        return kinds[0]
    both = [F.lit(None).cast(kind) for kind in kinds]
    try:
        return left.sparkSession.range(1).select(F.coalesce(*both).alias("x")).schema["x"].dataType
    except AnalysisException as e:
        raise ParamError(f"on: keys of types {kinds[0].simpleString()} and {kinds[1].simpleString()} cannot be compared") from e


def key_text(key: Column, kind: T.DataType) -> Column:
    """A key as what a filter hashes: equal keys have equal texts, -0.0 and 0.0 and all NaN too."""
    key = key.cast(kind)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        key = F.when(key == 0, F.lit(0.0).cast(kind)).when(F.isnan(key), F.lit(float("nan")).cast(kind)).otherwise(key)
    return key if isinstance(kind, (T.StringType, T.BinaryType)) else key.cast("string")


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _free(name: str, df: DataFrame) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name


def _marked(left: DataFrame, right: DataFrame, on: str, kind: str, epsilon: float, tabled: bool) -> tuple[DataFrame, str] | None:
    """left with a further column, whether right may have the key, and its name; None where the filter is too large to be of use."""
    if kind not in build.BUILDERS:
        raise ParamError(f"kind: {kind!r} is none of {sorted(build.BUILDERS)}")
    like = common_type(left, right, on)
    held = right.select(key_text(_named(on), like).alias("key")).where("key is not null")
    n, maybe = held.count(), _free("_maybe", left)
    if not tabled:
        if not build.fits(kind, n, epsilon):
            return None
        value = build.build(held, "key", kind, epsilon)
        return left.withColumn(maybe, might_contain(left.sparkSession, value, key_text(_named(on), like), here=True)), maybe
    if not build.addressable(kind, n, epsilon):
        return None
    text = _free("_key", left)
    keyed = left.withColumn(text, key_text(_named(on), like))
    asked = keyed.select(_named(text).alias("key"))
    if kind in build.FUSES:
        shards = build.shards_for(n)
        found = probe_shards(asked.distinct(), build.sharded_fuse(held, "key", shards, build.FUSES[kind]), shards)
    else:
        size = _sized_like(kind, n, epsilon)
        found = probe_words(asked, build.words_of(held, size), size)
    return keyed.join(found.select(F.col("key").alias(text), F.col("found").alias(maybe)), text, "left").drop(text), maybe


def semi_join(left: DataFrame, right: DataFrame, on: str, kind: str = "bloom", epsilon: float = 0.01, tabled: bool = False) -> DataFrame:
    """left rows whose `on` occurs in right: the exact left_semi, of the few rows that pass a filter of right's keys.

    Keys are compared in the type in which Spark compares them. A filter that is
    too large to be a value is left out, and the plain join gives the same rows.
    tabled: keep the filter as a table of words or shards, whatever its size.
    """
    marked = _marked(left, right, on, kind, epsilon, tabled)
    if marked is not None:
        left = marked[0].where(_named(marked[1])).drop(marked[1])
    columns_ = [_named(c) for c in left.columns]
    return left.join(right.select(_named(on)), on, "left_semi").select(columns_)


def anti_join(left: DataFrame, right: DataFrame, on: str, kind: str = "bloom", epsilon: float = 0.01, tabled: bool = False) -> DataFrame:
    """left rows whose `on` does not occur in right. What the filter rules out needs no join; the rest goes through the exact left_anti. Types and sizes as in semi_join."""
    marked = _marked(left, right, on, kind, epsilon, tabled)
    keys, columns_ = right.select(_named(on)), [_named(c) for c in left.columns]
    if marked is None:
        return left.join(keys, on, "left_anti").select(columns_)
    rows, maybe = marked
    certain = rows.where(~F.coalesce(_named(maybe), F.lit(False)))
    open_rows = rows.where(_named(maybe)).join(keys, on, "left_anti")
    return certain.select(columns_).unionByName(open_rows.select(columns_))


def measured_rate(spark: SparkSession, held: Filter, misses: DataFrame) -> DataFrame:
    """One row: probes, false_positives and rate over misses(key), keys that the filter does not hold."""
    hit = misses.select(might_contain(spark, held, F.col("key")).alias("hit"))
    return hit.agg(F.count("hit").alias("probes"), F.count_if("hit").alias("false_positives"), F.avg(F.col("hit").cast("double")).alias("rate"))


def verdicts(spark: SparkSession, keys: DataFrame, held: Filter, static: bool = False) -> Column:
    """For keys(key, inserted, late): absent, member, false positive, or, of a static filter, added after build."""
    found = F.when(~might_contain(spark, held, F.col("key")), "absent").when(F.col("inserted"), "member").otherwise("false positive")
    return F.when(F.col("late"), "added after build").otherwise(found) if static else found
