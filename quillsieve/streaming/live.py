"""Filters that grow with a stream.

Each micro-batch's bits are united with those stored. A bit that is set twice
stays set, so a batch that is replayed after a failure changes nothing: the
filter is exact under at-least-once delivery. Stored states are written under
the batch's number and the newest complete one is read, so a failure between
two writes leaves the one before.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quillsieve.operators import build, probe
from quillsieve.operators.filters import _Mutable
from quillsieve.plans import saturation


class LiveFilter:
    """A Bloom or blocked filter below `path`, as a table of words for each batch."""

    def __init__(self, spark: SparkSession, path: str, like: _Mutable) -> None:
        self.spark, self.path, self.like = spark, path.rstrip("/"), build.template(like)
        self.size = like

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _latest(self) -> DataFrame | None:
        log = self._log()
        return None if log is None else log.orderBy(F.desc("batch"), F.desc("at")).limit(1)

    def words(self) -> DataFrame:
        """(word, mask) of all batches so far."""
        last = self._latest()
        row = last.first() if last is not None else None
        return self.spark.read.parquet(f"{self.path}/words/{row['name']}") if row else self.spark.createDataFrame([], "word long, mask long")

    def absorb(self, batch: DataFrame, number: int, key: str | Column = "key") -> None:
        """Add a micro-batch's keys; safe to repeat."""
        name = f"{number}-{uuid.uuid4().hex}"
        fresh = build.words_of(build.keys_of(batch, key), self.like)
        build.united(self.words(), fresh).write.parquet(f"{self.path}/words/{name}")
        before = self._names()
        entry = build_log(self.spark, number, name, saturation.stats(self.spark.read.parquet(f"{self.path}/words/{name}"), self.like))
        entry.write.mode("append").parquet(f"{self.path}/log")
        for old in before[:-1]:  # the one that was newest stays, for readers that have begun with it
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/words/{old}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _names(self) -> list[str]:
        """Stored states, the newest last."""
        last = self._log()
        return [] if last is None else [r["name"] for r in last.orderBy("batch", "at").select("name").collect()]  # a row a batch

    def value(self) -> _Mutable:
        """The filter so far, as a value."""
        empty = self.size._empty()
        return build.collect_words(self.words(), empty)

    def drift(self) -> DataFrame:
        """batch, bits_set and rate after each batch: a rate above the target means that the filter has outgrown its size."""
        return self.spark.read.parquet(f"{self.path}/log").groupBy("batch").agg(F.max("bits_set").alias("bits_set"), F.max("rate").alias("rate")).orderBy("batch")


def build_log(spark: SparkSession, number: int, name: str, stats: DataFrame) -> DataFrame:
    return stats.select(F.lit(number).cast("long").alias("batch"), F.lit(name).alias("name"), F.current_timestamp().alias("at"), "bits_set", "rate").coalesce(1)


def absorbing(stream: DataFrame, live: LiveFilter, checkpoint: str, key: str = "key") -> DataStreamWriter:
    """A stream writer that adds a stream's keys to a live filter."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: live.absorb(batch, number, key))


def new_rows(batch: DataFrame, live: LiveFilter, key: str) -> DataFrame:
    """batch with seen: false is certain; true is right but for the filter's rate, so rows that are dropped by it may be new."""
    return batch.withColumn("seen", F.coalesce(probe.might_contain(batch.sparkSession, live.value(), F.col(key).cast("string")), F.lit(False)))


def first_within(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """A stream's rows without those whose keys came before, as long ago as the watermark's delay at most: exact, with state that is dropped behind the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def first_ever(stream: DataFrame, live: LiveFilter, key: str, out: str, checkpoint: str) -> DataStreamWriter:
    """A stream writer that appends the first row of every key to the table below `out`, however long ago the key came.

    The live filter tells most keys of a batch to be new; only those that it may
    have seen are looked up among the stored ones. A batch writes its own folder,
    so one that is replayed replaces what it wrote.
    """

    def absorb(batch: DataFrame, number: int) -> None:
        spark, fresh = batch.sparkSession, batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        marked = new_rows(fresh, live, key) if number else fresh.withColumn("seen", F.lit(False))
        if number:
            stored = spark.read.schema(batch.schema).parquet(*[f"{out}/batch={k}" for k in range(number)]).select(key)
            known = marked.where("seen").join(stored, key, "left_anti")
            marked = marked.where("not seen").unionByName(known)
        marked.drop("seen").write.mode("overwrite").parquet(f"{out}/batch={number}")
        live.absorb(spark.read.schema(batch.schema).parquet(f"{out}/batch={number}"), number, key)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(absorb)


def distinct_exactly(df: DataFrame, seen: DataFrame, key: str, epsilon: float = 0.01) -> DataFrame:
    """The distinct rows of df whose key is not in seen: the filter rules most out, an exact check decides the rest."""
    return probe.anti_join(df, seen, key, "bloom", epsilon).dropDuplicates([key])
