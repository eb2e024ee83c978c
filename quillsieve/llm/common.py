"""Helpers shared by the text operators: tables, checkpoints, words, cuts."""

from __future__ import annotations

import contextlib
import ctypes
import json
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space that ends a word, as characters.
SPACES = "\t\n\x0b\x0c\r"
#: Most rows of a table that is broadcast after its rows were counted.
BROADCAST_ROWS = 100_000
#: Most cut points of a range split; they travel inside the plan.
MAX_CUTS = 65_536
#: Rows of an Arrow batch that a worker treats at once.
SLICE = 1024
#: Keys that hold more than one row in so many of a table, times its partitions, are joined by broadcast.
HOT_SHARE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back.

    The folder is the session's spark.checkpoint.dir; only where none is set, on
    a local master (tests on one machine), a temporary one is made.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quillsieve-checkpoint-"))
    return sc.getCheckpointDir()


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [quoted(c) for c in df.columns]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def as_row(df: DataFrame) -> Column:
    """The whole row as one struct column `row`, so that added columns clash with none of its names; select("row.*") unpacks it."""
    return F.struct(*columns_of(df)).alias("row")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body is a lambda's."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, `rows` at most at once; between batches the worker's free memory goes back to the system.

    Workers live on between tasks, and would keep the memory of their largest
    batch for as long.
    """
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
        del b
        give_back()


def give_back() -> None:
    """Returns this process's free memory to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def null_to_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """The text's words as an array; none for an empty text."""
    flat = F.btrim(F.translate(text, SPACES, " " * len(SPACES)))
    return let(flat, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " +")))


def in_held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows are few; else left to the shuffle join, which AQE splits on skew."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def with_values(df: DataFrame, key: str, values: DataFrame, count: str, hot_share: int = HOT_SHARE) -> DataFrame:
    """df with the columns of values, which has one row for each key of df and in `count` how many rows of df have it.

    Keys that many rows share meet them by broadcast, all others by a shuffle
    join: no task gets all rows of a frequent key. At most hot_share times the
    shuffle partitions can be so frequent, so what is broadcast is bounded.
    """
    values = cut_lineage(values)
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = values.agg(F.sum(count)).first()[0] or 0
    limit = total / (hot_share * parts)
    hot = values.where(F.col(count) > limit).drop(count)
    if not hot.take(1):
        return df.join(values.drop(count), key)
    names = [c for c in values.columns if c not in (key, count)]
    marked = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    cold = marked.where("_hot is null").drop("_hot", *names).join(values.where(F.col(count) <= limit).drop(count), key)
    return marked.where("_hot").drop("_hot").unionByName(cold)


def range_cuts(df: DataFrame, key: str, parts: int) -> list:
    """Sorted values of key that are present in df; range i starts exactly at cut i.

    Made of the smallest key and approximate quantiles, each of which is a
    present value; for keys that are not numbers, of those whose hashes are
    least. Empty where no key is non-null.
    """
    parts = max(1, min(parts, MAX_CUTS))
    at = [i / parts for i in range(1, parts)]
    number = isinstance(df.schema[key].dataType, T.NumericType)
    wanted = [F.min(key).alias("lo")]
    if at and number:
        wanted.append(F.percentile_approx(key, at, max(10_000, 4 * parts)).alias("q"))
    row = df.agg(*wanted).first()
    if row["lo"] is None:
        return []
    if at and not number:
        some = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key)).limit(4 * parts)
        drawn = sorted(r[0] for r in some.collect())
        return sorted({row["lo"], *(drawn[len(drawn) * i // parts] for i in range(1, parts))})
    return sorted({row["lo"], *((row["q"] or []) if at else [])})


def as_array(cuts: list, kind: str) -> Column:
    """Cuts as one literal array; kind: the keys' type."""
    return F.from_json(F.lit(json.dumps(cuts, default=str)), f"array<{kind}>")


def range_of(key: Column, cuts: list, kind: str = "bigint") -> Column:
    """Index of the range that key falls in; null keys fall in the last one.

    Two short lists of comparisons instead of a long one: about the square root
    of the number of cuts each. kind: the keys' type.
    """
    if len(cuts) < 2:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    heads = cuts[::step]
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    head_list, group_list = as_array(heads, kind), as_array(groups, f"array<{kind}>")
    count = lambda xs, k: F.size(F.filter(xs, lambda c: c <= k))
    found = let(
        F.greatest(count(head_list, key) - 1, F.lit(0)),
        lambda g: g * step + F.greatest(count(F.get(group_list, g), key) - 1, F.lit(0)),
    )
    return F.when(key.isNull(), F.lit(len(cuts) - 1)).otherwise(found).cast("int")


def bounded_sample(rows: DataFrame, by: str, most_bytes: int, most_rows: int) -> DataFrame:
    """Those of rows(draw, text, by), at most most_rows in each group in the order of draw, that together have at most most_bytes of text.

    For rows that are few already; the first of each group always stays.
    """
    in_order = W.partitionBy(by).orderBy("draw", "text")
    so_far = F.sum(F.octet_length("text")).over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow))
    numbered = rows.withColumn("_so_far", so_far).withColumn("_number", F.row_number().over(in_order))
    return numbered.where((F.col("_number") == 1) | (F.col("_so_far") <= most_bytes) & (F.col("_number") <= most_rows)).drop("_so_far", "_number")


def with_fields(df: DataFrame, **kinds: str) -> T.StructType:
    """df's schema and more fields, nullable."""
    more = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in kinds.items()))
    return T.StructType([*df.schema.fields, *more.fields])
