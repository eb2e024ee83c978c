"""Building filters from DataFrames.

Bits are united by `bit_or`, so a build is one aggregation: each task turns its
batches into (word, mask) rows, already united by batch, and the shuffle unites
them by word. The result does not depend on partitioning or order. As long as a
filter is small it is then collected to a value; a larger one stays a table of
words, which can be probed by a join.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.errors import ParamError
from quillsieve.functions import columns, kernels, sizing
from quillsieve.operators.filters import BinaryFuse8, BinaryFuse16, BlockedBloomFilter, BloomFilter, _BinaryFuse, _Mutable, several_from_hashes

#: Payloads above this are not collected or broadcast.
DENSE_BYTES = 64 << 20
SEGMENT = 1 << 16  # words of a filter that one row carries to the driver
PIECE = 1 << 12  # words that one row carries between the tasks that build a value: 16 KB
#: Groups whose sizes are broadcast.
FEW_GROUPS = 100_000
#: Keys above this are not peeled in one task (about 150 bytes each while it runs); see sharded_fuse.
FUSE_KEYS = 1_000_000


def keys_of(df: DataFrame, key: str | Column) -> DataFrame:
    """The non-null keys, as one column `key`; numbers and dates as their text."""
    column = F.col(key) if isinstance(key, str) else key
    keys = df.select(column.alias("key"))
    if keys.schema["key"].dataType.simpleString() not in ("string", "binary"):
        keys = keys.select(F.col("key").cast("string").alias("key"))
    return keys.where("key is not null")


def fits(kind: str, n: int, epsilon: float) -> bool:
    """Whether a filter of n keys may be held as a value: by its bytes, or, of a fuse filter, by what its peeling takes."""
    if kind in ("fuse8", "fuse16"):
        return n <= FUSE_KEYS
    n = max(1, n)
    bits = sizing.bloom_size(n, epsilon).m if kind == "bloom" else sizing.blocked_count(sizing.blocked_bits_per_key(epsilon), n) * sizing.BLOCK_BITS
    return bits <= 8 * DENSE_BYTES


def addressable(kind: str, n: int, epsilon: float) -> bool:
    """Whether a filter of n keys can be addressed at all: its parameters are unsigned 32-bit numbers."""
    return max(n, sizing.bloom_size(max(1, n), epsilon).m if kind == "bloom" else 0) < 1 << 32


def template(like: _Mutable) -> _Mutable:
    """The filter's parameters without its payload, to send to tasks."""
    out = copy.copy(like)
    out.words = np.zeros(0, np.uint32)
    return out


def words_of(keys: DataFrame, like: _Mutable) -> DataFrame:
    """(word, mask) of the filter `like` over keys(key): the words that have a bit."""
    bare = template(like)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, mask = bare.bit_words(kernels.murmur128(b.column(0), bare.seed))
            index, mask = kernels.or_words(index.reshape(-1), mask.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(index.astype(np.int64)), pa.array(mask.astype(np.int64))], names=["word", "mask"])

    return united(keys.select("key").mapInArrow(run, "word long, mask long"))


def united(*words: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The union of filters of the same parameters, given as words; by: columns that tell filters of a table apart."""
    every = words[0]
    for more in words[1:]:
        every = every.unionByName(more)
    return every.groupBy(*by, "word").agg(F.bit_or("mask").alias("mask"))


def collect_words(words: DataFrame, into: _Mutable) -> _Mutable:
    """The filter with these words, as a value. Its size is checked before anything is collected."""
    if into.words.nbytes > DENSE_BYTES:
        raise ParamError(f"a filter of {into.words.nbytes} bytes is kept as words; the bound for a value is {DENSE_BYTES}")

    def segment(table: pa.Table) -> pa.Table:
        part = np.zeros(SEGMENT, "<u4")
        part[table["word"].to_numpy() % SEGMENT] = table["mask"].to_numpy()
        return pa.table({"segment": [table["segment"][0].as_py()], "part": pa.array([part.tobytes()], pa.binary())})

    parts = words.withColumn("segment", F.floor(F.col("word") / SEGMENT)).groupBy("segment").applyInArrow(segment, "segment long, part binary")
    for row in parts.toLocalIterator():
        at = row["segment"] * SEGMENT
        into.words[at : at + SEGMENT] = np.frombuffer(row["part"], "<u4")[: len(into.words) - at]
    return into


def dense(keys: DataFrame, into: _Mutable) -> _Mutable:
    """The filter `into` with keys(key), as a value: each task sets bits in an array of its own, and sends it in pieces of up to PIECE words that are united piece by piece.

    A task holds a filter of DENSE_BYTES at most, where rows of words would take many times that to aggregate.
    """
    if into.words.nbytes > DENSE_BYTES:
        raise ParamError(f"a filter of {into.words.nbytes} bytes is kept as words; the bound for a value is {DENSE_BYTES}")
    bare, size = template(into), len(into.words)

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for b in batches:
            index, mask = bare.bit_words(kernels.murmur128(b.column(0), bare.seed))
            index, mask = kernels.or_words(index.reshape(-1), mask.reshape(-1))
            words = np.zeros(size, "<u4") if words is None else words
            words[index] |= mask
        for at in range(0, size if words is not None else 0, PIECE):
            part = words[at : at + PIECE]
            if part.any():
                yield _piece(at // PIECE, part)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b in batches:
            for piece, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(part.as_buffer(), "<u4")
                if piece == last:
                    held |= part
                    continue
                if held is not None:
                    yield _piece(last, held)
                last, held = piece, part.copy()
        if held is not None:
            yield _piece(last, held)

    kind = "piece long, part binary"
    sent = keys.select("key").mapInArrow(set_bits, kind).repartition("piece").sortWithinPartitions("piece")
    for row in sent.mapInArrow(unite, kind).toLocalIterator():
        at = row["piece"] * PIECE
        into.words[at : at + PIECE] = np.frombuffer(row["part"], "<u4")
    return into


def _piece(piece: int, part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["piece", "part"])


def _sized(df: DataFrame, key: str | Column, epsilon: float, kind: type[_Mutable]) -> tuple[DataFrame, _Mutable]:
    keys = keys_of(df, key)
    return keys, kind.create(max(1, keys.count()), epsilon)


def bloom(df: DataFrame, key: str | Column, epsilon: float) -> BloomFilter:
    """A classic Bloom filter of a column; sized by its rows, repeated keys included."""
    keys, empty = _sized(df, key, epsilon, BloomFilter)
    return dense(keys, empty)


def blocked(df: DataFrame, key: str | Column, epsilon: float) -> BlockedBloomFilter:
    """A split-block Bloom filter of a column; sized by its rows, repeated keys included."""
    keys, empty = _sized(df, key, epsilon, BlockedBloomFilter)
    return dense(keys, empty)


def bloom_words_by(df: DataFrame, key: str, by: tuple[str, ...], epsilon: float, seed: int = 0) -> DataFrame:
    """A Bloom filter for each group, as rows (by..., m, k, n, word, mask).

    Each group is sized by its own rows. Rows without a key count for nothing; a
    group without any has no rows.
    """
    keyed = df.select(*by, F.col(key).cast("string").alias("key")).where("key is not null")
    sizes = keyed.groupBy(*by).agg(F.count("*").alias("n"))
    m, k = sizing.bloom_size_columns(F.col("n").cast("double"), F.lit(float(epsilon)))
    sizes = sizes.withColumn("m", m.cast("long")).withColumn("k", k.cast("long"))
    hashed = keyed.withColumn("h", columns.hash128(F.col("key"), seed))
    sizes = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], "m", "k", "n")
    if sizes.count() <= FEW_GROUPS:  # so that the rows of a large group stay where they are
        sizes = F.broadcast(sizes)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    bits = hashed.join(sizes, same).select(*by, "m", "k", "n", F.explode(columns.probes(F.col("h"), F.col("k"), F.col("m"))).alias("bit"))
    word, mask = columns.bit_word(F.col("bit"))
    return bits.groupBy(*by, "m", "k", "n", word.alias("word")).agg(F.bit_or(mask).alias("mask"))


def key_hashes(keys: DataFrame) -> DataFrame:
    """(w0, w1, shard): the distinct 64-bit hashes of keys(key); shard is a hash word that fuse filters don't use."""
    h = columns.hash128(F.col("key"))
    return keys.select(h.alias("h")).groupBy("h.w0", "h.w1").agg(F.min("h.w2").alias("shard"))


def _peeled(*kinds: type[_BinaryFuse]):
    def run(table: pa.Table) -> pa.Table:
        w0, w1 = (table[c].to_numpy().astype(np.uint64) for c in ("w0", "w1"))
        made = [x.to_bytes() for x in several_from_hashes(kinds, w0 | w1 << np.uint64(32))]
        return pa.table({"shard": pa.array([table["part"][0].as_py()] * len(made), pa.int64()), "frame": pa.array(made, pa.binary())})

    return run


def fuses(df: DataFrame, key: str | Column, *kinds: type[_BinaryFuse]) -> list[_BinaryFuse]:
    """Binary fuse filters of several widths of a column's distinct keys. The peeling order makes the bytes, so it runs in one task, once for all widths, up to FUSE_KEYS keys."""
    hashes = key_hashes(keys_of(df, key)).select("w0", "w1", F.lit(0).alias("part"))
    n = hashes.count()
    if n > FUSE_KEYS:
        raise ParamError(f"{n} keys are peeled in shards, by sharded_fuse; the bound for one filter is {FUSE_KEYS}")
    if not n:
        return several_from_hashes(kinds, np.zeros(0, np.uint64))
    rows = hashes.groupBy("part").applyInArrow(_peeled(*kinds), "shard long, frame binary").collect()  # one a width
    return [next(kind.from_bytes(bytes(r["frame"])) for r in rows if r["frame"][5] == kind.kind) for kind in kinds]


def fuse(df: DataFrame, key: str | Column, kind: type[_BinaryFuse] = BinaryFuse8) -> _BinaryFuse:
    """One such filter."""
    return fuses(df, key, kind)[0]


def shards_for(keys: int) -> int:
    """Shards in which so many distinct keys are peeled well within FUSE_KEYS each, as they are dealt by hash."""
    return max(1, -(-2 * keys // FUSE_KEYS))


def sharded_fuse(df: DataFrame, key: str | Column, shards: int, kind: type[_BinaryFuse] = BinaryFuse16) -> DataFrame:
    """(shard, frame): a filter for each shard of the keys, peeled side by side. A key's shard is word 2 of its hash modulo `shards`.

    A shard of more than FUSE_KEYS keys is refused; shards_for tells how many shards do.
    """
    hashes = key_hashes(keys_of(df, key)).select("w0", "w1", F.pmod("shard", F.lit(shards)).alias("part"))
    largest = hashes.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    if largest > FUSE_KEYS:
        raise ParamError(f"shards: of {shards} one has {largest} keys; the bound is {FUSE_KEYS}, and {shards_for(largest * shards)} shards do")
    return hashes.groupBy("part").applyInArrow(_peeled(kind), "shard long, frame binary")


FUSES = {"fuse8": BinaryFuse8, "fuse16": BinaryFuse16}
BUILDERS = {"bloom": bloom, "blocked": blocked, "fuse8": lambda df, key, _=None: fuse(df, key, BinaryFuse8), "fuse16": lambda df, key, _=None: fuse(df, key, BinaryFuse16)}


def build(df: DataFrame, key: str | Column, kind: str = "bloom", epsilon: float = 0.01):
    """A filter of any kind; fuse filters' rate is fixed by their width."""
    if kind not in BUILDERS:
        raise ParamError(f"kind: {kind!r} is none of {sorted(BUILDERS)}")
    return BUILDERS[kind](df, key, epsilon)
