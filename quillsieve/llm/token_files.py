"""Token ids in binary files with Elias-Fano document boundaries.

A file holds the ids of consecutive documents, ascending by doc_id, as one
array of little-endian numbers (16 bits where the vocabulary allows, else 32),
and two Elias-Fano codes: the ends of the documents in that array, and their
ids above the least. Spark's own committer writes the files to shared storage,
all in one folder, one for each block of a range of doc_id, and Spark reads them
back as binary files, so lost executors and stores without a local path are no
concern. Documents are read by select, a few boundaries at a time; they are never
unpacked into a table.

Layout: magic, version, id width, counts, range, part, least id, the two codes,
the array, CRC-32 of all before it, and one line feed (the text writer's).

Edge cases: a null text is empty, and its only id is the end id; rows that
repeat a doc_id follow each other, in the order of their texts' hashes; null
ids come last (rows of one id, or without one, lie in one range); an empty table gives no file and an empty result; a document
larger than a block has a block of its own. doc_id must be of a whole-number
type, as ids are coded as numbers; others are refused before anything is read.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsieve.llm import elias_fano
from quillsieve.llm.common import broadcast_if_small, cut_lineage, null_to_empty, range_cuts, range_of, shared_folder
from quillsieve.llm.tokenizing import encoder

BLOCK_IDS = 8_000_000
ROWS_A_RANGE = 4096
READ_DOCS = 1024  # boundaries that are open at once
MAGIC, VERSION = b"QSID", 2
_HEAD = struct.Struct("<4sBBIIIIq")  # magic, version, id width, documents, of these without id, range, part, least id


def pack_block(doc_ids: list[int | None], ids: list[bytes], width: int, place: tuple[int, int] = (0, 0)) -> bytes:
    """One file's content; place: its range and part, without the final line feed. doc_ids ascend, nulls last."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    above = known.view(np.uint64) - np.uint64(least & 0xFFFFFFFFFFFFFFFF)
    ends = np.cumsum([len(x) // width for x in ids])
    body = b"".join([_HEAD.pack(MAGIC, VERSION, width, len(ids), len(ids) - len(known), *place, least), elias_fano.encode(ends), elias_fano.encode(above), *ids])
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A file's content, opened: documents by number, without unpacking the boundaries."""

    def __init__(self, content: bytes) -> None:
        body = content[:-1]
        if content[-1:] != b"\n" or len(body) < _HEAD.size + 4 or zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("a token file is damaged: its checksum is wrong")
        magic, version, self.width, self.n, self.n_null, self.range, self.part, self.least = _HEAD.unpack_from(body)
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"not a token file of version {VERSION}")
        self.ends, at = elias_fano.decode(body, _HEAD.size)
        self.above, at = elias_fano.decode(body, at)
        self.ids = np.frombuffer(body, f"<u{self.width}", (len(body) - 4 - at) // self.width, at)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def bounds(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the documents from the first-th to before the last-th start and end."""
        ends = self.ends.slice(first, last).astype(np.int64)
        return np.concatenate([[self.ends.select(first - 1) if first else 0], ends[:-1]]).astype(np.int64), ends

    def doc_ids(self, first: int = 0, last: int | None = None) -> list[int | None]:
        last = self.n if last is None else min(last, self.n)
        known = (self.above.slice(first, last) + np.uint64(self.least & 0xFFFFFFFFFFFFFFFF)).view(np.int64).tolist()
        return [*known, *[None] * (last - first - len(known))]


def write_token_files(documents: DataFrame, path: str, vocabulary: str, spaces: str, end_id: int, width: int = 4, block_ids: int = BLOCK_IDS) -> None:
    """Encode documents(doc_id, text) and write the files to the folder path, one for each block of a range."""
    if not isinstance(documents.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError(f"doc_id is of type {documents.schema['doc_id'].dataType.simpleString()}; token files code whole numbers")
    n = documents.count()
    cuts = range_cuts(documents, "doc_id", max(1, n // ROWS_A_RANGE))
    end = end_id.to_bytes(width, "little")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(vocabulary, spaces, f"<u{width}")
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([ids + end for ids in of.encode_all(part.column(3))], pa.binary())], names=["range", "doc_id", "tie", "ids"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, size, docs, ids = None, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack_block(docs, ids, width, (at, part))], pa.binary())], names=["content"])

        for b in batches:
            for r, d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if docs and (r != at or size + len(x) > block_ids * width):
                    yield flush()
                    part, size, docs, ids = part + 1 if r == at else 0, 0, [], []
                at = r
                docs.append(d)
                ids.append(x)
                size += len(x)
        if docs:
            yield flush()

    ranged = documents.select(range_of(F.col("doc_id"), cuts).alias("range"), "doc_id", F.xxhash64("text").alias("tie"), null_to_empty("text").alias("text"))
    encoded = ranged.mapInArrow(encode, f"range int, doc_id {kind}, tie long, ids binary")
    in_order = encoded.repartition("range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_last(), "tie").select("range", "doc_id", "ids")
    files = in_order.mapInArrow(blocks, "content binary")
    files.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files below path: doc_id, start (in the whole id array), n_tokens, ids_crc32 (of 32-bit ids), ids (array)."""
    return _with_starts(_documents(spark, path, keep_ids=True)).select("doc_id", "start", "n_tokens", "ids_crc32", "ids")


def _documents(spark: SparkSession, path: str, keep_ids: bool) -> DataFrame:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                block = Block(content.as_py())
                for k in range(0, block.n, READ_DOCS):
                    last = min(k + READ_DOCS, block.n)
                    starts, ends = block.bounds(k, last)
                    ids = [block.ids[a:z].astype("<u4") for a, z in zip(starts, ends, strict=True)]
                    columns = [pa.array(np.full(last - k, block.range, np.int32)), pa.array(np.full(last - k, block.part, np.int32)), pa.array(block.doc_ids(k, last), pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                    names = ["range", "part", "doc_id", "local", "n_tokens", "ids_crc32"]
                    if keep_ids:
                        columns.append(pa.array(ids, pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(unpack, "range int, part int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids)


def _with_starts(rows: DataFrame) -> DataFrame:
    """rows with start: local plus the ids of all blocks before. The blocks are summed in two levels, so no window holds more than a share of them."""
    blocks = rows.groupBy("range", "part").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.floor(F.col("range") / 1024))
    blocks = cut_lineage(blocks)
    groups = blocks.groupBy("group").agg(F.sum("n").alias("total"))
    before = groups.select("group", (F.sum("total").over(W.orderBy("group")) - F.col("total")).alias("base"))
    inner = blocks.select("*", (F.sum("n").over(W.partitionBy("group").orderBy("range", "part")) - F.col("n")).alias("inside"))
    bases = inner.join(before, "group").select("range", "part", (F.col("base") + F.col("inside")).alias("base"))
    return rows.join(broadcast_if_small(bases, blocks.count()), ["range", "part"]).withColumn("start", F.col("base") + F.col("local"))


def encode_and_read_back(documents: DataFrame, vocabulary: str, spaces: str, end_id: int, width: int = 4) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from files written to the shared checkpoint folder, which are removed when they have been read."""
    spark = documents.sparkSession
    path = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    if not documents.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    write_token_files(documents, path, vocabulary, spaces, end_id, width)
    rows = cut_lineage(_documents(spark, path, keep_ids=False))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return _with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
