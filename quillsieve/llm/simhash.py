"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link if they differ in at most 3. Of their two halves
of 32 bits, one then differs in at most 1. The anchors of a half are a covering
code: the words of the perfect Hamming code of 31 bits, with bit 32 free. Every
half lies within radius 1 of an anchor. So each distinct fingerprint is sent,
for either half, to all anchors within 1 + 1: 17 of 2^27. Of two halves that
differ in at most 1, the nearest anchor of one is within 2 of both, so linked
fingerprints always meet at an anchor, and are compared there.

Equal fingerprints are folded before anything is replicated, however many
documents share one. At an anchor with many fingerprints blocks of them are
compared in pairs, as rows of their own. An anchor passes on a spanning forest
of its links, not all pairs; components follow from these.

Edge cases: a text of fewer words than a shingle is one shingle; a null text or
one without words has fingerprint zero, linked like any other; rows that
repeat a doc_id each count; component_id is the least doc_id that is not null;
an empty table gives an empty result; other columns are ignored, whatever their
names; very long texts are read whole, their hashes counted in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import broadcast_if_small, columns_of, cut_lineage, with_values
from quillsieve.llm.components import components

SHINGLE = 3
SEED = 42
BITS = 3
BLOCK = 2048  # fingerprints of an anchor that are compared in one piece
PIECE = 1 << 16  # hashes whose bits are counted at once
_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text as an unsigned number: bit i is set if over half of its shingles' XXH64 have it."""
    words = (text or "").encode("utf-8", "replace").translate(_UPPER).split()
    if not words:
        return 0
    flat, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = [0, *ends[: n - 1].tolist()]
    last = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, PIECE):
        hashes = np.array([digest(flat[a:b], seed) for a, b in zip(first[k : k + PIECE], last[k : k + PIECE], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of documents(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _masks() -> np.ndarray:
    """By syndrome of the Hamming code: what leads from a half to its 17 anchors; -1 for none."""
    free = 1 << 31
    rows = [[0, free] + [-1] * 15]
    for s in range(1, 32):
        pairs = [(1 << (a - 1)) | (1 << ((a ^ s) - 1)) for a in range(1, 32) if a < a ^ s]
        rows.append([1 << (s - 1), (1 << (s - 1)) | free, *pairs])
    return np.array(rows, np.int64)


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, fingerprints): a row for each fingerprint and each anchor within covering radius plus threshold."""
    masks, keys, owners = _masks(), [], []
    for side in (0, 1):
        half = (fps.view(np.uint64) >> np.uint64(32 * side)).astype(np.int64) & 0xFFFFFFFF
        syndrome = np.zeros(len(half), np.int64)
        for i in range(31):
            syndrome ^= ((half >> i) & 1) * (i + 1)
        m = masks[syndrome]
        keys.append(((half[:, None] ^ m) | (side << 32))[m >= 0])
        owners.append(np.repeat(fps, (m >= 0).sum(1)))
    return np.concatenate(keys), np.concatenate(owners)


def forest(a: np.ndarray, b: np.ndarray | None, bits: int = BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links within a, or between a and b."""
    nodes = a if b is None else np.concatenate([a, b])
    root = np.arange(len(nodes))
    offset = 0 if b is None else len(a)
    other = a if b is None else b
    found: list[tuple[int, int]] = []
    for i in range(len(a)):
        near = np.flatnonzero(np.bitwise_count(a[i] ^ other) <= bits) + offset
        new = near[root[near] != root[i]]
        if len(new):
            _, at = np.unique(root[new], return_index=True)  # one link into each tree that is joined
            found += [(int(a[i]), int(nodes[j])) for j in new[at]]
            root[np.isin(root, root[new])] = root[i]
    return found


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(0), batch.column(1)
        values = left.values.to_numpy(zero_copy_only=False).view(np.uint64)
        at = left.offsets.to_numpy()
        n, alone = np.diff(at), np.array(right.is_null())
        a_out, b_out = [], []
        for size in range(2, 9):  # the many small groups, all of a size at once
            first = at[:-1][(n == size) & alone]
            for i in range(size if len(first) else 0):
                for j in range(i):
                    x, y = values[first + i], values[first + j]
                    near = np.bitwise_count(x ^ y) <= BITS
                    a_out.append(x[near])
                    b_out.append(y[near])
        for k in np.flatnonzero((n > 8) | ~alone):
            own = values[at[k] : at[k + 1]]
            links = forest(own, None if alone[k] else np.array(right[k].as_py(), np.int64).view(np.uint64))
            a_out.append(np.array([x for x, _ in links], np.uint64))
            b_out.append(np.array([y for _, y in links], np.uint64))
        if a_out:
            a, b = (np.concatenate(x).view(np.int64) for x in (a_out, b_out))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """Edges(a, b) whose components are those of all links between the distinct fingerprints in column fp."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(fps), 4096):
                keys, owners = anchors_of(fps[k : k + 4096].copy())
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners)], names=["anchor", "fp"])

    sent = cut_lineage(distinct.select("fp").mapInArrow(replicate, "anchor long, fp long"))
    counts = cut_lineage(sent.groupBy("anchor").count().where(F.col("count") > BLOCK))
    hot = counts.count()
    alone = F.lit(None).cast("array<bigint>").alias("right")
    if not hot:
        groups = sent.groupBy("anchor").agg(F.collect_list("fp").alias("left")).where(F.size("left") > 1)
        return groups.select("left", alone).mapInArrow(_compare, "a long, b long")
    marked = sent.join(broadcast_if_small(counts, hot), "anchor", "left")
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int")
    placed = marked.select("anchor", "fp", F.coalesce(blocks, F.lit(1)).alias("blocks")).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    grouped = cut_lineage(placed.groupBy("anchor", "block", "blocks").agg(F.collect_list("fp").alias("left")).where("size(left) > 1 or blocks > 1"))
    within = grouped.where("size(left) > 1").select("left", alone)
    split = grouped.where("blocks > 1")
    below = split.where("block > 0").select("anchor", "left", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("other"))
    across = below.join(split.select("anchor", F.col("block").alias("other"), F.col("left").alias("right")), ["anchor", "other"])
    return within.union(across.select("left", "right")).mapInArrow(_compare, "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long) and component_id of every row of documents(doc_id, text)."""
    docs = cut_lineage(fingerprints(documents, shingle))
    distinct = cut_lineage(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    return with_values(docs, "fp", least_ids(distinct, "fp", links(distinct)), "n").select("doc_id", "fp", "component_id")


def least_ids(distinct: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """distinct(node, first_id, n, ...) as node, n and component_id: the least first_id of the nodes that edges(a, b) link it to."""
    roots = components(edges).select(F.col("node").alias("_node"), "root")
    linked = cut_lineage(distinct.select(node, "first_id").join(roots, F.col(node) == F.col("_node")).select(node, "root", "first_id"))
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"), F.count("*").alias("members"))
    joined = with_values(linked.select(node, "root"), "root", least, "members").select(node, "least_id")
    return distinct.join(joined, node, "left").select(node, "n", F.coalesce("least_id", "first_id").alias("component_id"))


def drop_near_duplicates(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """documents without all but one row of each component: the one whose doc_id is the component's.

    Rows that repeat a doc_id are one document, of which one row stays; of rows
    without an id one stays for each text. The texts are not shuffled unless
    the dropped ids are too many to broadcast.
    """
    return keep_one(documents, near_duplicates(documents, shingle))


def keep_one(documents: DataFrame, found: DataFrame) -> DataFrame:
    """As drop_near_duplicates, by components found(doc_id, component_id) of any method."""
    lost = cut_lineage(found.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct())
    n = lost.count()
    kept = documents.join(broadcast_if_small(lost, n), "doc_id", "left_anti").select(*columns_of(documents))
    repeated = cut_lineage(documents.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"))
    n = repeated.count()
    if not n:
        return kept
    # by flat columns: what the optimizer infers of a struct of many columns takes the driver's memory
    repeats, id_ = broadcast_if_small(repeated, n).select(F.col("doc_id").alias("again")), kept["doc_id"]
    key = "_key"
    while key in map(str.lower, kept.columns):
        key += "_"
    single = kept.join(repeats, id_.eqNullSafe(repeats["again"]), "left_anti")
    many = kept.join(repeats, id_.eqNullSafe(repeats["again"]), "left_semi").withColumn(key, F.when(F.col("doc_id").isNull(), F.md5(F.col("text").cast("binary"))))
    return single.union(many.dropDuplicates(["doc_id", key]).drop(key))
