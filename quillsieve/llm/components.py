"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import cut_lineage, give_back, with_values


#: Edges from which on a node with a share of them is met by broadcast; fewer are no burden for one task.
MANY = 100_000
#: Most edges that one task unites at once, about 120 bytes each while it runs; what is more after that is united by rounds of all tasks, with equal roots.
ALONE = 1 << 20
#: Tasks whose forests one task unites again.
JOINED = 8


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges (a, b), and the least node that it is linked to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # a root goes to the least one that it meets
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        x, y = root[x], root[y]
        open_ = x != y
        x, y = x[open_], y[open_]
    return nodes, nodes[root]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b), every node and its root, of the edges of a task, united whenever another `ALONE` of them have come: at most that many and a batch are held."""
    held: list[list[np.ndarray]] = []
    size = 0

    def roots() -> list[np.ndarray]:
        return list(united(*(np.concatenate(x) for x in zip(*held, strict=True))))

    for b in batches:
        held.append([c.to_numpy() for c in b.columns])
        size += b.num_rows
        if size > ALONE:
            held = [roots()]
            size = len(held[0][0])
            if 2 * size > ALONE:  # many nodes go out, and others begin
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b"])
                held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots()], names=["a", "b"])
        held.clear()
    give_back()


def _contracted(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Fewer edges(a, b) with the same components, and whether they are all nodes and their roots: each task unites its own, then those of `JOINED` tasks, and so on as long as tasks become fewer."""
    n, parts = edges.count(), edges.rdd.getNumPartitions()
    while True:
        if n <= ALONE:
            return cut_lineage(edges.coalesce(1).mapInArrow(_united, "a long, b long")), True
        edges = cut_lineage(edges.mapInArrow(_united, "a long, b long"))
        n = edges.count()
        fewer = max(-(-parts // JOINED), -(-n // max(1, ALONE)))
        if n > ALONE and fewer >= parts:
            return edges.where("a <> b"), False
        edges, parts = edges.coalesce(fewer), fewer


def _stars(edges: DataFrame, large: bool, many: bool) -> DataFrame:
    """One large-star or small-star step: each node's neighbours (the larger ones, or the others) go to its least neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if large else both.where("b <= a")
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    asked = both.where("b > a") if large else both.where("b < a")
    met = with_values(asked, "a", least, "n") if many else asked.join(least, "a")
    moved = met.select(F.col("b").alias("x"), F.col("m").alias("m"))
    if not large:
        moved = moved.union(least.select(F.col("a").alias("x"), "m"))
    return moved.where("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(a, b), which are longs: root is the least node that it is linked to.

    Each task first unites its own edges, then those of other tasks, as long as
    one task holds them: many links say the same again, and each round of all
    tasks costs the driver some records for every shuffle partition, however few
    the edges are. What is too much for one task is united by alternating
    large-star and small-star steps until nothing moves; the number of rounds
    grows with the logarithm of the nodes. Each round is written to the
    checkpoint folder. A node with very many neighbours is met by partial
    aggregation, and joined by broadcast, never in one task.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    edges, whole = _contracted(edges)
    if whole:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    edges = cut_lineage(edges.distinct())
    digest = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = digest(edges)
    while before[0]:
        many = before[0] > MANY
        edges = cut_lineage(_stars(_stars(edges, True, many), False, many))
        now = digest(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
