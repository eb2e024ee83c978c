"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents are cut into pieces of at most the capacity (only longer ones are
cut), and pieces are packed whole. The pieces are dealt by hash into blocks of
bounded size. Each block's first packing is best fit, longest first. A block
whose packing has more bins than its total length asks for goes to several
islands, rows of their own, which evolve packings: a crossover injects whole
well-filled bins of one parent into the other, bins that hold the same pieces are
dissolved, and what that displaces is exchanged for smaller pieces where it fills
a bin better, and else placed again by best fit, longest first. Between epochs
each island's elite migrates to the next island; last the best island's packing
of each block is taken. A block that is at that bound already has nothing to
gain, and is spared this.

The pieces of bins that are not well filled then meet those of other blocks in
further rounds, which pack them in the same way, until one block holds them all
or a round fills too few bins to go on.

Packing only sees lengths; texts are tokenized once, where they are read.

Edge cases: a null or empty text is one piece, of the end id alone; very long
texts are tokenized whole; rows that repeat a document are packed each; pieces of
equal length are placed in the order of their numbers; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import broadcast_if_small, cut_lineage, in_slices, null_to_empty
from quillsieve.llm.tokenizing import encoder

CAPACITY = 4096
BLOCK = 2048  # pieces that are packed together
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
FULL = 0.999  # bins below this share of the capacity are packed again
GAIN = 0.05  # a round that closes less than this share of its pieces is the last


def pieces(documents: DataFrame, vocabulary: str, spaces: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of documents(doc_id, text)."""
    end = np.array([end_id], "<u4").tobytes()
    kind = documents.schema["doc_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(vocabulary, spaces)
        for part in in_slices(batches):
            rows = []
            for d, own in zip(part.column(0).to_pylist(), of.encode_all(part.column(1)), strict=True):
                ids = own + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    rows.append((d, i, at // 4, len(piece) // 4, zlib.crc32(piece), piece))
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], part.schema.field(0).type), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:5]]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4") for x in columns[5]], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return documents.select("doc_id", null_to_empty("text").alias("text")).mapInArrow(cut, schema)


class _Bins:
    """Bins by the room that is left in them; finds the one that fits best."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.bins, self.rooms = capacity, [], [[] for _ in range(capacity + 1)]
        self.open = 0  # bit r is set if a bin has room r

    def add(self, items: list[int], size: int) -> None:
        self.bins.append(items)
        room = self.capacity - size
        self.rooms[room].append(len(self.bins) - 1)
        self.open |= 1 << room

    def place(self, item: int, size: int) -> None:
        fits = self.open >> size
        if not fits or size == self.capacity:
            self.add([item], size)
            return
        room = size + (fits & -fits).bit_length() - 1
        at = self.rooms[room].pop()
        if not self.rooms[room]:
            self.open &= ~(1 << room)
        self.bins[at].append(item)
        self.rooms[room - size].append(at)
        self.open |= 1 << (room - size)


def best_fit(kept: list[list[int]], loose: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins kept as they are, and loose items placed by best fit, longest first."""
    out = _Bins(capacity)
    for b in kept:
        out.add(list(b), sum(sizes[i] for i in b))
    for i in sorted(loose, key=lambda i: -sizes[i]):
        out.place(i, sizes[i])
    return out.bins


def _fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins are better; then those of unequal filling, which leave room together."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def dominate(kept: list[list[int]], loose: list[int], sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Kept bins with one or two of their pieces exchanged for a loose one that fills the bin better: the loose pieces become smaller, and easier to place."""
    spare = sorted((sizes[i], i) for i in loose)
    out = []
    for b in kept:
        b = list(b)
        room = capacity - sum(sizes[i] for i in b)
        for gone in [(i,) for i in b] + [(i, j) for k, i in enumerate(b[:8]) for j in b[k + 1 : 8]] if room and spare else ():
            least = sum(sizes[i] for i in gone)
            at = bisect.bisect_right(spare, (least + room, len(sizes))) - 1
            if at >= 0 and spare[at][0] > least:
                size, item = spare.pop(at)
                b = [i for i in b if i not in gone] + [item]
                for i in gone:
                    bisect.insort(spare, (sizes[i], i))
                room -= size - least
                break
        out.append(b)
    return out, [i for _, i in spare]


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Whole well-filled bins of b are injected into a; a's bins with the same items are dissolved, and what that displaces is placed by best fit."""
    filled = sorted(b, key=lambda x: -sum(sizes[i] for i in x))
    half = filled[: max(1, len(filled) // 2)]
    injected = [x for x in half if rng.random() < 0.5] or half[:1]
    inside = {i for x in injected for i in x}
    kept, loose = [], []
    for x in a:
        if inside.isdisjoint(x):
            kept.append(x)
        else:
            loose += [i for i in x if i not in inside]
    kept, loose = dominate(kept, loose, sizes, capacity)
    return best_fit(injected + kept, loose, sizes, capacity)


def mutate(a: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """The emptiest bins and a few others are dissolved and placed again."""
    order = sorted(range(len(a)), key=lambda k: sum(sizes[i] for i in a[k]))
    gone = set(order[: max(1, len(a) // 50)]) | set(rng.sample(range(len(a)), max(1, len(a) // 20)))
    loose = [i for k in gone for i in a[k]]
    kept, loose = dominate([x for k, x in enumerate(a) if k not in gone], loose, sizes, capacity)
    return best_fit(kept, loose, sizes, capacity)


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]], population: int = POPULATION, generations: int = GENERATIONS) -> list[list[int]]:
    """The best packing that an island finds, from elites of the epoch before if there are any.

    Stops at the bound that no packing can beat.
    """
    rng = random.Random(seed)
    bound = -(-sum(sizes) // capacity)
    rank = lambda x: _fitness(x, sizes, capacity)
    group = list(elites)
    if not group:
        group.append(best_fit([], list(range(len(sizes))), sizes, capacity))
    while len(group) < population and len(max(group, key=rank)) > bound:
        group.append(mutate(rng.choice(group), sizes, capacity, rng))
    for _ in range(generations):
        group.sort(key=rank, reverse=True)
        if len(group[0]) <= bound or len(group) < 2:
            break
        child = crossover(group[0], group[rng.randrange(1, len(group))], sizes, capacity, rng)
        other = crossover(group[rng.randrange(1, len(group))], group[0], sizes, capacity, rng)
        group[-2:] = sorted([*group[-2:], child, mutate(other, sizes, capacity, rng)], key=rank, reverse=True)[:2]
    return max(group, key=rank)


def _numbered(bins: list[list[int]], n: int) -> np.ndarray:
    number = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        number[b] = k
    return number


def _first_packing(capacity: int):
    """Best fit of a block's rows (block, uid, length); open tells whether fewer bins may do."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        sizes = table["length"].to_pylist()
        bins = best_fit([], list(range(len(sizes))), sizes, capacity)
        may_gain = len(bins) > -(-sum(sizes) // capacity)
        return pa.table({"block": table["block"], "uid": table["uid"], "length": table["length"], "bin": pa.array(_numbered(bins, len(sizes))), "open": pa.array(np.full(len(sizes), may_gain))})

    return run


def _islands(capacity: int, epoch: int):
    """Evolve the island of a group of rows (block, island, uid, length, bins): bins holds the piece's bin in each elite."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        sizes, elites = table["length"].to_pylist(), []
        rows = table["bins"].to_pylist()
        for e in range(len(rows[0])):
            found: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                found.setdefault(r[e], []).append(i)
            elites.append(list(found.values()))
        block, island = table["block"][0].as_py(), table["island"][0].as_py()
        best = evolve(sizes, capacity, hash((block, island, epoch)), elites)
        n = len(sizes)
        return pa.table({"block": table["block"], "island": table["island"], "uid": table["uid"], "length": table["length"], "bin": pa.array(_numbered(best, n)), "bins_used": pa.array(np.full(n, len(best), np.int32))})

    return run


def _evolved(first: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """first(block, uid, length, bin) with the bins that the best island of each block gives them."""
    rows = first.select("uid", "length", "block", F.explode(F.array(*[F.lit(k) for k in range(islands)])).alias("island"), F.array("bin").alias("bins"))
    out = "block long, island int, uid long, length long, bin int, bins_used int"
    for epoch in range(epochs):
        won = cut_lineage(rows.groupBy("block", "island").applyInArrow(_islands(capacity, epoch), out))
        if epoch + 1 < epochs:  # each island gets its own elite and that of the island before it
            mine = F.struct(F.col("island").alias("to"), "island", "bin")
            next_one = F.struct(((F.col("island") + 1) % islands).alias("to"), "island", "bin")
            sent = won.select("block", "uid", "length", F.explode(F.array(mine, next_one) if islands > 1 else F.array(mine)).alias("x"))
            rows = sent.groupBy("block", "uid", "length", F.col("x.to").alias("island")).agg(F.transform(F.array_sort(F.collect_list(F.struct("x.island", "x.bin"))), lambda e: e["bin"]).alias("bins"))
            rows = rows.select("uid", "length", "block", "island", "bins")
    best = won.groupBy("block").agg(F.min(F.struct("bins_used", "island"))["island"].alias("island"))
    return won.join(best, ["block", "island"], "left_semi").select("block", "uid", "length", "bin")


def _packed_blocks(items: DataFrame, capacity: int, islands: int, epochs: int, blocks: int) -> DataFrame:
    """items(uid, length) with the block and bin that they are given."""
    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"))
    first = cut_lineage(dealt.groupBy("block").applyInArrow(_first_packing(capacity), "block long, uid long, length long, bin int, open boolean"))
    packed = first.where("not open").select("block", "uid", "length", "bin")
    if not first.where("open").take(1):
        return packed
    return cut_lineage(packed.unionByName(_evolved(first.where("open"), capacity, islands, epochs)))


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """items(uid, length) with sequence_id and offset: uid a long of its own for each, 1 <= length <= capacity."""
    left, done, base = items.select("uid", "length"), [], 0
    n = left.count()
    while n:
        blocks = -(-n // block)
        packed = _packed_blocks(left, capacity, islands, epochs, blocks)
        # a block has about `block` pieces, and no more bins than pieces; ids go on from round to round
        stride = 8 * block
        packed = packed.withColumn("sequence_id", base + F.col("block") * stride + F.col("bin"))
        base += blocks * stride
        if blocks == 1:
            done.append(packed.select("uid", "length", "sequence_id"))
            break
        filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("filled")).where(F.col("filled") < FULL * capacity).select("sequence_id")
        marked = cut_lineage(packed.join(filled.withColumn("again", F.lit(True)), "sequence_id", "left").select("uid", "length", "sequence_id", F.coalesce("again", F.lit(False)).alias("again")))
        again = marked.where("again").count()
        if again > (1 - GAIN) * n:
            done.append(marked.select("uid", "length", "sequence_id"))
            break
        done.append(marked.where("not again").select("uid", "length", "sequence_id"))
        left, n = marked.where("again").select("uid", "length"), again
    if not done:
        return items.select("uid", "length", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    # a sequence has at most as many pieces as ids, and its pieces are summed in one row
    inside = every.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("x"))
    placed = inside.select("sequence_id", F.posexplode("x").alias("k", "y"), "x")
    offset = F.aggregate(F.slice("x", 1, F.col("k")), F.lit(0).cast("long"), lambda n, e: n + e["length"])
    return placed.select("y.uid", "y.length", F.col("sequence_id").cast("long"), offset.alias("offset"))


def best_fit_pack(documents: DataFrame, vocabulary: str, spaces: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of documents(doc_id, text), with sequence_id and offset."""
    cut = pieces(documents, vocabulary, spaces, end_id, capacity).withColumn("uid", F.monotonically_increasing_id())
    cut = cut_lineage(cut)
    placed = pack(cut, capacity)
    return cut.join(placed.drop("length"), "uid").drop("uid")
