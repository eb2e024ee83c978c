"""Membership filters as values: parameters and a dense payload.

They are what a build collects, a frame holds and a probe broadcasts. All hold
no key, answer true for every key that was added, and true for others at a
modelled rate.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterable
from typing import ClassVar

import numpy as np
import pyarrow as pa

from quillsieve import params
from quillsieve.errors import (
    BinaryFuseBuildError,
    BitSetRangeError,
    BlockedBloomParamMismatchError,
    BloomParamMismatchError,
    SerializationError,
    UnknownHashVariantError,
)
from quillsieve.functions import codec, kernels, sizing

BATCH = 1 << 18
ATTEMPTS = 100


def as_keys(keys: Iterable | pa.Array) -> pa.Array:
    """Keys (texts or bytes, mixed or not) as one binary array."""
    if isinstance(keys, (pa.Array, pa.ChunkedArray)):
        return keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    return pa.array([k.encode("utf-8", "replace") if isinstance(k, str) else bytes(k) for k in keys], pa.binary())


class Filter:
    """What the filters have in common."""

    kind: ClassVar[int]
    bits_per_key: float

    def has_all(self, keys: Iterable | pa.Array) -> np.ndarray:
        """A boolean for each key."""
        array = as_keys(keys)
        parts = [self._has(kernels.murmur128(array.slice(k, BATCH), getattr(self, "hash_seed", 0))) for k in range(0, len(array), BATCH)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    def has(self, key: str | bytes) -> bool:
        return bool(self.has_all([key])[0])

    def _has(self, words: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def to_bytes(self) -> bytes:
        raise NotImplementedError

    def to_json(self, tag: str = codec.TAG) -> dict:
        return codec.to_envelope(self.to_bytes(), tag)

    @classmethod
    def from_bytes(cls, data: bytes) -> Filter:
        raise NotImplementedError

    @classmethod
    def from_json(cls, value: object, tag: str = codec.TAG) -> Filter:
        return cls.from_bytes(codec.from_envelope(value, tag))

    def equals(self, other: Filter) -> bool:
        """Whether the frames are the same bytes."""
        return self.to_bytes() == other.to_bytes()

    @classmethod
    def _body(cls, data: bytes, least: int) -> bytes:
        frame = codec.read_frame(data)
        if frame.kind != cls.kind:
            raise SerializationError(f"{cls.__name__}: the frame is of type {frame.kind}, not {cls.kind}")
        if frame.flags & 0x0F:
            raise UnknownHashVariantError(f"{cls.__name__}: hash variant {frame.flags & 0x0F} is unknown")
        codec.need_body(frame.body, least, cls.__name__)
        return frame.body


class _Mutable(Filter):
    """Filters of bits in 32-bit words, to which keys can be added."""

    def __init__(self, words: int, seed: int, n: int) -> None:
        self.words, self.seed, self.n = np.zeros(words, np.uint32), seed, n

    @property
    def hash_seed(self) -> int:
        return self.seed

    def bit_words(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, mask) of what these keys set, each (keys, bits)."""
        raise NotImplementedError

    def add_all(self, keys: Iterable | pa.Array) -> None:
        array = as_keys(keys)
        for k in range(0, len(array), BATCH):
            index, mask = self.bit_words(kernels.murmur128(array.slice(k, BATCH), self.seed))
            index, mask = kernels.or_words(index.reshape(-1), mask.reshape(-1))
            self.words[index] |= mask

    def add(self, key: str | bytes) -> None:
        self.add_all([key])

    def _has(self, words: np.ndarray) -> np.ndarray:
        index, mask = self.bit_words(words)
        found = np.ones(len(index), bool)
        alive = np.arange(len(index))
        for j in range(index.shape[1]):  # keys drop out at their first unset bit
            hit = (self.words[index[alive, j]] & mask[alive, j]) != 0
            found[alive[~hit]] = False
            alive = alive[hit]
        return found

    @property
    def length(self) -> int:
        """Bits that are set."""
        return int(np.bitwise_count(self.words).sum(dtype=np.int64))

    def _united(self, other: _Mutable) -> _Mutable:
        out = self._empty()
        out.words[:] = self.words | other.words
        return out

    def _empty(self) -> _Mutable:
        raise NotImplementedError


class BloomFilter(_Mutable):
    """k bits a key, anywhere among m."""

    kind = 1

    def __init__(self, m: int, k: int, seed: int = 0, n: int | None = None) -> None:
        m, k, seed = params.uint32(params.positive_int(m, "m"), "m"), params.uint16(params.positive_int(k, "k"), "k"), params.uint32(seed, "seed")
        super().__init__(-(-m // 32), seed, int(np.floor(m * np.log(2) / k + 0.5)) if n is None else n)
        self.m, self.k = m, k

    @classmethod
    def create(cls, n: int, epsilon: float) -> BloomFilter:
        n = params.uint32(params.positive_int(n, "n"), "n")
        return cls(*sizing.bloom_size(n, params.probability(epsilon, "epsilon")), n=n)

    @classmethod
    def from_keys(cls, keys: Iterable, epsilon: float) -> BloomFilter:
        array = as_keys(keys)
        out = cls.create(max(1, len(array)), epsilon)
        out.add_all(array)
        return out

    def bit_words(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index = kernels.probes(hashed, self.k, self.m)
        return index >> np.uint64(5), np.uint32(1) << (index & np.uint64(31)).astype(np.uint32)

    def _empty(self) -> BloomFilter:
        return BloomFilter(self.m, self.k, self.seed, self.n)

    def union(self, other: BloomFilter) -> BloomFilter:
        """Both filters' keys; n is this one's."""
        if (self.m, self.k, self.seed) != (other.m, other.k, other.seed):
            raise BloomParamMismatchError(f"m, k, seed {(self.m, self.k, self.seed)} and {(other.m, other.k, other.seed)}")
        return self._united(other)

    def rate(self) -> float:
        """The false-positive rate at the present filling."""
        return (self.length / self.m) ** self.k

    @property
    def bits_per_key(self) -> float:
        return self.m / self.n if self.n else float("inf")

    def to_bytes(self) -> bytes:
        bits = self.words.astype("<u4").tobytes()[: -(-self.m // 8)]
        return codec.write_frame(self.kind, struct.pack("<IHII", self.m, self.k, self.seed, self.n) + bits)

    @classmethod
    def from_bytes(cls, data: bytes) -> BloomFilter:
        body = cls._body(data, 14)
        m, k, seed, n = struct.unpack_from("<IHII", body)
        codec.need_exact_body(body, 14 + -(-m // 8), cls.__name__)
        out = cls(m, k, seed, n)
        out.words[:] = np.frombuffer(body[14:].ljust(4 * len(out.words), b"\0"), "<u4")
        return out


class BlockedBloomFilter(_Mutable):
    """Eight bits a key, all in one block of 256."""

    kind = 2

    def __init__(self, bits_per_key: float, capacity: int, seed: int = 0) -> None:
        params.positive_finite(bits_per_key, "bits_per_key")
        capacity = params.uint32(params.positive_int(capacity, "capacity"), "capacity")
        self._of(sizing.blocked_count(bits_per_key, capacity), params.uint32(seed, "seed"), capacity)

    def _of(self, blocks: int, seed: int, n: int) -> BlockedBloomFilter:
        if blocks * sizing.BLOCK_BITS > 1 << 40:
            raise BitSetRangeError(f"{blocks} blocks are more than fit in memory")
        _Mutable.__init__(self, blocks * sizing.LANES, seed, n)
        self.blocks = blocks
        return self

    @classmethod
    def create(cls, n: int, epsilon: float) -> BlockedBloomFilter:
        params.positive_int(n, "n")
        return cls(sizing.blocked_bits_per_key(params.probability(epsilon, "epsilon")), n)

    @classmethod
    def from_keys(cls, keys: Iterable, epsilon: float) -> BlockedBloomFilter:
        array = as_keys(keys)
        out = cls.create(max(1, len(array)), epsilon)
        out.add_all(array)
        return out

    def bit_words(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return kernels.block_lanes(hashed, self.blocks)

    def _empty(self) -> BlockedBloomFilter:
        return BlockedBloomFilter.__new__(BlockedBloomFilter)._of(self.blocks, self.seed, self.n)

    def union(self, other: BlockedBloomFilter) -> BlockedBloomFilter:
        """Both filters' keys; n is this one's."""
        if (self.blocks, self.seed) != (other.blocks, other.seed):
            raise BlockedBloomParamMismatchError(f"blocks, seed {(self.blocks, self.seed)} and {(other.blocks, other.seed)}")
        return self._united(other)

    def rate(self) -> float:
        """The false-positive rate at the present filling."""
        return (self.length / (self.blocks * sizing.BLOCK_BITS)) ** sizing.LANES

    @property
    def bits_per_key(self) -> float:
        return self.blocks * sizing.BLOCK_BITS / self.n

    def to_bytes(self) -> bytes:
        return codec.write_frame(self.kind, struct.pack("<III", self.blocks, self.seed, self.n) + self.words.astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> BlockedBloomFilter:
        body = cls._body(data, 12)
        blocks, seed, n = struct.unpack_from("<III", body)
        if not blocks or not n:
            raise SerializationError(f"{cls.__name__}: {blocks} blocks for {n} keys")
        codec.need_exact_body(body, 12 + 32 * blocks, cls.__name__)
        out = cls.__new__(cls)._of(blocks, seed, n)
        out.words[:] = np.frombuffer(body, "<u4", offset=12)
        return out


def peel(keys: np.ndarray, geometry: sizing.FuseGeometry, attempts: int = ATTEMPTS) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, mixed keys, their own slots) in the order in which slots became free.

    keys: distinct 64-bit hashes. The counts and exclusive ors of all slots come
    from whole-array operations. What follows must be sequential, as the order
    decides the bytes: the last slot found with a single key goes first.
    """
    n = len(keys)
    for seed in range(attempts):
        mixed = kernels.mix_seed(keys, seed)
        places = kernels.fuse_positions(mixed, geometry.segment, geometry.segment_count_length)
        rows = np.arange(n)
        flat = places.reshape(-1).astype(np.int64)
        counts = np.bincount(flat, minlength=geometry.array_length)
        owners = np.zeros(geometry.array_length, np.int64)  # exclusive or of the rows in a slot
        for j in range(3):
            np.bitwise_xor.at(owners, flat[j::3], rows)
        stack = array("q", np.flatnonzero(counts == 1).astype(np.int64).tobytes())
        # views of arrays, as lists of numbers would take several times their memory
        count_of, owner_of, of = counts.astype(np.int64).data, owners.data, flat.data
        order, own = array("q"), array("q")
        while stack:
            slot = stack.pop()
            if count_of[slot] != 1:
                continue
            row = owner_of[slot]
            order.append(row)
            own.append(slot)
            for p in of[3 * row : 3 * row + 3]:
                count_of[p] -= 1
                owner_of[p] ^= row
                if count_of[p] == 1:
                    stack.append(p)
        if len(order) == n:
            return seed, mixed[np.frombuffer(order, np.int64)], np.frombuffer(own, np.int64)
    raise BinaryFuseBuildError(f"{n} keys could not be arranged with {attempts} seeds")


class _BinaryFuse(Filter):
    """A fingerprint a key, the exclusive or of three slots; built once, never changed."""

    width: ClassVar[int]

    def __init__(self, geometry: sizing.FuseGeometry, seed: int, size: int, slots: np.ndarray) -> None:
        self.geometry, self.seed, self.size, self.slots = geometry, seed, size, slots

    hash_seed = 0  # keys are hashed once; the seed is mixed in later

    @classmethod
    def from_keys(cls, keys: Iterable) -> _BinaryFuse:
        array = as_keys(keys)
        parts = [kernels.key64(kernels.murmur128(array.slice(k, BATCH))) for k in range(0, len(array), BATCH)]
        return cls.from_hashes(np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    @classmethod
    def from_hashes(cls, hashes: np.ndarray, attempts: int = ATTEMPTS) -> _BinaryFuse:
        """Of 64-bit key hashes; equal ones count once."""
        return several_from_hashes((cls,), hashes, attempts)[0]

    @classmethod
    def _filled(cls, n: int, geometry: sizing.FuseGeometry, peeled: tuple[int, np.ndarray, np.ndarray]) -> _BinaryFuse:
        """The filter of n keys that were peeled: slots are set in the opposite order."""
        seed, mixed, own = peeled
        own = own.data
        fingerprint = kernels.fuse_fingerprint(mixed, cls.width).data
        places = kernels.fuse_positions(mixed, geometry.segment, geometry.segment_count_length).reshape(-1).astype(np.int64).data
        slots = array("BH"[cls.width // 16], bytes(geometry.array_length * cls.width // 8))
        for row in range(len(own) - 1, -1, -1):
            a, b, c = places[3 * row : 3 * row + 3]
            slots[own[row]] = fingerprint[row] ^ slots[a] ^ slots[b] ^ slots[c]
        return cls(geometry, seed, n, np.array(slots).astype(f"<u{cls.width // 8}"))

    def _has(self, words: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.zeros(len(words), bool)
        mixed = kernels.mix_seed(kernels.key64(words), self.seed)
        at = kernels.fuse_positions(mixed, self.geometry.segment, self.geometry.segment_count_length).astype(np.int64)
        return kernels.fuse_fingerprint(mixed, self.width) == self.slots[at[:, 0]] ^ self.slots[at[:, 1]] ^ self.slots[at[:, 2]]

    @property
    def bits_per_key(self) -> float:
        return self.slots.nbytes * 8 / self.size if self.size else 0

    def to_bytes(self) -> bytes:
        g = self.geometry
        return codec.write_frame(self.kind, struct.pack("<IIII", self.seed, g.segment, g.segment_count_length, self.size) + self.slots.tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> _BinaryFuse:
        body = cls._body(data, 16)
        seed, segment, count_length, size = struct.unpack_from("<IIII", body)
        if not 0 < segment <= 1 << 18 or segment & (segment - 1) or count_length % segment:
            raise SerializationError(f"{cls.__name__}: segments of {segment} in {count_length} slots")
        slots = count_length + 2 * segment if size else 0
        codec.need_exact_body(body, 16 + slots * cls.width // 8, cls.__name__)
        return cls(sizing.FuseGeometry(segment, count_length, count_length + 2 * segment), seed, size, np.frombuffer(body, f"<u{cls.width // 8}", offset=16))


class BinaryFuse8(_BinaryFuse):
    kind, width = 3, 8


class BinaryFuse16(_BinaryFuse):
    kind, width = 4, 16


def several_from_hashes(kinds: tuple[type[_BinaryFuse], ...], hashes: np.ndarray, attempts: int = ATTEMPTS) -> list[_BinaryFuse]:
    """Fuse filters of several widths of the same 64-bit key hashes, which are peeled once; equal ones count once."""
    hashes = np.unique(hashes)
    geometry = sizing.fuse_geometry(len(hashes))
    if not len(hashes):
        return [kind(geometry, 0, 0, np.zeros(0, f"<u{kind.width // 8}")) for kind in kinds]
    peeled = peel(hashes, geometry, attempts)
    return [kind._filled(len(hashes), geometry, peeled) for kind in kinds]


BY_KIND = {c.kind: c for c in (BloomFilter, BlockedBloomFilter, BinaryFuse8, BinaryFuse16)}


def from_bytes(data: bytes) -> Filter:
    """The filter of any kind that a frame holds."""
    kind = codec.read_frame(data).kind
    if kind not in BY_KIND:
        raise SerializationError(f"no filter has type {kind}")
    return BY_KIND[kind].from_bytes(data)
