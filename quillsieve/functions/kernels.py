"""Hashing and index derivation on whole Arrow or NumPy batches; pure functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U32, U64 = np.uint32, np.uint64
_MASK = U64(0xFFFFFFFF)

# Multipliers, rotations and addends of MurmurHash3_x86_128, by word.
MULTIPLY = (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93)
ROTATE_KEY = (15, 16, 17, 18)
ROTATE_HASH = (19, 17, 15, 13)
ADD = (0x561CCD1B, 0x0BCAA747, 0x96CD1C35, 0x32AC3B17)

# The bit-choosing multipliers of split-block filters, by lane.
SALT = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], U32)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U32(r)) | (x >> U32(32 - r))


def fmix32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U32(16))) * U32(0x85EBCA6B)
    x = (x ^ (x >> U32(13))) * U32(0xC2B2AE35)
    return x ^ (x >> U32(16))


def fmix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def key_bytes(keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first byte of each key, length of each) of a string or binary array; nulls have length 0."""
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    if not (pa.types.is_binary(keys.type) or pa.types.is_string(keys.type)):
        keys = keys.cast(pa.large_binary() if pa.types.is_large_string(keys.type) or pa.types.is_large_binary(keys.type) else pa.binary())
    wide = pa.types.is_large_binary(keys.type) or pa.types.is_large_string(keys.type)
    _, offsets, data = keys.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(keys) + 1, keys.offset * (8 if wide else 4)).astype(np.int64) if len(keys) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at[:-1], np.diff(at)


def murmur128(keys: pa.Array, seed: int = 0, upto: int | None = None) -> np.ndarray:
    """MurmurHash3_x86_128 of every key of a string or binary array: uint32, one row a key, four words.

    upto: hash only so many first bytes of each key.

    All keys advance together by blocks of 16 bytes; those that have none left
    drop out. The rest of a key is its last block with zeros behind, which the
    hash mixes without the block rotations.
    """
    raw, first, length = key_bytes(keys)
    length = length if upto is None else np.minimum(length, upto)
    raw = np.concatenate([raw, np.zeros(16, np.uint8)])
    h = [np.full(len(first), seed, U32) for _ in range(4)]
    block, lane = 0, np.arange(16)

    def words(at: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        taken = raw[np.minimum(at[:, None] + lane, len(raw) - 1)]
        if keep is not None:
            taken = np.where(lane < keep[:, None], taken, 0).astype(np.uint8)
        return np.ascontiguousarray(taken).view("<u4")

    def key_mix(k: np.ndarray, i: int) -> np.ndarray:
        return _rotl(k * U32(MULTIPLY[i]), ROTATE_KEY[i]) * U32(MULTIPLY[(i + 1) % 4])

    live = np.flatnonzero(length >= 16)
    while len(live):
        k = words(first[live] + 16 * block)
        s = [x[live] for x in h]
        for i in range(4):
            s[i] = (_rotl(s[i] ^ key_mix(k[:, i], i), ROTATE_HASH[i]) + s[(i + 1) % 4]) * U32(5) + U32(ADD[i])
        for i in range(4):
            h[i][live] = s[i]
        block += 1
        live = live[length[live] >= 16 * (block + 1)]
    k = words(first + length // 16 * 16, length % 16)
    h = [x ^ key_mix(k[:, i], i) ^ length.astype(U32) for i, x in enumerate(h)]
    for mix in (True, False):
        h[0] = h[0] + h[1] + h[2] + h[3]
        h = [h[0], *[x + h[0] for x in h[1:]]]
        if mix:
            h = [fmix32(x) for x in h]
    return np.stack(h, 1)


def reduce_range(x: np.ndarray, size: int) -> np.ndarray:
    """x of [0, 2^32) to [0, size) by its share of the range."""
    return (x.astype(U64) * U64(size)) >> U64(32)


def probes(words: np.ndarray, count: int, size: int) -> np.ndarray:
    """Bit indices of each key (rows) in a Bloom filter of `size` bits: uint64."""
    i = np.arange(count, dtype=U64)
    x = words[:, :1].astype(U64) + words[:, 1:2].astype(U64) * i + i * i
    return ((x & _MASK) * U64(size)) >> U64(32)


def block_lanes(words: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, mask) of each key's eight lanes of 32 bits in a split-block filter."""
    block = reduce_range(words[:, 0], blocks)
    bits = (words[:, 1:2] * SALT) >> U32(27)
    return (block[:, None] * U64(8) + np.arange(8, dtype=U64)), U32(1) << bits


def key64(words: np.ndarray) -> np.ndarray:
    """The 64-bit identity of a key in fuse filters: words 0 (low) and 1 (high)."""
    return words[:, 0].astype(U64) | words[:, 1].astype(U64) << U64(32)


def mix_seed(keys: np.ndarray, seed: int) -> np.ndarray:
    return fmix64(keys + U64(seed))


def mulhi(x: np.ndarray, n: int) -> np.ndarray:
    """floor(x * n / 2^64) for n below 2^32."""
    return ((x >> U64(32)) * U64(n) + (((x & _MASK) * U64(n)) >> U64(32))) >> U64(32)


def fuse_positions(mixed: np.ndarray, segment: int, segment_count_length: int) -> np.ndarray:
    """The three slots of each mixed key: uint64, one row a key."""
    mask = U64(segment - 1)
    a = mulhi(mixed, segment_count_length)
    b = (a + U64(segment)) ^ ((mixed >> U64(18)) & mask)
    c = (a + U64(2 * segment)) ^ (mixed & mask)
    return np.stack([a, b, c], 1)


def fuse_fingerprint(mixed: np.ndarray, width: int) -> np.ndarray:
    return ((mixed ^ (mixed >> U64(32))) & U64((1 << width) - 1)).astype(f"<u{width // 8}")


def or_words(index: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices, and the masks of each united."""
    order = np.argsort(index, kind="stable")
    index, mask = index[order], mask[order]
    if not len(index):
        return index, mask
    start = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
    return index[start], np.bitwise_or.reduceat(mask, start)
