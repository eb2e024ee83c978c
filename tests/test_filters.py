from __future__ import annotations

import base64
import struct
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillsieve import errors
from quillsieve.functions import codec
from quillsieve.operators import filters
from quillsieve.operators.filters import BinaryFuse8, BinaryFuse16, BlockedBloomFilter, BloomFilter
from quillsieve.plans.queries import GOLDEN, NAMES

# Frames of a few names, to which all builds must agree.
BLOOM_3 = "QU1RRgMBAAAABAAABwAqAAAAZQAAAAAAAAAAQAAAAgAAAAAAAAAQAAAAEACAAIAAAAAAAAAAAAIAAAAAAAACEAAgAAAAQAAAAAAAAAAAAAAAAAAEAAAAAAAAAACAAAAAAAAAAAgAAAAAAAAAAAAAAAAAAAAAEAAAAgAAAAAAAAAAAAAAAAAAAAAAIAAAEAAEAAAACACAi3eVnQ=="
FUSE8_4 = "QU1RRgMDAAAAAAAACAAAAAgAAAAEAAAAAAAAAAAAAAAAAAAAHwAAAAAZAAAAlXUAdTBLlA=="
KINDS = {"bloom": BloomFilter, "blocked": BlockedBloomFilter, "fuse8": BinaryFuse8, "fuse16": BinaryFuse16}
some_keys = st.lists(st.one_of(st.text(max_size=20), st.binary(max_size=40)), max_size=60)


def fresh(kind: str, keys, epsilon: float = 0.01):
    return KINDS[kind].from_keys(keys, *([epsilon] if kind.startswith("b") else []))


@pytest.mark.parametrize("kind", KINDS)
def test_golden(kind):
    data = base64.b64decode(GOLDEN[kind])
    held = KINDS[kind].from_bytes(data)
    assert held.has_all(NAMES).all() and held.to_bytes() == data == fresh(kind, NAMES).to_bytes()
    assert filters.from_bytes(data).equals(held) and KINDS[kind].from_json(held.to_json()).equals(held)


def test_golden_with_seed():
    held = BloomFilter(1024, 7, 42)
    held.add_all(["alice", "bob", b"carol"])
    assert held.to_bytes() == base64.b64decode(BLOOM_3) and held.n == 101
    assert BinaryFuse8.from_keys(["alice", "bob", "carol", "dave"]).to_bytes() == base64.b64decode(FUSE8_4)


@settings(max_examples=60, deadline=None)
@given(some_keys, st.sampled_from(sorted(KINDS)))
def test_no_false_negatives_and_round_trip(keys, kind):
    held = fresh(kind, keys)
    assert held.has_all(keys).all()
    again = KINDS[kind].from_bytes(held.to_bytes())
    assert again.equals(held) and again.has_all(keys).all()
    assert fresh(kind, list(reversed(keys))).equals(held)


@settings(max_examples=60, deadline=None)
@given(some_keys, some_keys)
def test_union_holds_both(a, b):
    x, y = BloomFilter.create(50, 0.01), BloomFilter.create(50, 0.01)
    x.add_all(a)
    y.add_all(b)
    before, both = x.to_bytes(), x.union(y)
    assert both.has_all([*a, *b]).all() and x.to_bytes() == before and both.rate() >= max(x.rate(), y.rate())


@pytest.mark.parametrize(("bits", "capacity", "blocks"), [(10, 164, 7), (17, 100, 7), (100, 157, 62), (10.3, 100, 5)])
def test_blocked_union_keeps_its_blocks(bits, capacity, blocks):
    x, y = BlockedBloomFilter(bits, capacity), BlockedBloomFilter(bits, capacity)
    a, b = [f"a-{i}" for i in range(50)], [f"b-{i}" for i in range(50)]
    x.add_all(a)
    y.add_all(b)
    assert x.union(y).blocks == blocks and x.union(y).has_all(a + b).all() and x.union(y).n == capacity


def test_mismatched_unions():
    with pytest.raises(errors.BloomParamMismatchError):
        BloomFilter(100, 3).union(BloomFilter(100, 4))
    with pytest.raises(errors.BlockedBloomParamMismatchError):
        BlockedBloomFilter(8, 1000).union(BlockedBloomFilter(8, 10))
    assert not hasattr(BinaryFuse8, "union") and not hasattr(BinaryFuse8, "add")


def test_bad_parameters():
    for make in (lambda: BloomFilter(0, 3), lambda: BloomFilter(10, 70000), lambda: BloomFilter(10, 3, -1), lambda: BloomFilter.create(1.5, 0.1), lambda: BloomFilter.create(10, 1), lambda: BlockedBloomFilter(0, 10), lambda: BlockedBloomFilter(8, 0), lambda: BlockedBloomFilter.create(10, 1e-9)):
        with pytest.raises(errors.ParamError):
            make()


def test_empty_filters():
    for kind in KINDS:
        held = fresh(kind, [])
        assert not held.has_all(["", "a"]).any() and KINDS[kind].from_bytes(held.to_bytes()).equals(held)
    assert BinaryFuse8.from_keys([]).bits_per_key == 0 and BloomFilter.from_keys([], 0.01).n == 1


def test_fuse_counts_distinct_keys():
    assert BinaryFuse8.from_keys([f"k{i % 500}" for i in range(1500)]).size == 500
    assert not BinaryFuse8.from_keys(["x"]).equals(BinaryFuse16.from_keys(["x"]))
    with pytest.raises(errors.BinaryFuseBuildError):
        import numpy as np

        BinaryFuse8.from_hashes(np.array([1, 2], np.uint64), attempts=0)


def test_known_verdicts():
    keys = [f"key-{i}" for i in range(10_000)]
    bloom, blocked, fuse = (fresh(k, keys) for k in ("bloom", "blocked", "fuse8"))
    assert bloom.has("miss-22") and not any(f.has("miss-0") for f in (bloom, blocked, fuse))


@pytest.mark.parametrize(("kind", "low", "high"), [("bloom", 0.006, 0.0125), ("blocked", 0.004, 0.013), ("fuse8", 0.002, 0.006), ("fuse16", 0, 1e-4)])
def test_rates(kind, low, high):
    held = fresh(kind, [f"0:{i}" for i in range(50_000)])
    assert low <= held.has_all([f"1:{i}" for i in range(200_000)]).mean() <= high


def test_rejected_frames():
    good = base64.b64decode(GOLDEN["bloom"])
    for n in range(len(good)):
        with pytest.raises(errors.SerializationError):
            BloomFilter.from_bytes(good[:n])
    with pytest.raises(errors.BadMagicError):
        BloomFilter.from_bytes(b"X" + good[1:])
    with pytest.raises(errors.UnknownVersionError):
        filters.from_bytes(base64.b64decode(GOLDEN["old"]))
    with pytest.raises(errors.ChecksumError):
        BloomFilter.from_bytes(good[:-1] + bytes([good[-1] ^ 1]))
    with pytest.raises(errors.SerializationError):
        BlockedBloomFilter.from_bytes(good)
    body = codec.read_frame(good).body
    with pytest.raises(errors.UnknownHashVariantError):
        BloomFilter.from_bytes(codec.write_frame(1, body, flags=1))
    assert BloomFilter.from_bytes(codec.write_frame(1, body, flags=0x10)).has("alice")
    with pytest.raises(errors.TruncatedError):
        BloomFilter.from_bytes(codec.write_frame(1, body[:-1]))
    with pytest.raises(errors.ParamError):
        BloomFilter.from_bytes(codec.write_frame(1, struct.pack("<IHII", 0, 3, 0, 1)))
    for blocks, n in ((0, 5), (1, 0)):
        with pytest.raises(errors.SerializationError):
            BlockedBloomFilter.from_bytes(codec.write_frame(2, struct.pack("<III", blocks, 0, n)))
    for segment, count, size in ((3, 12, 1), (4, 10, 1), (2**19, 0, 0)):
        with pytest.raises(errors.SerializationError):
            BinaryFuse8.from_bytes(codec.write_frame(3, struct.pack("<IIII", 0, segment, count, size)))


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 255), st.integers(0, 255), st.booleans())
def test_hostile_bytes_give_typed_errors(data, kind, flags, framed):
    frame = codec.write_frame(kind, data, flags) if framed else data
    for c in KINDS.values():
        try:
            c.from_bytes(frame)
        except (errors.SerializationError, errors.ParamError):
            pass


@pytest.mark.parametrize(
    ("value", "error"),
    [(None, "SerializationError"), (3, "SerializationError"), ([], "SerializationError"), ({}, "SerializationError"), ({"$": "other"}, "SerializationError"), ({"$": codec.TAG, "v": 2}, "UnknownVersionError"), ({"$": codec.TAG, "v": 3}, "SerializationError"), ({"$": codec.TAG, "v": 3, "data": "!"}, "SerializationError")],
)
def test_bad_envelopes(value, error):
    with pytest.raises(getattr(errors, error)) as found:
        codec.from_envelope(value)
    assert type(found.value).__name__ == error


def test_peeling_takes_little_memory_a_key():
    hashes = np.random.default_rng(1).integers(0, 2**64, 100_000, np.uint64)
    tracemalloc.start()
    held = BinaryFuse16.from_hashes(hashes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * len(hashes) and zlib.crc32(held.to_bytes()) == 558161692  # the bytes of peeling in lists
