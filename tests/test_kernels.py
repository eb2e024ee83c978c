from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillsieve import params
from quillsieve.errors import ParamError
from quillsieve.functions import codec, kernels, sizing

PANGRAM = "The quick brown fox jumps over the lazy dog"
# Published MurmurHash3_x86_128 results.
TEXTS = [
    ("", 0, (0, 0, 0, 0)),
    ("", 42, (0xAF6D2CB6, 0x95C80CBA, 0x95C80CBA, 0x95C80CBA)),
    ("a", 0, (0xA794933C, 0x5556B01B, 0x5556B01B, 0x5556B01B)),
    ("abc", 0, (0x75CDC6D1, 0xA2B006A5, 0xA2B006A5, 0xA2B006A5)),
    ("abc", 42, (0x5BCF0FBE, 0x8741BBE9, 0x8741BBE9, 0x8741BBE9)),
    ("Hello, world!", 0, (0x26ACDBA7, 0xF0638DFC, 0x402B4263, 0x0AFDD4C3)),
    (PANGRAM, 0, (0x2F1583C3, 0xECEE2C67, 0x5D7BF66C, 0xE5E91D2C)),
]
# Word 0 of byte i = 37 i + 11, by length.
PATTERN = {1: 0x1A2A893C, 4: 0xD021EF70, 5: 0xA1BDD9F5, 8: 0xFC0141D5, 12: 0x6BBE8B8B, 13: 0xCBEDDA29, 15: 0xE834163D, 16: 0xAA3A2073, 17: 0xC5078DC0, 32: 0xCE5FF737, 33: 0xF2CE5217, 40: 0xEB975766}


@pytest.mark.parametrize(("text", "seed", "words"), TEXTS)
def test_hash_of_texts(text, seed, words):
    assert tuple(kernels.murmur128(pa.array([text]), seed)[0].tolist()) == words


def test_hash_of_all_tails_at_once():
    keys = [bytes((37 * i + 11) & 255 for i in range(n)) for n in PATTERN]
    assert kernels.murmur128(pa.array(keys, pa.binary()))[:, 0].tolist() == list(PATTERN.values())


@given(st.lists(st.binary(max_size=70), max_size=20))
def test_hash_does_not_depend_on_the_batch(keys):
    together = kernels.murmur128(pa.array(keys, pa.binary()))
    assert [tuple(x) for x in together.tolist()] == [tuple(kernels.murmur128(pa.array([k], pa.binary()))[0].tolist()) for k in keys]
    assert (kernels.murmur128(pa.array([b"x", *keys], pa.binary()).slice(1)) == together).all()


@given(st.integers(0, 2**32 - 1), st.integers(1, 2**32 - 1))
def test_reduce_and_mulhi(x, n):
    assert int(kernels.reduce_range(np.array([x], np.uint32), n)[0]) == x * n >> 32
    assert int(kernels.mulhi(np.array([x << 32 | (n * 7) % 2**32], np.uint64), n)[0]) == (x << 32 | (n * 7) % 2**32) * n >> 64


def test_block_lanes_stay_in_one_block():
    index, mask = kernels.block_lanes(kernels.murmur128(pa.array([f"k{i}" for i in range(500)])), 777)
    assert (index // 8 == index[:, :1] // 8).all() and (index < 777 * 8).all() and (np.bitwise_count(mask) == 1).all()


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 31)), max_size=30))
def test_or_words(pairs):
    want = {}
    for w, b in pairs:
        want[w] = want.get(w, 0) | 1 << b
    index, mask = kernels.or_words(np.array([w for w, _ in pairs], np.int64), np.array([1 << b for _, b in pairs], np.uint32))
    assert dict(zip(index.tolist(), mask.tolist(), strict=True)) == want


def test_sizes():
    assert sizing.bloom_size(10, 0.01) == (96, 7)
    assert sizing.bloom_size(1000, 0.01) == (9586, 7)
    assert sizing.bloom_size(1e6, 1e-6) == (28755176, 20)
    for n in (1e3, 1e6):
        for eps in (1e-2, 1e-4):
            assert sizing.bloom_rate(*sizing.bloom_size(n, eps), n) == pytest.approx(eps, rel=0.05)
    assert {e: sizing.blocked_bits_per_key(e) for e in (0.1, 0.05, 0.01, 1e-3, 1e-4, 3e-5, 1e-5, 1e-6)} == {0.1: 6, 0.05: 8, 0.01: 11, 1e-3: 17, 1e-4: 27, 3e-5: 34, 1e-5: 41, 1e-6: 65}
    assert sizing.blocked_rate(11) == pytest.approx(0.00816820, rel=1e-5)
    for bad in (1e-8, 3e-8):
        with pytest.raises(ParamError):
            sizing.blocked_bits_per_key(bad)
    rates = [sizing.blocked_rate(b) for b in range(1, 65)]
    assert rates == sorted(rates, reverse=True)
    assert sizing.fuse_geometry(1) == (4, 4, 12)
    assert sizing.fuse_geometry(1000) == (128, 1152, 1408)
    assert sizing.fuse_geometry(10**8) == (131072, 112328704, 112590848)
    assert (sizing.fuse_bits_per_key(0, 8), sizing.fuse_bits_per_key(3, 8), sizing.fuse_bits_per_key(3, 16)) == (0, 64, 128)
    assert sizing.floor_bits_per_key(0.01) == pytest.approx(6.64, abs=0.01)


@pytest.mark.parametrize(
    ("check", "bad"),
    [
        (params.positive_int, [0, -1, 1.5, math.nan, math.inf, "3", True, None]),
        (params.positive_finite, [0, -1, math.nan, math.inf, "3", None]),
        (params.uint16, [-1, 65536, 0.5, math.nan]),
        (params.uint32, [-1, 2**32, 0.5, math.inf]),
        (params.probability, [0, 1, -0.5, math.nan, "x", None]),
    ],
)
def test_params(check, bad):
    for value in bad:
        with pytest.raises(ParamError):
            check(value, "x")
    assert check(0.5 if check in (params.probability, params.positive_finite) else 7, "x") in (0.5, 7)


@given(st.binary(max_size=300))
def test_base64(data):
    assert codec.from_base64(codec.to_base64(data)) == data
    assert codec.from_base64(codec.to_base64(data).rstrip("=")) == data


@pytest.mark.parametrize("bad", ["!!!!!!!!", "Z\ng", "A", "Zm 9v", "Zg==Zg"])
def test_bad_base64(bad):
    with pytest.raises(ValueError):
        codec.from_base64(bad)


def test_crc_of_frames():
    assert zlib.crc32(b"123456789") == 0xCBF43926
    assert codec.read_frame(codec.write_frame(1, b"body")) == (1, 0, b"body")


@settings(max_examples=50)
@given(st.integers(1, 2**31), st.floats(1e-6, 0.5))
def test_bloom_columns_agree_with_python(n, eps):
    m, k = sizing.bloom_size(n, eps)
    assert m > 0 and k >= 1


def test_hash_of_prefixes():
    keys = pa.array([b"abcdefghijklmnopqrstuvwxyz", b"ab", b""])
    assert (kernels.murmur128(keys, 5, upto=17) == kernels.murmur128(pa.array([b"abcdefghijklmnopq", b"ab", b""]), 5)).all()


def test_bit_set():
    from quillsieve.errors import BitSetRangeError
    from quillsieve.functions.bits import BitSet

    bits = BitSet(16)
    bits.set(0)
    bits.set(9)
    assert bits.to_bytes() == b"\x01\x02" and bits.count() == 2 and bits.get(9) and not bits.get(1)
    with pytest.raises(BitSetRangeError):
        BitSet(2**32 + 1)
