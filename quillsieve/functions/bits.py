"""A plain bit set in the layout of Bloom payloads: bit i is bit i % 8 of byte i // 8."""

from __future__ import annotations

import numpy as np

from quillsieve.errors import BitSetRangeError

MOST = 2**32


class BitSet:
    def __init__(self, bits: int) -> None:
        if bits > MOST:
            raise BitSetRangeError(f"{bits} bits; the most is {MOST}")
        self.data = np.zeros(-(-bits // 8), np.uint8)

    def set(self, i: int) -> None:
        self.data[i >> 3] |= 1 << (i & 7)

    def get(self, i: int) -> bool:
        return bool(self.data[i >> 3] >> (i & 7) & 1)

    def count(self) -> int:
        return int(np.bitwise_count(self.data).sum(dtype=np.int64))

    def to_bytes(self) -> bytes:
        return self.data.tobytes()
