"""What can go wrong, as exceptions that callers can tell apart."""

from __future__ import annotations


class ParamError(ValueError):
    """A construction or sizing parameter is out of its range."""


class BloomParamMismatchError(Exception):
    """Two Bloom filters of different geometry were to be united."""


class BlockedBloomParamMismatchError(Exception):
    """Two blocked Bloom filters of different geometry were to be united."""


class BinaryFuseBuildError(Exception):
    """No seed within the allowed attempts gives a binary fuse filter."""


class SerializationError(Exception):
    """Bytes or JSON are not a filter of the wanted kind."""


class TruncatedError(SerializationError):
    """Fewer or more bytes than the frame's own fields call for."""


class BadMagicError(SerializationError):
    """The bytes are not a frame at all."""


class UnknownVersionError(SerializationError):
    """A format version that this package doesn't read."""


class UnknownHashVariantError(SerializationError):
    """A hash function that this package doesn't have."""


class ChecksumError(SerializationError):
    """The frame's bytes don't match its CRC-32."""


class BitSetRangeError(ValueError):
    """More bits than a filter can address."""
