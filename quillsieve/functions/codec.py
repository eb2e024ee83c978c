"""Frames, JSON envelopes and strict base64: for values in Python, and for columns.

A frame is a header of 8 bytes, a body, and the CRC-32 of both; all numbers are
little-endian. An envelope is a JSON object with the tag of the program that
wrote it under "$", the version under "v", and the frame in base64 under "data".
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsieve.errors import BadMagicError, ChecksumError, SerializationError, TruncatedError, UnknownVersionError

MAGIC, VERSION = b"AMQF", 3
HEADER, TRAILER = 8, 4
TAG = "quillsieve"  # of envelopes; give another to exchange them with another program

_STRICT = re.compile(r"[A-Za-z0-9+/]*=*")


class Frame(NamedTuple):
    kind: int
    flags: int
    body: bytes


def write_frame(kind: int, body: bytes, flags: int = 0) -> bytes:
    head = MAGIC + bytes([VERSION, kind, flags, 0]) + body
    return head + struct.pack("<I", zlib.crc32(head))


def read_frame(data: bytes) -> Frame:
    """The frame's parts. Length, magic, version and checksum are checked, in this order."""
    if len(data) < HEADER + TRAILER:
        raise TruncatedError(f"{len(data)} bytes are no frame, which has {HEADER + TRAILER} at least")
    if data[:4] != MAGIC:
        raise BadMagicError(f"a frame starts with {MAGIC.decode()}")
    if data[4] != VERSION:
        raise UnknownVersionError(f"format version {data[4]}; this reads {VERSION}")
    if struct.unpack_from("<I", data, len(data) - TRAILER)[0] != zlib.crc32(data[:-TRAILER]):
        raise ChecksumError("the frame's CRC-32 is not that of its bytes")
    return Frame(data[5], data[6], bytes(data[HEADER:-TRAILER]))


def need_body(body: bytes, at_least: int, what: str) -> None:
    if len(body) < at_least:
        raise TruncatedError(f"{what}: {len(body)} bytes hold no parameters, which take {at_least}")


def need_exact_body(body: bytes, wanted: int, what: str) -> None:
    if len(body) != wanted:
        raise TruncatedError(f"{what}: {len(body)} bytes, where the parameters call for {wanted}")


def to_base64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def from_base64(text: str) -> bytes:
    """Strict decoding: the standard alphabet only, any padding at the end, no length of 4k + 1."""
    bare = text.rstrip("=")
    if not _STRICT.fullmatch(text) or len(bare) % 4 == 1:
        raise ValueError("not base64")
    return base64.b64decode(bare + "=" * (-len(bare) % 4))


def to_envelope(frame: bytes, tag: str = TAG) -> dict:
    return {"$": tag, "v": VERSION, "data": to_base64(frame)}


def from_envelope(value: object, tag: str = TAG) -> bytes:
    """The envelope's frame; the frame itself is not looked into."""
    if not isinstance(value, (dict, list)):
        raise SerializationError("an envelope is a JSON object")
    got = value if isinstance(value, dict) else {}
    if got.get("$") != tag:
        raise SerializationError(f'the envelope\'s "$" is not {tag!r}')
    if got.get("v") != VERSION or isinstance(got.get("v"), bool):
        raise UnknownVersionError(f"envelope version {got.get('v')!r}; this reads {VERSION}")
    if not isinstance(got.get("data"), str):
        raise SerializationError('the envelope has no text under "data"')
    try:
        return from_base64(got["data"])
    except ValueError:
        raise SerializationError('the envelope\'s "data" is not base64') from None


# Columns: built-in expressions only.


def base64_column(data: Column) -> Column:
    """One line of base64, whatever the session's line breaking."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def unbase64_column(text: Column) -> Column:
    """Strict decoding; null for what from_base64 rejects."""
    bare = F.rtrim(text, F.lit("="))
    ok = text.rlike(r"\A[A-Za-z0-9+/]*=*\z") & (F.length(bare) % 4 != 1)
    padded = F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4))))
    return F.when(ok, F.unbase64(padded))


def number_column(data: Column, first: int, width: int) -> Column:
    """The little-endian unsigned number at 0-based byte `first` of a binary column."""
    found = F.lit(0).cast("long")
    for k in range(width):
        byte = F.conv(F.hex(F.substring(data, first + 1 + k, 1)), 16, 10).cast("long")
        found = found + byte * (1 << (8 * k))
    return found


def frame_error_column(data: Column) -> Column:
    """The name of the error that reading a binary column as a frame gives, or null."""
    n = F.octet_length(data)
    tail = F.substring(data, -TRAILER, TRAILER)
    crc = F.crc32(F.substr(data, F.lit(1), F.greatest(n - TRAILER, F.lit(0))))
    return (
        F.when(n < HEADER + TRAILER, "TruncatedError")
        .when(F.substring(data, 1, 4) != F.lit(MAGIC), "BadMagicError")
        .when(F.substring(data, 5, 1) != F.lit(bytes([VERSION])), "UnknownVersionError")
        .when(number_column(tail, 0, 4) != crc, "ChecksumError")
    )


def envelope_column(frame: Column, tag: str = TAG) -> Column:
    return F.to_json(F.struct(F.lit(tag).alias("$"), F.lit(VERSION).alias("v"), base64_column(frame).alias("data")))


def from_envelope_column(text: Column, tag: str = TAG) -> tuple[Column, Column]:
    """(frame, error) of a JSON text column: one of the two is null."""
    kind = F.get_json_object(text, "$.v")
    data = F.get_json_object(text, "$.data")
    given = F.from_json(text, "`$` string, v string, data string")
    error = (
        F.when(given.isNull() | ~F.coalesce(F.trim(text).startswith("{"), F.lit(False)), "SerializationError")
        .when(~F.coalesce(given.getField("$") == tag, F.lit(False)), "SerializationError")
        .when(~F.coalesce(kind == str(VERSION), F.lit(False)), "UnknownVersionError")
        .when(data.isNull() | unbase64_column(data).isNull(), "SerializationError")
    )
    return F.when(error.isNull(), unbase64_column(data)), error
