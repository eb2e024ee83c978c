"""Checks of parameters, made when a plan is built and never by row."""

from __future__ import annotations

import math

from quillsieve.errors import ParamError

UINT16, UINT32 = 2**16 - 1, 2**32 - 1


def _whole(value: object) -> bool:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return False
    return math.isfinite(value) and value == int(value)


def _require(ok: bool, label: str, wanted: str, value: object) -> None:
    if not ok:
        raise ParamError(f"{label}: {value!r} is not {wanted}")


def positive_int(value: float, label: str) -> int:
    _require(_whole(value) and value >= 1, label, "a whole number of 1 or more", value)
    return int(value)


def positive_finite(value: float, label: str) -> float:
    ok = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) and value > 0
    _require(ok, label, "a finite number above 0", value)
    return value


def uint16(value: float, label: str) -> int:
    _require(_whole(value) and 0 <= value <= UINT16, label, "a whole number from 0 to 65535", value)
    return int(value)


def uint32(value: float, label: str) -> int:
    _require(_whole(value) and 0 <= value <= UINT32, label, "a whole number from 0 to 4294967295", value)
    return int(value)


def probability(value: float, label: str) -> float:
    ok = isinstance(value, (int, float)) and not isinstance(value, bool) and 0 < value < 1
    _require(ok, label, "strictly between 0 and 1", value)
    return float(value)
