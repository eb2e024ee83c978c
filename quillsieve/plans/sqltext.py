"""DuckDB SQL for the hash and what is derived from it: an implementation of its own, for comparison.

For keys of any length. Each step is one common table expression that adds
columns; a key's blocks of 16 bytes are folded by one list_reduce, whose state
is turned by one word a step, so that every step treats its first word.
"""

from __future__ import annotations

from quillsieve.functions.kernels import ADD, MULTIPLY, ROTATE_HASH, ROTATE_KEY, SALT

LOW = "4294967295::UBIGINT"


class Steps:
    """A chain of SELECT *, ... steps."""

    def __init__(self, source: str) -> None:
        self.parts, self.last = [f"s0 AS ({source})"], "s0"

    def add(self, **columns: str) -> Steps:
        name = f"s{len(self.parts)}"
        self.parts.append(f"{name} AS (SELECT *, {', '.join(f'{sql} AS {c}' for c, sql in columns.items())} FROM {self.last})")
        self.last = name
        return self

    def again(self, **columns: str) -> Steps:
        """Replace columns."""
        name = f"s{len(self.parts)}"
        self.parts.append(f"{name} AS (SELECT * REPLACE ({', '.join(f'{sql} AS {c}' for c, sql in columns.items())}) FROM {self.last})")
        self.last = name
        return self

    def select(self, sql: str) -> str:
        return f"WITH {', '.join(self.parts)} {sql.format(s=self.last)}"


def _mul(x: str, c: int) -> str:
    return f"((({x}) * {c}::UBIGINT) & {LOW})"


def _rotl(x: str, by: int) -> str:
    return f"(((({x}) << {by}) | (({x}) >> {32 - by})) & {LOW})"


def _word(text: str, at: str) -> str:
    """The little-endian 32-bit word that begins at character `at` of hex digits."""
    return f"('0x' || substr({text}, {at} + 6, 2) || substr({text}, {at} + 4, 2) || substr({text}, {at} + 2, 2) || substr({text}, {at}, 2))::UBIGINT"


def _folded(blocks: str, seed: int) -> str:
    """The four words after a list of blocks, each of 32 hex digits, as a list."""
    lanes = []
    for i in range(4):
        turned = f"list_transform(list_transform({blocks}, lambda b: {_mul(_word('b', str(8 * i + 1)), MULTIPLY[i])}), lambda k: {_mul(_rotl('k', ROTATE_KEY[i]), MULTIPLY[(i + 1) % 4])})"
        lanes.append(f"list_transform({turned}, lambda k: [k, {ROTATE_HASH[i]}, {ADD[i]}, 0]::UBIGINT[])")
    steps = f"flatten(list_transform(list_zip({', '.join(lanes)}), lambda z: [z[1], z[2], z[3], z[4]]))"
    first = f"[{', '.join([f'{seed}'] * 4)}]::UBIGINT[]"
    mixed = "xor(s[1], x[1])"
    new = f"((((({mixed} << x[2]) | ({mixed} >> (32::UBIGINT - x[2]))) & {LOW}) + s[2]) * 5::UBIGINT + x[3]) & {LOW}"
    return f"list_reduce(list_prepend({first}, {steps}), lambda s, x: [s[2], s[3], s[4], {new}])"


def hashed(source: str, seed: int = 0) -> Steps:
    """Steps from a SELECT with a text column `key`, to w0..w3 as UBIGINT."""
    s = Steps(source)
    s.add(digits="hex(encode(key))", octets="octet_length(encode(key))::UBIGINT")
    s.add(tail="rpad(substr(digits, (octets // 16 * 32)::BIGINT + 1), 32, '0')", folded=f"CASE WHEN octets < 16 THEN [{', '.join([f'{seed}'] * 4)}]::UBIGINT[] ELSE {_folded('regexp_extract_all(digits, chr(46) || chr(123) || chr(51) || chr(50) || chr(125))', seed)} END")
    s.add(**{f"k{w}": _mul(_word("tail", str(8 * w + 1)), MULTIPLY[w]) for w in range(4)})
    s.add(**{f"w{w}": f"xor(xor(folded[{w + 1}], {_mul(_rotl(f'k{w}', ROTATE_KEY[w]), MULTIPLY[(w + 1) % 4])}), octets & {LOW})" for w in range(4)})

    def cross() -> None:
        s.again(w0=f"(w0 + w1 + w2 + w3) & {LOW}")
        s.again(**{f"w{w}": f"(w{w} + w0) & {LOW}" for w in (1, 2, 3)})

    cross()
    for shift, c in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        s.again(**{f"w{w}": _mul(f"xor(w{w}, w{w} >> {shift})", c) for w in range(4)})
    s.again(**{f"w{w}": f"xor(w{w}, w{w} >> 16)" for w in range(4)})
    cross()
    return s


def bloom_bits(source: str, m: str, k: str, seed: int = 0) -> Steps:
    """Steps to one row for each of the k bits of a key: `bit`, of a filter of m bits; m and k are SQL."""
    return hashed(source, seed).add(i=f"unnest(range(({k})::BIGINT))").add(bit=f"((((w0 + i::UBIGINT * w1 + (i * i)::UBIGINT) & {LOW}) * ({m})::UBIGINT) >> 32)::BIGINT").add(word="bit // 32", mask="(1::BIGINT << (bit % 32))")


def block_bits(source: str, blocks: str, seed: int = 0) -> Steps:
    """Steps to one row for each of the eight lanes of a key: word and mask."""
    salts = "[" + ", ".join(f"{int(x)}::UBIGINT" for x in SALT) + "]"
    return hashed(source, seed).add(i="unnest(range(8))").add(word=f"((w0 * ({blocks})::UBIGINT) >> 32)::BIGINT * 8 + i", mask=f"(1::BIGINT << (((w1 * ({salts})[i + 1]) & {LOW}) >> 27)::INT)")


def _mul64(x: str, c: int) -> str:
    return f"((({x})::UHUGEINT * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def fuse_slots(source: str, seed: int, segment: int, count_length: int) -> Steps:
    """Steps to h0, h1, h2 of a key in a binary fuse filter."""
    s = hashed(source).add(x=f"(((w1::UHUGEINT * 4294967296::UHUGEINT + w0::UHUGEINT) + {seed}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT")
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        s.again(x=_mul64("xor(x, x >> 33)", c))
    s.again(x="xor(x, x >> 33)")
    s.add(h0=f"((x::UHUGEINT * {count_length}::UHUGEINT) // 18446744073709551616::UHUGEINT)::UBIGINT")
    return s.add(h1=f"xor(h0 + {segment}::UBIGINT, (x >> 18) & {segment - 1}::UBIGINT)", h2=f"xor(h0 + {2 * segment}::UBIGINT, x & {segment - 1}::UBIGINT)")
