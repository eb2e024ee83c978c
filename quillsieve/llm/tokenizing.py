"""Encoding texts with a public tokenizer, a chunk at a time.

Most chunks of a text (a word and what stands before or behind it) occur again
and again, so each worker keeps the ids of the chunks that it has met, and the
tokenizers library encodes only new ones. Texts are cut only where the
tokenizer itself can never join what stands on both sides, so the ids are those
of the whole text:

- "dropped": tokenizers that drop white space and case. Cut at ASCII white space.
- "kept": byte-level tokenizers whose words may start with a space. Cut before a
  space that no white space follows, and around a line feed before a letter.
  Every token boundary rule of such a tokenizer puts a boundary there.

Both are also cut between letters and a punctuation mark behind them, other than
an apostrophe. Arrow cuts some hundred texts at once and numbers their distinct
chunks; only these are looked up one by one, and NumPy puts the ids in place.
Letters alone are one word to the tokenizer, and go straight to its merging
model; other chunks go through the whole tokenizer. So do whole texts with other
white space, white space behind a space, or the name of an added token, such as
an end of text, to which the library gives an id of its own.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are cut at once, and their bytes (a longer one is cut alone).
TEXTS, BYTES = 1024, 4 << 20
#: Chunks of either kind that a worker remembers, twice at most, and the longest that it remembers, in bytes.
CACHED = 200_000
LONGEST = 48

# Letters that no tokenizer here joins with one of _MARKS behind them; in the syntax of Python and of Arrow.
_LETTERS, _LETTERS_RE2 = "a-zA-ZÀ-ÖØ-öø-ɏ", r"a-zA-Z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
_MARKS = ".,!#$%&*|"
_WORD = {True: re.compile(rf" ?[{_LETTERS}]+"), False: re.compile("[a-zß-öø-ÿ]+")}  # where case is dropped, of lower case
# What sends a text through the tokenizer in one piece: white space that is not ASCII or seldom met, and white space behind a space.
_UNCUT = r" [ \n\t\r]|[\x{0}\x{b}\x{c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CUT = "\0"  # between chunks of a text that holds none
_open: dict = {}


def _byte_letters() -> list[str]:
    """The character by which byte-level tokenizers write each byte: itself if it is printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class ChunkEncoder:
    """Encodes texts to bytes of little-endian ids of type `kind`."""

    def __init__(self, path: str, spaces: str, kind: str = "<u4") -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        if spaces not in ("kept", "dropped"):
            raise ValueError(f"spaces is {spaces!r}, not 'kept' or 'dropped'")
        self.kept, self.kind = spaces == "kept", np.dtype(kind)
        self.merge, self.code = self.tokenizer.model.tokenize, {2: "H", 4: "I"}[self.kind.itemsize]
        if sys.byteorder != "little":
            raise NotImplementedError("ids are packed in the machine's order, which must be little-endian")
        self.letters = {b: c for b, c in enumerate(_byte_letters()) if chr(b) != c}
        self.word = _WORD[self.kept].fullmatch
        names = pa.array([t.content for t in self.tokenizer.get_added_tokens_decoder().values()], pa.string())
        self.added = (names if self.kept else pc.ascii_lower(names)).to_pylist()
        self.known = _Known(self.fresh)

    def whole(self, text: str) -> bytes:
        """The ids of a text that goes through the tokenizer in one piece."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, chunk: str) -> bytes:
        """The ids of a chunk of letters, by the tokenizer's merging model."""
        if chunk.isascii():
            own = self.letters[32] + chunk[1:] if chunk[0] == " " else chunk
        else:
            own = chunk.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.merge(own)]).tobytes()

    def encode(self, text: str) -> bytes:
        """The text's ids."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a string array without nulls."""
        out, first, size = [], 0, 0
        for k, n in enumerate(pc.binary_length(texts).to_pylist()):
            if k > first and (k - first == TEXTS or size + n > BYTES):
                out += self._several(texts.slice(first, k - first))
                first, size = k, 0
            size += n
        return out + self._several(texts.slice(first)) if first < len(texts) else out

    def _several(self, texts: pa.Array) -> list[bytes]:
        own = texts if self.kept else pc.ascii_lower(texts)
        alone = pc.match_substring_regex(own, _UNCUT if self.kept else r"\x{0}")
        for name in self.added:
            alone = pc.or_(alone, pc.match_substring(own, name))
        if pc.any(alone).as_py():
            own = pc.if_else(alone, "", own)
        own = pc.replace_substring_regex(own, rf"([{_LETTERS_RE2}])([{_MARKS}])", rf"\1{CUT}\2")
        if self.kept:
            own = pc.replace_substring(own, " ", f"{CUT} ")
            own = pc.replace_substring_regex(own, rf"\n([{_LETTERS_RE2}])", rf"{CUT}\n{CUT}\1".replace("\\n", "\n"))
        else:
            own = pc.replace_substring_regex(own, r"[ \t\n\r\x{b}\x{c}]+", CUT)
        pieces = pc.split_pattern(own, CUT)
        at, coded = pieces.offsets.to_numpy(), pieces.values.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        self.known = self.known.bounded()
        found = list(map(self.known.__getitem__, _as_bytes(coded.dictionary)))
        length = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        pool, begin = np.frombuffer(b"".join(found), self.kind), np.cumsum(length) - length
        each = length[index]
        ends = np.concatenate([[0], np.cumsum(each)])
        flat = pool[np.repeat(begin[index] - ends[:-1], each) + np.arange(ends[-1])].tobytes()
        cuts = (ends[at] * self.kind.itemsize).tolist()
        out = [flat[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
        for k in np.flatnonzero(alone.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self.whole(texts[k].as_py())
        return out

    def fresh(self, raw: bytes) -> bytes:
        """The ids of a chunk that is met for the first time."""
        chunk = raw.decode()
        return self._word(chunk) if self.word(chunk) else self.whole(chunk)


def _as_bytes(texts: pa.Array) -> list[bytes]:
    """The items of a string array, without a string object for each."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32, len(texts) + 1, 4 * texts.offset).tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:z] for a, z in zip(at, at[1:], strict=False)]


class _Known(dict):
    """Ids by chunk; a chunk that is not there is encoded. What was known before the last clearing is kept once more, so frequent chunks stay."""

    def __init__(self, fresh, older: dict | None = None) -> None:
        super().__init__()
        self.fresh, self.older = fresh, older or {}

    def bounded(self) -> _Known:
        """This, or an emptied one if it has grown too large."""
        if len(self) <= CACHED:
            return self
        return _Known(self.fresh, dict(self))

    def __missing__(self, chunk) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.fresh(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids


def encoder(path: str, spaces: str, kind: str = "<u4") -> ChunkEncoder:
    """The worker's encoder for a vocabulary file, kept from task to task."""
    key = (path, spaces, kind)
    if key not in _open:
        _open[key] = ChunkEncoder(*key)
    return _open[key]
