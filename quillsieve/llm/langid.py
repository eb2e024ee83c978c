"""Language identification by error-correcting output codes.

Every language has a codeword of bits; one binary classifier a bit predicts it
from hashed byte trigrams of the lower-cased letters. A text's language is the
one whose codeword loses least against all the classifiers' margins; a text
whose two nearest codewords lose about the same is flagged ambiguous.

The classifiers learn from a sample of about `per_language` documents of each
language, whole texts of at most `max_bytes`, drawn by the hash of doc_id and
never from the held-out quarter. All languages are learned: the bounds
`SAMPLE_ROWS` and `SAMPLE_BYTES` of the whole sample are shared among them, and
every language keeps a document at least. Every document is scored, whole, very
long ones in pieces.

Edge cases: a null text or one without a letter (Unicode category L) is `und`
with score 0; so is every text where nothing can be learned; with one language
learned it is that one; of languages equally near the first in the alphabet
wins; rows that repeat a document get equal results; an empty table gives an
empty result; all columns are passed on inside `row`, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import as_row, bounded_sample, broadcast_if_small, give_back, in_held_out, in_slices, with_fields

DIMS = 8192
PER_LANGUAGE = 400
MAX_BYTES = 65_536
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 48 << 20
SPARE = 40  # documents of a language that are expected beyond what is wanted, so that chance leaves none without
AMBIGUOUS = 0.6  # scores below this are flagged
SCALE = 100.0
CHUNK = 1 << 20

_LETTER = re.compile(r"[^\W\d_]")  # and some numerals, which are no letters
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # (DIMS + 1) x bits; the last row is 0
    bias: np.ndarray


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text or ""))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A code for n languages: all splits of the languages in two up to 6 of them, else random splits in which no two languages are close."""
    if n <= 6:
        bits = max(1, 2 ** (n - 1) - 1)
        splits = np.arange(1, bits + 1)
        return np.array([1 - 2 * (splits >> (i - 1) & 1) if i else np.ones(bits, int) for i in range(n)])
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    tries = (rng.choice([-1, 1], (n, bits)) for _ in range(50))
    alike = lambda c: np.triu(c @ c.T, 1)  # noqa: E731  the more bits differ, the smaller
    return min(tries, key=lambda c: (alike(c) + np.tril(np.full((n, n), -bits))).max())


def trigram_slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts in one array, and where each text's begin; slot DIMS is for those across two texts."""
    parts = [b" " + t.encode("utf-8", "replace").translate(_FOLD) + b" " for t in texts]
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    b = np.frombuffer(b"".join(parts) + b"  ", dtype=np.uint8).astype(np.int32)
    slots = (b[:-2] * 961 + b[1:-1] * 3571 + b[2:] * 57) & (DIMS - 1)
    ends = np.append(starts[1:], len(slots))
    slots[ends - 1] = slots[ends - 2] = DIMS
    return slots, starts


def fit(texts: list[str], langs: list[str], rounds: int = 120, rate: float = 0.5) -> Model | None:
    languages = sorted(set(langs))
    if not languages:
        return None
    code = codewords(len(languages))
    want = code[np.searchsorted(languages, langs)].astype(np.float32)
    x = np.empty((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        s = trigram_slots([t])[0]
        x[i] = np.bincount(s, minlength=DIMS + 1)[:DIMS] * (SCALE / max(1, len(s) - 2))
    w, bias = np.zeros((DIMS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = (1 / np.bincount(np.searchsorted(languages, langs)))[np.searchsorted(languages, langs)].astype(np.float32)[:, None]
    weight /= weight.sum()
    for k in range(1, rounds + 1):  # logistic loss, Adam
        g = -want / (1 + np.exp(np.clip(want * (x @ w + bias), -50, 50))) * weight
        grad = x.T @ g + 1e-4 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6) * 0.1
        bias -= rate * g.sum(0)
    return Model(languages, code, np.vstack([w, np.zeros((1, code.shape[1]), np.float32)]), bias)


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Languages and scores (the soft-max share of the nearest codeword)."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    usable = [i for i, t in enumerate(texts) if t and has_letter(t)]
    if model is None or not usable:
        return langs, scores
    at = 0
    while at < len(usable):
        upto, size = at, 0
        while upto < len(usable) and (upto == at or size + len(texts[usable[upto]]) < CHUNK):
            size += len(texts[usable[upto]])
            upto += 1
        rows = usable[at:upto]
        slots, starts = trigram_slots([texts[i] for i in rows])
        n = np.maximum(np.diff(np.append(starts, len(slots))) - 2, 1)
        sums = np.zeros((len(rows), model.code.shape[1]))
        if len(texts[rows[0]]) >= CHUNK:  # a very long text, which is always alone, in pieces
            for k in range(0, len(slots), CHUNK):
                sums[0] += model.weights[slots[k : k + CHUNK]].sum(0, dtype=np.float64)
        else:
            sums = np.add.reduceat(model.weights[slots], starts, axis=0)
        margins = sums * SCALE / n[:, None] + model.bias
        loss = np.logaddexp(0, -margins[:, None, :] * model.code[None]).sum(2)
        share = np.exp(loss.min(1)[:, None] - loss)
        best = loss.argmin(1)
        for i, k, p in zip(rows, best, share[np.arange(len(rows)), best] / share.sum(1), strict=True):
            langs[i], scores[i] = model.languages[k], p
        at = upto
    return langs, scores


def train(documents: DataFrame, per_language: int = PER_LANGUAGE, max_bytes: int = MAX_BYTES) -> Model | None:
    """A model of the languages of documents(doc_id, text, lang), from a bounded sample of rows that are not held out."""
    rows = documents.select("doc_id", "text", "lang").where(~in_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.octet_length("text") <= max_bytes))
    counts = rows.groupBy("lang").count()
    n = counts.count()
    if not n:
        return None
    wanted = min(per_language, max(2, SAMPLE_ROWS // n))
    draw = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)).alias("draw")
    drawn = rows.select("text", "lang", draw).join(broadcast_if_small(counts, n), "lang").where(F.col("draw") * F.col("count") < wanted + SPARE)
    sample = bounded_sample(drawn.select("draw", "text", "lang"), "lang", SAMPLE_BYTES // n, wanted)
    texts = sorted((r["text"], r["lang"]) for r in sample.select("text", "lang").collect())
    texts = [x for x in texts if has_letter(x[0])]
    model = fit([t for t, _ in texts], [g for _, g in texts])
    give_back()
    return model


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """row (a row of documents(doc_id, text), whole), lang_pred, score and ambiguous."""
    rows = documents.select(as_row(documents))

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            langs, scores = predict(model, b.column(0).field("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(scores < AMBIGUOUS)], names=["row", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(score_batches, with_fields(rows, lang_pred="string", score="double", ambiguous="boolean"))
