"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad from its own features and those
of the lines before and after it; the field's two-by-two transitions tie
neighbours together. The forward-backward marginals, weighted by the lines'
lengths, make the text's share of bad text, and a logistic curve fitted on the
training texts turns it into the probability of label 1.

Labels are given for documents, not lines. Training starts with every line
labelled as its document; then lines of bad documents that the field believes
good are relabelled, and it is fitted again. It learns from a sample of at most
about `per_label` documents of either label, whole texts of at most `max_bytes`,
of `SAMPLE_BYTES` a label, drawn by the hash of doc_id, never from the held-out
quarter. Every document is scored, whole, however long; labels, lang, source and
doc_id are no inputs.

Edge cases: a null or empty text is scored as one empty line; without training
texts of both labels every score is 0.5; documents of equal texts, and rows that
repeat one, get equal scores; an empty table gives an empty result; all columns
are passed on inside `row`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import as_row, bounded_sample, give_back, in_held_out, in_slices, with_fields

PER_LABEL = 1500
MAX_BYTES = 65_536
SAMPLE_BYTES = 12 << 20
CHUNK = 1 << 20
ROUNDS = 150
KEEP_AT = 0.7

_KINDS = 6  # byte classes counted for each line
_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 1
_CLASS[ord("!")] = 2
_CLASS[ord("A") : ord("Z") + 1] = 3
_CLASS[ord("0") : ord("9") + 1] = 4
_CLASS[[ord(c) for c in "\"'()+-/:;=?@[\\]^_`{}~"]] = 5
_CLASS = _CLASS.tobytes()
_NEIGHBOUR = (2, 3, 4, 7, 9)  # features that are also taken from the lines around
_OWN = 13


class Model(NamedTuple):
    emission: np.ndarray  # of "bad" against "good", by feature
    transition: np.ndarray  # 2 x 2, logs
    slope: float
    offset: float


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, line lengths, first line of each text)."""
    lines, starts, repeats = [], [], []
    for t in texts:
        starts.append(len(lines))
        own = t.encode("utf-8", "replace").split(b"\n")
        lines += own
        if len(own) == len(set(own)):
            repeats += [0.0] * len(own)
        else:
            seen: dict[bytes, int] = {}
            for x in own:
                seen[x] = seen.get(x, 0) + 1
            repeats += [float(seen[x] > 1 and len(x) > 0) for x in own]
    n = np.array([len(x) for x in lines], np.int64)
    classes = np.frombuffer(b"\n".join(lines).translate(_CLASS) + b"\0", np.uint8)
    at = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
    counts = np.stack([np.add.reduceat((classes == k).view(np.uint8), at, dtype=np.int64) for k in range(1, _KINDS)], 1)
    split = [x.split() for x in lines]
    words = np.array([len(w) for w in split], np.float64)
    distinct = np.array([len(set(w)) for w in split], np.float64)
    per = counts / np.maximum(n, 1)[:, None]
    f = np.empty((len(lines), _OWN))
    f[:, 0] = 1
    f[:, 1] = np.log1p(n) / 5
    f[:, 2] = np.minimum(1, 8 * per[:, 0])
    f[:, 3] = np.minimum(1, 10 * per[:, 1])
    f[:, 4] = np.minimum(1, 3 * per[:, 2])
    f[:, 5] = np.minimum(1, 5 * per[:, 3])
    f[:, 6] = np.minimum(1, 8 * per[:, 4])
    f[:, 7] = np.where(words > 0, 1 - distinct / np.maximum(words, 1), 0) ** 2
    f[:, 8] = words < 4
    f[:, 9] = repeats
    f[:, 10] = np.minimum(2, (n - words + 1) / np.maximum(words, 1) / 8)
    f[:, 11] = [x[-1:] in (b".", b"!", b"?", b'"', b"'") for x in (y.rstrip() for y in lines)]
    f[:, 12] = n == 0
    first = np.zeros(len(lines), bool)
    first[starts] = True
    near = f[:, _NEIGHBOUR]
    before = np.vstack([np.zeros((1, len(_NEIGHBOUR))), near[:-1]])
    before[first] = 0
    after = np.vstack([near[1:], np.zeros((1, len(_NEIGHBOUR)))])
    after[np.append(first[1:], True)] = 0
    return np.hstack([f, before, after]), np.maximum(n, 1), np.array(starts)


def marginals(scores: np.ndarray, starts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(bad) of each line, expected 2 x 2 transitions), of chains given by their first lines.

    Forward-backward, all chains side by side: step t treats the t-th line of
    every chain that is that long.
    """
    total = len(scores)
    length = np.diff(np.append(starts, total))
    order = np.argsort(-length, kind="stable")
    first, length = starts[order], length[order]
    emit = np.stack([np.ones(total), np.exp(np.clip(scores, -30, 30))], 1)
    t = np.exp(np.clip(transition, -20, 20))
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    forward, backward = np.empty((total, 2)), np.empty((total, 2))
    for k, n in enumerate(alive):
        at = first[:n] + k
        a = emit[at] if k == 0 else emit[at] * (forward[at - 1] @ t)
        forward[at] = a / a.sum(1, keepdims=True)
    for k in range(length[0] - 1, -1, -1):
        n = alive[k]
        at = first[:n] + k
        b = np.ones((n, 2))
        more = alive[k + 1] if k + 1 < length[0] else 0
        if more:
            x = (emit[at[:more] + 1] * backward[at[:more] + 1]) @ t.T
            b[:more] = x / x.sum(1, keepdims=True)
        backward[at] = b
    p = forward * backward
    p /= p.sum(1, keepdims=True)
    inner = np.ones(total, bool)
    inner[starts] = False
    to = np.flatnonzero(inner)
    pairs = forward[to - 1][:, :, None] * t[None] * (emit[to] * backward[to])[:, None, :]
    pairs /= pairs.sum((1, 2), keepdims=True)
    return p[:, 1], pairs


def _fit_field(x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights and transitions of the greatest penalised likelihood, by Adam."""
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    inner = np.ones(len(x), bool)
    inner[starts] = False
    to = np.flatnonzero(inner)
    seen = np.zeros((len(to), 2, 2))
    seen[np.arange(len(to)), y[to - 1], y[to]] = 1
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for k in range(1, rounds + 1):
        p, pairs = marginals(x @ w, starts, t)
        gw = x.T @ (weight * (p - y)) / weight.sum() + 1e-4 * w
        gt = ((pairs - seen) * weight[to][:, None, None]).sum(0) / weight.sum() + 1e-3 * t
        for i, (v, g) in enumerate(((w, gw), (t, gt))):
            state[2 * i] = 0.9 * state[2 * i] + 0.1 * g
            state[2 * i + 1] = 0.99 * state[2 * i + 1] + 0.01 * g * g
            v -= 0.15 * (state[2 * i] / (1 - 0.9**k)) / (np.sqrt(state[2 * i + 1] / (1 - 0.99**k)) + 1e-9)
    return w, t


def bad_share(model: Model, texts: list[str]) -> np.ndarray:
    """The length-weighted mean of P(bad) over each text's lines."""
    x, n, starts = line_features(texts)
    p, _ = marginals(x @ model.emission, starts, model.transition)
    return np.add.reduceat(p * n, starts) / np.add.reduceat(n, starts)


def fit(texts: list[str], quality: list[int], weights: tuple[float, float] = (1.0, 1.0), rounds: int = ROUNDS) -> Model | None:
    """weights: of a document of label 0 and of 1, to undo an uneven sample."""
    q = np.array(quality)
    if len(set(quality)) < 2:
        return None
    x, n, starts = line_features(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(x))))
    y = (1 - q)[doc]
    weight = 1.0 / np.diff(np.append(starts, len(x)))[doc] / np.bincount(q)[q][doc]  # either label counts as much, and each document of it
    for again in range(2):
        w, t = _fit_field(x, starts, y, weight, rounds)
        p, _ = marginals(x @ w, starts, t)
        top = np.maximum.reduceat(p, starts)[doc]
        if not again:
            y = np.where(q[doc] == 1, 0, (p > 0.5) | (p >= top)).astype(int)
    share = np.add.reduceat(p * n, starts) / np.add.reduceat(n, starts)
    by_doc = np.array(weights)[q]
    a, b = 1.0, -1.0
    for _ in range(50):  # Newton, of the calibrating curve
        z = 1 / (1 + np.exp(-np.clip(a + b * share, -30, 30)))
        g = np.array([(by_doc * (z - q)).sum() + 1e-2 * a, (by_doc * (z - q) * share).sum() + 1e-2 * b])
        h = by_doc * z * (1 - z)
        m = np.array([[h.sum() + 1e-2, (h * share).sum()], [(h * share).sum(), (h * share * share).sum() + 1e-2]])
        step = np.linalg.solve(m, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return Model(w, t, float(b), float(a))


def predict(model: Model | None, texts: list[str | None]) -> np.ndarray:
    """The probability of label 1 for each text."""
    scores = np.full(len(texts), 0.5)
    if model is None:
        return scores
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto] or "") < CHUNK):
            size += len(texts[upto] or "")
            upto += 1
        share = bad_share(model, [t or "" for t in texts[at:upto]])
        scores[at:upto] = 1 / (1 + np.exp(-np.clip(model.offset + model.slope * share, -30, 30)))
        at = upto
    return scores


def train(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, max_bytes: int = MAX_BYTES) -> Model | None:
    """A model from a bounded sample of the labelled documents that are not held out."""
    marked = labels.where(~in_held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    counts = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chance = F.when(F.col("quality") == 1, min(1.0, per_label / counts[1])).otherwise(min(1.0, per_label / counts[0]))
    ids = marked.withColumn("draw", draw).where(F.col("draw") < chance).orderBy("draw", "doc_id").limit(3 * per_label)  # so few rows that they are broadcast
    rows = documents.select("doc_id", "text").where(F.octet_length("text") <= max_bytes).join(F.broadcast(ids), "doc_id").select("draw", "text", "quality")
    few = bounded_sample(rows.orderBy("draw", "text").limit(3 * per_label), "quality", SAMPLE_BYTES, 3 * per_label)
    sample = sorted((r["text"], r["quality"]) for r in few.select("text", "quality").collect())
    got = [sum(q == k for _, q in sample) for k in (0, 1)]
    model = fit([t for t, _ in sample], [q for _, q in sample], tuple(counts[k] / max(1, got[k]) for k in (0, 1))) if all(got) else None
    give_back()
    return model


def classify(documents: DataFrame, model: Model | None) -> DataFrame:
    """row (a row of documents(text), whole) and score, the probability of label 1."""
    rows = documents.select(as_row(documents))

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            scores = predict(model, b.column(0).field("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    return rows.mapInArrow(score_batches, with_fields(rows, score="double"))
