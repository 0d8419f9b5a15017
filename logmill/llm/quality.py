"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of a fixed number of words.  Each passage is
encoded from its shares of character classes, its repetition and its word
lengths; a gated attention (tanh times sigmoid) weighs the passages, and a
logistic layer scores their weighted mean.  Encoder, attention and score are
learned together from document labels alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from . import wordmodel as M

#: Words of a passage, and units of the encoder and of the attention.
PASSAGE, UNITS, GATES = 64, 24, 12
#: Most documents of each class to learn from, and most characters of them all.
SAMPLE, CHARS = 1500, 8_000_000

#: Class of each byte: lower case, upper case, digit, white space, line end, other character, and each printable sign for itself.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 0, 1, 2, 5
_CLASS[:0x21] = 3
_CLASS[0x0A] = 4
_SIGNS = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
_CLASS[_SIGNS] = 6 + np.arange(len(_SIGNS))
_CLASSES = 6 + len(_SIGNS)
FEATURES = _CLASSES + 8


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float = 0.5


def encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and how many passages each text has; a text without words has one empty passage."""
    data, offsets = K.buffers(texts)
    starts, ends, counts = K.spans(data, offsets)
    parts = np.maximum(1, -(-counts // PASSAGE))
    first = np.cumsum(parts) - parts
    total = int(parts.sum())
    owner = np.repeat(np.arange(len(counts)), counts)
    word = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    passage = first[owner] + word // PASSAGE
    n = np.bincount(passage, minlength=total).astype(np.float64)
    # a passage reaches from its first word to the next passage's
    edge = np.repeat(offsets[:-1], parts)
    opens = np.flatnonzero((word % PASSAGE == 0) & (word > 0))
    edge[passage[opens]] = starts[opens]
    sizes = np.diff(np.append(edge, len(data)))
    of_byte = np.repeat(np.arange(total), sizes)
    shares = np.bincount(of_byte * _CLASSES + _CLASS[data], minlength=total * _CLASSES).reshape(total, _CLASSES) / np.maximum(sizes, 1)[:, None]
    out = np.zeros((total, FEATURES))
    out[:, :_CLASSES] = np.sqrt(shares)
    lengths = (ends - starts).astype(np.float64)
    mean = np.bincount(passage, lengths, total) / np.maximum(n, 1)
    out[:, _CLASSES] = np.log1p(n)
    out[:, _CLASSES + 1] = mean
    out[:, _CLASSES + 2] = np.sqrt(np.maximum(np.bincount(passage, lengths * lengths, total) / np.maximum(n, 1) - mean * mean, 0))
    if len(starts):
        hashes = K.word_hashes(data, starts, ends)
        # by text, then by word: 44 bits of the hash part a text's words well enough for a share
        key = (owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20))
        by = np.argsort(key, kind="stable")
        key, p = key[by], passage[by]
        again = np.zeros(len(key), dtype=bool)
        again[1:] = key[1:] == key[:-1]
        new = ~again
        new[1:] |= p[1:] != p[:-1]
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(key))).astype(np.float64)
        out[:, _CLASSES + 3] = np.bincount(p[at], minlength=total) / np.maximum(n, 1)
        out[:, _CLASSES + 4] = np.bincount(p[at], times * times, total) / np.maximum(n * n, 1)
        out[:, _CLASSES + 7] = np.bincount(p, again, total) / np.maximum(n, 1)
        same = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
        out[:, _CLASSES + 5] = np.bincount(passage[1:][same], minlength=total) / np.maximum(n, 1)
        bare = ~(M.ALNUM[data[starts]] & M.ALNUM[data[ends - 1]])
        out[:, _CLASSES + 6] = np.bincount(passage, bare, total) / np.maximum(n, 1)
    return out, parts


def _forward(x: np.ndarray, owner: np.ndarray, first: np.ndarray, m: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    h = np.tanh(x @ m["w"] + m["b"])
    t, s = np.tanh(h @ m["v"]), 1 / (1 + np.exp(-(h @ m["u"])))
    e = (t * s) @ m["a"]
    e = np.exp(e - np.maximum.reduceat(e, first)[owner])
    attention = e / np.add.reduceat(e, first)[owner]
    z = np.add.reduceat(attention[:, None] * h, first, axis=0)
    return h, t, s, attention, z, 1 / (1 + np.exp(-np.clip(z @ m["o"] + m["c"], -40, 40)))


def train(texts: list[str], labels: np.ndarray, seed: int = 0) -> QualityModel:
    """Adam on the weighted log-loss of documents."""
    labels = np.asarray(labels, dtype=np.float64)
    x, parts = encoded(pa.array(texts, pa.large_string()))
    mean = x.mean(axis=0) if len(x) else np.zeros(FEATURES)
    scale = (x.std(axis=0) if len(x) else np.ones(FEATURES)) + 0.02
    if len(set(labels.tolist())) < 2:
        return QualityModel(mean, scale, constant=float(labels.mean()) if len(labels) else 0.5)
    x = np.clip((x - mean) / scale, -6, 6)
    r = np.random.default_rng(seed)
    m = {"w": r.normal(size=(FEATURES, UNITS)) / np.sqrt(FEATURES), "b": np.zeros(UNITS), "v": r.normal(size=(UNITS, GATES)) / 5, "u": r.normal(size=(UNITS, GATES)) / 5, "a": r.normal(size=GATES) / 4, "o": r.normal(size=UNITS) / 5, "c": np.zeros(1)}
    moment, square = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    begin = np.cumsum(parts) - parts
    step = 0
    batch = 64
    epochs = int(np.clip(60_000 // len(labels), 25, 120))
    for _ in range(epochs):
        for docs in np.array_split(r.permutation(len(labels)), max(1, len(labels) // batch)):
            n = parts[docs]
            first = np.cumsum(n) - n
            owner = np.repeat(np.arange(len(docs)), n)
            xs = x[np.repeat(begin[docs] - first, n) + np.arange(n.sum())]
            h, t, s, attention, z, p = _forward(xs, owner, first, m)
            g = (p - labels[docs]) * weight[docs] / len(docs)
            dz = g[:, None] * m["o"]
            dh = attention[:, None] * dz[owner]
            da = (h * dz[owner]).sum(axis=1)
            de = attention * (da - np.add.reduceat(attention * da, first)[owner])
            dt, ds = de[:, None] * m["a"] * s * (1 - t * t), de[:, None] * m["a"] * t * s * (1 - s)
            dh += dt @ m["v"].T + ds @ m["u"].T
            dw = dh * (1 - h * h)
            grads = {"w": xs.T @ dw, "b": dw.sum(axis=0), "v": h.T @ dt, "u": h.T @ ds, "a": ((t * s) * de[:, None]).sum(axis=0), "o": z.T @ g, "c": np.array([g.sum()])}
            step += 1
            for k, v in grads.items():
                v = v + 1e-4 * m[k]
                moment[k] += 0.1 * (v - moment[k])
                square[k] += 0.001 * (v * v - square[k])
                m[k] -= 0.004 * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(mean, scale, m)


def _learned(docs: DataFrame, labels: DataFrame, seed: int) -> QualityModel:
    texts, marks = M.labelled(docs, labels, "quality", SAMPLE, CHARS)
    model = train(texts, np.array(marks), seed)
    K.give_back()
    return model


def _score_pass(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, 1):
                x, parts = encoded(part.column(1))
                score, most = np.full(len(parts), model.constant), np.ones(len(parts))
                if model.parts:
                    first = np.cumsum(parts) - parts
                    owner = np.repeat(np.arange(len(parts)), parts)
                    *_, attention, _, score = _forward(np.clip((x - model.mean) / model.scale, -6, 6), owner, first, model.parts)
                    most = np.maximum.reduceat(attention, first)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(parts), pa.array(most)], ["doc_id", "score", "passages", "most_attention"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", model: QualityModel | None = None, threshold: float = 0.5, seed: int = 0) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold), passages, and most_attention, the largest weight of one.

    Without a model one is learned from the rows of `labels` (doc_id, quality 0
    or 1) that are not held out (crc32 of the id as text, modulo 3, is not 1):
    whole texts of at most SAMPLE documents of each class, chosen by hash.  A null
    or empty text or one without words is one empty passage and is scored as such.
    Without two classes to learn from, every score is the share of class 1, or 0.5
    if there are no labels.  A row without an id is scored and not held out;
    repeated rows each give a row.  Other columns are not read.
    """
    docs = K.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        model = _learned(docs, labels, seed)
    out = docs.mapInArrow(_score_pass(model), "doc_id long, score double, passages long, most_attention double")
    return out.select("doc_id", K.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages", "most_attention")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
