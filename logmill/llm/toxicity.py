"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the embeddings of its hashed character n-grams
and of the word itself, so an unseen misspelling shares most of its vector with
the word it stands for.  The words of a window are averaged, and a linear
softmax gives the window's class; embeddings and softmax are trained together.
A document is as toxic as its most toxic window, in training as well: the loss
is that of each document's largest window, so a few insults in a long text are
not averaged away.  As the softmax is linear, each bucket's share in the
difference of the two classes is a number, and scoring adds these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from . import wordmodel as M

GRAMS = (3, 4, 5)
BUCKETS = 1 << 18
DIM = 8
#: Words of a window; windows begin every half of it.
WINDOW = 8
#: Most documents of each class to learn from, and most characters of them all.
SAMPLE, CHARS = 1500, 8_000_000


@dataclass
class ToxicityModel:
    share: np.ndarray  # of each bucket in the difference of the classes' logits
    bias: float


def _windows(counts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean value of each window, and each text's first window and number of windows; a text without words has one of value 0."""
    half = WINDOW // 2
    parts = np.maximum(1, -(-(counts - half) // half))
    first = np.cumsum(parts) - parts
    owner = np.repeat(np.arange(len(counts)), parts)
    begin = (np.arange(len(owner)) - first[owner]) * half
    n = np.minimum(counts[owner] - begin, WINDOW)
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    at = (np.cumsum(counts) - counts)[owner] + begin
    return (total[at + n] - total[at]) / np.maximum(n, 1), first, parts


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, buckets and first places of theirs, each word's number, and words of each text."""
    data, offsets = K.buffers(texts)
    data = M.lowered(data)
    starts, ends, counts = M.bare_spans(data, offsets)
    hashes, first, word = M.distinct(data, starts, ends)
    bucket, begin = M.grams(data, hashes, starts[first], ends[first], GRAMS, BUCKETS)
    # a word said again at once counts once
    owner = np.repeat(np.arange(len(counts)), counts)
    keep = np.ones(len(word), dtype=bool)
    keep[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
    return bucket, begin, word[keep], np.bincount(owner[keep], minlength=len(counts)), starts[keep]


def _means(bucket: np.ndarray, begin: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of each distinct word's buckets."""
    sizes = np.diff(np.append(begin, len(bucket)))
    return np.add.reduceat(values[bucket], begin) / sizes if len(begin) else np.zeros(0)


def _association(bucket: np.ndarray, sizes: np.ndarray, word: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Signed root of each bucket's likelihood ratio between the classes, less 2.5 for chance."""
    one, both = np.zeros(BUCKETS), np.zeros(BUCKETS)
    begin, at = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
    for k in range(len(counts)):
        kinds = np.unique(word[at[k] : at[k] + counts[k]])
        m = sizes[kinds]
        rows = np.unique(bucket[np.repeat(begin[kinds] - (np.cumsum(m) - m), m) + np.arange(m.sum())])
        both[rows] += 1
        one[rows] += labels[k]
    share = labels.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = np.where(one > 0, one * np.log(one / (both * share)), 0) + np.where(both > one, (both - one) * np.log((both - one) / (both * (1 - share))), 0)
        n, n1 = len(labels), labels.sum()
        out1, out = n1 - one, n - both
        outside = np.where(out1 > 0, out1 * np.log(out1 / (out * share)), 0) + np.where(out > out1, (out - out1) * np.log((out - out1) / (out * (1 - share))), 0)
    root = np.sqrt(np.maximum(2 * (inside + outside), 0))
    return np.sign(one - both * share) * np.maximum(root - 2.5, 0)


def train(texts: list[str], labels: np.ndarray, seed: int = 0) -> ToxicityModel:
    r = np.random.default_rng(seed)
    labels = np.asarray(labels, dtype=np.float64)
    vectors = (r.normal(size=(BUCKETS, DIM)) * 0.1).astype(np.float32)
    softmax = (r.normal(size=(DIM, 2)) * 0.3).astype(np.float32)
    bias = np.zeros(2)
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))))
    bucket, begin, word, counts, _ = _words(pa.array(texts, pa.large_string()))
    sizes = np.diff(np.append(begin, len(bucket)))
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    seen_v, seen_s, seen_b = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    # the embeddings begin along the softmax, by how much more often documents of one class have the bucket than chance would give
    along = softmax[:, 1] - softmax[:, 0]
    vectors += np.outer(4.0 * _association(bucket, sizes, word, counts, labels), along / (along @ along)).astype(np.float32)
    first_word = np.cumsum(counts) - counts
    half = WINDOW // 2
    batch = 64 if len(labels) < 1000 else 128
    epochs = int(np.clip(10_000 // len(labels), 40, 60))
    for _ in range(epochs):
        share = vectors @ (softmax[:, 1] - softmax[:, 0])
        value, first, parts = _windows(counts, _means(bucket, begin, share)[word])
        by = r.permutation(len(labels))
        owner = np.repeat(np.arange(len(counts)), parts)
        top = np.lexsort((-value, owner))[first]
        for docs in np.array_split(by, max(1, len(by) // batch)):
            at = first_word[docs] + (top[docs] - first[docs]) * half
            n = np.minimum(first_word[docs] + counts[docs] - at, WINDOW)
            doc = np.repeat(np.arange(len(docs)), n)
            kind = word[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            m = sizes[kind]
            of = np.repeat(np.arange(len(kind)), m)
            rows = bucket[np.repeat(begin[kind] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            scale = (1.0 / (m[of] * np.maximum(n[doc[of]], 1))).astype(np.float32)
            bag = np.zeros((len(docs), DIM), np.float32)
            for d in range(DIM):
                bag[:, d] = np.bincount(doc[of], vectors[rows, d] * scale, len(docs))
            logit = bag @ softmax + bias
            p = 1 / (1 + np.exp(logit[:, 0] - logit[:, 1]))
            g = ((p - labels[docs]) * weight[docs]).astype(np.float32)
            both = np.stack([-g, g], axis=1)
            step = bag.T @ both / len(docs) + 1e-4 * softmax
            seen_s += step * step
            shift = both.mean(axis=0)
            seen_b += shift * shift
            touched, slot = np.unique(rows, return_inverse=True)
            pull = g[doc[of]] * scale
            along = softmax[:, 1] - softmax[:, 0]
            amount = np.bincount(slot, pull, len(touched)).astype(np.float32) / len(docs)
            seen_v[touched] += amount * amount
            vectors[touched] -= (0.3 * amount / np.sqrt(seen_v[touched]))[:, None] * along / (np.linalg.norm(along) + 1e-6)
            softmax -= (0.05 * step / np.sqrt(seen_s)).astype(np.float32)
            bias -= 0.05 * shift / np.sqrt(seen_b)
    share = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
    return ToxicityModel(share, float(bias[1] - bias[0]))


def _learned(docs: DataFrame, labels: DataFrame, seed: int) -> ToxicityModel:
    texts, marks = M.labelled(docs, labels, "toxic", SAMPLE, CHARS)
    model = train(texts, np.array(marks), seed)
    K.give_back()
    return model


def _score_pass(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, 1):
                bucket, begin, word, counts, starts = _words(part.column(1))
                value, first, parts = _windows(counts, _means(bucket, begin, model.share)[word])
                owner = np.repeat(np.arange(len(counts)), parts)
                top = np.lexsort((-value, owner))[first]
                at = (np.cumsum(counts) - counts) + (top - first) * (WINDOW // 2)
                offsets = K.buffers(part.column(1))[1]
                place = np.where(counts > 0, (starts[np.minimum(at, max(len(starts) - 1, 0))] if len(starts) else 0) - offsets[:-1], 0)
                with np.errstate(over="ignore"):
                    score = 1 / (1 + np.exp(-(value[top] + model.bias)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(place)], ["doc_id", "score", "at_byte"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", model: ToxicityModel | None = None, threshold: float = 0.7, seed: int = 0) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold) and at_byte, where its most toxic window begins.

    Without a model one is learned from the rows of `labels` (doc_id, toxic 0 or
    1) that are not held out (crc32 of the id as text, modulo 3, is not 1): whole
    texts of at most SAMPLE documents of each class, chosen by hash.  Null and
    empty texts and those without words get the score of an empty bag.  If no
    label can be learned from, every score is 0.5; with labels of one class only,
    that class's share.  A row without an id is scored, and not held out; repeated
    rows each give a row.  Of the first of equal windows the place is given.
    Other columns are not read.
    """
    docs = K.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        model = _learned(docs, labels, seed)
    out = docs.mapInArrow(_score_pass(model), "doc_id long, score double, at_byte long")
    return out.select("doc_id", K.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "at_byte")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
