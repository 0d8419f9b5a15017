"""Language identification with a linear-chain conditional random field over words.

Each word's emission is the sum of learned weights of its character n-grams
between two marks (so prefixes and suffixes are among them) and of the word
itself (the lexicon).  Transitions between the languages of neighbouring words
are learned too, from sequences that switch between documents of different
languages.  Forward-backward gives each word its posterior; a document's
language is the one with the largest mean posterior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from . import wordmodel as M

NO_LANGUAGE = "und"
GRAMS = (2, 3, 4)
BUCKETS = 1 << 17
#: Most documents of each language to learn from, most characters of them all, and most languages, the most frequent.
SAMPLE, CHARS, LANGUAGES = 600, 700_000, 200
_BLOCK = 32
#: Bytes of text that are scored at once: its words' numbers take a hundred times as much memory.
_PART = 250_000


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # bucket x language
    transitions: np.ndarray  # factors, language x language


def _parted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = K.buffers(texts)
    data = M.lowered(data)
    return data, *K.spans(data, offsets, ~M.LETTER)


def _word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    hashes, first, inverse = M.distinct(data, starts, ends)
    bucket, begin = M.grams(data, hashes, starts[first], ends[first], GRAMS, len(weights))
    return np.add.reduceat(weights[bucket], begin, axis=0)[inverse] if len(first) else np.zeros((0, weights.shape[1]))


def posteriors(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward over all texts' words at once: the posterior of each word.

    Chains are cut into blocks whose transfer matrices are multiplied side by
    side; messages then pass from block to block, and inside each block.
    """
    n, k = scores.shape
    if not n:
        return scores
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    blocks = -(-counts // _BLOCK)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.cumsum(blocks) - blocks
    row, column = first[owner] + place // _BLOCK, place % _BLOCK
    total = int(blocks.sum())
    grid = np.ones((total, _BLOCK, k))
    grid[row, column] = emit
    used = np.bincount(row, minlength=total)

    transfer = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(_BLOCK):
        on = used > t
        step = (transfer[on].reshape(-1, k) @ transitions).reshape(-1, k, k) * grid[on, t][:, None, :]
        transfer[on] = step / step.max(axis=(1, 2), keepdims=True)

    ahead, behind = np.empty((total, k)), np.empty((total, k))
    order = np.argsort(-blocks, kind="stable")
    order = order[blocks[order] > 0]
    depth = -np.sort(-blocks[order])
    message = np.full((len(order), k), 1.0 / k)
    for j in range(int(depth[0])):
        live = int(np.searchsorted(-depth, -j, side="left"))
        at = first[order[:live]] + j
        ahead[at] = message[:live]
        step = np.einsum("di,dij->dj", message[:live], transfer[at])
        message[:live] = step / step.sum(axis=1, keepdims=True)
    message = np.full((len(order), k), 1.0)
    for j in range(int(depth[0]) - 1, -1, -1):
        live = int(np.searchsorted(-depth, -j, side="left"))
        at = first[order[:live]] + j
        behind[at] = message[:live]
        step = np.einsum("dij,dj->di", transfer[at], message[:live])
        message[:live] = step / step.sum(axis=1, keepdims=True)

    forward = np.empty((total, _BLOCK, k))
    for t in range(_BLOCK):
        ahead = (ahead @ transitions) * grid[:, t]
        ahead /= ahead.sum(axis=1, keepdims=True)
        forward[:, t] = ahead
    for t in range(_BLOCK - 1, -1, -1):
        on = (used > t)[:, None]
        forward[:, t] *= np.where(on, behind, 1.0)
        step = (behind * grid[:, t]) @ transitions.T
        behind = np.where(on, step / step.sum(axis=1, keepdims=True), behind)
    out = forward[row, column]
    return out / out.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 0, epochs: int = 8, length: int = 64) -> LanguageModel:
    """Fits weights and transitions by the gradient of the chains' log-likelihood, with one step size for each weight (Adagrad)."""
    languages = sorted(set(labels)) or [NO_LANGUAGE]
    k = len(languages)
    data, starts, ends, counts = _parted(pa.array(texts, pa.large_string()))
    hashes, first, word = M.distinct(data, starts, ends)
    bucket, begin = M.grams(data, hashes, starts[first], ends[first], GRAMS, BUCKETS)
    sizes = np.diff(np.append(begin, len(bucket)))
    label = np.repeat(np.array([languages.index(x) for x in labels], dtype=np.int64), counts)
    weights, factors = np.zeros((BUCKETS, k), np.float32), np.eye(k) * 2.0
    seen_w, seen_t = np.full((BUCKETS, k), 1e-3, np.float32), np.full((k, k), 1e-3)
    r = np.random.default_rng(seed)
    piece = 16
    for _ in range(epochs if k > 1 else 0):
        # sequences of pieces from different documents: some switch language, most go on
        at = np.flatnonzero(np.repeat(np.arange(len(counts)), counts)[: len(word) - piece + 1] == np.repeat(np.arange(len(counts)), counts)[piece - 1 :])
        at = at[r.permutation(len(at))[: max(64, len(word) // piece)]]
        by = np.argsort(label[at] + (r.random(len(at)) < 0.3) * r.integers(0, k, len(at)), kind="stable")
        at = at[by][: len(at) // (length // piece) * (length // piece)].reshape(-1, length // piece)
        chains = (at[:, :, None] + np.arange(piece)).reshape(len(at), -1)
        r.shuffle(chains)
        for part in np.array_split(chains, max(1, len(chains) // 64)):
            if not len(part):
                continue
            kinds, inverse = np.unique(word[part], return_inverse=True)
            n = sizes[kinds]
            of = np.repeat(np.arange(len(kinds)), n)
            rows = bucket[np.repeat(begin[kinds] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            score = np.add.reduceat(weights[rows], np.cumsum(n) - n, axis=0)[inverse.reshape(part.shape)].astype(np.float64)
            emit = np.exp(score - score.max(axis=2, keepdims=True))
            a = np.exp(factors)
            alpha, beta = np.empty_like(emit), np.ones_like(emit)
            message = np.full((len(part), k), 1.0 / k)
            for t in range(part.shape[1]):
                message = (message @ a) * emit[:, t]
                message /= message.sum(axis=1, keepdims=True)
                alpha[:, t] = message
            for t in range(part.shape[1] - 2, -1, -1):
                back = (beta[:, t + 1] * emit[:, t + 1]) @ a.T
                beta[:, t] = back / back.sum(axis=1, keepdims=True)
            post = alpha * beta
            post /= post.sum(axis=2, keepdims=True)
            truth = label[part]
            residue = post - np.eye(k)[truth]
            pair = alpha[:, :-1, :, None] * a * (emit[:, 1:] * beta[:, 1:])[:, :, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            wanted = np.bincount((truth[:, :-1] * k + truth[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
            g = (pair.sum(axis=(0, 1)) - wanted) / part.size + 1e-3 * (factors - factors.mean())
            seen_t += g * g
            factors -= 0.1 * g / np.sqrt(seen_t)
            by_kind = np.stack([np.bincount(inverse.ravel(), residue[:, :, c].ravel(), len(kinds)) for c in range(k)], axis=1)
            touched, slot = np.unique(rows, return_inverse=True)
            g = np.stack([np.bincount(slot, by_kind[of, c], len(touched)) for c in range(k)], axis=1) / len(part)
            seen_w[touched] += g * g
            weights[touched] -= 0.1 * g / np.sqrt(seen_w[touched])
    return LanguageModel(languages, weights, np.exp(factors))


def _learned(docs: DataFrame, seed: int) -> LanguageModel:
    rows = docs.where(~K.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    often = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    rows = rows.join(F.broadcast(often.select("lang")), "lang")
    model = train(*M.sample(M.chosen(rows, "lang", ["doc_id", "text"], SAMPLE), "lang", SAMPLE, CHARS), seed)
    K.give_back()
    return model


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _predict_pass(model: LanguageModel, with_runs: bool):
    names = np.array(model.languages, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, 1, _PART):
                raw, offsets = K.buffers(part.column(1))
                data, starts, ends, counts = _parted(part.column(1))
                post = posteriors(_word_scores(data, starts, ends, model.weights).astype(np.float64), counts, model.transitions)
                owner = np.repeat(np.arange(len(counts)), counts)
                mean = np.stack([np.bincount(owner, post[:, c], len(counts)) for c in range(len(names))], axis=1) / np.maximum(counts, 1)[:, None]
                best = mean.argmax(axis=1)
                pred, score = names[best], mean[np.arange(len(best)), best]
                plain = np.bincount(np.repeat(np.arange(len(counts)), np.diff(offsets))[data < 0x80], M.LETTER[data[data < 0x80]], len(counts))
                none = counts == 0
                for k in np.flatnonzero((plain == 0) & ~none):
                    none[k] = not has_letter(raw[offsets[k] : offsets[k + 1]].tobytes())
                pred[none], score[none] = NO_LANGUAGE, 0.0
                columns = [part.column(0), pa.array(pred, pa.string()), pa.array(np.clip(score, 0.0, 1.0)), pa.array(counts)]
                fields = ["doc_id", "lang_pred", "score", "n_words"]
                if with_runs:
                    label = post.argmax(axis=1)
                    new = np.ones(len(label), dtype=bool)
                    new[1:] = (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])
                    at = np.flatnonzero(new)
                    last = np.append(at[1:], len(label)) - 1 if len(at) else at
                    values = pa.StructArray.from_arrays([pa.array(starts[at] - offsets[owner[at]]), pa.array(ends[last] - offsets[owner[at]]), pa.array(names[label[at]], pa.string())], ["begin", "end", "lang"])
                    columns.append(K.lists(values, np.bincount(owner[at], minlength=len(counts))))
                    fields.append("runs")
                yield pa.RecordBatch.from_arrays(columns + part.columns[2:], fields + part.schema.names[2:])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: LanguageModel | None = None, runs: bool = False, seed: int = 0) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score, n_words and, on demand, runs.

    Without a model one is learned from rows that are not held out (crc32 of the
    id as text, modulo 3, is not 1) and have a language: whole texts of at most
    SAMPLE documents of each, chosen by hash.  lang_pred is `und` with
    score 0 for a null text or one without letters; otherwise a learned language,
    and score its mean posterior over the text's words, from 0 to 1.  Ties go to
    the first language.  runs lists stretches of words of one language by byte
    positions.  If nothing can be learned from, every text is `und`.  Rows
    without an id are not held out.  Other columns are not read.
    """
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    if model is None:
        model = _learned(docs.select(*columns, F.col(lang_col).cast("string").alias("lang")), seed)
    kinds = "doc_id long, lang_pred string, score double, n_words long" + ", runs array<struct<begin: long, end: long, lang: string>>" * runs
    out = K.bounded(docs).select(*columns).mapInArrow(_predict_pass(model, runs), kinds)
    return out.select("doc_id", K.held_out(F.col("doc_id")).alias("held_out"), *out.columns[1:])


def in_a_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 0) -> DataFrame:
    """Rows of `docs` whose text is in a language; a null language becomes the predicted one.

    A null or empty text and one without letters go.  Where no language can be
    learned, all other rows stay, and a null language stays null.  Rows without an
    id and repeated rows are rows as others are; other columns pass, whatever
    their names.
    """
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    model = _learned(docs.select(*columns, F.col(lang_col).cast("string").alias("lang")), seed)
    passed, fields, own = K.carried(docs)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()), *fields])
    out = K.bounded(docs).select(*columns, *passed).mapInArrow(_predict_pass(model, False), schema)
    # with nothing learned each text is `und`, but only those without letters have score 0
    out = out.where(F.col("score") > 0 if model.languages == [NO_LANGUAGE] else F.col("lang_pred") != NO_LANGUAGE)
    own[lang_col] = F.coalesce(own[lang_col], F.nullif(F.col("lang_pred"), F.lit(NO_LANGUAGE)).cast(docs.schema[lang_col].dataType))
    return out.select(*(own[c].alias(c) for c in docs.columns))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
