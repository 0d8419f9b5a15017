"""Hashed character n-grams of words, for the models that score words, and what their training shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkernel as K

_CODE = np.arange(256)
#: Letters of ASCII and all bytes of other characters; for ALNUM digits too.
LETTER = (_CODE >= 0x80) | ((_CODE | 0x20) >= 0x61) & ((_CODE | 0x20) <= 0x7A) & (_CODE >= 0x41)
ALNUM = LETTER | (_CODE >= 0x30) & (_CODE <= 0x39)


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and, after the byte 0xC3, of the accented Latin-1 letters."""
    out = K.LOWER[data]
    if len(out) > 1:
        accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][accented] += 0x20
    return out


def bare_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space without the signs before and after them; signs alone are no word."""
    starts, ends, counts = K.spans(data, offsets)
    inside = np.flatnonzero(ALNUM[data])
    if not len(starts) or not len(inside):
        return starts[:0], ends[:0], np.zeros_like(counts)
    a, b = np.searchsorted(inside, starts), np.searchsorted(inside, ends)
    has = b > a
    owner = np.repeat(np.arange(len(counts)), counts)[has]
    return inside[a[has]], inside[b[has] - 1] + 1, np.bincount(owner, minlength=len(counts))


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of one occurrence of each distinct word, and each word's number among them."""
    hashes, first, inverse = np.unique(K.word_hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
    return hashes, first, inverse


def grams(data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word between two marks, so that affixes are n-grams too, and of the whole word, by its hash; with each word's first place."""
    lengths = ends - starts
    padded = lengths + 2
    first = np.cumsum(padded) - padded
    text = np.zeros(int(padded.sum()), dtype=np.uint64)
    word = np.repeat(np.arange(len(starts)), padded)
    place = np.arange(len(text)) - first[word]
    body = (place > 0) & (place <= lengths[word])
    text[body] = data[(starts[word] + place - 1)[body]].astype(np.uint64) + np.uint64(1)
    text[~body] = 300
    left = padded[word] - place
    mask = np.uint64(buckets - 1)
    owners, found = [], []
    with np.errstate(over="ignore"):
        value = np.zeros(len(text), dtype=np.uint64)
        for n in range(1, max(sizes) + 1):
            shifted = np.zeros_like(text)
            shifted[: len(text) - n + 1] = text[n - 1 :]
            value = value * np.uint64(0x100000001B3) + shifted
            if n in sizes:
                ok = left >= n
                owners.append(word[ok])
                found.append(K.mix(value[ok] + np.uint64(n << 40)) & mask)
        owners.append(np.arange(len(starts)))
        found.append(K.mix(hashes + np.uint64(77)) & mask)
    owner, bucket = np.concatenate(owners), np.concatenate(found).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(starts)))


def _least_pass(most: int):
    """The `most` smallest hashes of each label in a task; labels and hashes are the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | int, np.ndarray] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            label = batch.column(0).dictionary_encode()
            number, hashes = label.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for k, name in enumerate(label.dictionary.to_pylist()):
                now = hashes[number == k]
                if name in held:
                    now = np.concatenate([held[name], now[now < held[name][-1]] if len(held[name]) >= most else now])
                held[name] = np.unique(now)[:most]
        if held:
            labels = [name for name, some in held.items() for _ in range(len(some))]
            yield pa.RecordBatch.from_arrays([pa.array(labels, kind), pa.array(np.concatenate(list(held.values())))], ["label", "hash"])

    return run


def chosen(rows: DataFrame, by: str, keys: list[str], most: int) -> DataFrame:
    """Rows of the `most` distinct `keys` with the smallest hashes of each value of `by`, whatever their number; their repeats too."""
    hashed = rows.withColumn("__hash", F.xxhash64(*keys))
    kind = rows.schema[by].dataType.simpleString()
    least = hashed.select(by, "__hash").mapInArrow(_least_pass(most), f"label {kind}, hash long").distinct()
    least = least.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("hash"))).where(F.col("n") <= most)
    limit = F.broadcast(least.groupBy("label").agg(F.max("hash").alias("__most")))
    return hashed.join(limit, hashed[by] == limit["label"]).where("__hash <= __most").select(rows.columns)


def sample(rows: DataFrame, by: str, most: int, chars: int) -> tuple[list[str], list]:
    """Whole texts of `rows` (by, doc_id, text) and their labels, to be learned from on the driver.

    Of each label `most` rows at most, repeated ones once, in the order of a hash
    of id and text, until their texts have `chars` characters; one row at least.
    """
    rows = rows.select(by, "doc_id", "text", F.xxhash64("doc_id", "text").alias("hash"))
    rows = rows.groupBy(by, "doc_id", "hash").agg(F.first("text").alias("text"))
    order = Window.partitionBy(by).orderBy("hash", "doc_id")
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    rows = rows.withColumn("chars", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("chars") <= chars) | (F.col("n") == 1))
    got = rows.select(by, "hash", "doc_id", "text").toArrow().sort_by([(k, "ascending") for k in (by, "hash", "doc_id")])
    return got["text"].to_pylist(), got[by].to_pylist()


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, chars: int) -> tuple[list[str], list[int]]:
    """sample() of the documents that are not held out and that `labels` marks 0 or 1 in the column `label`.

    Labels of documents that are not there, or have no text, are left out first, by
    their ids, so that it does not matter how many of these there are.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label))
    known = known.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~K.held_out(F.col("doc_id")))
    there = docs.where("doc_id is not null and text <> ''").select("doc_id").distinct()
    known = chosen(known.join(there, "doc_id", "left_semi"), label, ["doc_id"], most).distinct()
    return sample(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").where("text <> ''"), label, most, chars)
