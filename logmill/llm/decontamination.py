"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Pairs of neighbouring words of each test item are counted over all documents,
and its rarest ones become seeds: so many that an alignment which reaches the
threshold must keep a few of them (pigeonhole).  In a document a pair may have
one word between, so that inserted words do not break it.  Documents' pairs that
may be seeds are joined with the table of seeds; where a document holds as many
seeds of an item as it must, and close enough to each other, the passage around
them is aligned with the item word by word (Smith-Waterman with a linear gap).
So the pairs found are those of aligning every document with every item, however
the copy was edited.  Of short items, of which an alignment need not keep any pair,
the rarest words are seeds, by the same pigeonhole over words.

All documents are read three times, whatever the number of items: to count, to
find seeds, and, only those with candidates, to align.  What is sent to all tasks
are bit tables of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from . import wordmodel as M

#: Least score of an alignment against that of the whole item, to count as a copy.
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
#: Items of which fewer matching words reach the threshold have words as seeds.
LEAST_WORDS = 4
#: The work of an alignment against that of a seed found.
ALIGN_WORK = 5000.0
#: Seeds that stand so often among this many words of the documents are joined in SALTS parts; so there are few of them.
HOT_WORDS, SALTS = 10_000, 16


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the bare lower-case words, words of each text, and the words' places."""
    data, offsets = K.buffers(texts)
    data = M.lowered(data)
    starts, ends, counts = M.bare_spans(data, offsets)
    hashes = K.word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return hashes, counts, starts, ends, offsets


def _keys(hashes: np.ndarray, counts: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of pairs of words up to `far` apart, the text of each and the place of its first word."""
    owner = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        keys, places = [K.mix(hashes + np.uint64(2))], [np.arange(len(hashes))]
        for d in range(1, far + 1):
            at = np.flatnonzero(owner[d:] == owner[:-d])
            keys.append(K.mix(hashes[at] * np.uint64(3) + hashes[at + d] + np.uint64(1)))
            places.append(at)
    place = np.concatenate(places)
    return np.concatenate(keys), owner[place], place


def _item_pass(threshold: float):
    """Words of each item, and its seeds-to-be with how often each stands in it; of short items their words, of others their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts, *_ = _hashed(batch.column(2))
            keys, owner, _ = _keys(hashes, counts, 1)
            short = threshold * counts < LEAST_WORDS
            keep = short[owner] == (np.arange(len(keys)) < len(hashes))
            by = np.lexsort((keys[keep], owner[keep]))
            keys, owner = keys[keep][by], owner[keep][by]
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(keys)))
            sizes = np.bincount(owner[at], minlength=len(counts))
            lists = [K.lists(pa.array(x), n) for x, n in ((hashes.view(np.int64), counts), (keys[at].view(np.int64), sizes), (times, sizes))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists[0], pa.array(short), lists[1], lists[2]], ["item", "item_id", "words", "short", "keys", "times"])

    return run


def _count_pass(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = 0
        for batch in batches:
            for part in K.slices(batch, 0):
                hashes, counts, *_ = _hashed(part.column(0))
                words += len(hashes)
                keys = _keys(hashes, counts, 2)[0].view(np.int64)
                keys, n = np.unique(keys[K.falls_on(bits, keys)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])
        # the number of all words has no key
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([words], pa.int64())], ["key", "n"])

    return run


def least_kept(n: int, least: float) -> int:
    """Fewest of an item's n - 1 pairs of neighbouring words that an alignment with a score of `least` keeps.

    Of M matches, two neighbours of the item are both matched, and lie next to
    each other in the document or one word apart, unless a word of the item
    between is not matched (at least one off the score, and one word less to
    match) or two words or more of the document lie between (two off).
    """
    m = np.arange(max(1, int(np.ceil(least / MATCH - 1e-9))), n + 1)
    slack = np.floor(MATCH * m - least + 1e-9)
    lost = np.minimum(n - m, slack)
    return int((m - 1 - lost - (slack - lost) // 2).min())


def _seed_pass(total: int, threshold: float):
    """The rarest keys of each item, how many of them a document must hold, and within how many words.

    If all but c places of the item hold seeds, `kept` - c seeds at least are
    kept.  Of the numbers of seeds for which that is positive, the one of the
    least expected work is taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, np.ndarray, np.ndarray, int, int]] = []
        for batch in batches:
            for item, size, short, keys in zip(*(c.to_pylist() for c in batch.columns)):
                key, times, n = np.array([[k["key"], k["times"], k["n"]] for k in keys], dtype=np.int64).T
                order = np.lexsort((key, n))
                key, times, n = key[order], times[order], n[order]
                least = MATCH * threshold * size
                span = int(3 * size - least) + 2
                kept = int(np.ceil(least / MATCH - 1e-9)) if short else least_kept(size, least)
                must = np.maximum(kept, 1) - (times.sum() - np.cumsum(times))
                rate = np.cumsum(n) / total
                # Chernoff's bound of as many seeds again near a seed
                near, more = rate * span, np.maximum(must - 1, 0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    tail = np.where(more > near, np.exp(np.minimum(0, more - near + more * np.log(near / np.maximum(more, 1)))), 1.0)
                k = int(np.where(must > 0, rate * (1 + ALIGN_WORK * tail), np.inf).argmin())
                out.append((item, key[: k + 1], n[: k + 1], int(must[k]), span))
            # seeds that no document holds count above, and need not be looked for
            rows = [(item, k, c, need, span) for item, key, n, need, span in out for k, c in zip(key.tolist(), n.tolist()) if c]
            out.clear()
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "key", "n", "need", "span"])

    return run


def _hit_pass(bits: np.ndarray, hot: np.ndarray):
    """Places of the documents' keys that may be seeds; those of repeated rows once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            once = []
            for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key not in seen:
                    seen.add(key)
                    once.append(k)
            for part in K.slices(batch.take(pa.array(once, pa.int64())), 2):
                hashes, counts, *_ = _hashed(part.column(2))
                keys, owner, place = _keys(hashes, counts, 2)
                keys = keys.view(np.int64)
                at = np.flatnonzero(K.falls_on(bits, keys))
                keys, owner, place = keys[at], owner[at], (place - (np.cumsum(counts) - counts)[owner])[at]
                digest = part.column(1).to_numpy(zero_copy_only=False)[owner]
                salt = np.where(np.isin(keys, hot), digest & (SALTS - 1), 0)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(digest), pa.array(keys), pa.array(salt), pa.array(place)], ["doc_id", "text_hash", "key", "salt", "place"])

    return run


def _near_pass():
    """Of the places of an item's seeds in a document those that lie close enough to enough others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, keep = [], []
            for k, (need, span, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3, 6)))):
                at = np.unique(np.array(at, dtype=np.int64))
                n = len(at) - need + 1
                first = np.flatnonzero(at[need - 1 :] - at[:n] <= span) if n > 0 else []
                if len(first):
                    inside = np.zeros(len(at) + 1, dtype=np.int64)
                    np.add.at(inside, first, 1)
                    np.add.at(inside, first + need, -1)
                    places.append(at[np.cumsum(inside[:-1]) > 0].tolist())
                    keep.append(k)
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(places, pa.list_(pa.int64()))], ["item", "doc_id", "text_hash", "places"])

    return run


def align(passage: np.ndarray, item: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment score, and begin and end in `passage`; ties go to the first end."""
    m = len(passage)
    score, origin = np.zeros(m + 1), np.arange(m + 1)
    best, span = 0.0, (0, 0)
    place = np.arange(m + 1)
    for word in item:
        diagonal = np.concatenate([[0.0], score[:-1] + np.where(passage == word, MATCH, MISMATCH)])
        came = np.concatenate([[0], origin[:-1]])
        down = score + GAP
        take = down > diagonal
        now, came = np.where(take, down, diagonal), np.where(take, origin, came)
        fresh = now <= 0
        now, came = np.where(fresh, 0.0, now), np.where(fresh, place, came)
        # gaps along the row: the best earlier cell less a gap for each step
        lifted = now - GAP * place
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted >= top, place, 0))
        score, origin = top + GAP * place, came[source]
        k = int(score.argmax())
        if score[k] > best:
            best, span = float(score[k]), (int(origin[k]), k)
    return best, *span


def _windows(at: np.ndarray, reach: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Passages between `first` and `last` that lie within reach of the places, run together where they meet."""
    for group in np.split(at, np.flatnonzero(np.diff(at) > 2 * reach) + 1):
        yield max(int(group[0]) - reach, first), min(int(group[-1]) + reach, last)


def _bound(passage: np.ndarray, words: np.ndarray) -> float:
    """No alignment of the passage scores more than this: that of its best run if each word of the item matched wherever it stands."""
    run = np.concatenate([[0.0], np.cumsum(np.where(np.isin(passage, words), MATCH, -1.0))])
    return float((run - np.minimum.accumulate(run)).max())


def _align_pass(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, 1):
                hashes, counts, starts, ends, offsets = _hashed(part.column(1))
                first = np.cumsum(counts) - counts
                rows: list[tuple] = []
                memory: dict[tuple[int, bytes], tuple[float, int, int]] = {}
                for d, candidates in enumerate(part.column(2)):
                    for c in candidates:
                        item, words, places = c["item"].as_py(), np.asarray(c["words"].values).view(np.uint64), np.asarray(c["places"].values)
                        least, top = MATCH * threshold * len(words), (0.0, 0, 0)
                        # an alignment that reaches the threshold is no longer than this
                        reach = int(3 * len(words) - least) + 2
                        for begin, end in _windows(places + first[d], reach, int(first[d]), int(first[d] + counts[d])):
                            passage = hashes[begin:end]
                            key = (item, passage.tobytes())
                            if key not in memory:
                                memory[key] = align(passage, words) if _bound(passage, words) >= least - 1e-6 else (0.0, 0, 0)
                            score, x, y = memory[key]
                            if score > top[0]:
                                top = (score, begin + x, begin + y)
                        share = top[0] / (MATCH * len(words))
                        if share >= threshold and top[2] > top[1]:
                            rows.append((part.column(0)[d].as_py(), c["item_id"].as_py(), share, len(places), int(starts[top[1]] - offsets[d]), int(ends[top[2] - 1] - offsets[d]), part.column(3)[d].as_py()))
                columns = list(zip(*rows)) if rows else [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "score", "seeds", "begin", "end", "text_hash"])

    return run


def _holdings(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, threshold: float) -> DataFrame:
    """What contaminated() returns, and the hash of each row's text."""
    docs = K.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text <> ''")
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null and text <> ''").distinct()
    items = K.saved(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInArrow(_item_pass(threshold), "item long, item_id long, words array<long>, short boolean, keys array<long>, times array<long>").where("size(keys) > 0"))
    keys = items.select("item", F.posexplode("keys").alias("k", "key"), "times").select("item", "key", F.col("times")[F.col("k")].alias("times"))

    counts = docs.select("text").mapInArrow(_count_pass(K.maybe(keys.select("key").distinct(), "key")), "key long, n long")
    counts = K.saved(counts.groupBy("key").agg(F.sum("n").alias("n")))
    total = max(1, counts.where("key is null").agg(F.sum("n")).first()[0] or 0)
    counted = keys.join(counts, "key", "left").groupBy("item").agg(F.collect_list(F.struct("key", "times", F.coalesce("n", F.lit(0)).alias("n"))).alias("keys"))
    seeds = items.select("item", F.size("words").alias("n"), "short").join(counted, "item").select("item", "n", "short", "keys")
    seeds = K.saved(seeds.mapInArrow(_seed_pass(total, threshold), "item long, key long, n long, need long, span long"))

    # a key that has 1 of HOT_WORDS words: at most 3 * HOT_WORDS of them, as a word begins three keys
    hot = np.array([r["key"] for r in seeds.where(F.col("n") * HOT_WORDS > total).select("key").distinct().collect()], dtype=np.int64)
    hits = docs.mapInArrow(_hit_pass(K.maybe(seeds.select("key").distinct(), "key", room=128), hot), "doc_id long, text_hash long, key long, salt long, place long")
    salts = F.when(F.col("n") * HOT_WORDS > total, F.expr(f"sequence(0L, {SALTS - 1}L)")).otherwise(F.expr("array(0L)"))
    found = hits.join(seeds.select("item", "key", "need", "span", F.explode(salts).alias("salt")), ["key", "salt"])
    found = found.groupBy("item", "doc_id", "text_hash").agg(F.first("need").alias("need"), F.first("span").alias("span"), F.collect_set("place").alias("places")).where("size(places) >= need")
    near = K.saved(found.mapInArrow(_near_pass(), "item long, doc_id long, text_hash long, places array<long>"))

    # an item that very many documents hold is joined in parts
    parts = items.select("item", "item_id", "words", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    candidates = near.withColumn("salt", F.col("text_hash").bitwiseAND(F.lit(SALTS - 1).cast("long"))).join(parts, ["item", "salt"]).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item", "item_id", "words", "places")).alias("candidates"))
    some = K.falling(docs, "text_hash", K.maybe(near.select("text_hash").distinct(), "text_hash", room=128))
    some = some.join(candidates, ["doc_id", "text_hash"]).select("doc_id", "text", "candidates", "text_hash")
    return some.mapInArrow(_align_pass(threshold), "doc_id long, item_id long, score double, seeds long, begin long, end long, text_hash long")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of documents and benchmark items that they hold: doc_id, item_id, score, seeds, begin, end.

    Words are parted at white space, without the signs around them, in lower
    case.  score is the best alignment's share of a whole copy's (1: verbatim) and
    is at least `threshold`; begin and end are the byte positions of the aligned
    passage, and seeds is how many places of the document with seeds of the item
    led to it.  All pairs that reach the threshold are found, of items of any number
    of words: so at 0.5 an item of two words is held where one of them stands.
    Documents or items that are null, empty or without words match nothing.  Repeated
    document rows each give their rows; repeated items give theirs once.  A row of
    either table without an id is not compared.  Other columns are not read.
    """
    return K.written(lambda: _holdings(docs, benchmark, id_col, text_col, item_id_col, item_text_col, threshold).drop("text_hash"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs` that hold no benchmark item, whatever their other columns' names.

    Rows without an id stay, as do null and empty texts; repeated rows stay or go
    together, and a row of another text under the same id is judged by its own.
    """
    bad = K.written(lambda: _holdings(docs, benchmark, id_col, text_col, item_id_col, item_text_col, threshold).select("doc_id", "text_hash").distinct())
    return K.without(docs, id_col, bad.select(F.col("doc_id").alias("marked_id"), F.col("text_hash").alias("marked_text"), F.lit(True).alias("goes")), text_col)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
