"""Periodic runs of words by the runs theorem.

Every maximal repetition of a word sequence has a root that is the longest
Lyndon word at its place, under some order of the words or under the reverse
order.  The longest Lyndon word at a place ends at the next smaller value of the
inverse suffix array, or for the reverse order at the next larger one.  Each such
root is extended to the right by the longest common prefix of two suffixes, and
to the left by the same on the reversed words; both are minima over a range of
the LCP array, by a sparse table.

Texts are worked on in groups of some megabyte, as arrays: suffixes are ordered
by prefix doubling, in which only suffixes that are not yet told apart are sorted
again.  No row is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3


class Suffixes:
    """Suffixes of several sequences in one array: their order, LCP array and the LCP of any two of one sequence.

    `letters` are whole numbers, none in two sequences, and `owner` tells the
    sequence of each.  A suffix ends with its sequence, and the end is smaller than
    every letter.
    """

    def __init__(self, letters: np.ndarray, owner: np.ndarray) -> None:
        n = len(letters)
        self.n = n
        order = np.argsort(letters)
        first = np.ones(n, dtype=bool)
        first[1:] = letters[order[1:]] != letters[order[:-1]]
        # the rank of a suffix is the place of the first one that is equal so far
        starts = np.flatnonzero(first)
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
        last = np.append(np.flatnonzero(np.diff(owner)) + 1, n)
        self.end = last[np.searchsorted(last, np.arange(n), side="right")] if n else np.zeros(0, np.int64)
        #: levels[k]: ranks by the first 2**k letters; -1 after the end
        self.levels = [np.append(rank, np.int32(-1))]
        equal = self._equal(rank)
        width = 1
        while len(equal):
            ahead = np.minimum(equal + width, n)
            ahead[equal + width >= self.end[equal]] = n
            key = rank[equal].astype(np.int64) * (n + 1) + self.levels[-1][ahead] + 1
            by = np.argsort(key, kind="stable")
            equal, key = equal[by], key[by]
            group = key // (n + 1)
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            head = np.ones(len(key), dtype=bool)
            head[1:] = group[1:] != group[:-1]
            at = np.arange(len(key))
            offset = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
            rank = rank.copy()
            rank[equal] = group + offset
            self.levels.append(np.append(rank, np.int32(-1)))
            # a suffix whose rank no other has is told apart
            alone = new & np.append(new[1:], True)
            equal = equal[~alone]
            width *= 2
        self.rank = rank
        self.table: list[np.ndarray] | None = None

    @staticmethod
    def _equal(rank: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1) if len(rank) else np.zeros(0, np.int64)

    def next_end(self, some: np.ndarray, greater: bool = False) -> np.ndarray:
        """For each suffix of `some` the place of the next one that is smaller (or greater), or its sequence's end: where the longest Lyndon word there ends."""
        value = -self.rank if greater else self.rank
        low = [np.append(value, np.iinfo(np.int32).min).astype(np.int32)]
        out = np.zeros(self.n, dtype=np.int64)
        out[some] = some + 1
        # windows of doubling width that hold no smaller value are passed over; then they are halved again
        active, turned = some, []
        while True:
            k = len(low) - 1
            inside = out[active] < self.end[active]
            active = active[inside]
            found = low[k][out[active]] < value[active]
            turned.append(active[found])
            active = active[~found]
            if not len(active):
                break
            out[active] += 1 << k
            wider = low[k].copy()
            half = 1 << k
            wider[:-half] = np.minimum(low[k][:-half], low[k][half:])
            low.append(wider)
        rest = np.zeros(0, np.int64)
        for k in range(len(turned) - 1, 0, -1):
            rest = np.concatenate([rest, turned[k]])
            ahead = low[k - 1][out[rest]] >= value[rest]
            out[rest[ahead]] += 1 << (k - 1)
        return np.minimum(out[some], self.end[some])

    def _lcp(self) -> np.ndarray:
        """LCP of each suffix in order with the one before it."""
        order = np.empty(self.n, dtype=np.int64)
        order[self.rank] = np.arange(self.n)
        a, b = order[:-1].copy(), order[1:].copy()
        out = np.zeros(self.n, dtype=np.int32)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            same = np.flatnonzero((level[a] == level[b]) & (level[a] >= 0))
            out[same + 1] += 1 << k
            for x in (a, b):
                x[same] = np.minimum(x[same] + (1 << k), self.n)
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """LCP of suffixes a and b, of one sequence each and different; by the least of the LCP array between them."""
        if self.table is None:
            self.table = [self._lcp()]
            while 2 << (len(self.table) - 1) <= self.n:
                half = 1 << (len(self.table) - 1)
                self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))
        x, y = self.rank[a].astype(np.int64), self.rank[b].astype(np.int64)
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(a), dtype=np.int64)
        for k in np.unique(level):
            some = np.flatnonzero(level == k)
            out[some] = np.minimum(self.table[k][low[some]], self.table[k][high[some] - (1 << int(k))])
        return out


def _repeating(letters: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Sequences in which some `width` letters, a power of two, stand at two places."""
    value, step = letters, 1
    with np.errstate(over="ignore"):
        while step < width and len(value) > step:
            value = K.mix(value[:-step] * np.uint64(3) + value[step:])
            step *= 2
    if step < width or not len(value):
        return owner[:0]
    at = np.flatnonzero(owner[: len(value)] == owner[width - 1 : width - 1 + len(value)])
    value = value[at]
    by = np.argsort(value)
    value = value[by]
    return np.unique(owner[at[by[1:][value[1:] == value[:-1]]]])


def runs(letters: np.ndarray, owner: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the sequences, in the order of start and period: at least `least_words` letters and `least_periods` (2 or more) periods long."""
    none = np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        letters = K.mix(letters.astype(np.uint64) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    # from the leftmost root of a run, so many letters come again after it at least
    p = np.arange(1, least_words + 1)
    width = 1 << int(np.maximum((least_periods - 2) * p + 1, least_words - 2 * p + 1).min()).bit_length() - 1
    inside = np.flatnonzero(np.isin(owner, _repeating(letters, owner, width)))
    if not len(inside):
        return none, none, none
    letters, owner = letters[inside], owner[inside]
    ahead = Suffixes(letters, owner)
    begin, period, after = [], [], []
    again = ahead.levels[min(width.bit_length(), len(ahead.levels)) - 1]
    shared = np.flatnonzero(np.bincount(again[:-1], minlength=len(letters))[again[:-1]] > 1)
    for greater in (False, True):
        stop = ahead.next_end(shared, greater)
        some = np.flatnonzero((stop < ahead.end[shared]) & (again[shared] == again[stop]))
        start, p = shared[some], (stop - shared)[some]
        reach = p + ahead.common(start, start + p)
        # the leftmost root begins in the run's first period, so what follows from there is less than a period short of the run
        ok = reach >= np.maximum(least_words, least_periods * p) - (p - 1)
        begin.append(start[ok])
        period.append(p[ok])
        after.append((start + reach)[ok])
    start, p, stop = np.concatenate(begin), np.concatenate(period), np.concatenate(after)
    if not len(start):
        return none, none, none
    # roots of one run share its end and period, and no two runs share both: the leftmost root is extended to the left
    by = np.lexsort((start, p, stop))
    start, p, stop = start[by], p[by], stop[by]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (stop[1:] != stop[:-1]) | (p[1:] != p[:-1])
    start, p, stop = start[new], p[new], stop[new]
    held = np.flatnonzero(np.isin(owner, owner[start]))
    place = np.zeros(len(letters), dtype=np.int64)
    place[held] = len(held) - 1 - np.arange(len(held))
    behind = Suffixes(letters[held][::-1], owner[held][::-1])
    opens = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    first = opens[np.searchsorted(opens, start, side="right") - 1]
    some = np.flatnonzero(start > first)
    left = np.zeros(len(start), dtype=np.int64)
    left[some] = behind.common(place[start[some] - 1], place[start[some] + p[some] - 1])
    start = start - left
    keep = stop - start >= np.maximum(least_words, least_periods * p)
    start, p, stop = start[keep], p[keep], stop[keep]
    by = np.lexsort((p, start))
    return inside[start[by]], inside[start[by]] + (stop - start)[by], p[by]


def folded(n: int, doc_id: int | None) -> np.ndarray:
    """The words that stand at 0 to n - 1 when each tenth document, by the crc32 of its number, repeats a part of itself to its end."""
    at = np.arange(n)
    if doc_id is None or not n:
        return at
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return at
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(at >= a, a + (at - a) % p, at)


def _run_pass(fold: bool, least_words: int, least_periods: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, 1):
                data, offsets = K.buffers(part.column(1))
                starts, ends, counts = K.spans(data, offsets)
                hashes = K.word_hashes(data, starts, ends, lower=False) if len(starts) else np.zeros(0, np.uint64)
                ids = part.column(0).to_pylist()
                first = np.cumsum(counts) - counts
                source = np.arange(len(hashes))
                if fold:
                    for k, doc_id in enumerate(ids):
                        source[first[k] : first[k] + counts[k]] = first[k] + folded(int(counts[k]), doc_id)
                owner = np.repeat(np.arange(len(ids)), counts)
                start, stop, period = runs(hashes[source], owner, least_words, least_periods)
                # words that some run holds after its first period
                drop = np.zeros(len(hashes) + 1, dtype=np.int32)
                np.add.at(drop, start + period, 1)
                np.add.at(drop, stop, -1)
                kept = np.cumsum(drop[:-1]) == 0
                begins = np.searchsorted(start, np.append(first, len(hashes)))
                raw = data.tobytes()
                found, texts = [], []
                for k in range(len(ids)):
                    a, b = begins[k], begins[k + 1]
                    base, end = int(first[k]), int(first[k] + counts[k])
                    found.append([{"start": s - base, "length": e - s, "period": p} for s, e, p in zip(start[a:b].tolist(), stop[a:b].tolist(), period[a:b].tolist())])
                    words = raw[offsets[k] : offsets[k + 1]].split()
                    at = source[base:end]
                    if a < b or (fold and end > base and at[-1] != end - 1):
                        words = [words[i] for i in (at[kept[base:end]] - base).tolist()]
                    texts.append(b" ".join(words).decode("utf-8", "replace"))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: bool = False, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, runs (array of start, length, period in words, by start, then period) and collapsed, the text without the repetitions.

    Words are runs of other characters than space and TAB to CR, and are told
    apart by 64-bit hashes.  A run is a stretch with smallest period p, of at least
    `least_words` words and `least_periods` (2 or more) periods, that no word beside
    it extends.  collapsed holds the words, joined by one space, that no run holds
    after its first period.  With fold, every tenth document by its number first
    repeats a part of itself (see folded()).  A null or empty text or one without
    words has no runs and an empty collapsed text; a row without an id is not
    folded; repeated rows each give a row.  Other columns are not read.

    A text needs some 8 * log2(its longest repetition) bytes a word in its task.
    """
    if least_periods < 2:
        raise ValueError("a run has two periods at least")
    docs = K.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_run_pass(fold, least_words, least_periods), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def most_periodic(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """Of runs (start, length, period) that with the most periods, by exact fractions; ties go to the smaller start, then period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold=True)
    # a / b > c / d as a * d > c * b, so that no fraction is rounded
    more = "CASE WHEN best IS NULL OR r.length * best.period > best.length * r.period THEN r ELSE best END"
    best = F.expr(f"aggregate(runs, CAST(NULL AS struct<start: bigint, length: bigint, period: bigint>), (best, r) -> {more})")
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
