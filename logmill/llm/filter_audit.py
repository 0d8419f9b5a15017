"""Interaction audit of document filters by inclusion and exclusion.

Each document has a flag for each filter that it fails.  One aggregation counts,
for all 32 sets of the five filters, the documents that fail every filter of the
set: sums of products of flags, as are those of documents of good quality and of
toxic ones.  Everything else follows from these counts for each part, whatever
its size.  Signed sums over subsets (Moebius inversion) give the survivors of any
set of filters, and so what each filter removes and finds removed in any order,
and what it alone fails; and each set's joint failures with a sign are the
Harsanyi dividend of the game "documents removed", which shared equally among the
set's filters give their Shapley values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

#: Filters in the order of their bits: few words, few different ones, capitals, signs, copies.
FILTERS = "ABCDE"
_SETS = 1 << len(FILTERS)
#: Numbers of all orders; shares of a dividend among up to five filters are whole parts of it.
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def _bytes(*codes: int) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(codes)] = True
    return out


#: Bytes of capitals, of the signs that D looks for, and those inside a character.
_CAPITAL, _SIGN, _INSIDE = _bytes(*range(0x41, 0x5B)), _bytes(*b"#$%&*|"), _bytes(*range(0x80, 0xC0))


def flags(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Whether each text fails each filter but the last, which needs all texts."""
    starts, ends, words = K.spans(data, offsets)
    hashes = K.word_hashes(data, starts, ends, lower=False) if len(starts) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(words)), words)
    with np.errstate(over="ignore"):
        hashes = K.mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    by = np.argsort(hashes)
    hashes = hashes[by]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    different = np.bincount(owner[by[new]], minlength=len(words))

    def count(kind: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(kind[data]), offsets))

    return {"A": words < 100, "B": 100 * different < 80 * words, "C": 100 * count(_CAPITAL) > 10 * (np.diff(offsets) - count(_INSIDE)), "D": count(_SIGN) > 0}


def _flag_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch, 2):
            data, offsets = K.buffers(part.column(2))
            raw = memoryview(data)
            digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.binary()), *map(pa.array, flags(data, offsets).values())], ["doc_id", "part", "digest", *FILTERS[:-1]])


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, A to E, good, toxic, n): what equal rows of `docs` fail, with their labels; n rows each.

    Texts are not shuffled: they count as equal by their sha256.  A copy is found by
    the smallest id of each text, which is joined by text and id, so that copies of
    one text are spread over all tasks.
    """
    rows = K.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(_flag_pass, "doc_id long, part string, digest binary, " + ", ".join(f"{f} boolean" for f in FILTERS[:-1]))
    # repeated rows become one before anything joins by their id
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.col(mark).cast("int") == 1).alias(name) for name, mark in (("good", "quality"), ("toxic", "toxic"))))
    joined = rows.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    no = F.lit(False)
    return joined.select("doc_id", "part", *FILTERS[:-1], copy.alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "n")


def _members(s: int) -> list[str]:
    return [f for k, f in enumerate(FILTERS) if s >> k & 1]


def joint_failures(rows: DataFrame) -> DataFrame:
    """(part, failing, failing_good, failing_toxic): for each part how many documents fail all filters of each set, in arrays by the set's bits."""
    bits = {f: F.col(f).cast("long") for f in FILTERS}
    weights = {"failing": F.col("n"), "failing_good": F.col("n") * F.col("good").cast("long"), "failing_toxic": F.col("n") * F.col("toxic").cast("long")}
    sums = []
    for name, weight in weights.items():
        for s in range(_SETS):
            product = weight
            for f in _members(s):
                product = product * bits[f]
            sums.append(F.sum(product).alias(f"{name}_{s}"))
    counted = rows.groupBy("part").agg(*sums)
    return counted.select("part", *(F.array(*(f"{name}_{s}" for s in range(_SETS))).alias(name) for name in weights))


def _survivors(failing: str) -> str:
    """SQL of an array by sets: documents that fail no filter of the set, the signed sum over its subsets."""
    return f"transform(sequence(0, {_SETS - 1}), t -> aggregate(sequence(0, {_SETS - 1}), 0L, (total, s) -> total + IF(s & ~t = 0, IF(bit_count(s) % 2 = 0, {failing}[s], -{failing}[s]), 0L)))"


def _of_filter(f: str, share: bool) -> Column:
    """Over the sets that hold f, the sum of their dividends; with `share`, of f's parts in them, times the number of orders."""
    total = F.lit(0).cast("long")
    for size in range(1, len(FILTERS) + 1):
        for some in combinations(FILTERS, size):
            if f in some:
                dividend = F.col("failing")[sum(1 << FILTERS.index(x) for x in some)] * (1 if size % 2 else -1)
                total = total + (dividend * (len(ORDERS) // size) if share else dividend)
    return total


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of the five filters and step in it: part, filter_order, step (from 1), kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A text fails A with under 100 words (runs of other characters than space and
    TAB to CR), B if under 80 % of its words are different, C if over 10 % of its
    characters are A to Z, D if it holds any of #$%&*|, and E if its text is that
    of a smaller id in the whole table.  Of the step's filter, `redundant` counts
    documents that fail it and were removed earlier, `unique_fails` those that fail
    no other, and `shapley` what it removes in all orders together; good_lost and
    toxic_lost those removed here with quality or toxic 1 in `labels` (doc_id,
    quality, toxic), where any of several labels of a document counts.

    Words of a text are told apart by 64-bit hashes.  A null text is empty, a null part is the empty string.  Each row counts as a
    document: repeated rows fail alike.  A row without an id has no label, is no
    copy and makes no other row one.  An empty table gives no rows.  Other columns
    are not read.
    """
    counts = joint_failures(failures(docs, labels, id_col, text_col, part_col))
    by_filter = {f: F.struct(F.col("failing")[1 << k].alias("fails"), _of_filter(f, False).alias("unique_fails"), _of_filter(f, True).alias("shapley")) for k, f in enumerate(FILTERS)}
    known = counts.select("part", *(F.expr(_survivors(f"failing{x}")).alias(f"kept{x}") for x in ("", "_good", "_toxic")), F.array(*by_filter.values()).alias("filters"))
    steps = known.select("*", F.explode(F.lit(ORDERS)).alias("filter_order")).select("*", F.explode(F.expr(f"sequence(1, {len(FILTERS)})")).alias("step"))
    number = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    before = sum((F.when(earlier.contains(f), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumns({"number": number, "before": before}).withColumn("after", F.col("before").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("number"))))
    gone = lambda x: F.col(f"kept{x}")[F.col("before")] - F.col(f"kept{x}")[F.col("after")]
    mine = F.col("filters")[F.col("number")]
    return steps.select("part", "filter_order", "step", F.col("kept")[F.col("after")].alias("kept"), gone("").alias("removed"), (mine["fails"] - gone("")).alias("redundant"), mine["unique_fails"].alias("unique_fails"), gone("_good").alias("good_lost"), gone("_toxic").alias("toxic_lost"), mine["shapley"].alias("shapley"))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Applies each order to the documents themselves, without inclusion and exclusion.
ORACLE_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM texts),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
flagged AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  concat(CASE WHEN len(words) < 100 THEN 'A' ELSE '' END,
    CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END,
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM worded LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flagged GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, CASE WHEN step = 1 THEN '' ELSE filter_order[1:step - 1] END AS earlier FROM orders, range(1, 6) AS t(step)),
met AS (SELECT part, filter_order, step, f, n, good, toxic, fails,
  contains(fails, f) AS fails_it, earlier <> '' AND regexp_matches(fails, concat('[', earlier, '_]')) AS gone FROM cells, steps),
audited AS (SELECT part, filter_order, step, f,
  sum(CASE WHEN NOT gone AND NOT fails_it THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails_it THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN gone AND fails_it THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN NOT gone AND fails_it THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails_it THEN toxic ELSE 0 END) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM audited
"""
