"""Line dedup over levelled sorted runs of line hashes.

The hashes of lines that were seen are kept as runs: tables bucketed and sorted by
hash.  A batch of documents is merge-anti-joined with every run, which leaves the
lines that no earlier batch holds; these become a run of the lowest level.  When a
level has as many runs as it may, they are merged into one of the next, so the
runs stay few.  As runs are bucketed alike, a batch is shuffled once, however many
runs it meets, and the runs not at all.

dedup_batch() drops from new documents what earlier ones hold.  dedup_lines()
drops lines of a whole table that are found in several documents: it first counts
lines, then takes the documents in batches from the largest ids down, so that the
batch in which a line is new is that of its largest document, where it stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K

#: Characters that a line's key does not begin or end with.
BLANK = " \t\n\v\f\r"
#: Batches that dedup_lines() makes, and runs of a level that are merged into one of the next.
BATCHES, FANOUT = 4, 3
#: Lines up to which those to drop are told to all tasks: 24 bytes each.
MOST_TOLD = 1 << 20
#: A line with more than 1 of HOT_PAIRS of all pairs of line and document is joined in SALTS parts; so there are few of them.
HOT_PAIRS, SALTS = 1_000, 16
_KEY = ["h1", "h2"]
_RUN = "h1 long, h2 long, doc_id long"


class LineRuns:
    """Runs of line hashes (h1, h2, doc_id) in a folder, each line in one run, with the document that keeps it.

    A folder that holds runs is opened with them.  A run counts from the moment it
    is written whole; a merge that was cut off leaves its parts beside it, which
    does not change what lines are held.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: Level, path and table of each run.
        self.runs: list[tuple[int, str, str]] = []
        at = self._path(folder)
        if self._store(at).exists(at):
            for found in self._store(at).listStatus(at):
                # run-LEVEL-BUCKETS-NAME
                _, level, buckets, name = found.getPath().getName().split("-")
                if self._store(at).exists(self._path(f"{folder}/{found.getPath().getName()}/_SUCCESS")):
                    path, table = f"{folder}/{found.getPath().getName()}", f"line_run_{uuid.uuid4().hex}"
                    spark.sql(f"CREATE TABLE {table} (h1 BIGINT, h2 BIGINT, doc_id BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {buckets} BUCKETS LOCATION '{path}'")
                    self.runs.append((int(level), path, table))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _store(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write(self, keys: DataFrame, level: int) -> None:
        name = uuid.uuid4().hex
        path, table = f"{self.folder}/run-{level}-{self.buckets}-{name}", f"line_run_{name}"
        keys.select("h1", "h2", "doc_id").repartition(self.buckets, *_KEY).write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).format("parquet").option("path", path).saveAsTable(table)
        self.runs.append((level, path, table))

    def fresh(self, keys: DataFrame) -> DataFrame:
        """Those of `keys` (h1, h2, doc_id; each line once) that no run holds."""
        for _, _, table in self.runs:
            keys = keys.join(self.spark.table(table).select(*_KEY).hint("merge"), _KEY, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Adds a run of lines that are in none, and merges full levels."""
        self._write(keys, 0)
        level = 0
        while len(full := [r for r in self.runs if r[0] == level]) >= self.fanout:
            self._write(self._union(full).groupBy(*_KEY).agg(F.max("doc_id").alias("doc_id")), level + 1)
            for run in full:
                self._drop(run)
            level += 1

    def held(self) -> DataFrame:
        """(h1, h2, doc_id) of all runs."""
        return self._union(self.runs) if self.runs else self.spark.createDataFrame([], _RUN)

    def _union(self, runs: list[tuple[int, str, str]]) -> DataFrame:
        out = self.spark.table(runs[0][2])
        for _, _, table in runs[1:]:
            out = out.unionByName(self.spark.table(table))
        return out

    def _drop(self, run: tuple[int, str, str]) -> None:
        self.runs.remove(run)
        self.spark.sql(f"DROP TABLE IF EXISTS {run[2]}")
        at = self._path(run[1])
        self._store(at).delete(at, True)

    def delete(self) -> None:
        """Deletes all runs."""
        for run in list(self.runs):
            self._drop(run)


def _hashed(texts: pa.Array, least_chars: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of the texts, how many each has, and of the lines with long keys their places and two hashes of the key."""
    texts = texts.cast(pa.large_string()).fill_null("")
    parts = pc.split_pattern(texts, "\n")
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = parts.flatten()
    keys = pc.ascii_lower(pc.ascii_trim(lines, BLANK))
    long = pc.greater_equal(pc.utf8_length(keys), least_chars)
    data, offsets = K.buffers(keys.filter(long))
    at = np.flatnonzero(long.to_numpy(zero_copy_only=False))
    if not len(at):
        return lines, counts, at, np.zeros(0, np.int64), np.zeros(0, np.int64)
    # bytes under another code give a hash of its own
    h1, h2 = (K.word_hashes(d, offsets[:-1], offsets[1:], lower=False).view(np.int64) for d in (data, data ^ np.uint8(0x55)))
    return lines, counts, at, h1, h2


def _key_pass(least_chars: int, bits: np.ndarray | None = None):
    """Distinct long lines of each row with an id; with bits those that fall on one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            for part in K.slices(batch, 1):
                _, counts, at, h1, h2 = _hashed(part.column(1), least_chars)
                row = np.repeat(np.arange(len(counts)), counts)[at]
                if bits is not None:
                    some = np.flatnonzero(K.falls_on(bits, h1))
                    row, h1, h2 = row[some], h1[some], h2[some]
                by = np.lexsort((h2, h1, row))
                row, h1, h2 = row[by], h1[by], h2[by]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                ids = part.column(0).to_numpy(zero_copy_only=False)[row[new]]
                yield pa.RecordBatch.from_arrays([pa.array(h1[new]), pa.array(h2[new]), pa.array(ids, pa.int64())], ["h1", "h2", "doc_id"])

    return run


def _found(h1: np.ndarray, h2: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Place of each line in a table sorted by both hashes, or -1."""
    out = np.full(len(h1), -1)
    at = np.searchsorted(table[0], h1)
    rest = np.arange(len(h1))
    while len(rest):
        # mostly once: lines with the same first hash stand one after the other
        rest = rest[at[rest] < len(table[0])]
        rest = rest[table[0][at[rest]] == h1[rest]]
        hit = table[1][at[rest]] == h2[rest]
        out[rest[hit]] = at[rest[hit]]
        rest = rest[~hit]
        at[rest] += 1
    return out


def _drop_pass(least_chars: int, told: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
    """Texts without the lines that are told, but for their own documents, or without those of each row's third column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, 1):
                lines, counts, at, h1, h2 = _hashed(part.column(1), least_chars)
                row = np.repeat(np.arange(len(counts)), counts)
                drop = np.zeros(len(row), dtype=bool)
                if told is not None:
                    found = _found(h1, h2, told)
                    some = np.flatnonzero(found >= 0)
                    ids = part.column(0)
                    has, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
                    owner = row[at[some]]
                    drop[at[some]] = has[owner] & (ids[owner] != told[2][found[some]])
                elif part.num_columns > 2:
                    mine = part.column(2)
                    edges = np.searchsorted(at, np.append(0, np.cumsum(counts)))
                    for k in np.flatnonzero(mine.is_valid().to_numpy(zero_copy_only=False)):
                        a, b = edges[k], edges[k + 1]
                        pairs = mine[k].values
                        x, y = (pairs.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                        by = np.lexsort((y, x))
                        drop[at[a:b]] = _found(h1[a:b], h2[a:b], (x[by], y[by])) >= 0
                kept = np.bincount(row[~drop], minlength=len(counts))
                texts = pc.binary_join(K.lists(lines.filter(pa.array(~drop)).cast(pa.string()), kept), "\n")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.array(counts - kept), texts], ["doc_id", "n_lines", "n_dropped", "text"])

    return run


_OUT = "doc_id long, n_lines long, n_dropped long, text string"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return K.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _without(rows: DataFrame, pairs: DataFrame, least_chars: int) -> DataFrame:
    """rows without the lines of `pairs` (h1, h2, doc_id); only rows with a line to drop are shuffled."""
    lists = K.saved(pairs.groupBy("doc_id").agg(F.collect_set(F.struct(*_KEY)).alias("lines")).withColumnRenamed("doc_id", "dropping"))
    bits = K.maybe(lists, "dropping")
    some = K.falling(rows, "doc_id", bits).join(lists, F.col("doc_id") == F.col("dropping"), "left").select("doc_id", "text", "lines")
    straight = K.falling(rows, "doc_id", bits, hit=False)
    return some.mapInArrow(_drop_pass(least_chars, None), _OUT).unionByName(straight.mapInArrow(_drop_pass(least_chars, None), _OUT))


def dedup_batch(runs: LineRuns, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40) -> DataFrame:
    """Rows of `docs` without the long lines that `runs` holds from earlier batches: doc_id, n_lines, n_dropped, text; adds its own lines to the runs.

    Of a line that several of these documents hold and no run does, the one with
    the largest id keeps it.  Lines, keys and odd rows are as in dedup_lines().
    """
    rows = _rows(docs, id_col, text_col)
    keys = K.saved(rows.mapInArrow(_key_pass(least_chars), _RUN).distinct())
    fresh = K.saved(runs.fresh(keys.groupBy(*_KEY).agg(F.max("doc_id").alias("doc_id"))))
    out = _without(rows, keys.join(fresh, [*_KEY, "doc_id"], "left_anti"), least_chars)
    runs.add(fresh)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 5, least_chars: int = 40, batches: int = BATCHES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines (before), n_dropped, text without the dropped lines.

    A text is parted at each line feed; a null or empty one is one empty line.  A
    line's key is the line without blanks (space and TAB to CR) at its ends, A-Z
    in lower case, and counts if it has `least_chars` characters; keys are told
    apart by 128 bits of hash.  A key that `least_docs` ids or more hold loses its
    lines but in the largest of these ids.  Repeated rows, and rows that share an
    id, count as one document and are dropped from alike.  A row without an id
    counts as none and keeps its lines.  An empty table gives no rows.  Other
    columns are not read.

    Texts are read three times: to count lines, to find the documents of those
    that are frequent, and to drop lines.  Where more than MOST_TOLD lines are
    frequent, they are joined by document instead of told to all tasks.
    """
    rows = _rows(docs, id_col, text_col)
    counted = rows.mapInArrow(_key_pass(least_chars), _RUN).groupBy(*_KEY).agg(F.count("*").alias("n"))
    often = K.saved(counted.where(F.col("n") >= least_docs).select("h1"))
    # lines that fall on no frequent one's slot are left out; repeated rows count once
    pairs = K.saved(rows.mapInArrow(_key_pass(least_chars, K.maybe(often, "h1")), _RUN).distinct())
    frequent = K.saved(pairs.groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") >= least_docs))
    edges = pairs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] or []
    runs = LineRuns(rows.sparkSession, K.new_folder(rows.sparkSession))
    bounds = [None, *sorted(set(edges), reverse=True), None]
    for above, least in zip(bounds[:-1], bounds[1:]):
        some = pairs
        some = some if above is None else some.where(F.col("doc_id") < above)
        some = some if least is None else some.where(F.col("doc_id") >= least)
        # each line once, so no hot line is gathered by the merge
        own = some.groupBy(*_KEY).agg(F.max("doc_id").alias("doc_id")).join(frequent.select(*_KEY).hint("merge"), _KEY, "left_semi")
        runs.add(runs.fresh(own))
    held = K.saved(runs.held())
    runs.delete()
    if held.count() <= MOST_TOLD:
        told = held.toArrow().sort_by([(c, "ascending") for c in _KEY])
        K.dropped(often, pairs, frequent, held)
        return rows.mapInArrow(_drop_pass(least_chars, tuple(told[c].to_numpy() for c in ("h1", "h2", "doc_id"))), _OUT)
    total = frequent.agg(F.sum("n")).first()[0]
    hot = [r["h1"] for r in frequent.where(F.col("n") * HOT_PAIRS > total).select("h1").distinct().collect()]
    salts = lambda own: F.when(F.col("h1").isin(hot), own).otherwise(F.lit(0))
    parted = held.withColumnRenamed("doc_id", "keeper").withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})"))).where((F.col("salt") == 0) | F.col("h1").isin(hot))
    drops = pairs.withColumn("salt", salts(F.pmod(F.hash("doc_id"), F.lit(SALTS)))).join(parted, [*_KEY, "salt"]).where(F.col("doc_id") != F.col("keeper"))
    return _without(rows, drops.select(*_KEY, "doc_id"), least_chars)


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS place FROM texts),
keyed AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM numbered),
frequent AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, line, place, coalesce(doc_id <> keeper, false) AS gone FROM keyed LEFT JOIN frequent USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
