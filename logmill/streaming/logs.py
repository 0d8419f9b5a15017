"""Logs as a stream of arriving files.

Each line comes with its file's first one, so the format of a file holds in every
batch, also where the file grows from one batch to the next.  Each batch writes
its counters under its number, over what an earlier try left, so that totals
count every line once.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators import metrics
from ..operators.entries import entries
from ..sources.files import NAMES, located
from ..sources.logsource import register

log = logging.getLogger(__name__)
_TEXT = T.StructType([T.StructField("value", T.StringType())])
_COUNTS = T.StructType([T.StructField("ip", T.StringType()), *(T.StructField(c, T.LongType()) for c in metrics.COUNTERS)])


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Text of arriving log files with their file metadata, by Spark's own source, which leaves out names that begin with `_` or a dot; at most so many files a batch."""
    return spark.readStream.schema(_TEXT).option("pathGlobFilter", NAMES).option("maxFilesPerTrigger", files_per_batch).text(path).select("*", "_metadata")


def growing_lines(spark: SparkSession, path: str, state: str, files_per_batch: int = 0, tail: bool = False) -> DataFrame:
    """(source, pos, first, value) of a folder's log files, whatever their names begin with, read on where they grow.

    No folder yet, or an empty one, gives no lines.  With `tail` a last line
    without an end waits until it has one; otherwise it counts as it is, and what
    is written to its end later is no line of its own.
    """
    options = {"folder": path, "planned": f"{state}/planned.json", "files": str(files_per_batch), "tail": str(tail)}
    return spark.readStream.format(register(spark)).options(**options).load()


def start(spark: SparkSession, path: str, state: str, mode: str = "full", lenient: bool = False, files_per_batch: int = 100, continuous: bool = False, follow: bool = True) -> StreamingQuery:
    """Counts arriving lines into `state`; ends when all that is there is read, or with `continuous` goes on with what is new.

    By default files of all names are read, as in a batch, and those that grow are
    read on; what is there at the start of a run that ends is then one batch.
    follow=False takes Spark's own source of whole files, also for stores that only
    Spark's readers can open.  A state keeps to the source that it began with.
    """

    def batch(lines: DataFrame, number: int) -> None:
        found = entries(lines if follow else located(lines), mode, lenient, keep=(), sources=files_per_batch)
        # counters of each address: both the totals and the address counts add up from these
        found.groupBy("ip").agg(*metrics.counters()).write.mode("overwrite").parquet(f"{state}/counts/batch={number}")

    lines = growing_lines(spark, path, state, files_per_batch if continuous else 0, continuous) if follow else stream_lines(spark, path, files_per_batch)
    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/checkpoint")
    return (writer if continuous else writer.trigger(availableNow=True)).start()


def _counts(spark: SparkSession, state: str) -> DataFrame:
    """Counters of each batch and address; no rows before the first batch."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/counts")
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(_COUNTS).parquet(f"{state}/counts") if there else spark.createDataFrame([], _COUNTS)


def totals(spark: SparkSession, state: str) -> DataFrame:
    """COUNTERS over all batches so far; zeros before the first."""
    return metrics.merged(_counts(spark, state))


def ip_totals(spark: SparkSession, state: str) -> DataFrame:
    """(ip, hits) over all batches so far."""
    return _counts(spark, state).where("ip <> ''").groupBy("ip").agg(F.sum("total_lines").alias("hits"))


def run(spark: SparkSession, path: str, state: str, mode: str = "full", lenient: bool = False, files_per_batch: int = 100, follow: bool = True) -> DataFrame:
    """COUNTERS of all files that are there, read as a stream; zeros where none is."""
    start(spark, path, state, mode, lenient, files_per_batch, follow=follow).awaitTermination()
    return totals(spark, state)


class ProgressLog(StreamingQueryListener):
    """Logs each batch's number, lines and rate; add it with spark.streams.addListener(ProgressLog())."""

    def onQueryStarted(self, event) -> None:
        log.info("stream %s started", event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        log.info("batch %s: %s lines, %.0f a second", p.batchId, p.numInputRows, p.processedRowsPerSecond or 0)

    def onQueryIdle(self, event) -> None:
        log.debug("stream %s waits for files", event.id)

    def onQueryTerminated(self, event) -> None:
        log.info("stream %s ended", event.id)
