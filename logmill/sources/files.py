"""Directories of log files as lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import first_bytes
from .logsource import LINE as LINE_BYTES
from .logsource import register

#: Names that are read: something before the suffix, top level only.
NAMES = "?*.log"


class NoLogs(Exception):
    """The directory has no file to read."""


def log_files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the directory's log files, by Hadoop's listing; FileNotFoundError for no directory, NoLogs for no file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at) or not store.getFileStatus(at).isDirectory():
        raise FileNotFoundError(path)
    found = [s for s in store.listStatus(at) if s.isFile()]
    names = [s.getPath().toString() for s in found if (n := s.getPath().getName()).endswith(".log") and len(n) > 4]
    if not names:
        raise NoLogs(path)
    return sorted(names)


def clean_lines(lines: DataFrame) -> DataFrame:
    """Without empty lines, and each line's first LINE_BYTES bytes."""
    return lines.where("value <> ''").withColumn("value", first_bytes(F.col("value"), LINE_BYTES))


def located(lines: DataFrame, whole: bool = False) -> DataFrame:
    """(source, pos, value), or with `whole` without a cut, of what Spark's text reader gives: pos orders the lines of a source, whatever splits it was read in."""
    pos = F.struct(F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("seq"))
    source = "source" if "source" in lines.columns else F.col("_metadata.file_path").alias("source")
    lines = lines.select(source, pos.alias("pos"), "value")
    return lines.where("value <> ''") if whole else clean_lines(lines)


def _hidden(names: list[str]) -> list[str]:
    """Names that Spark's own readers leave out."""
    return [n for n in (name.rpartition("/")[2] for name in names) if n[0] in "._"]


def source_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(source, pos, first, value) by the data source of logsource.py, with its options."""
    return spark.read.format(register(spark)).options(folder=path, **options).load()


def read_logs(spark: SparkSession, path: str, partitions: int | None = None, whole: bool = False) -> DataFrame:
    """Lines of a directory's log files: (source, pos, value), and `first`, the file's first line, where `partitions` is given.

    Lines end at LF, CR or CRLF; empty ones are left out, and others cut at
    LINE_BYTES unless `whole`.  Splits follow the files' sizes, or with `partitions`
    are dealt to so many tasks by their bytes; neither shuffles.  Spark's own reader
    leaves out files whose names begin with `_` or a dot: these come from the data
    source of logsource.py, as all do with `partitions`.
    """
    names = log_files(spark, path)
    line = "0" if whole else str(LINE_BYTES)
    if partitions:
        return source_lines(spark, path, workers=str(partitions), line=line)
    hidden = _hidden(names)
    out = None
    if len(hidden) < len(names):
        out = located(spark.read.option("pathGlobFilter", NAMES).text(path).select("*", "_metadata", F.col("_metadata.file_path").alias("source")), whole)
    if hidden:
        above = names[0].rpartition("/")[0]
        more = source_lines(spark, path, names=json.dumps(hidden), line=line)
        pos = F.struct(F.lit(0).cast("long").alias("block_start"), F.col("pos").alias("seq"))
        more = more.select(F.concat(F.lit(above), F.regexp_extract("source", "(/[^/]*)$", 1)).alias("source"), pos.alias("pos"), "value")
        out = more if out is None else out.unionByName(more)
    return out


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """(source, total): line ends (LF) in each file, so that a last line without one does not count; a file without lines has no row."""
    names = log_files(spark, path)
    hidden, out = _hidden(names), None
    if len(hidden) < len(names):
        lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", NAMES).text(path)
        lines = lines.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_size").alias("size"), F.octet_length("value").alias("n"))
        counts = lines.groupBy("source").agg(F.count("*").alias("lines"), F.sum(F.col("n") + 1).alias("bytes"), F.first("size").alias("size"))
        out = counts.select("source", (F.col("lines") - (F.col("bytes") > F.col("size")).cast("int")).cast("long").alias("total"))
    if hidden:
        above = names[0].rpartition("/")[0]
        counts = spark.read.format(register(spark)).options(folder=path, names=json.dumps(hidden), count="true").load()
        counts = counts.groupBy("source").agg(F.sum("total").alias("total"))
        counts = counts.select(F.concat(F.lit(above), F.regexp_extract("source", "(/[^/]*)$", 1)).alias("source"), "total")
        out = counts if out is None else out.unionByName(counts)
    return out
