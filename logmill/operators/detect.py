"""Format detection: of a line, and of a source by its first line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .parse import APACHE

#: Sources whose formats are broadcast if there are known to be no more: some 100 bytes each.
MOST_BROADCAST = 1_000_000
FORMATS = ["UNKNOWN", "APACHE", "JSON", "SYSLOG", "NGINX_ERROR"]


def format_of(line: Column, lenient: bool = False) -> Column:
    """Format of a line.  JSON takes what no other test does; lenient calls that UNKNOWN unless it begins with a brace, and sees `<priority>` as syslog."""
    long_as = lambda n: F.octet_length(line) > n
    out = F.when(line.isNull() | (line == ""), "UNKNOWN").when(line.startswith("{"), "JSON")
    out = out.when(long_as(20) & line.rlike("^[0-9]{4}/"), "NGINX_ERROR")
    out = out.when(long_as(15) & line.rlike("^[A-Za-z]{3} [0-9 ]"), "SYSLOG")
    if lenient:
        out = out.when(line.rlike("^<[0-9]+>"), "SYSLOG")
    out = out.when(line.rlike(r"^[0-9]*\.[0-9]*\.[0-9]*\.[0-9]* "), "APACHE").when(line.rlike(APACHE), "APACHE")
    return out.otherwise("UNKNOWN" if lenient else "JSON")


def source_formats(lines: DataFrame, lenient: bool = False) -> DataFrame:
    """(source, format): that of the first line, in the order of pos, of each source.

    pos is a number, or a struct of a split's begin and a number inside it.  The
    format's number stands in the low bits of the line's, so that the first line
    of each split is found by hash aggregation of a long, without a sort.
    """
    split = isinstance(lines.schema["pos"].dataType, T.StructType)
    block, seq = (F.col("pos.block_start"), F.col("pos.seq")) if split else (F.lit(0).cast("long"), F.col("pos"))
    form = format_of(F.col("value"), lenient)
    code = F.array_position(F.array(*map(F.lit, FORMATS)), form) - 1
    by_block = lines.groupBy("source", block.alias("block")).agg(F.min(seq.cast("long") * 8 + code).alias("first"))
    first = by_block.groupBy("source").agg(F.min(F.struct("block", "first")).alias("x"))
    return first.select("source", F.element_at(F.array(*map(F.lit, FORMATS)), (F.pmod(F.col("x.first"), F.lit(8)) + 1).cast("int")).alias("format"))


def with_sticky_format(lines: DataFrame, lenient: bool = False, sources: int | None = None) -> DataFrame:
    """lines with the format of their source.

    Where each line comes with its source's first one (`first`), no other line is
    asked.  Otherwise one row per source joins.  Where the caller knows that there are at most
    `sources` of them, and that is within MOST_BROADCAST, these rows are broadcast;
    otherwise Spark chooses by their size.
    """
    if "first" in lines.columns:
        return lines.withColumn("format", format_of(F.col("first"), lenient)).drop("first")
    formats = source_formats(lines, lenient)
    few = sources is not None and sources <= MOST_BROADCAST
    return lines.join(F.broadcast(formats) if few else formats, "source")


def with_line_format(lines: DataFrame, lenient: bool = True) -> DataFrame:
    """lines with the format of each by itself."""
    return lines.withColumn("format", format_of(F.col("value"), lenient))
