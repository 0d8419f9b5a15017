"""Counts over entries: totals, levels, HTTP classes, addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X

LEVELS = ["DEBUG", "INFO", "WARN", "ERROR", "CRITICAL"]
COUNTERS = ["total_lines", *(f"count_{x.lower()}" for x in LEVELS), "count_4xx", "count_5xx"]
#: Stands for the most frequent address where there is none.
NO_IP = "-"


def counters() -> list[Column]:
    """Aggregates of COUNTERS over entries."""
    level, status = F.col("level"), F.col("http_status")
    out = [F.count("*").alias("total_lines"), *(F.count_if(level == x).alias(f"count_{x.lower()}") for x in LEVELS)]
    return [*out, F.count_if((status >= 400) & (status < 500)).alias("count_4xx"), F.count_if(status >= 500).alias("count_5xx")]


def _once(entries: DataFrame, *keys: str) -> DataFrame:
    """What counters() and the keys need, out of a generator: each counter would otherwise classify the line anew."""
    names = list(dict.fromkeys([*keys, "level", "http_status"]))
    return entries.select(F.explode(F.array(F.struct(*names))).alias("e")).select("e.*")


def summary(entries: DataFrame) -> DataFrame:
    """One row of COUNTERS; zeros for no entries.  5xx has no upper bound."""
    return _once(entries).agg(*counters())


def partial_summary(entries: DataFrame, *keys: str) -> DataFrame:
    """COUNTERS of each group, as merged() takes them."""
    return _once(entries, *keys).groupBy(*keys).agg(*counters())


def merged(parts: DataFrame) -> DataFrame:
    """The sum of partial counters."""
    return parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS))


def ip_counts(entries: DataFrame) -> DataFrame:
    """(ip, hits) of every address, exact and without a limit."""
    return entries.where(F.col("ip") != "").groupBy("ip").agg(F.count("*").alias("hits"))


def top_ips(entries: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent addresses; ties go to the smaller text."""
    return ip_counts(entries).orderBy(F.desc("hits"), F.asc("ip")).limit(k)


def top_ip(entries: DataFrame) -> DataFrame:
    """One row: the most frequent address, or NO_IP.  The maximum is found by partial aggregation."""
    best = ip_counts(entries).agg(F.min_by("ip", F.struct(-F.col("hits"), F.col("ip"))).alias("ip"))
    return best.select(F.coalesce("ip", F.lit(NO_IP)).alias("top_ip"))


def summary_and_ips(entries: DataFrame) -> DataFrame:
    """COUNTERS and the hits of each address from one scan: the row with a null ip has the counters of all entries, and no hits."""
    by_ip = partial_summary(entries, "ip")
    total = F.grouping_id()
    both = by_ip.rollup("ip").agg(*(F.sum(c).alias(c) for c in COUNTERS), total.alias("all_ips"))
    return both.where((F.col("all_ips") == 1) | (F.col("ip") != "")).withColumn("hits", F.when(F.col("all_ips") == 0, F.col("total_lines")).otherwise(0)).drop("all_ips")


def report_rows(entries: DataFrame, k: int = 10) -> DataFrame:
    """What a report shows, from one scan: summary_and_ips() in order, the counters of all entries first, then the k most frequent addresses, ties to the smaller text."""
    return summary_and_ips(entries).orderBy(F.col("ip").isNotNull(), F.desc("hits"), "ip").limit(k + 1)


def of_report(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """summary(), top_ip() and top_ips() out of report_rows()."""
    ips = rows.where("ip is not null").select("ip", "hits")
    best = ips.agg(F.min_by("ip", F.struct(-F.col("hits"), F.col("ip"))).alias("ip")).select(F.coalesce("ip", F.lit(NO_IP)).alias("top_ip"))
    return rows.where("ip is null").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS)), best, ips


def errors_4xx_5xx(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("count_4xx_5xx", F.col("count_4xx") + F.col("count_5xx"))


def progress(done: DataFrame, totals: DataFrame) -> DataFrame:
    """Per source and over all (source null): lines done, lines there, whole percent, errors."""
    both = totals.join(done, "source", "left").select("source", F.coalesce("done", F.lit(0)).alias("done"), "total", F.coalesce("errors", F.lit(0)).alias("errors"))
    every = both.agg(F.lit(None).cast("string").alias("source"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("done", "total", "errors")))
    return both.unionByName(every).withColumn("percent", X.percent(F.col("done"), F.col("total")))
