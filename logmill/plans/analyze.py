"""Analysis of a directory: entries, counters, addresses and the report."""

from __future__ import annotations

import argparse
import logging
import sys
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import mode_bits
from ..operators import metrics
from ..operators.entries import entries
from ..sources.files import NoLogs, line_counts, log_files, read_logs
from ..sources.scratch import scratch_folder
from . import live, report
from .quarantine import sort_out

log = logging.getLogger(__name__)


@dataclass
class Result:
    mode: str
    entries: DataFrame
    metrics: DataFrame
    top_ips: DataFrame

    def text(self, layout: str = "prodcons") -> str:
        """The report: counters and addresses, a few rows, come to the driver from one scan of the lines."""
        rows = [r.asDict() for r in metrics.report_rows(self.entries).collect()]
        values = next((r for r in rows if r["ip"] is None), dict.fromkeys(metrics.COUNTERS, 0))
        ips = [(r["ip"], r["hits"]) for r in rows if r["ip"] is not None]
        return report.text(layout, self.mode, values, ips[0][0] if ips else metrics.NO_IP, ips)


def analyze_lines(lines: DataFrame, mode: str = "full", strict: bool = True, year: int | None = None, sources: int | None = None) -> Result:
    mode_bits(mode)
    found = entries(lines, mode, not strict, year, sources=sources)
    return Result(mode.lower(), found, metrics.summary(found), metrics.top_ips(found))


def analyze(spark: SparkSession, path: str, mode: str = "full", strict: bool = True, year: int | None = None, partitions: int | None = None) -> Result:
    """Result for a directory's log files.  strict keeps the reading of formats by each file's first line; see entries()."""
    if partitions is not None and partitions < 1:
        raise ValueError("partitions must be at least 1")
    mode_bits(mode)
    log.info("reading %s in mode %s", path, mode)
    return analyze_lines(read_logs(spark, path, partitions), mode, strict, year, len(log_files(spark, path)))


def progress(spark: SparkSession, path: str, mode: str = "full") -> DataFrame:
    """Lines done against lines there, whole percent and errors of each file and of all; counts the lines once more."""
    done = entries(read_logs(spark, path), mode).groupBy("source").agg(F.count("*").alias("done"), F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("errors"))
    return metrics.progress(done, line_counts(spark, path))


def dashboard(rows: list[dict], seconds: float) -> str:
    """A bar of 20 signs, percent and errors for each source, the sum and the time taken."""
    out = []
    for r in sorted(rows, key=lambda r: (r["source"] is None, r["source"] or "")):
        name = "Total" if r["source"] is None else r["source"].rpartition("/")[2]
        full = r["percent"] // 5
        out.append(f"{name}: [{'#' * full}{' ' * (20 - full)}] {r['percent']:3d}% ({r['done']}/{r['total']}) errors {r['errors']}")
    s = int(seconds)
    return "\n".join([*out, f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}", ""])


def bar(snapshot: live.Snapshot) -> str:
    """One line: the sum of all files as in dashboard(), and the tasks that are done."""
    r = snapshot.rows[-1]
    full = r["percent"] // 5
    return f"[{'#' * full}{' ' * (20 - full)}] {r['percent']:3d}% {r['lines']} lines, errors {r['errors']}, tasks {snapshot.tasks_done}/{snapshot.tasks}"


def main(args: list[str] | None = None) -> int:
    """Command line: directory, mode, layout, and where the report goes."""
    p = argparse.ArgumentParser(prog="logmill", description="Counts, levels and addresses of a directory of logs")
    p.add_argument("directory")
    p.add_argument("mode", help="security, performance, traffic or full, in any case")
    p.add_argument("--layout", choices=sorted(report.TITLES), default="prodcons")
    p.add_argument("--workers", type=int, help="tasks to spread the lines over; by default by file size")
    p.add_argument("--lenient", action="store_true", help="detect the format line by line, read users and agents")
    p.add_argument("--year", type=int, help="year of syslog times")
    p.add_argument("--output", help="file for the report")
    p.add_argument("--parquet", help="folder for the entries")
    p.add_argument("--quarantine", help="folder for entries and rejected lines, each with its reason")
    p.add_argument("--progress", action="store_true", help="a bar while the lines are counted, and one for each file at the end")
    p.add_argument("--verbose", action="store_true")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)
    began = time.monotonic()
    try:
        mode_bits(a.mode)
        if a.workers is not None and a.workers < 1:
            raise ValueError("--workers must be at least 1")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("logmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        result = analyze(spark, a.directory, a.mode, not a.lenient, a.year, a.workers)
    except FileNotFoundError:
        print(f"no such directory: {a.directory}", file=sys.stderr)
        return 1
    except NoLogs:
        print(f"no log files in {a.directory}")
        return 0
    if a.parquet:
        result.entries.write.mode("overwrite").parquet(a.parquet)
    if a.quarantine:
        sorted_ = sort_out(read_logs(spark, a.directory, a.workers), a.quarantine, a.mode, a.lenient, a.year)
        print(", ".join(f"{name} {n}" for name, n in sorted_.counts.items()), file=sys.stderr)
    if not a.progress:
        report.emit(result.text(a.layout), a.output)
        return 0
    # the watched job counts by file and address; report and last bars come from its few rows
    made = live.run(spark, a.directory, scratch_folder(spark), a.mode, a.lenient, a.year, a.workers, lambda s: print("\r" + bar(s), end="", file=sys.stderr, flush=True))
    print(file=sys.stderr)
    report.emit(live.text(made, a.mode, a.layout), a.output)
    rows = [r.asDict() | {"done": r["lines"], "total": r["lines"]} for r in live.final(made).collect()]
    print(dashboard(rows, time.monotonic() - began))
    return 0
