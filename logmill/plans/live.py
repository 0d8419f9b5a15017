"""Progress of a batch while its one job runs.

The lines are read once.  Between parsing and counting they pass a tap that adds
each task's bytes, lines and errors to an accumulator of the driver; a thread there
sets these against the sizes in the folder's listing, and the tasks that are done
against those of the job.  What is shown moves as tasks end, and is an estimate: a
task that runs twice counts twice, and the share is then held at 100.  The results,
and the rows of final(), come from the job itself and are exact.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import AccumulatorParam
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import metrics
from ..operators.entries import sorted_out
from ..sources.files import LINE_BYTES, NoLogs, source_lines
from ..sources.logsource import RANGE, listed
from . import report

#: Most files with a bar of their own; of more, only the sum is shown and kept.
MOST_BARS = 64
#: Tasks a core, so that the bars move, and bytes that a task has at least.
TASKS, LEAST = 8, 1 << 20
_SUMS = ("done", "lines", "errors")


class _Sums(AccumulatorParam):
    """File name to its sums of _SUMS."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        for name, sums in b.items():
            a[name] = tuple(map(sum, zip(a.get(name, (0,) * len(_SUMS)), sums)))
        return a


@dataclass
class Snapshot:
    """Rows as dashboard() takes them (source null: all files; done and total in bytes), tasks done and planned, seconds since the start."""

    rows: list[dict] = field(default_factory=list)
    tasks_done: int = 0
    tasks: int = 0
    seconds: float = 0.0


def _row(source: str | None, done: int, total: int, lines: int, errors: int, ended: bool) -> dict:
    done = total if ended else min(done, total)
    return {"source": source, "done": done, "total": total, "percent": done * 100 // total if total else 100, "lines": lines, "errors": errors}


def _snapshot(sizes: dict[str, int], seen: dict[str, tuple], tasks: tuple[int, int], began: float, ended: bool) -> Snapshot:
    rows = [_row(n, *(seen.get(n, (0, 0, 0))[:1]), size, *seen.get(n, (0, 0, 0))[1:], ended) for n, size in sizes.items()] if len(sizes) <= MOST_BARS else []
    every = [sum(s[k] for s in seen.values()) for k in range(len(_SUMS))]
    rows.append(_row(None, every[0], sum(sizes.values()), every[1], every[2], ended))
    return Snapshot(rows, *tasks, time.monotonic() - began)


def _tapped(rows: DataFrame, sums, by_file: bool) -> DataFrame:
    """rows as they are; on the way each Arrow batch is added up."""

    def tap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.table({"source": batch.column("source"), "done": batch.column("bytes"), "lines": pa.repeat(1, batch.num_rows), "errors": batch.column("error").cast(pa.int64())})
            got = t.group_by("source").aggregate([(c, "sum") for c in _SUMS]).to_pylist()
            for g in got:
                sums.add({g["source"].rpartition("/")[2] if by_file else "": tuple(g[f"{c}_sum"] or 0 for c in _SUMS)})
            yield batch

    return rows.mapInArrow(tap, rows.schema)


def _tasks(spark: SparkSession, group: str) -> tuple[int, int]:
    """Tasks done and planned in the stages that a job group has begun."""
    tracker = spark.sparkContext.statusTracker()
    infos = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    stages = [tracker.getStageInfo(s) for i in infos if i for s in i.stageIds]
    return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)


def run(
    spark: SparkSession,
    path: str,
    folder: str,
    mode: str = "full",
    lenient: bool = False,
    year: int | None = None,
    partitions: int | None = None,
    show: Callable[[Snapshot], None] | None = None,
    every: float = 0.5,
    lines: DataFrame | None = None,
) -> DataFrame:
    """Counters of a folder's lines by file and address, written to `folder`: source, ip, lines, entries, errors and COUNTERS.

    show gets a Snapshot about every `every` seconds, and one at the end whose sums
    were observed by the job itself; an error in it ends the showing while the job
    runs, not the job.  Lines that do not parse and entries of other modes count as
    lines only.  `lines` (source, pos, first, value) stands in for the files' own
    lines.  No file, or no folder, is NoLogs.
    """
    bits = X.mode_bits(mode)
    sizes = listed(path)
    if not sizes:
        raise NoLogs(path)
    context = spark.sparkContext
    if lines is None:
        size = max(LEAST, min(RANGE, sum(sizes.values()) // (TASKS * context.defaultParallelism)))
        options = {"workers": str(partitions)} if partitions else {"range": str(size)}
        lines = source_lines(spark, path, line="0", **options)
    lines = lines.withColumn("bytes", F.octet_length("value").cast("long") + 1).withColumn("value", X.first_bytes(F.col("value"), LINE_BYTES))
    rows = sorted_out(lines, "full", lenient, year, keep=("source", "bytes", "event_types"))
    wanted = F.col("reason").isNull() & (F.lit(bits == X.MODES["full"]) | (F.col("event_types").bitwiseAND(bits) != 0))
    error = F.coalesce(F.col("level").isin("ERROR", "CRITICAL"), F.lit(False))
    rows = rows.select("source", "bytes", F.coalesce(wanted, F.lit(False)).alias("entry"), error.alias("error"), "level", "http_status", "ip")
    sums = context.accumulator({}, _Sums())
    tapped = _tapped(rows, sums, len(sizes) <= MOST_BARS)
    entry = F.col("entry")
    # what is no entry of the mode counts as a line only
    counted = tapped.select("source", "entry", (entry & F.col("error")).alias("error"), *(F.when(entry, F.col(c)).alias(c) for c in ("level", "http_status", "ip")))
    seen = Observation()
    counted = counted.observe(seen, F.count("*").alias("lines"), F.count_if(entry).alias("entries"), F.count_if("error").alias("errors"))
    made = counted.groupBy("source", "ip").agg(F.count("*").alias("lines"), F.count_if(entry).alias("entries"), F.count_if("error").alias("errors"), F.count_if(entry).alias("total_lines"), *metrics.counters()[1:])
    group, began, ended = f"logmill-{uuid.uuid4().hex}", time.monotonic(), threading.Event()

    def watch() -> None:
        while not ended.wait(every):
            show(_snapshot(sizes, dict(sums.value), _tasks(spark, group), began, False))

    before = context.getLocalProperty("spark.jobGroup.id"), context.getLocalProperty("spark.job.description")
    thread = threading.Thread(target=watch, daemon=True) if show else None
    context.setJobGroup(group, f"counting {path}")
    try:
        if thread:
            thread.start()
        made.write.mode("overwrite").parquet(folder)
    finally:
        ended.set()
        if thread:
            thread.join()
        context.setLocalProperty("spark.jobGroup.id", before[0])
        context.setLocalProperty("spark.job.description", before[1])
    if show:
        last = _snapshot(sizes, dict(sums.value), _tasks(spark, group), began, True)
        # the sum is the job's own, whatever tasks ran twice
        last.rows[-1] |= {k: seen.get[k] for k in ("lines", "errors")}
        show(last)
    return spark.read.parquet(folder)


def final(made: DataFrame) -> DataFrame:
    """(source, lines, entries, errors, percent) of each file with lines and of all (source null), from what run() wrote."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("lines", "entries", "errors")]
    by_file = made.groupBy("source").agg(*sums)
    every = by_file.agg(F.lit(None).cast("string").alias("source"), *sums)
    return by_file.unionByName(every).withColumn("percent", F.lit(100))


def text(made: DataFrame, mode: str = "full", layout: str = "prodcons", k: int = 10) -> str:
    """The report, from what run() wrote."""
    values = metrics.merged(made).first().asDict()
    hits = made.where("ip <> ''").groupBy("ip").agg(F.sum("entries").alias("hits"))
    ips = [tuple(r) for r in hits.orderBy(F.desc("hits"), "ip").limit(k).collect()]
    return report.text(layout, mode.lower(), values, ips[0][0] if ips else metrics.NO_IP, ips)
