"""One scan, two outputs: entries, and the lines that no grammar takes, each with its reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.entries import sorted_out

ENTRIES, REJECTED = "entries", "rejected"


@dataclass
class Sorted:
    """What sort_out() wrote, and the counts that came with the writing: lines, entries, rejected."""

    entries: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def sort_out(lines: DataFrame, folder: str, mode: str = "full", lenient: bool = False, year: int | None = None, keep: tuple[str, ...] = ("source", "pos")) -> Sorted:
    """Writes lines as Parquet below `folder`: part=entries and part=rejected, over what was there.

    Each task writes both parts as it goes, without a shuffle; the counts are
    observed in the same job.  A part without rows is an empty table.
    """
    seen = Observation()
    rows = sorted_out(lines, mode, lenient, year, keep)
    rejected = F.col("reason").isNotNull()
    watched = rows.observe(seen, F.count("*").alias("lines"), F.count_if(~rejected).alias("entries"), F.count_if(rejected).alias("rejected"))
    watched.withColumn("part", F.when(rejected, REJECTED).otherwise(ENTRIES)).write.mode("overwrite").partitionBy("part").parquet(folder)
    written = lines.sparkSession.read.schema(rows.withColumn("part", F.lit("")).schema).parquet(folder)
    entries = written.where(F.col("part") == ENTRIES).drop("part", "reason", "value")
    return Sorted(entries, written.where(F.col("part") == REJECTED).select(*keep, "reason", "format", "value"), dict(seen.get))
