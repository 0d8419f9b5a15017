"""Log files as a data source of Spark: every name, byte ranges without a shuffle, and streams that follow growing files.

`spark.read.format("logfiles")` and `spark.readStream.format("logfiles")` give the
lines of a folder's files, whatever their names begin with: source, pos (byte at
which the line begins), first (the file's first line that is not empty) and value.
With the first line beside it, a line's format is known without a join, in any
split and any batch.

A batch is parted into ranges of bytes, or into as many tasks as `workers` says,
the longest ranges first to the task with the least.  A stream keeps one offset for
each file: the bytes that were read.  A file that grows is read on from there.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "logfiles"
SCHEMA = "source string, pos long, first string, value string"
COUNTS = "source string, total long"
#: Bytes read at once, bytes of a range, and bytes of a line that are kept.
CHUNK, RANGE, LINE = 1 << 22, 128 << 20, 511
#: Options: folder; names (JSON list; all log files if not given); workers; range (bytes); line (bytes kept, 0: all);
#: count (true: the line feeds of each range instead of lines); tail (true: a last line without an end waits for it); files (most new files a batch); planned (file for the last planned offset).
_LF, _CR = b"\n", b"\r"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; local without a scheme."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/") if colon or path.startswith("/") else path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def listed(folder: str) -> dict[str, int]:
    """Names and sizes of the log files at the top of a folder; none if there is no folder yet."""
    store, at = store_of(folder)
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return {f.base_name: f.size for f in found if f.type == fs.FileType.File and f.base_name.endswith(".log") and len(f.base_name) > 4}


class Ranges(InputPartition):
    """Ranges (name, begin, end) of a task."""

    def __init__(self, ranges: list[tuple[str, int, int]]) -> None:
        self.ranges = ranges


def planned(wanted: list[tuple[str, int, int]], size: int, workers: int = 0) -> list[Ranges]:
    """Tasks for ranges of files: each of about `size` bytes, or so many tasks of about the same number of bytes."""
    total = sum(end - begin for _, begin, end in wanted)
    step = max(1, min(size, -(-total // workers))) if workers else size
    parts = [(name, at, min(at + step, end)) for name, begin, end in wanted for at in range(begin, end, step)]
    parts.sort(key=lambda p: p[1] - p[2])
    bins: list[list[tuple[str, int, int]]] = []
    # the least filled task gets the longest of what is left; without a number of tasks, one is opened where none has room
    heap: list[tuple[int, int]] = []
    for part in parts:
        n = part[2] - part[1]
        if heap and (len(bins) >= workers > 0 or not workers and heap[0][0] + n <= size):
            held, k = heapq.heappop(heap)
        else:
            held, k = 0, len(bins)
            bins.append([])
        bins[k].append(part)
        heapq.heappush(heap, (held + n, k))
    return [Ranges(sorted(b)) for b in bins]


def first_line(file: pa.NativeFile, line: int) -> bytes:
    """The first line that is not empty."""
    file.seek(0)
    held = b""
    while chunk := file.read(1 << 16):
        held = (held + chunk.replace(_CR, _LF)).lstrip(_LF)
        if _LF in held or line and len(held) > line:
            break
    head = held.split(_LF, 1)[0]
    return head[:line] if line else head


def _lines(data: bytes, at: int, line: int) -> tuple[pa.Array, pa.Array]:
    """Places and texts of the lines of whole lines' bytes; empty ones are left out."""
    lines = pc.split_pattern(pa.array([data], pa.large_binary()), _LF).flatten()
    sizes = pc.binary_length(lines)
    places = pc.add(pc.subtract(pc.cumulative_sum(pc.add(sizes, 1)), pc.add(sizes, 1)), at)
    some = pc.greater(sizes, 0)
    lines, places = lines.filter(some), places.filter(some)
    return places, pc.binary_slice(lines, 0, line) if line else lines


def _text(values: pa.Array) -> pa.Array:
    """Bytes as text as they are, as Spark's own reader does."""
    return pc.cast(values, options=pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True))


def range_lines(file: pa.NativeFile, begin: int, end: int, line: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Lines that begin in a range of bytes, also where they end behind it."""
    file.seek(max(0, begin - 1))
    at, held = begin, b""
    if begin:
        # the line around the range's begin is that of the range before
        before = file.read(1).replace(_CR, _LF)
        while before and before[-1:] != _LF:
            before = file.read(CHUNK).replace(_CR, _LF)
            cut = before.find(_LF)
            if cut >= 0:
                held, at = before[cut + 1 :], at + cut + 1
                break
            at += len(before)
    while at < end:
        chunk = file.read(CHUNK).replace(_CR, _LF)
        held += chunk
        # lines that begin in the range: up to the first line end at its last byte or behind it
        stop = held.find(_LF, max(0, end - 1 - at)) if at + len(held) >= end else -1
        if stop < 0 and chunk:
            stop = held.rfind(_LF, 0, max(0, end - at))
            if stop < 0:
                continue
        data = held if stop < 0 else held[:stop]
        if data:
            yield _lines(data, at, line)
        if stop < 0:
            return
        held, at = held[stop + 1 :], at + stop + 1


class _Reading:
    """What the readers of batches and streams share."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["folder"].rstrip("/")
        self.names = set(json.loads(options["names"])) if "names" in options else None
        self.workers, self.range, self.line = int(options.get("workers", 0)), int(options.get("range", RANGE)), int(options.get("line", LINE))
        self.count = options.get("count", "false").lower() == "true"
        self.tail = options.get("tail", "false").lower() == "true"
        self.files, self.plan = int(options.get("files", 0)), options.get("planned")

    def sizes(self) -> dict[str, int]:
        return {name: size for name, size in sorted(listed(self.folder).items()) if self.names is None or name in self.names}

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, at = store_of(self.folder)
        for name, begin, end in partition.ranges:
            try:
                file = store.open_input_file(f"{at}/{name}")
            except OSError:
                # one that is gone or may not be read is passed over
                continue
            with file:
                if self.count:
                    file.seek(begin)
                    n = 0
                    for low in range(begin, end, CHUNK):
                        n += file.read(min(CHUNK, end - low)).count(_LF)
                    yield pa.RecordBatch.from_arrays([pa.array([f"{self.folder}/{name}"]), pa.array([n])], ["source", "total"])
                    continue
                first = _text(pa.array([first_line(file, self.line)], pa.binary()))
                for places, values in range_lines(file, begin, end, self.line):
                    for k in range(0, len(values), 20_000):
                        part = values.slice(k, 20_000)
                        n = len(part)
                        yield pa.RecordBatch.from_arrays([pa.repeat(f"{self.folder}/{name}", n), places.slice(k, n).cast(pa.int64()), pa.repeat(first[0], n), _text(part)], ["source", "pos", "first", "value"])


class LogReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Ranges]:
        return planned([(name, 0, size) for name, size in self.sizes().items() if size], self.range, self.workers) or [Ranges([])]


class LogStreamReader(_Reading, DataSourceStreamReader):
    """Offsets are the bytes read of each file; with `files`, a batch takes at most so many files that have more."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        self.at = {}
        return {}

    def latestOffset(self) -> dict:
        if self.at is None:
            # begun again: the batch that was planned last is the last one in Spark's log
            store, at = store_of(self.plan) if self.plan else (None, None)
            self.at = {}
            if store and store.get_file_info(at).type == fs.FileType.File:
                with store.open_input_stream(at) as file:
                    self.at = json.loads(file.read())
        now, more = dict(self.at), 0
        for name, size in self.sizes().items():
            end = self._whole(name, now.get(name, 0), size)
            if end > now.get(name, 0) and (not self.files or more < self.files):
                now[name] = end
                more += 1
        self.at = now
        return now

    def _whole(self, name: str, begin: int, size: int) -> int:
        """The end of what may be read: with `tail` that of the last whole line."""
        if not self.tail or size <= begin:
            return size
        store, at = store_of(self.folder)
        with store.open_input_file(f"{at}/{name}") as file:
            while size > begin:
                low = max(begin, size - CHUNK)
                file.seek(low)
                cut = file.read(size - low).replace(_CR, _LF).rfind(_LF)
                if cut >= 0:
                    return low + cut + 1
                size = low
        return begin

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        if self.plan:
            store, at = store_of(self.plan)
            store.create_dir(at.rpartition("/")[0])
            with store.open_output_stream(f"{at}.new") as file:
                file.write(json.dumps(end).encode())
            store.move(f"{at}.new", at)
        return planned([(name, start.get(name, 0), size) for name, size in end.items() if size > start.get(name, 0)], self.range, self.workers)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COUNTS if self.options.get("count", "false").lower() == "true" else SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)


def register(spark: SparkSession) -> str:
    """Makes the source known to a session; returns its name."""
    spark.dataSource.register(LogSource)
    return NAME
