"""Vectorised word kernels over Arrow string buffers, without a Python object per word."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Space and the control characters TAB to CR part words.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Most bytes of a batch of rows that goes to Python, but for a longer row.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_LIBC = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None
_OWN: dict[str, str] = {}
_LIVE: dict[str, DataFrame] = {}
_KEPT: dict[str, Callable[[], None]] = {}
_ODD = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_BYTE_LOWER = _BYTE[LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_ODD, _SEGMENT + 1)
_DOWN = _powers(pow(_ODD, -1, 1 << 64), _SEGMENT + 1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if n else raw[:0], at - at[0] if n else np.zeros(1, np.int64)


def give_back() -> None:
    """Returns freed memory to the system: workers live on, and each task would otherwise add to what they hold."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def kept(name: str, forget: Callable[[], None]) -> None:
    """Says that a worker keeps something large from task to task; slices() that do not name it forget it."""
    _KEPT[name] = forget


def slices(batch: pa.RecordBatch, text: int, most: int = 1_000_000, keep: str = "") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each; a longer text is a part of its own.

    What is kept() goes, but for `keep`: workers live on from stage to stage.
    """
    for name in [name for name in _KEPT if name != keep]:
        _KEPT.pop(name)()
    if not batch.num_rows:
        return
    ends = buffers(batch.column(text))[1][1:]
    first = 0
    while first < batch.num_rows:
        begun = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begun + most, side="right")))
        yield batch.slice(first, last - first)
        first = last
    give_back()


def spans(data: np.ndarray, offsets: np.ndarray, part: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and how many words each text has."""
    inside = ~part[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(inside))]
    begin[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.diff(np.searchsorted(starts, offsets))


def _between(data: np.ndarray, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum over starts <= i < ends of values[data[i]] * ODD**i, modulo 2**64; both are ascending."""
    out = np.zeros(len(starts), dtype=np.uint64)
    carry, scale = np.uint64(0), np.uint64(1)
    run = np.zeros(_SEGMENT + 1, dtype=np.uint64)
    for first in range(0, len(data), _SEGMENT):
        part = data[first : first + _SEGMENT]
        n = len(part)
        np.cumsum(values[part] * _UP[:n], out=run[1 : n + 1])
        last = first + n == len(data)
        for at, sign in ((ends, False), (starts, True)):
            a, b = np.searchsorted(at, [first, first + n])
            b = len(at) if last else b
            sums = run[at[a:b] - first]
            sums = sums * scale + carry if first else sums
            out[a:b] = out[a:b] - sums if sign else out[a:b] + sums
        carry, scale = run[n] * scale + carry, scale * _UP[_SEGMENT]
    return out


def _unscale(at: np.ndarray) -> np.ndarray:
    """ODD**-at."""
    block = at // _SEGMENT
    far = _powers(pow(_ODD, -_SEGMENT, 1 << 64), int(block.max(initial=0)) + 1)
    return _DOWN[at - block * _SEGMENT] * far[block]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes; lower takes A-Z as a-z."""
    values = _BYTE_LOWER if lower else _BYTE
    with np.errstate(over="ignore"):
        return mix(_between(data, values, starts, ends) * _unscale(starts) + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of `size` words, its text's number and its first word's position in `words`; a shorter text is one run."""
    with np.errstate(over="ignore"):
        first = np.cumsum(counts) - counts
        runs = np.where(counts >= size, counts - size + 1, 0)
        owner = np.repeat(np.arange(len(counts)), runs)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs) + first[owner]
        value = np.zeros(len(at), dtype=np.uint64)
        for k in range(size):
            value = mix(value * np.uint64(3) + words[at + k] + np.uint64(k + 1))
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            extra = np.zeros(len(short), dtype=np.uint64)
            for k in range(size - 1):
                has = counts[short] > k
                extra[has] = mix(extra[has] * np.uint64(3) + words[first[short[has]] + k] + np.uint64(k + 1))
            extra = mix(extra + counts[short].astype(np.uint64) * np.uint64(_ODD))
            owner, at, value = np.concatenate([owner, short]), np.concatenate([at, first[short]]), np.concatenate([value, extra])
            order = np.argsort(owner, kind="stable")
            owner, at, value = owner[order], at[order], value[order]
    return value, owner, at


def lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def bounded(df: DataFrame) -> DataFrame:
    """df; its session sends at most BATCH_BYTES at once to Python from now on, or fewer if it did, so that long texts need little memory there."""
    spark = df.sparkSession
    now = spark.conf.get(_BATCH_SETTING, None)
    if now is None or not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def new_folder(spark: SparkSession) -> str:
    """A new folder's path below the one that spark.checkpoint.dir names, or where none is set and all runs on one machine, below one of this session's own; deleted when the session's JVM ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if "folder" not in _OWN:
            _OWN["folder"] = tempfile.mkdtemp(prefix="tables-")
        folder = _OWN["folder"]
    path = f"{folder}/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in a new_folder()."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    _LIVE[path] = out
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that saved() wrote and nothing reads any more."""
    for df in tables:
        if _LIVE.pop(path := getattr(df, "_saved_at", None), None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make() returns, saved; those that were saved on the way to it are deleted."""
    before = set(_LIVE)
    try:
        out = saved(make())
        before.add(out._saved_at)
    finally:
        dropped(*(df for path, df in list(_LIVE.items()) if path not in before))
    return out


# The primes of the 64-bit hash xxHash, and the seed that Spark gives it.
_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
_XX_SEED = np.uint64(42)


def xxhash64(ids: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of whole numbers."""
    one, two, three, four, five = _PRIMES

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    with np.errstate(over="ignore"):
        x = (_XX_SEED + five + np.uint64(8)) ^ turned(ids.astype(np.int64).view(np.uint64) * two, 31) * one
        x = turned(x, 27) * one + four
        x = (x ^ (x >> np.uint64(33))) * two
        x = (x ^ (x >> np.uint64(29))) * three
        return x ^ (x >> np.uint64(32))


#: Most bits of the tables of maybe(): 16 MB.
MOST_BITS = 1 << 27


def maybe(ids: DataFrame, column: str, room: int = 32) -> np.ndarray:
    """64-bit words of bits, set where an id falls: a one-hash Bloom filter of `room` bits or more an id, but MOST_BITS at most.

    The bits of each word are brought together before and after a shuffle by
    word, so no task and no machine sees more than MOST_BITS.  With more ids than
    half of that, all bits are set, and everything falls on one.
    """
    n = ids.count()
    if 2 * n > MOST_BITS:
        return np.full(1, -1, dtype=np.int64)
    words = max(1 << 10, min(MOST_BITS, 1 << (n * room).bit_length()) // 64)
    at = F.xxhash64(F.col(column).cast("long")).bitwiseAND(F.lit(64 * words - 1))
    bits = ids.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    got = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(words, dtype=np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out


def falls_on(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id falls on a set bit."""
    at = xxhash64(ids) & np.uint64(64 * len(bits) - 1)
    return (bits.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own(df: DataFrame) -> list[Column]:
    """The columns of df, whatever signs their names hold."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def falling(df: DataFrame, id_col: str, bits: np.ndarray, hit: bool = True) -> DataFrame:
    """Rows whose id falls on a set bit of maybe(), or with hit=False those whose does not, null ids among them; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            falls = falls_on(bits, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(falls == hit)).columns[:-1], batch.schema.names[:-1])

    columns, fields, own = carried(df)
    out = bounded(df).select(*columns, F.col(quoted(id_col)).cast("long").alias("id")).mapInArrow(run, T.StructType(fields))
    return out.select(*(own[c].alias(c) for c in df.columns))


def without(docs: DataFrame, id_col: str, marked: DataFrame, text_col: str | None = None) -> DataFrame:
    """docs without the rows that `marked` (marked_id, goes) says go; of the other marked rows one stays.

    With text_col, rows are marked by their id and the xxhash64 of their text
    (marked_text).  Only rows whose id falls on a marked one's slot are shuffled;
    all others pass straight on.  Rows without an id pass.
    """
    key, digest, goes = (fresh(name, docs) for name in ("marked_id", "marked_text", "goes"))
    keys = [key, digest] if text_col else [key]
    marked = marked.withColumnsRenamed({"marked_id": key, "marked_text": digest, "goes": goes})
    marked = saved(marked.groupBy(*keys).agg(F.max(goes).alias(goes)))
    bits = maybe(marked, key)
    straight = falling(docs, id_col, bits, hit=False)
    falls = falling(docs, id_col, bits)
    same = falls[quoted(id_col)].cast("long") == marked[key]
    if text_col:
        same &= F.xxhash64(falls[quoted(text_col)].cast("string")) == marked[digest]
    falls = falls.join(marked, same, "left").where(~F.coalesce(F.col(goes), F.lit(False)))
    alone = falls.where(F.col(key).isNull()).select(*own(docs))
    once = falls.where(F.col(key).isNotNull()).dropDuplicates(keys).select(*own(docs))
    return straight.unionByName(alone).unionByName(once)


def carried(docs: DataFrame, *used: str) -> tuple[list[Column], list[T.StructField], dict[str, Column]]:
    """The columns that an operator passes through Python, under names that cannot clash; their fields; and each by its own name."""
    rest = [c for c in docs.columns if c not in used]
    columns = [F.col(quoted(c)).alias(f"__{k}") for k, c in enumerate(rest)]
    return columns, [T.StructField(f"__{k}", docs.schema[c].dataType) for k, c in enumerate(rest)], {c: F.col(f"__{k}") for k, c in enumerate(rest)}
