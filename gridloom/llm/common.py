"""What the operators share: tables, the shared folder, word rules and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the storage that driver and executors share (``spark.checkpoint.dir``).

    Only where that setting is absent, as in tests, a folder below the warehouse stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
        if not spark.sparkContext.master.startswith("local") and base.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/gridloom-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, read again: lineage ends here and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that no later step reads."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps: it does so once their handles on the driver are garbage.

    Python lets go of its handles in the background, so a second look a moment later finds the rest.
    """
    for pause in (0.2, 0):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(pause)


#: What operators keep in a worker from task to task: by operator, what drops it.
KEPT: dict[str, Callable[[], None]] = {}


def make_room(keeps: str | None = None) -> None:
    """Drops what other operators than ``keeps`` have left in this worker, and gives free memory back."""
    for name, drop in KEPT.items():
        if name != keeps:
            drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving free memory back when a task begins and ends, as workers stay for later tasks and stages.

    What other operators than ``keeps`` remember is dropped: a stage has the memory that it needs, and not its predecessors'.
    """

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(keeps)
        try:
            yield from run(rows)
        finally:
            make_room(keeps)

    return task


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0b\x0c\r]+"), "")


def batches(rows: Iterator[pa.RecordBatch], column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose ``column`` (string or binary) holds about ``most_bytes`` at most."""
    for batch in rows:
        if not batch.num_rows:
            continue
        ends = np.cumsum(text_lengths(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value; null counts as 0."""
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values on end, offset of each value and the end); null is empty."""
    parts = texts(column)
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection of uint64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES.encode())] = True
#: Powers of an odd base modulo 2**64, grown on demand.
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.cumprod(np.full(256, _BASE, np.uint64))]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.full(max(n, 2 * len(_POWERS[0])), _BASE, np.uint64))
    return _POWERS[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in texts on end, and the first word's number of each text (and the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over the word, then a finaliser."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    within = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    values = (data[within + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))


_ODD = np.uint64(0xD6E8FEB86659FD93)


def joined_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` neighbouring hashes."""
    out = h
    for k in range(1, width):
        out = mix(out[: max(len(h) - k, 0)] * _ODD + h[k:])
    return out


def run_positions(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, place) of every member of runs that have ``counts`` members and begin at ``first``, on end."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Marks rows that differ from the row before in any of the columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new
