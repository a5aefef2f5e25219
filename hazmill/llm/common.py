"""Shared plumbing: durable intermediates, bounded text slices and vectorised word hashing.

A *word* is a maximal run of ASCII letters, digits and non-ASCII characters of the
lower-cased text. Hashes are position-independent polynomial hashes modulo 2**64,
computed for whole Arrow buffers at once.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only for a local master without that setting."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = sc._jsc.sc().getCheckpointDir().getOrElse(None) if sc._jsc.sc().getCheckpointDir().isDefined() else None
        path = path or "file://" + tempfile.mkdtemp(prefix="hazmill-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remove_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the shared folder's owner cleans up
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/hazmill-{name}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Folders:
    """Tables in the shared folder, by name: a new table of a name replaces the old one, whose folder is deleted.

    With `collect`, after each deletion the driver collects its garbage, so that Spark deletes the shuffle files that no plan needs any more.
    """

    def __init__(self, spark: SparkSession, collect: bool = True):
        self.spark, self.collect = spark, collect
        self.held: dict[str, str] = {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = new_path(self.spark, name), df.schema
        df.write.option("compression", "zstd").parquet(path)
        self.delete(name)
        self.held[name] = path
        return self.spark.read.schema(schema).parquet(path)

    def delete(self, name: str) -> None:
        if old := self.held.pop(name, None):
            remove_path(self.spark, old)
        if not self.collect:
            return
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def clear(self, *keep: str) -> None:
        for name in [n for n in self.held if n not in keep]:
            self.delete(name)


def give_back() -> None:
    """Return memory that this process no longer uses to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


_kept: dict[str, Callable[[], None]] = {}


def holds(operator: str, forget: Callable[[], None]) -> None:
    """Say that this process keeps an operator's models and memos between tasks, and how to forget them."""
    _kept[operator] = forget


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], operator: str = ""):
    """The function of a mapInArrow for workers that Spark uses again: a task first forgets what other operators keep, and in the end
    gives unused memory back to the system."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other in [name for name in _kept if name != operator]:
            _kept.pop(other)()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of an array that begin at starts, one after the other."""
    total = np.append(0, np.cumsum(sizes))
    return flat[np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])]


def free(name: str, taken: list[str]) -> str:
    """The name, lengthened until no column has it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice has few bytes of text, but one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text))
        ends = np.cumsum(np.asarray(pc.fill_null(sizes, 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


class Words:
    """Hashes of all words of a slice. first[i]..first[i+1] are the words of text i; start and end are byte offsets in data."""

    def __init__(self, texts: pa.Array):
        low = pc.utf8_lower(texts)
        offsets = np.frombuffer(low.buffers()[1], dtype=np.int64)[low.offset : low.offset + len(low) + 1]
        raw = low.buffers()[2]
        self.data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        bounds = offsets - offsets[0]
        n = len(self.data)
        inside = _WORD_BYTE[self.data]
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = inside
        before[bounds] = False
        after = np.zeros(n + 1, dtype=bool)
        after[:n] = inside
        after[bounds] = False
        self.start = np.flatnonzero(inside & ~before[:n])
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.hash = self._hashes(inside)

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        out, done, n = np.empty(len(self.start), dtype=np.uint64), 0, len(self.start)
        while done < n:
            base = self.start[done]
            to = max(done + 1, int(np.searchsorted(self.end, base + BLOCK_BYTES, "right")))
            stop = self.end[to - 1]
            up, down = _grown(max(int(stop - base) + 1, BLOCK_BYTES + 1))
            piece = (self.data[base:stop].astype(np.uint64) + np.uint64(1)) * up[: stop - base]
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(piece, out=sums[1:])
            s = self.start[done:to] - base
            out[done:to] = (sums[self.end[done:to] - base] - sums[s]) * down[s]
            done = to
        return mix(out)

    def word(self, i: int) -> str:
        return bytes(self.data[self.start[i] : self.end[i]]).decode("utf-8", "replace")


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed word shingles: per text distinct and ascending, as (text index, 44-bit hash, times it occurs).

    A text of fewer words than the size has one shingle of all its words; one without words has none.
    """
    h, first = words.hash, words.first
    counts = np.diff(first)
    n = len(h)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty.astype(np.uint64), empty
    owner = np.repeat(np.arange(len(counts)), counts)
    last = np.repeat(first[1:], counts)
    at = np.arange(n)
    acc = np.full(n, np.uint64(size * 0x1F3D5B79))
    for k in range(size):
        pos = at + k
        ok = pos < last
        step = np.where(ok, h[np.minimum(pos, n - 1)], np.uint64(0x51ED270B))
        acc = mix(acc + step * np.uint64(2 * k + 3))
    whole = (at + size <= last) | (at == last - np.repeat(counts, counts))
    keys = (owner[whole].astype(np.uint64) << np.uint64(44)) | (acc[whole] >> np.uint64(20))
    keys.sort()
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    where = np.flatnonzero(fresh)
    times = np.diff(np.append(where, len(keys)))
    keys = keys[where]
    return (keys >> np.uint64(44)).astype(np.int64), keys & np.uint64((1 << 44) - 1), times


def sum_blocks(parts: DataFrame, kind: str) -> DataFrame:
    """Add up blocks (block int, data binary of numbers of the given numpy kind) of one number by streaming over each task's rows."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.frombuffer(data.as_buffer(), dtype=kind)
                if block in total:
                    total[block] += more
                else:
                    total[block] = more.copy()
        for block in sorted(total):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total[block].tobytes()], pa.binary())], ["block", "data"])

    return parts.repartition(F.col("block")).mapInArrow(added, "block int, data binary")


def blocks_of(values: np.ndarray, count: int) -> pa.RecordBatch:
    """An array as so many equal blocks, leaving out those that hold only zeros."""
    cut = values.reshape(count, -1)
    some = np.flatnonzero(cut.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([cut[i].tobytes() for i in some], pa.binary())], ["block", "data"])


def gathered(df: DataFrame, kind: str, count: int, length: int) -> np.ndarray:
    """The summed blocks on the driver: count * length numbers, whatever the input's size."""
    out = np.zeros((count, length), dtype=kind)
    for block, data in df.collect():
        out[block] = np.frombuffer(bytes(data), dtype=kind)
    return out.reshape(-1)


def ranked(df: DataFrame, by: list[str], order: list[str], name: str, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The table, written in order, with `pos`, a row's place from 0 among the rows of equal `by` columns (nulls are equal, and first).

    Also the table of counts: the `by` columns and n. No task sorts more than its range: rows are dealt by ranges of (by, order), and a row's
    place is its row number in its file plus what earlier files hold of its group. End the order with a column that tells rows apart, else a
    third of the rows may be equal and one range. What is joined has a row for each group and file.
    """
    spark = df.sparkSession
    taken = df.columns
    file, row, first, before, n = (free(c, taken) for c in ("file", "row", "first", "before", "n"))
    keys = [F.col(c).asc_nulls_first() for c in [*by, *order]]
    path = new_path(spark, name)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    rows = spark.read.schema(df.schema).parquet(path).select("*", number.alias(file), F.col("_metadata.row_index").alias(row))
    held = rows.groupBy(file, *by).agg(F.min(row).alias(first), F.count("*").alias(n))
    earlier = Window.partitionBy(*by).orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    held = stored(held.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))), f"{name}-files")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    on = functools.reduce(lambda a, b: a & b, same, F.col(f"l.{file}") == F.col(f"r.{file}"))
    out = rows.alias("l").join(held.alias("r"), on).select(*[F.col(f"l.{c}") for c in taken], (F.col(f"l.{row}") - F.col(f"r.{first}") + F.col(f"r.{before}")).alias("pos"))
    return out, held.groupBy(*by).agg(F.sum(n).alias("n"))
