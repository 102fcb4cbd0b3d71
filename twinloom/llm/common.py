"""Helpers of the operators: storage between steps, text as numbers, packed rows."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT_BYTES = 2 << 20  # text that is turned into numbers at once
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # splitmix64
_GOLD = np.uint64(0x9E3779B97F4A7C15)


# ---- storage and plans -------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """A new folder name where all executors can write.

    It lies in ``spark.checkpoint.dir`` of the session; where that is unset, in the
    session's warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write as Parquet on shared storage and read back: computed once, lineage cut."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def kept_fields(df: DataFrame, results: T.StructType) -> list[T.StructField]:
    """Columns that stay beside results; results replace columns of their names (in any case)."""
    taken = {n.lower() for n in results.names}
    return [f for f in df.schema.fields if f.name.lower() not in taken]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def training_rows(key: str = "doc_id") -> F.Column:
    """True for rows that a model may learn from; false for the held-out quarter."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 != 2


def tidy(function):
    """A task's function over batches that hands freed memory back when it ends.

    Workers live on between tasks, and beside each other; what one has freed but kept would
    count against the executor.
    """

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


# ---- numbers -----------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n fixed odd multipliers."""
    with np.errstate(over="ignore"):
        x = mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * _GOLD)
    return x | np.uint64(1)


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted keys."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of each combination of keys, one combination after the other; rows are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        begin = run_starts(*(batch.column(c).to_numpy() for c in keys)).tolist()
        for b, e in zip(begin, [*begin[1:], batch.num_rows]):
            part = batch.slice(b, e - b)
            if held and any(held[0].column(c)[0] != part.column(c)[0] for c in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def in_larger_batches(batches: Iterable[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The rows of many small batches in batches of about ``rows``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_segments(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts in groups of about SEGMENT_BYTES, with their places in the list."""
    places: list[int] = []
    group: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SEGMENT_BYTES:
            yield places, group
            places, group, size = [], [], 0
        places.append(i)
        group.append(t)
        size += len(t)
    if places:
        yield places, group


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _hash_words(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word (a run of bytes outside space and 09-0D)."""
    a = np.frombuffer(joined, dtype=np.uint8)
    solid = ~_SPACE[a]
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64)
    at = np.flatnonzero(solid)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(len(at)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), 0x5851F42D4C957F2D, dtype=np.uint64))
    terms = (a[at].astype(np.uint64) + np.uint64(1)) * powers[within]
    return starts, mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * _GOLD)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, one after the other, and offsets by text."""
    if sum(map(len, texts)) > 2 * SEGMENT_BYTES:  # one very long text: hashed piece by piece
        parts, counts = [], []
        for t in texts:
            n, begin = 0, 0
            while begin < len(t):
                end = begin + SEGMENT_BYTES
                while end < len(t) and not _SPACE[t[end]]:
                    end += 1
                piece = _hash_words(t[begin:end])[1]
                parts.append(piece)
                n += len(piece)
                begin = end
            counts.append(n)
        hashes = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
        return hashes, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    starts, hashes = _hash_words(b" ".join(texts))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, begins).astype(np.int64)


def sliding_sum(values: np.ndarray, width: int, multiplier: np.uint64) -> np.ndarray:
    """Polynomial hash of every ``width`` consecutive values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total, done, block, size = np.zeros(n, dtype=np.uint64), 0, values, 1
    power = multiplier  # multiplier ** size
    shift = np.uint64(1)  # multiplier ** done
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                total += block[done : done + n] * shift
                done += size
                shift = shift * power
            if done == width:
                return total
            block = block[:-size] + block[size:] * power
            power, size = power * power, size * 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    if size < width:
        values = np.minimum(values[: len(values) - (width - size)], values[width - size :])
    return values


def packed(array: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Slices of an array as bytes, one per row."""
    data, step = array.tobytes(), array.dtype.itemsize
    return [data[s * step : e * step] for s, e in zip(starts.tolist(), ends.tolist())]


def unpacked(blobs: Iterable[bytes], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=dtype)


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
    )
