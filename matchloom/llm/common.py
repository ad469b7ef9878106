"""What the operators of this subpackage share: reading tables, text columns as numpy bytes, hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step works on; bounds a task's memory, not what it covers.
BLOCK_BYTES = 512 << 10

#: Rows in an Arrow batch at most; a batch of whole texts is held several times over by the JVM and by each Python worker.
BATCH_ROWS = 1000

U64 = np.uint64


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    """The C library, if it can give memory back; Arrow is told to take its memory from there."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.malloc_trim.restype = ctypes.c_int
        return libc
    except (OSError, AttributeError):
        return None


def trim() -> None:
    """Gives what a task has freed back to the machine; Python workers live on from task to task."""
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Sets the rows of an Arrow batch for this session, unless they are fewer already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(column: str | Column, folds: int) -> Column:
    """crc32 of a key as text, modulo ``folds``; a null key counts as empty text."""
    key = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return body[offs[0] : offs[-1]], offs - offs[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row gets a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def inverse_mod_2_64(r: int) -> int:
    """Of an odd number."""
    return pow(r, -1, 1 << 64)


@lru_cache(maxsize=8)
def _powers(r: int, n: int) -> np.ndarray:
    out = np.full(n, r, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(r: int, n: int) -> np.ndarray:
    """r**0 .. r**(n-1) modulo 2**64."""
    return _powers(r, 1 << max(n - 1, 1).bit_length())[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> U64(32))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = inverse_mod_2_64(BASE)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from prefix sums of a polynomial; equal spans get equal hashes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U64(1)) * powers(BASE, len(data)), out=sums[1:])
    back = powers(BASE_INV, len(data) + 1)
    return mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def lowered_ascii() -> np.ndarray:
    """A table from byte to byte that lower-cases A-Z alone."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lowered_ascii()


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes that stays within its row, and the first word of each row.

    ``is_word`` has a flag for each of 256 bytes.
    """
    n = len(data)
    flag = np.zeros(n + 2, np.bool_)
    flag[1 : n + 1] = is_word[data]
    first = np.zeros(n + 1, np.bool_)
    first[offsets] = True
    here, before, after = flag[1:-1], flag[:-2], flag[2:]
    starts = np.flatnonzero(here & (~before | first[:n]))
    ends = np.flatnonzero(here & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def grouped_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums over the ranges between ``bounds``; an empty range gives 0."""
    total = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64) if values.dtype.kind in "bi" else values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def with_columns_by_batch(df: DataFrame, needs: list[str], adds: list[tuple[str, T.DataType]], function: Callable[..., list[pa.Array]]) -> DataFrame:
    """``df`` with columns that ``function`` computes from Arrow columns, a batch at a time.

    ``function`` gets the columns named in ``needs`` and returns one array for
    each of ``adds``. A column of ``df`` whose name an added one has (in any
    case) is replaced.
    """
    small_batches(df.sparkSession)
    taken = {name.lower() for name, _ in adds}
    keep = [c for c in df.columns if c.lower() not in taken]
    more = [c for c in dict.fromkeys(needs) if c not in keep]  # needed, but replaced in the result
    source = df.select(*(F.col(f"`{c}`") for c in keep + more))
    at = [(keep + more).index(c) for c in needs]
    n = len(keep)
    schema = T.StructType([*source.schema.fields[:n], *(T.StructField(name, kind) for name, kind in adds)])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.columns
            yield pa.RecordBatch.from_arrays([*columns[:n], *function(*(columns[i] for i in at))], names=names)
        trim()

    return source.mapInArrow(run, schema)
