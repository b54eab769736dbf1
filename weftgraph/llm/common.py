"""What the text operators share: reading tables, cutting lineage, and hashing words in bulk."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import by_shuffle, cut, delete, owned, release, shared_dir  # noqa: F401  for the operators
from ..functions.workers import ship

#: A word: anything but the six ASCII white-space characters. Used by Python, Spark and DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch by rows and bytes, so that batches of very long texts fit a Python worker, which also gets
    this package. The two settings stay in the session, as plans read them when they run."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def tidy() -> None:
    """Gives memory that a Python worker no longer uses back to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: nothing to trim
        pass


def row_of(df: DataFrame) -> Column:
    """The caller's whole row in one struct. Operators carry it beside columns of their own, so no column of the caller
    can clash with one of theirs, and give it back by select("row.*")."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def rows_with_text(df: DataFrame, text: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array]]:
    """df as one column `row`, and what gets the texts, as strings, out of a batch of it."""
    at = df.columns.index(text)
    if isinstance(df.schema[text].dataType, T.StringType):
        return df.select(row_of(df)), lambda batch: batch.column(0).field(at)
    return df.select(row_of(df), F.col(f"`{text}`").cast("string").alias("text")), lambda batch: batch.column(1)


#: Rows of a table that may be broadcast because very many rows meet them, and how many those are at least.
MOST_HOT, HOT_ROWS = 10_000, 500


def join_hot(left: DataFrame, right: DataFrame, key: str, times: str) -> DataFrame:
    """left with the columns of right (one row for each key) or nulls. times: the column of right that says how many rows
    of left have the key.

    Up to MOST_HOT keys are broadcast. Of more, those with a MOST_HOT-th of all rows or more, of which there can't be
    more than MOST_HOT, are broadcast, so that no task gets all rows of one key; all others meet by a shuffle.
    """
    sizes = right.agg(F.count("*").alias("keys"), F.coalesce(F.sum(times), F.lit(0)).alias("n")).first()
    least = max(HOT_ROWS, -(-int(sizes["n"]) // MOST_HOT))
    found = right.drop(times)
    if sizes["keys"] <= MOST_HOT:
        return left.join(F.broadcast(found), key, "left").select(*left.columns, *(c for c in found.columns if c != key))
    hot = right.filter(F.col(times) >= least).drop(times)
    if hot.isEmpty():
        return left.join(by_shuffle(found), key, "left")
    names = [*left.columns, *(c for c in found.columns if c != key)]
    hot = F.broadcast(hot)
    many = left.join(hot, key).select(*names)
    few = left.join(hot.select(key), key, "left_anti").join(by_shuffle(found), key, "left").select(*names)
    return many.unionByName(few)


# ---- words and shingles of whole Arrow batches, in numpy -------------------------------------------------

_rng = np.random.RandomState(20240229)
_BYTE = _rng.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, STRETCH + 1)
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(b: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 bytes start and end. The bytes of the six spaces never occur inside a code point."""
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~outside[b]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Bytes that are hashed at once: what hashing needs beside the text and its spans doesn't grow with the text.
STRETCH = 1 << 18


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, which depends on its bytes alone and not on where it stands.

    Spans are in order and don't overlap. A span longer than STRETCH is hashed part by part from its own start.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    if end[-1] - start[0] <= STRETCH:
        return _hashes(b[start[0] : end[-1]], start - start[0], end - start[0])
    out, k = np.empty(len(start), np.uint64), 0
    while k < len(start):
        last = int(np.searchsorted(end, start[k] + STRETCH, side="right"))
        if last > k:
            out[k:last] = _hashes(b[start[k] : end[last - 1]], start[k:last] - start[k], end[k:last] - start[k])
        else:
            at, last = np.arange(start[k], end[k], STRETCH), k + 1
            value = np.array([end[k] - start[k]], np.uint64)
            for f in at.tolist():
                part = b[f : min(f + STRETCH, end[k])]
                value = mix64(value * np.uint64(0xD6E8FEB86659FD93) + _hashes(part, np.array([0]), np.array([len(part)])))
            out[k] = value[0]
        k = last
    return out


def _hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _power_tables(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
    return mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(raw: bytes | memoryview | np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 bytes, in order; lower: A-Z count as a-z."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    if lower:
        b = _LOWER[b]
    return span_hashes(b, *word_spans(b))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width words; with fewer words, of the whole sequence; none without words."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix64(out)


_NO_LETTER = np.ones(256, dtype=bool)
_NO_LETTER[[*range(97, 123), *range(128, 256)]] = False


def letter_words(raw: bytes | memoryview) -> np.ndarray:
    """Hashes of the runs of letters (a-z with A-Z folded, and all beyond ASCII), in order."""
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    return span_hashes(b, *word_spans(b, _NO_LETTER)) if len(b) else np.zeros(0, np.uint64)


def texts_of(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of each value of a string column without copies; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = None if not column.null_count else np.asarray(column.is_valid())
    for k in range(len(column)):
        yield view[ends[k] : ends[k + 1]] if valid is None or valid[k] else view[:0]
