"""What the operators of this package share: shared folders, Arrow chunks and word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; bounds a task's memory, not a document.
CHUNK_BYTES = 1 << 20
#: Bytes and rows of an Arrow batch that Spark sends to Python, about; a longer text is a batch of its own.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4000

#: Memory of a worker from which on it gives back what it has freed.
HELD_BYTES = 200 << 20

U64 = np.uint64
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a session in one process, as in tests, may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="townledger-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tl-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """From now on in this session, an Arrow batch for Python ends at BATCH_BYTES, so that long texts do not add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Memory that this process has freed goes back to the system, where it can, if the process holds much."""
    with contextlib.suppress(OSError, AttributeError, ValueError):  # only where the system tells sizes and its C library can
        with open("/proc/self/statm") as f:
            held = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
        if held > HELD_BYTES:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that gives freed memory back when it ends: a worker lives on for tasks of other kinds."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return whole


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet in a shared folder and read it again: lineage ends there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closed(docs: DataFrame, *more: str, text: str = "text") -> DataFrame:
    """docs as its text, the columns more and all other columns in one, _row, whatever their names; the text is sent once."""
    return docs.select(text, *more, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.lit(0).alias("_")).alias("_row"))


def opened(rows: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns of docs again, from rows that closed made."""
    return rows.select(*[F.col(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in columns])


def text_chunks(batch: pa.RecordBatch, column: str, target: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; a null is an empty text. Each text is whole."""
    arr = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_string(arr.type):
        arr = arr.cast(pa.string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if not n:
        return
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + target, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def _byte_tables(delimiters: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.ones(256, dtype=bool)
    for a, b in delimiters:
        word[a : b + 1] = False
    return lower, word


#: Words are runs of other bytes than these, after A-Z became a-z.
SPACED = _byte_tables([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = _byte_tables([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); changes h in place."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(32)
    return h


def words(data: np.ndarray, offs: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, length, words before each document and in all) of the words of a chunk."""
    lower, word = tables
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, np.zeros(len(offs), np.int64)
    buf = np.zeros(n + 72, np.uint8)
    np.take(lower, data, out=buf[:n])
    is_word = np.zeros(n + 1, bool)
    is_word[:n] = word[buf[:n]]
    first = is_word[:n].copy()
    first[1:] &= ~is_word[: n - 1]
    last = is_word[:n] & ~is_word[1:]
    cut = offs[:-1][offs[:-1] < n]
    first[cut] = is_word[cut]
    cut = offs[1:][offs[1:] > 0] - 1
    last[cut] = is_word[cut]
    start = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - start
    view = np.ndarray((n + 64,), dtype="<u8", buffer=buf, strides=(1,))
    h = length.astype(U64) * U64(0x9FB21C651E98DF25)
    some, k = np.arange(len(start)), 0
    while len(some) and k < 64:
        left = length[some] - k
        w = view[start[some] + k] & _MASKS[np.minimum(left, 8)]
        x = h[some] ^ w
        h[some] = mix(x)
        k += 8
        some = some[left > 8]
    for i in some:  # words of over 64 bytes, by a hash of the whole word
        h[i] = xxhash.xxh64_intdigest(buf[start[i] : start[i] + length[i]].tobytes())
    return h, start, length, np.searchsorted(start, offs)


def crc_of_id(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))
