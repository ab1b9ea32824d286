"""Token ids of documents as Parquet list columns, in ascending document order, read back by column and page."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from townledger.llm.common import small_batches, text_chunks
from townledger.llm.tokens import default_path, encoder

def encoded(batch: pa.RecordBatch, column: str, path: str, end: int | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, where each text's begin) for runs of rows; a null text is empty; end is put after each text."""
    encode = encoder(path).batch
    for lo, hi, data, offs in text_chunks(batch, column):
        ids, at = encode(data, offs)
        if end is not None:
            n = hi - lo
            out = np.empty(len(ids) + n, np.uint32)
            out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
            at = at + np.arange(n + 1)
            out[at[1:] - 1] = end
            ids = out
        yield lo, hi, ids, at


def write_token_files(
    docs: DataFrame, out: str, path: str | None = None, end: int | None = 2, text: str = "text", key: str = "doc_id", meta: tuple[str, ...] = (), row_group_bytes: int = 32 << 20, page_rows: int = 2000
) -> None:
    """Write key, meta columns, part, n_tokens and ids (whole texts, then the end id) below the folder out.

    Rows are dealt by ranges of key (and a checksum, so that equal keys spread) and sorted, so files hold
    ascending keys, and row-group and page indexes let a reader skip by key. ids are dictionary
    encoded in bit-packed runs; n_tokens and part by dictionary or delta (writer version 2). Null keys come first.
    """
    path = path or default_path()
    small_batches(docs.sparkSession)
    cols = [key, *[c for c in meta if c in docs.columns and c not in (key, text)]]
    rows = docs.select(*cols, F.col(text).cast("string").alias("_text"), F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("_tie"))
    rows = rows.repartitionByRange(F.col(key), F.col("_tie")).sortWithinPartitions(key, "_tie")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*cols).schema.fields]

    def encode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            for lo, hi, flat, at in encoded(batch, "_text", path, end):
                own = [batch.column(i).slice(lo, hi - lo) for i in range(len(cols))]
                sizes, ids = pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays([*own, pa.array([part] * (hi - lo), pa.int32()), sizes, ids], names=[*cols, "part", "n_tokens", "ids"])

    tokens = rows.mapInArrow(encode_part, ", ".join([*kinds, "part int", "n_tokens long", "ids array<int>"]))
    (
        tokens.write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.writer.version", "PARQUET_2_0")
        .parquet(out)
    )


def read_token_files(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The named columns of token files (all, if none is named); only these are read from the files."""
    df = spark.read.parquet(folder)
    return df.select(*columns) if columns else df


def token_digest(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and ids_crc32 of each document of token files, from the ids that the files hold.

    start is the number of ids of all documents before it: each part's total (one row a part) gives its first
    position, and documents add up inside their part.
    """
    kind = read_token_files(spark, folder, key).schema[0].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            at, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = np.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc)], names=["k", "part", "n_tokens", "ids_crc32"])

    rows = read_token_files(spark, folder, key, "part", "ids").mapInArrow(digest, f"k {kind}, part int, n_tokens long, ids_crc32 long")
    totals = read_token_files(spark, folder, "part", "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("k", "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("s", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(firsts, "part").select(F.col("k").alias(key), (F.col("first") + F.col("s")).alias("start"), "n_tokens", "ids_crc32")
