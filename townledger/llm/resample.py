"""Importance resampling towards a target: external sort-count of packed bucket streams, then gains gathered by document.

Texts are read once: each run of documents becomes one row with a packed uint16 stream of feature buckets and the offsets
of its documents in it, in a shared folder. Counts come from streams that are sorted and run-length encoded, weights from
the same streams by np.add.reduceat over the gains, which are a table of fixed size.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townledger.llm.common import ALNUM, U64, mix, shared_dir, small_batches, stored, text_chunks, words
from townledger.operators.ordered import numbered


@dataclass(frozen=True)
class Settings:
    """Features are runs of low to high consecutive words; buckets is at most 65,536, so that a bucket is a uint16."""

    buckets: int = 10_000
    low: int = 1
    high: int = 1
    min_words: int = 20
    percent: int = 10
    seed: int = 2024


def _buckets(data: np.ndarray, offs: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the stream of buckets by document, its offsets, words of each document) of a chunk."""
    h, start, length, first = words(data, offs, ALNUM)
    n = np.diff(first)
    low = ALNUM[0][data].tobytes()
    found, of = [], []
    doc = np.repeat(np.arange(len(n)), n)
    run = h.copy()
    for k in range(1, s.high + 1):
        if k > 1:
            run = mix(run[: len(run) - 1] * U64(0x9FB21C651E98DF25) ^ h[k - 1 :]) if len(run) else run
        at = np.flatnonzero(doc[: len(run)] == doc[k - 1 :]) if k > 1 else np.arange(len(run))
        if k < s.low or not len(at):
            continue
        _, kind, back = np.unique(run[at], return_index=True, return_inverse=True)
        crc = np.empty(len(kind), np.uint16)
        for i, w in enumerate(at[kind].tolist()):  # each distinct feature of a chunk once
            crc[i] = zlib.crc32(b" ".join(low[start[j] : start[j] + length[j]] for j in range(w, w + k))) % s.buckets
        found.append(crc[back])
        of.append(doc[at])
    if not found:
        return np.zeros(0, np.uint16), np.zeros(len(n) + 1, np.int64), n
    stream, of = np.concatenate(found), np.concatenate(of)
    if len(found) > 1:
        order = np.argsort(of, kind="stable")
        stream, of = stream[order], of[order]
    return stream, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(n)))]), n


def streams(docs: DataFrame, settings: Settings = Settings(), text: str = "text", key: str | None = "doc_id") -> DataFrame:
    """Rows of (keys, words, offsets, stream): a run of documents each, every document in one row, whole."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString() if key else "int"

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key)) if key else pa.nulls(batch.num_rows, pa.int32())
            for lo, hi, data, offs in text_chunks(batch, text):
                stream, ends, n = _buckets(data, offs, settings)
                cut = lambda values: pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [cut(keys.slice(lo, hi - lo)), cut(pa.array(n)), pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends.astype(np.int64))), pa.array([stream.astype("<u2").tobytes()], pa.binary())],
                    names=["keys", "words", "offsets", "stream"],
                )

    return docs.select(*([key] if key else []), text).mapInArrow(per_task, f"keys array<{kind}>, words array<long>, offsets array<long>, stream binary")


def counts(packed: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Features of all streams by bucket. Streams are sorted and run-length encoded; a task sends a row a bucket at most, the driver gets one of each."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                seen = np.sort(np.frombuffer(blob.as_buffer(), "<u2"))
                if len(seen):
                    runs = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
                    total[seen[runs]] += np.diff(np.append(runs, len(seen)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some.astype(np.int32)), "n": pa.array(total[some])})

    got = packed.select("stream").mapInArrow(per_task, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(settings.buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of how much likelier each bucket is in the target, with one added to each count."""
    b, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key, seed: int) -> int:
    """A document's Gumbel noise in thousandths, from its id alone; a null id is an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(packed: DataFrame, gain: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document of the streams."""
    kind = packed.schema["keys"].dataType.elementType.simpleString()
    sent = packed.sparkSession.sparkContext.broadcast(gain)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                keys, n, offs = (batch.column(j)[i].values for j in (0, 1, 2))
                offs = offs.to_numpy()
                size = np.diff(offs)
                weight = np.zeros(len(size), np.int64)
                if some := np.flatnonzero(size).tolist():
                    weight[some] = np.add.reduceat(gain[np.frombuffer(batch.column(3)[i].as_buffer(), "<u2")], offs[some])
                drawn = np.array([noise(k, settings.seed) for k in keys.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([keys, n, pa.array(size), pa.array(weight), pa.array(weight + drawn)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return packed.select("keys", "words", "offsets", "stream").mapInArrow(per_task, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, settings: Settings = Settings(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; rank is null for documents that are not drawn.

    Of the N documents with at least min_words words, the floor(percent * N / 100) with the highest score are drawn: weight
    (the sum of the gains of a document's features) plus Gumbel noise of its id, which draws without replacement in
    proportion to exp(weight / 1000). Ties go to the smaller id. A null text has no words, a null id is an empty text in
    the noise and comes before all others; repeated rows are each scored and ranked, in any order among themselves; an empty
    target gives each bucket one; an empty table gives an empty result. No other column of docs or target is read.
    """
    if not 0 < settings.buckets <= 1 << 16 or not 1 <= settings.low <= settings.high:
        raise ValueError("buckets must be 1 to 65536, and runs of words 1 or longer")
    folder = shared_dir(spark)
    packed = stored(streams(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), settings), f"{folder}/packed")
    aimed = streams(target.select(F.col(text).alias("text")), settings, key=None)
    scored = stored(scores(packed, gains(counts(packed, settings), counts(aimed, settings)), settings), f"{folder}/scored")
    long_enough = scored.filter(F.col("n_words") >= settings.min_words)
    drawn = settings.percent * long_enough.count() // 100
    ranks = numbered(long_enough, [], [F.desc("score"), F.col("doc_id")], "rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranks.withColumn("rank", rank).unionByName(scored.filter(F.col("n_words") < settings.min_words).withColumn("rank", F.lit(None).cast("long")))
