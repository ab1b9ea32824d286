"""Rendezvous hashing of record keys over weighted shards, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one numbering task sorts, about; a shard of any size is numbered in blocks of keys.
BLOCK_ROWS = 200_000


def _score(key: Column, shard: int, weight: float) -> Column:
    """The weighted rendezvous score -weight / ln(u) of a key at a shard, u in (0, 1) from a hash of both."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
    return F.lit(-float(weight)) / F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53)))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score for a key; ties go to the lower shard.

    Only the key and the shards' numbers and weights decide.  A shard added at the end takes rows only into
    itself, one taken away gives up only its own.  A null key is a key like any other; a shard of weight 0
    gets no row.
    """
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    best = F.array_max(F.array(*[F.struct(_score(key, i, w).alias("s"), F.lit(-i).alias("n")) for i, w in live]))
    return (-best["n"]).cast("int")


def numbered(rows: DataFrame, group: str, order: Sequence[str], total: int, slot: str = "slot") -> DataFrame:
    """Gapless numbers from 0 in each group, without ever sorting a whole group in one task.

    Each group is cut into blocks by a hash of the row; block counts (pre-aggregated) give every block its
    first number, and rows are numbered inside their block.
    """
    blocks = max(1, math.ceil(total / BLOCK_ROWS))
    cut = rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(7), *order), F.lit(blocks)).cast("int"))
    counts = cut.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(group, "_block").orderBy(*order)
    ranked = cut.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(firsts, [group, "_block"]).withColumn(slot, F.col("_first") + F.col("_rank")).drop("_block", "_first", "_rank")


def shard_documents(docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    size: UTF-8 bytes of the text plus 16, a null text has none.  Nulls: a null key hashes as null, a null or
    empty text has checksum 0.  Repeated rows share a shard and get slots of their own.  An empty table gives
    an empty result.  Other columns of docs are not read.
    """
    weights = list(weights or [1.0] * shards)
    grown = [*weights, sum(weights) / len(weights)]
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + F.lit(16)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = rows.select("*", F.lit("key").alias("law"), rendezvous(F.col("doc_id"), weights).alias("shard"), rendezvous(F.col("doc_id"), grown).alias("grown_shard"))
    return numbered(rows, "shard", ["doc_id", "text_crc32", "size"], docs.count()).select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
