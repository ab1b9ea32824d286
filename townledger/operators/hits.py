"""Hits with their texts: candidates filled in from chunks and items, and the spans of an item and of the one it is linked to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townledger.operators.ordered import running_sums
from townledger.operators.search import best_per_group

SPAN_BUDGET = 9000


def hydrate(hits: DataFrame, chunks: DataFrame, items: DataFrame) -> DataFrame:
    """hits with the columns of their chunks (by chunk_id) and of their chunks' items (by item_id), null where a chunk has none.

    hits: chunk_id and more. chunks: chunk_id, item_id and more. items: item_id, linked_item_id and more. A hit whose
    chunk is gone is left out; a chunk whose item is gone keeps its own columns.
    """
    return hits.join(chunks, "chunk_id").join(items, "item_id", "left")


def best_of_items(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """The best hit of each item for each query, by rank and then chunk_id; hits without an item stay all."""
    keyed = hits.withColumn("_item", F.when(F.col("item_id").isNotNull(), F.struct(query, "item_id")))
    return best_per_group(keyed, "_item", "rank", "chunk_id").drop("_item")


def item_spans(hits: DataFrame, chunks: DataFrame, budget: int = SPAN_BUDGET, query: str = "query_id") -> DataFrame:
    """(query, hit, position, chunk_id, size): the spans of each hit, the matched chunk at position 1.

    hits: query, chunk_id, item_id and linked_item_id, as from hydrate; chunks: chunk_id, item_id, ordinal, size
    (characters). After the matched chunk come the others of its item and then those of the linked item, by ordinal and
    chunk_id, up to the first that would take the sum of sizes over the budget. The matched chunk always stays. An item
    linked to itself gives its chunks once; hits without an item have their own chunk only; null sizes are 0.
    """
    sized = chunks.select("chunk_id", "item_id", "ordinal", F.coalesce("size", F.lit(0)).alias("size"))
    asked = hits.select(query, F.col("chunk_id").alias("hit"), "item_id", F.when(~F.col("linked_item_id").eqNullSafe(F.col("item_id")), F.col("linked_item_id")).alias("linked"))
    own = asked.select(query, "hit", F.lit(0).alias("place"), F.col("hit").alias("chunk_id")).join(sized.select("chunk_id", "ordinal", "size"), "chunk_id")
    # A hop is a row for the item itself and one for the linked item, so both kinds meet the chunks in one join.
    hops = asked.select(query, "hit", F.inline(F.array(F.struct(F.lit(1).alias("place"), F.col("item_id")), F.struct(F.lit(2).alias("place"), F.col("linked").alias("item_id"))))).filter(F.col("item_id").isNotNull())
    others = hops.join(sized, "item_id").filter(F.col("chunk_id") != F.col("hit"))
    columns = [query, "hit", "place", "ordinal", "chunk_id", "size"]
    spans = running_sums(own.select(*columns).unionByName(others.select(*columns)), [query, "hit"], ["place", "ordinal", "chunk_id"], {"used": F.col("size"), "position": F.lit(1).cast("long")})
    return spans.filter((F.col("used") <= budget) | (F.col("place") == 0)).select(query, "hit", "position", "chunk_id", "size")
