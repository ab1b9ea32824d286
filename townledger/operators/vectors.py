"""Nearest vectors by cosine: exact in blocks of queries by matrix products, and by an inverted file of trained centroids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townledger.operators.ordered import shared_folder, written

#: Queries that are broadcast at once; more are searched in hashed blocks of about that many.
MAX_QUERIES = 10_000
#: Scores in memory at once.
SCORES = 4_000_000
#: Rows of a list that one group compares with its queries; a longer list is dealt into several.
BLOCK_ROWS = 20_000
#: Scores are compared to so many decimals, so that equal vectors tie whatever order a product sums in.
DECIMALS = 12


@dataclass(frozen=True)
class Lists:
    """lists centroids are trained on sample rows at most (a bound, whatever the table's size), chosen by a hash of the key.

    A query probes the probes nearest lists; None takes the least number that reaches the target recall at k on trials rows of
    the sample, searched among the sample: few for vectors in clusters, most lists for vectors like noise.
    """

    lists: int = 32
    sample: int = 20_000
    rounds: int = 12
    probes: int | None = None
    target: float = 0.96
    trials: int = 256


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which had no length."""
    size = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(size == 0, 1, size)[:, None], size == 0


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length, without nulls, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Best:
    """The k best (score, key) of each query of what has been added; ties go to the lesser key."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.bar = k, np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, scores: np.ndarray, keys: np.ndarray, fits: np.ndarray | None = None) -> None:
        """scores: queries x keys; fits tells the pairs that count."""
        if fits is not None:
            scores = np.where(fits, scores, np.nan)
        if scores.shape[1] > self.k and fits is None:
            self.bar = np.maximum(self.bar, np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, i = np.nonzero(scores >= self.bar[:, None])
        self.parts.append((q, keys[i], scores[q, i]))
        self.rows += len(q)
        if self.rows > 4 * self.k * len(self.bar) + 100_000:
            self.taken()

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, score), k a query at most."""
        if not self.parts:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0)
        q, key, score = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((key, -score, q))
        q, key, score = q[order], key[order], score[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        q, key, score = q[nth < self.k], key[nth < self.k], score[nth < self.k]
        full = np.flatnonzero(nth[nth < self.k] == self.k - 1)
        self.bar[q[full]] = np.maximum(self.bar[q[full]], score[full])
        self.parts, self.rows = [(q, key, score)], len(q)
        return q, key, score


def _scores(rows: np.ndarray, queries: np.ndarray, no_query: np.ndarray) -> np.ndarray:
    """Cosines, queries x rows; one with a zero vector is minus infinity."""
    unit, none = _unit(rows)
    s = np.round(queries @ unit.T, DECIMALS)
    s[no_query] = -np.inf
    s[:, none] = -np.inf
    return s


def exact_search(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", k: int = 10, within: tuple[str, str] | None = None) -> DataFrame:
    """(query_key, key, score, rank): the k nearest rows of each of a stated set of queries, best first, least key on ties.

    Queries come to the driver and are broadcast as matrices in hashed blocks of about MAX_QUERIES; each task multiplies its
    batches with a block and keeps the k best of each query, which is all that is shuffled. within: a column of df and one of
    queries; only rows whose values are equal count. Rows and queries without a vector are left out, zero vectors come last;
    all vectors have one length.
    """
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(query_key).alias("_key"), F.col(vector).alias("_vector"), *([F.col(within[1]).alias("_within")] if within else []))
    blocks = max(1, -(-asked.count() // MAX_QUERIES))
    rows = df.filter(F.col(vector).isNotNull()).select(key, vector, *([within[0]] if within else []))
    kinds = f"query int, `{key}` {df.schema[key].dataType.simpleString()}, score double"
    best = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    found = None
    for i in range(blocks):
        block = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("_key"), F.lit(blocks)) == i)).toArrow()
        names = block.column("_key").to_pylist()
        unit, none = _unit(_matrix(block.column("_vector").combine_chunks())) if names else (np.zeros((0, 1)), np.zeros(0, bool))
        labels = np.array(block.column("_within").to_pylist(), dtype=object) if within else None
        sent = df.sparkSession.sparkContext.broadcast((unit, none, labels))

        def per_task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            unit, none, labels = sent.value
            kept, kind = Best(len(unit), k), None
            for b in batches:
                kind = b.schema.field(0).type
                step = max(1, SCORES // max(1, len(unit)))
                for part in (b.slice(at, step) for at in range(0, b.num_rows if len(unit) else 0, step)):
                    fits = None if labels is None else labels[:, None] == np.array(part.column(2).to_pylist(), dtype=object)[None, :]
                    kept.add(_scores(_matrix(part.column(1)), unit, none), part.column(0).to_numpy(zero_copy_only=False), fits)
            if kept.parts:
                q, key_, score = kept.taken()
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(key_, kind), pa.array(score)], names=["query", key, "score"])

        named = df.sparkSession.createDataFrame(pd.DataFrame({"query": np.arange(len(names), dtype=np.int32), query_key: names}), f"query int, `{query_key}` {queries.schema[query_key].dataType.simpleString()}")
        hits = rows.mapInArrow(per_task, kinds).join(F.broadcast(named), "query").select(query_key, key, "score")
        top = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        found = top if found is None else found.unionByName(top)
    return found


def _probes(x: np.ndarray, centres: np.ndarray, s: Lists, k: int) -> int:
    """The least number of lists that holds the target share of the k nearest of s.trials rows of x."""
    own, some = (x @ centres.T).argmax(1), x[:: max(1, len(x) // s.trials)]
    near = np.argsort(-(some @ x.T), axis=1)[:, : k + 1]
    rank = np.argsort(np.argsort(-(some @ centres.T), axis=1), axis=1)  # of each list for each trial
    needed = np.take_along_axis(rank, own[near], axis=1) + 1
    return next(n for n in range(1, len(centres) + 1) if np.mean(needed[:, 1:] <= n) >= s.target or n == len(centres))


def train(df: DataFrame, s: Lists = Lists(), key: str = "vec_id", vector: str = "embedding", k: int = 10) -> tuple[np.ndarray, int]:
    """Centroids (unit rows) of at most s.sample vectors by spherical k-means in numpy, and how many a query probes. Null and zero vectors teach nothing."""
    some = df.filter(F.col(vector).isNotNull()).select(vector, F.xxhash64(key, F.lit(11)).alias("_h")).orderBy("_h").limit(s.sample).select(vector).toArrow()
    if not some.num_rows:
        return np.zeros((0, 1)), 0
    x, none = _unit(_matrix(some.column(0).combine_chunks()))
    x = x[~none]
    centres = np.unique(x[: 4 * s.lists], axis=0)
    centres = centres[np.random.default_rng(0).permutation(len(centres))[: s.lists]]
    for _ in range(s.rounds if len(centres) else 0):
        own = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        moved, empty = _unit(total)
        centres = np.where(empty[:, None], centres, moved)
    return centres, (s.probes or _probes(x, centres, s, k)) if len(centres) else 0


def _nearest(rows: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(-(_unit(rows)[0] @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)


def assigned(df: DataFrame, centres: np.ndarray, n: int, key: str, vector: str) -> DataFrame:
    """(key, vector, list): a row for each of the n nearest lists of a vector."""
    sent = df.sparkSession.sparkContext.broadcast(centres)
    schema = df.select(key, vector).schema

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = _nearest(_matrix(b.column(1)), sent.value, n)
                at = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(near.ravel())], names=[key, vector, "list"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return df.filter(F.col(vector).isNotNull()).select(key, vector).mapInArrow(per_task, f"{kinds}, list int")


def indexed_search(df: DataFrame, queries: DataFrame, s: Lists = Lists(), key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", k: int = 10) -> DataFrame:
    """(query_key, key, score, rank): the k nearest rows of the lists that each query probes, exactly scored; least key on ties.

    Every row is in the list of its nearest centroid; lists are dealt into blocks of about BLOCK_ROWS by a hash of the key, and
    a query meets each block of its lists in a shuffled join, so a list with a third of all rows is no single group. Rows
    and queries without a vector are left out; an empty table finds nothing.
    """
    folder = shared_folder(df.sparkSession)
    centres, n = train(df, s, key, vector, k)
    if not len(centres):
        return queries.select(query_key).limit(0).join(df.select(key).limit(0)).select(query_key, key, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    lists = written(assigned(df, centres, 1, key, vector), f"{folder}/lists")
    sizes = F.broadcast(lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("blocks")))  # s.lists rows at most
    dealt = lists.join(sizes, "list").select(F.col(key).alias("_key"), F.col(vector).alias("_vector"), "list", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int").alias("block"))
    probes = assigned(queries, centres, n, query_key, vector).join(sizes, "list")
    probes = probes.select(F.col(query_key).alias("_key"), F.col(vector).alias("_vector"), "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    schema = f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}, `{key}` {df.schema[key].dataType.simpleString()}, score double"

    def compared(rows: pa.Table, asked: pa.Table) -> pa.Table:
        kinds = [(query_key, asked.schema.field("_key").type), (key, rows.schema.field("_key").type), ("score", pa.float64())]
        if not rows.num_rows or not asked.num_rows:
            return pa.table({n: pa.array([], t) for n, t in kinds})
        keys, m = rows.column("_key").combine_chunks(), _matrix(rows.column("_vector").combine_chunks())
        kept: list[pa.Table] = []
        names, vectors = asked.column("_key").combine_chunks(), asked.column("_vector").combine_chunks()
        for at in range(0, len(names), SCORES // BLOCK_ROWS):
            unit, none = _unit(_matrix(vectors.slice(at, SCORES // BLOCK_ROWS)))
            best = Best(len(unit), k)
            best.add(_scores(m, unit, none), keys.to_numpy(zero_copy_only=False))
            q, found, score = best.taken()
            kept.append(pa.table({query_key: names.slice(at, SCORES // BLOCK_ROWS).take(pa.array(q)), key: pa.array(found, keys.type), "score": score}))
        return pa.concat_tables(kept)

    hits = dealt.groupBy("list", "block").cogroup(probes.groupBy("list", "block")).applyInArrow(compared, schema)
    best = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, query_key: str = "query_id", key: str = "vec_id") -> DataFrame:
    """(query_key, recall): the share of a query's exact neighbours that were found, for every query of exact."""
    hit = exact.select(query_key, key).join(found.select(query_key, key, F.lit(1).alias("hit")), [query_key, key], "left")
    return hit.groupBy(query_key).agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
