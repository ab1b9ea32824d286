"""Ranked search over passages: keywords, vectors, fusion, reranking, one best hit for each group, and span budgets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townledger.functions import text as T
from townledger.functions.stems import IRREGULAR, SUFFIXES, stems
from townledger.operators.ordered import running_sums
from townledger.operators.vectors import MAX_QUERIES, exact_search

def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """The rows that meet every condition given; None sets no condition, so the filter below a scan holds only what applies."""
    for c in conditions:
        if c is not None:
            df = df.filter(c)
    return df


def _of_texts(df: DataFrame, key: str, text: str, work: Callable[[], Callable[[bytes], list[tuple]]], columns: str) -> DataFrame:
    """Rows (key, *columns): what the function that work makes in each task finds in each text in lower case, in one pass over its words."""
    T.small_batches(df.sparkSession)
    given = df.filter(F.col(text).isNotNull()).select(key, F.lower(text).cast("binary").alias("_low"))
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [pa.float64() if c.endswith(" double") else pa.string() if c.endswith(" string") else pa.int64() for c in columns.split(", ")]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = work()
        for batch in batches:
            rows, found = [], []
            for i, low in enumerate(batch.column(1)):
                now = of(low.as_py())
                found += now
                rows += [i] * len(now)
                if len(found) > 20_000:
                    yield _batch(batch, rows, found)
                    rows, found = [], []
            if found:
                yield _batch(batch, rows, found)

    def _batch(batch: pa.RecordBatch, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, k) for x, k in zip(zip(*found), kinds))], names=[key, *names])

    return given.mapInArrow(per_task, f"`{key}` {given.schema[key].dataType.simpleString()}, {columns}")


def keyword_search(df: DataFrame, query: str, key: str = "doc_id", text: str = "text", k: int = 50) -> DataFrame:
    """(key, score): passages with any term of the query by 0.1 * hits / (1 + 0.1 * hits), best first, least key on ties.

    Terms are counted inside each row by one pattern, so only the k best of each task move. A query of stop words finds nothing.
    """
    terms = T.search_terms(query)
    if not terms:
        return df.limit(0).select(key, F.lit(0.0).alias("score"))
    hits = F.regexp_count(F.lower(text), F.lit(rf"(?<![a-z0-9])(?:{'|'.join(sorted(set(terms)))})(?![a-z0-9])")).cast("double")
    scored = df.select(key, hits.alias("_h")).filter(F.col("_h") > 0).select(key, (F.lit(0.1) * F.col("_h") / (F.lit(1.0) + F.lit(0.1) * F.col("_h"))).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def keyword_search_many(df: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "query_id", query: str = "query", k: int = 10) -> DataFrame:
    """(query_key, key, hits, rank) of the k best passages for each query: how often a passage has the query's distinct terms.

    Up to MAX_QUERIES queries are broadcast as lists of their terms, hits are added up inside each row, and a task keeps the k best of
    each query only; where an id stands twice, its rows' hits move instead. More queries meet the passages by an equi-join of terms.
    """
    asked = queries.select(query_key, F.explode(T.tokens(F.col(query))).alias("term")).distinct()
    best = Window.partitionBy(query_key).orderBy(F.desc("hits"), key)
    if queries.limit(MAX_QUERIES + 1).count() <= MAX_QUERIES:
        lists = asked.groupBy(query_key).agg(F.collect_list("term").alias("terms")).toArrow()
        again = bool(df.groupBy(key).count().filter("count > 1").limit(1).count())
        numbers = df.sparkSession.createDataFrame(lists.select([query_key]).append_column("_q", pa.array(range(len(lists)), pa.int32())), queries.select(query_key, F.lit(0).alias("_q")).schema)
        found = _hits_of_queries(df, key, text, lists["terms"].to_pylist(), None if again else k)
        found = (found.groupBy("_q", key).agg(F.sum("hits").alias("hits")) if again else found).join(F.broadcast(numbers), "_q").select(query_key, key, "hits")
    else:
        terms = df.select(key, F.explode(T.tokens(F.col(text))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
        counted = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
        found = counted.join(asked, "term").groupBy(query_key, key).agg(F.sum("tf").alias("hits"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _hits_of_queries(df: DataFrame, key: str, text: str, queries: list[list[str]], k: int | None) -> DataFrame:
    """(key, _q, hits) of each row and query number with hits; with k only the rows that are among the k best of their task."""
    T.small_batches(df.sparkSession)
    given = df.filter(F.col(text).isNotNull()).select(key, F.lower(text).cast("binary").alias("_low"))
    sent = df.sparkSession.sparkContext.broadcast(queries)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, postings = {}, []
        for q, words in enumerate(sent.value):
            for w in words:
                if number.setdefault(w.encode(), len(postings)) == len(postings):
                    postings.append([])
                postings[number[w.encode()]].append(q)
        postings, n = [np.array(x) for x in postings], len(sent.value)
        rows, best = max(1, (1 << 20) // max(1, n)), None

        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                hits = np.zeros((part.num_rows, n), np.int64)
                for i, low in enumerate(part.column(1)):
                    for words in T.word_runs(low.as_py()):
                        terms, counts = np.unique([number[w] for w in words if w in number], return_counts=True)
                        if len(terms):
                            of = [postings[t] for t in terms.astype(int)]
                            hits[i] += np.bincount(np.concatenate(of), np.repeat(counts, [len(x) for x in of]), n).astype(np.int64)
                i, q = np.nonzero(hits if k is None else hits * (hits >= np.partition(hits, -min(k, len(hits)), 0)[-min(k, len(hits))]))
                now = pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array(q.astype(np.int32)), pa.array(hits[i, q])], names=[key, "_q", "hits"])
                if k is None:
                    yield now
                else:
                    best = _first(now if best is None else pa.concat_batches([best, now]), key, k)
        if best is not None:
            yield best

    kind = given.schema[key].dataType.simpleString()
    return given.mapInArrow(per_task, f"`{key}` {kind}, _q int, hits long")


def _first(found: pa.RecordBatch, key: str, k: int) -> pa.RecordBatch:
    """The k rows of each query with most hits, least key on ties, a null one first as in Spark."""
    found = found.take(pc.sort_indices(found, [("_q", "ascending"), ("hits", "descending"), (key, "ascending")], null_placement="at_start"))
    q = found.column(1).to_numpy()
    return found.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))


def word_forms(df: DataFrame, query: str, text: str = "text") -> dict[str, list[str]]:
    """stem -> the words of df's texts that share it, for each stem of a query's terms, in order of the terms.

    A rule changes no more than the last two letters of what it leaves, so only words that begin like an asked stem
    without these, and end in suffixes, leave their task, each about once, and are stemmed. Only the forms of the asked stems come to the driver: a stem has no more forms than the
    rules have suffixes to take off.
    """
    terms = list(dict.fromkeys(T.search_terms(query)))
    if not terms:
        return {}
    asked = stems(df.sparkSession.createDataFrame(list(enumerate(terms)), "at int, word string")).collect()
    forms: dict[str, list[str]] = {r["stem"]: [] for r in sorted(asked, key=lambda r: r["at"])}
    heads = sorted({s[: max(1, len(s) - 2)] for s in forms})
    near = rf"^(?:(?:{'|'.join(heads)})[a-z0-9]{{0,4}}(?:{'|'.join(SUFFIXES)})*|{'|'.join(IRREGULAR)})$"  # for Arrow, whose patterns take linear time
    begun = tuple(w.encode() for w in (*heads, *IRREGULAR))

    def work() -> Callable[[bytes], list[tuple]]:
        seen: set[bytes] = set()

        def of(low: bytes) -> list[tuple]:
            new = {w for words in T.word_runs(low) for w in words if w.startswith(begun)} - seen
            if not new:
                return []
            if len(seen) > 300_000:
                seen.clear()
            seen.update(new)
            words = pa.array([w.decode() for w in new])
            return [(w,) for w in words.filter(pc.match_substring_regex(words, near)).to_pylist()]

        return of

    words = _of_texts(df.select(F.lit(0).alias("_key"), F.col(text).alias("_text")), "_key", "_text", work, "word string").select("word").distinct()
    words = words.filter((F.length("word") >= 2) & ~F.col("word").isin(*T.STOPWORDS))
    for r in sorted(stems(words).filter(F.col("stem").isin(*forms)).collect(), key=lambda r: r["word"]):
        forms[r["stem"]].append(r["word"])
    return forms


def stem_search(df: DataFrame, query: str, key: str = "doc_id", text: str = "text", k: int = 50, near: bool = False) -> DataFrame:
    """(key, score): passages ranked by cover density of the query's stems, best first, least key on ties.

    A cover is a shortest run of words that meets the query; one of n words that are not the query's adds 0.1 / (1 + n), and
    a sum of s scores s / (1 + s). With any term enough, each of its places is a cover; near asks for all terms, and covers are
    the shortest runs that hold them all. All words have places, stop words too. A query of stop words, or (near) with a
    stem that no text has, finds nothing; null and empty texts are never found.
    """
    forms = word_forms(df, query, text)
    if not any(forms.values()) or near and not all(forms.values()):
        return df.limit(0).select(key, F.lit(0.0).alias("score"))
    number = {w.encode(): i for i, words in enumerate(forms.values()) for w in words}

    def places(low: bytes) -> list[tuple]:
        n = sum(sum(map(number.__contains__, words)) for words in T.word_runs(low))
        return [(0.1 * n,)] if n else []

    def covers(low: bytes) -> list[tuple]:
        last, first, total = [(-1, 0)] * len(forms), -1, 0.0  # where each term stood last, and how many places came before
        begin = n = 0
        for words in T.word_runs(low):
            for at, term in enumerate(map(number.get, words), begin):
                if term is not None:
                    last[term] = (at, n)
                    start, before = min(last)
                    if start > first:  # a cover ends here, as its first word moved on
                        total += 0.1 / (1 + at - start - (n - before))
                    first, n = start, n + 1
            begin += len(words)
        return [(total,)] if total else []

    found = _of_texts(df, key, text, lambda: covers if near else places, "_sum double")
    return found.select(key, (F.col("_sum") / (F.lit(1.0) + F.col("_sum"))).alias("score")).orderBy(F.desc("score"), key).limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_search(df: DataFrame, query: Sequence[float], key: str = "vec_id", vector: str = "embedding", k: int = 50) -> DataFrame:
    """(key, score): cosine similarity to the query, best first, least key on ties; null vectors are left out, zero ones come last."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = F.sqrt(dot(F.col(vector), F.col(vector))) * F.sqrt(dot(q, q))
    score = F.when(norm == 0, F.lit(float("-inf"))).otherwise(dot(F.col(vector), q) / norm)
    return df.filter(F.col(vector).isNotNull()).select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def vector_search_many(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", k: int = 10, within: tuple[str, str] | None = None) -> DataFrame:
    """(query_key, key, score, rank): exact nearest vectors of a stated set of queries; see vectors.exact_search."""
    return exact_search(df, queries, key, vector, query_key, k, within)


def fuse(lists: Sequence[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, score): reciprocal-rank fusion of lists that have the columns key and rank."""
    both = lists[0].select(key, "rank")
    for other in lists[1:]:
        both = both.unionByName(other.select(key, "rank"))
    return both.groupBy(key).agg(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("score"))


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """Ranks 1, 2, ... of a short list."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def overlap_score(query: str, text: Column) -> Column:
    """The share of the query's distinct terms that a passage has; 0 for a query without terms."""
    terms = sorted(set(T.search_terms(query)))
    has = lambda t: F.lower(text).rlike(rf"(?<![a-z0-9]){t}(?![a-z0-9])").cast("int")
    return F.coalesce(sum(map(has, terms), F.lit(0)) / F.lit(float(len(terms))), F.lit(0.0)) if terms else F.lit(0.0)


def best_per_group(hits: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """The best hit of each group; hits without a group stay all."""
    own = Window.partitionBy(group).orderBy(*order)
    return hits.withColumn("_n", F.when(F.col(group).isNotNull(), F.row_number().over(own)).otherwise(F.lit(1))).filter("_n = 1").drop("_n")


def within_budget(spans: DataFrame, group: str, size: Column, budget: int, *order: Column | str) -> DataFrame:
    """The first spans of each group while their sizes add up to at most the budget. Sizes aren't negative, so the rest is a suffix."""
    return running_sums(spans, [group], order, {"used": size}).filter(F.col("used") <= budget)


def _bags(dim: int) -> Callable[[bytes], np.ndarray]:
    """For use in a task: how many search tokens of a text in lower case are in each bucket. A word is hashed once, up to 300,000 of them kept."""

    class Buckets(dict):
        def __missing__(self, word: bytes) -> int:
            at = self[word] = dim if len(word) < 2 or word in stop else int.from_bytes(hashlib.sha256(word).digest()[:4], "big") % dim
            return at

    buckets, stop = Buckets(), {w.encode() for w in T.STOPWORDS}

    def bag(low: bytes) -> np.ndarray:
        n = np.zeros(dim + 1, np.int64)
        for words in T.word_runs(low):
            n += np.bincount(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), minlength=dim + 1)
            if len(buckets) > 300_000:
                buckets.clear()
        return n[:dim]

    return bag


def hashed_bag(df: DataFrame, key: str, text: str, dim: int = 768) -> DataFrame:
    """(key, bucket, n): a passage's terms in dim buckets: the first 32 bits of a term's SHA-256, modulo dim."""

    def work() -> Callable[[bytes], list[tuple]]:
        bag = _bags(dim)
        return lambda low: [(b, n[b]) for n in (bag(low),) for b in np.flatnonzero(n)]

    return _of_texts(df, key, text, work, "bucket long, n long").groupBy(key, F.col("bucket").cast("int").alias("bucket")).agg(F.sum("n").alias("n"))


def bag_search(df: DataFrame, query: str, key: str = "doc_id", text: str = "text", dim: int = 768, k: int = 50) -> DataFrame:
    """(key, score): cosine similarity of hashed bags of words, worked out inside each row, so only the k best of each task move."""
    if not T.search_terms(query):
        return df.limit(0).select(key, F.lit(0.0).alias("score"))
    asked = _bags(dim)(" ".join(T.search_terms(query)).encode())

    def work() -> Callable[[bytes], list[tuple]]:
        bag = _bags(dim)
        return lambda low: [(dot, int(n @ n)) for n in (bag(low),) for dot in (int(asked @ n),) if dot]

    length = math.sqrt(int(asked @ asked))
    rows = _of_texts(df, key, text, work, "dot long, square long")
    return rows.select(key, (F.col("dot") / F.sqrt("square") / F.lit(length)).alias("score")).orderBy(F.desc("score"), key).limit(k)


def hybrid_search(df: DataFrame, query: str, key: str = "doc_id", text: str = "text", group: str | None = None, candidates: int = 50, k: int = 10, rerank: bool = True) -> DataFrame:
    """(key, rank, score): keyword and bag lists fused, reranked by term overlap, one hit for each group, k in all."""
    lists = [ranked(f(df, query, key, text, k=candidates), F.desc("score"), key) for f in (keyword_search, bag_search)]
    fused = fuse(lists, key).orderBy(F.desc("score"), key).limit(candidates)
    hits = df.join(F.broadcast(fused), key)
    if rerank:
        hits = hits.withColumn("score", overlap_score(query, F.col(text)))
    if group:
        hits = best_per_group(hits, group, F.desc("score"), key)
    return ranked(hits.select(key, "score").orderBy(F.desc("score"), key).limit(k), F.desc("score"), key)


MODES = ("keyword", "vector", "hybrid", "rerank")


def search(df: DataFrame, query: str, mode: str = "rerank", key: str = "doc_id", text: str = "text", group: str | None = None, candidates: int = 50, k: int = 10) -> DataFrame:
    """(key, rank, score) of the k best passages of df, which is filtered before: by terms, by bags, by both fused, or fused and reranked.

    A question has 1 to 500 characters, k is 1 to 50. Of a group's passages the best one is kept.
    """
    if not 1 <= len(query.strip()) <= 500 or not 1 <= k <= 50 or mode not in MODES:
        raise ValueError(f"a question has 1 to 500 characters, k is 1 to 50, a mode one of {', '.join(MODES)}")
    if mode == "rerank":
        return hybrid_search(df, query.strip(), key, text, group, candidates, k)
    alone = {"keyword": keyword_search, "vector": bag_search}
    lists = [f(df, query.strip(), key, text, k=candidates) for m, f in alone.items() if mode in (m, "hybrid")]
    hits = lists[0] if len(lists) == 1 else fuse([ranked(x, F.desc("score"), key) for x in lists], key)
    if group:
        hits = best_per_group(hits.join(df.select(key, group), key), group, F.desc("score"), key)
    return ranked(hits.select(key, "score").orderBy(F.desc("score"), key).limit(k), F.desc("score"), key)
