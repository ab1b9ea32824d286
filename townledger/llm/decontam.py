"""Benchmark decontamination by suffix arrays over the training text.

Each task sorts the word suffixes of its run of documents (a shard), binary-searches every window of the benchmark's
suffixes in it, and joins matches that continue each other into longest verbatim matches with their places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townledger.llm.common import ALNUM, U64, closed, opened, small_batches, text_chunks, tidy, words

#: Text of one suffix array; a longer document has one of its own.
SHARD_BYTES = 2 << 20
#: Benchmark text that is broadcast at once; a larger benchmark is searched in blocks of this size, one after the other.
BLOCK_BYTES = 4 << 20

SPAN = "array<struct<s:int,e:int>>"
MATCH = "array<struct<item_id:string,doc_word:int,item_word:int,n_words:int>>"


class Tests:
    """The windows of a block of benchmark items: distinct windows, and where each stands in the items."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.window = window
        self.names = sorted({i for i, _ in items})
        code = {x: i for i, x in enumerate(self.names)}
        texts = [(t or "").encode() for _, t in items]
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        h, _, _, first = words(np.frombuffer(b"".join(texts), np.uint8), offs, ALNUM)
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        size = np.minimum(np.diff(first), window)
        n = np.where(size > 0, np.diff(first) - size + 1, 0)  # windows of each item
        row = np.repeat(np.arange(len(items)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = first[:-1][row] + place
        padded = np.concatenate([ids.astype(np.int32), np.zeros(window, np.int32)])
        grid = np.lib.stride_tricks.sliding_window_view(padded, window)[start]
        grid[np.arange(window) >= size[row][:, None]] = -1
        item = np.array([code[i] for i, _ in items], np.int64)[row]
        self.grid, of = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, np.zeros(0, np.int64))
        of = of.reshape(-1)
        self.sizes = (self.grid >= 0).sum(1)
        by = np.argsort(of, kind="stable")
        self.item, self.place = item[by], place[by]
        self.at = np.searchsorted(of[by], np.arange(len(self.grid) + 1))


def suffix_array(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(suffixes in order, their first words packed in one number, bits of a word) for codes from 1; 0 ends a document.

    Suffixes are sorted by four words (three, for many codes), then by twice as many each round, where ties are left,
    until depth words are in order.
    """
    bits = int(codes.max(initial=1)).bit_length()
    k = 4 if 4 * bits <= 63 else 3
    n = len(codes)
    pad = np.concatenate([codes, np.zeros(k, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(k):
        key = key << bits | pad[j : n + j]
    sa = np.argsort(key)
    packed = key[sa]
    new = np.concatenate([[True], packed[1:] != packed[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    have = k
    while have < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        s = sa[slots]
        pair = rank[s] * (n + 1) + rank[np.minimum(s + have, n)] + 1
        by = np.argsort(pair)
        sa[slots], pair = s[by], pair[by]
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        new[slots] = fresh
        rank[sa[slots]] = np.maximum.accumulate(np.where(fresh, slots, 0))
        have *= 2
    return sa, packed, bits


def _narrow(sa: np.ndarray, codes: np.ndarray, col: int, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """For each range of suffixes alike up to col, where those whose word there is less (or no more) than want end."""
    lo, hi = lo.copy(), hi.copy()
    while (live := lo < hi).any():
        mid = (lo + hi) >> 1
        at = np.minimum(sa[np.minimum(mid, len(sa) - 1)] + col, len(codes) - 1)
        below = (codes[at] <= want) if right else (codes[at] < want)
        lo, hi = np.where(live & below, mid + 1, lo), np.where(live & ~below, mid, hi)
    return lo


def search(codes: np.ndarray, vocabulary: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """(window, place in codes) of every occurrence of a window; vocabulary holds the word hashes of codes 1, 2, ..."""
    at = np.minimum(np.searchsorted(vocabulary, tests.vocabulary), max(0, len(vocabulary) - 1))
    code = np.where(vocabulary[at] == tests.vocabulary, at + 1, -1) if len(vocabulary) else np.full(len(tests.vocabulary), -1)
    grid = np.where(tests.grid >= 0, code[tests.grid], 0)
    some = np.flatnonzero((grid >= 0).all(1))
    if not len(some) or not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sa, packed, bits = suffix_array(codes, tests.window)
    grid, size = grid[some], tests.sizes[some]
    k = 4 if 4 * bits <= 63 else 3
    first, last = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
    for j in range(k):
        c = grid[:, j] if j < tests.window else 0
        first = first << bits | c
        last = last << bits | np.where(j < size, c, (1 << bits) - 1)
    lo, hi = np.searchsorted(packed, first, "left"), np.searchsorted(packed, last, "right")
    for col in range(k, tests.window):
        alive = np.flatnonzero((lo < hi) & (col < size))
        if not len(alive):
            break
        a, b, want = lo[alive], hi[alive], grid[alive, col]
        lo[alive], hi[alive] = _narrow(sa, codes, col, want, a, b, False), _narrow(sa, codes, col, want, a, b, True)
    n = np.maximum(hi - lo, 0)
    window = np.repeat(some, n)
    slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return window, sa[slot]


def _shard(data: np.ndarray, offs: np.ndarray, tests: Tests) -> tuple[np.ndarray, dict[int, list], dict[int, set], dict[int, list]]:
    """Words of each document of a shard, and by document its hit spans, items and longest matches."""
    h, _, _, first = words(data, offs, ALNUM)
    docs = len(offs) - 1
    n_words = np.diff(first)
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    matches: dict[int, list] = {}
    if not len(h) or not len(tests.grid):
        return n_words, spans, items, matches
    seen, vocabulary = pd.factorize(h)
    by = np.argsort(vocabulary)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(1, len(by) + 1)
    begin = first[:-1] + np.arange(docs)  # a 0 stands after each document
    codes = np.zeros(len(h) + docs, np.int64)
    codes[np.arange(len(h)) + np.repeat(np.arange(docs), n_words)] = rank[seen]
    window, pos = search(codes, vocabulary[by], tests)
    if not len(window):
        return n_words, spans, items, matches
    edge = np.zeros(len(codes) + 1, np.int32)
    np.add.at(edge, pos, 1)
    np.add.at(edge, pos + tests.sizes[window], -1)
    hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    starts, ends = np.flatnonzero(~hit[:-1] & hit[1:]), np.flatnonzero(hit[:-1] & ~hit[1:])
    for d, s, e in zip((np.searchsorted(begin, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist()):
        spans.setdefault(d, []).append((s - int(begin[d]), e - int(begin[d])))
    # A window may stand at several places of the items; matches on one diagonal that go on word by word are one.
    k = tests.at[window + 1] - tests.at[window]
    each = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(tests.at[window], k)
    item, place, p, size = tests.item[each], tests.place[each], np.repeat(pos, k), np.repeat(tests.sizes[window], k)
    by = np.lexsort((p, p - place, item))
    item, place, p, size = item[by], place[by], p[by], size[by]
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (p[1:] != p[:-1] + 1) | (place[1:] != place[:-1] + 1)])
    cut = np.append(np.flatnonzero(new), len(item))
    doc = np.searchsorted(begin, p[cut[:-1]], "right") - 1
    for d, a, b in zip(doc.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
        name = tests.names[item[a]]
        items.setdefault(d, set()).add(name)
        matches.setdefault(d, []).append((name, int(p[a] - begin[d]), int(place[a]), int(p[b - 1] + size[b - 1] - p[a])))
    return n_words, spans, items, matches


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _search_block(docs: DataFrame, sent, text: str, without: tuple[str, ...] = ()) -> DataFrame:
    schema = docs.schema
    plain = [f for f in schema.fields if f.name not in ("n_words", "_spans", "_items", "_matches", *without)]
    more = "_spans" in docs.columns
    names = [f.name for f in plain]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = sent.value
        for batch in batches:
            old = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_spans", "_items", "_matches")} if more else None
            n_words, spans, items, matches = [], [], [], []
            for lo, hi, data, offs in text_chunks(batch, text, SHARD_BYTES):
                n, s, i, m = _shard(data, offs, tests)
                n_words += n.tolist()
                for r in range(hi - lo):
                    a, b, c = s.get(r, []), i.get(r, set()), m.get(r, [])
                    if old:
                        a = _union(a + [(x["s"], x["e"]) for x in old["_spans"][lo + r]])
                        b, c = b | set(old["_items"][lo + r]), c + [tuple(x.values()) for x in old["_matches"][lo + r]]
                    spans.append([{"s": x, "e": y} for x, y in a])
                    items.append(sorted(b))
                    matches.append([dict(zip(("item_id", "doc_word", "item_word", "n_words"), x)) for x in sorted(c)])
            own = [batch.column(batch.schema.get_field_index(c)) for c in names]
            span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
            match = pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("n_words", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*own, pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string())), pa.array(matches, match)], names=[*names, "n_words", "_spans", "_items", "_matches"])

    return docs.mapInArrow(tidy(per_task), ", ".join([*kinds, "n_words long", f"_spans {SPAN}", "_items array<string>", f"_matches {MATCH}"]))


def find_matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", without: tuple[str, ...] = ()) -> DataFrame:
    """docs, but for the columns without, with n_words, n_hit, n_items, item_ids, items_sha256, contaminated and matches (longest verbatim ones).

    Words are runs of letters, digits and non-ASCII bytes after A-Z became a-z. Windows are every run of window words of
    an item, or a whole shorter item; a document word in any occurrence is hit. matches: item, first word in the document
    and in the item, words. A null or empty text has no words; an item without words matches nothing; a null item id
    is the id "null". Repeated items count once by id; repeated documents each. Columns of docs that
    have these names are replaced. Without documents or items the result is what these rules give.
    """
    made = ("n_words", "n_hit", "n_items", "item_ids", "items_sha256", "contaminated", "matches", "_spans", "_items", "_matches")
    small_batches(spark)
    out = docs.select(*[c for c in docs.columns if c not in made])
    tests = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("t")).filter(F.octet_length("t") > 0)
    size = tests.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(blocks):
        part = tests.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else tests
        out = _search_block(out, spark.sparkContext.broadcast(Tests([(r["i"], r["t"]) for r in part.collect()], window)), text, without if b == blocks - 1 else ())
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["e"] - x["s"]))
    return out.withColumns({"n_hit": hit, "n_items": F.size("_items").cast("long"), "items_sha256": F.sha2(F.array_join(F.array_sort("_items"), ","), 256)}).withColumn("contaminated", F.col("n_hit") > 0).withColumnsRenamed({"_items": "item_ids", "_matches": "matches"}).drop("_spans")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any window of the benchmark, with the columns of docs."""
    return opened(find_matches(spark, closed(docs), benchmark, window).filter(~F.col("contaminated")), docs.columns)
