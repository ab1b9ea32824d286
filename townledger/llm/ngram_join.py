"""N-gram Jaccard self-join: subsets of small sets, inverted lists of large ones, the boundary chosen by cost.

Word shingles are ordered from rare to frequent. Two sets that overlap enough share their first common shingles
within short prefixes of that order: small sets are keyed by every pair of shingles of a prefix,
large sets (and the small ones that may match a large one) by each shingle of a shorter prefix, the inverted lists.
Each key's members are first compared with one of them, the hub. Members that meet in a component need no more;
only keys whose members still lie in several components compare their members of different ones.
No link between components is lost, and the pairs inside a group of copies are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townledger.llm.common import SPACED, U64, mix, shared_dir, small_batches, stored, text_chunks, tidy, words
from townledger.llm.components import components, merged

_MULT = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
#: Bits of a shingle that its frequency is counted by, of which RANGE_BITS deal counting out.
COUNT_BITS, RANGE_BITS = 33, 13
#: Shingles of a range that are sorted rather than counted in an array.
BUFFER = 200_000
#: The filter of shingles that occur twice has 2**FILTER_BITS bits (16 MB) at any size of the corpus.
FILTER_BITS = 27
#: At most so many frequent shingles are known by frequency; the least frequent beyond that keep hash order.
MAX_FREQUENT = 1_000_000
#: Bytes of document ids that a broadcast may hold; beyond, candidates' texts are found by a shuffled join.
MAX_BROADCAST_IDS = 1_000_000
#: Rounds that compare each component with one other; what is left after them is compared whole.
MERGE_ROUNDS = 3
#: Members that are compared with one copy of a hub, and pairs that one task compares, about.
HUB_MEMBERS, TASK_PAIRS = 200, 400


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80

    def need(self, n: int) -> int:
        """The least overlap of a set of n with any set it links to."""
        return (self.percent * n + 99) // 100

    def alone(self, n: int) -> bool:
        """Whether a set of n links to equal sets only."""
        return 100 * n // self.percent == n and self.need(n) == n

    def __post_init__(self) -> None:
        if not 50 < self.percent <= 100 or self.words < 1:
            raise ValueError("percent must be over 50, up to 100, and words positive")


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a chunk."""
    h, _, _, first = words(data, offs, SPACED)
    n = len(h)
    if n < width:
        rolled = np.zeros(0, U64)
    else:
        rolled = np.zeros(n - width + 1, U64)
        for k in range(width):
            rolled += h[k : n - width + 1 + k] * _MULT[k % 8] + U64(k)
        mix(rolled)
    sets = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= width:
            a = np.sort(rolled[lo : hi - width + 1])
            if len(a) > 1 and (same := a[1:] == a[:-1]).any():
                a = a[np.concatenate([[True], ~same])]
        elif hi > lo:  # a short text is one shingle
            x = np.full(1, U64(hi - lo))
            for k in range(lo, hi):
                x = mix(x * _MULT[5] + h[k : k + 1])
            a = x
        else:
            a = np.zeros(0, U64)
        sets.append(a)
    return sets


def class_key(a: np.ndarray) -> int:
    """Documents with the same set have the same key (64 bits)."""
    with np.errstate(over="ignore"):
        x = np.array([mix(a ^ _MULT[6]).sum(dtype=U64) + U64(len(a)) * _MULT[7]], U64)
    return int(mix(x).view(np.int64)[0])


def _count_rows(tops: list[np.ndarray]) -> pa.RecordBatch:
    """Sorted counts of a task's shingles, a row for each range: gaps as 16 bits, or numbers as 32 where they are sparse."""
    v = np.sort(np.concatenate(tops))
    low = v & U64((1 << (COUNT_BITS - RANGE_BITS)) - 1)
    ranges = v >> U64(COUNT_BITS - RANGE_BITS)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(ranges)) + 1, [len(v)]])
    gap = np.diff(low.astype(np.int64), prepend=0)
    gap[cut[:-1]] = low[cut[:-1]]
    wide = bool(gap.max() > 65535)
    body = low.astype("<u4") if wide else gap.astype("<u2")
    blobs = [body[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
    return pa.RecordBatch.from_pydict(
        {"doc_id": pa.nulls(len(blobs), pa.int64()), "cls": pa.nulls(len(blobs), pa.int64()), "n": pa.nulls(len(blobs), pa.int64()), "range": pa.array(ranges[cut[:-1]].astype(np.int32)), "wide": pa.array([wide] * len(blobs)), "blob": pa.array(blobs, pa.binary())}
    )


def _describe(docs: DataFrame, s: Settings) -> DataFrame:
    """A row (doc_id, cls, n) for each document, and rows (range, wide, blob) that count each task's shingles."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, held = [], 0
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offs in text_chunks(batch, "text"):
                sets = shingle_sets(data, offs, s.words)
                tops += [(a >> U64(64 - COUNT_BITS)) for a in sets if len(a)]
                held += sum(map(len, sets))
                none = pa.nulls(hi - lo, pa.int32())
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(lo, hi - lo), "cls": pa.array([class_key(a) for a in sets], pa.int64()), "n": pa.array([len(a) for a in sets], pa.int64()), "range": none, "wide": pa.nulls(hi - lo, pa.bool_()), "blob": pa.nulls(hi - lo, pa.binary())})
                if held > 4_000_000:
                    yield _count_rows(tops)
                    tops, held = [], 0
        if tops:
            yield _count_rows(tops)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(per_task), "doc_id long, cls long, n long, range int, wide boolean, blob binary")


def _filter_bits(low: np.ndarray) -> Iterator[np.ndarray]:
    """The two places, in its range's part of the filter, of a shingle's counted bits below the range."""
    mask = U64((1 << (COUNT_BITS - RANGE_BITS)) - 1)
    for factor in (0x9E3779B1, 0x85EBCA77):
        yield ((low * U64(factor)) & mask) >> U64(COUNT_BITS - FILTER_BITS)


def _frequencies(blobs: DataFrame, least: int = 2) -> DataFrame:
    """From the counts of all tasks: rows (top, n) of shingles in at least 8 documents, and for each range a row (range, bits, ones, squares).

    The bits tell shingles that occur least times or more. A range's shingles are sorted while they are few; from BUFFER of them on, they are added up in an array of fixed size.
    """
    width = 1 << (COUNT_BITS - RANGE_BITS)
    tasks = min(1 << RANGE_BITS, 4 * blobs.sparkSession.sparkContext.defaultParallelism)

    def done(r: int, low: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        twice = np.zeros(1 << (FILTER_BITS - RANGE_BITS), bool)
        for bit in _filter_bits(low[n >= least].astype(U64)):
            twice[bit] = True
        some = np.flatnonzero(n > 7)
        tops = ((r << (COUNT_BITS - RANGE_BITS)) + low[some]).astype(np.int64)
        k = len(some)
        return pa.RecordBatch.from_pydict(
            {"top": pa.array([*tops.tolist(), None], pa.int64()), "n": pa.array([*n[some].tolist(), None], pa.int64()), "range": pa.array([None] * k + [r], pa.int32()), "bits": pa.array([None] * k + [np.packbits(twice).tobytes()], pa.binary()),
             "total": pa.array([None] * k + [int(n.sum())], pa.int64()), "squares": pa.array([None] * k + [float((n.astype(float) ** 2).sum())], pa.float64())}
        )

    def counted(parts: list[np.ndarray], counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if counts is not None:
            for x in parts:
                np.add.at(counts, x, 1)
            some = np.flatnonzero(counts)
            return some, counts[some]
        return np.unique(np.concatenate(parts), return_counts=True)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held, counts = None, [], 0, None
        for batch in batches:
            for r, wide, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if r != now:
                    if now is not None:
                        yield done(now, *counted(parts, counts))
                    now, parts, held, counts = r, [], 0, None
                parts.append(np.frombuffer(blob, "<u4").astype(np.int64) if wide else np.cumsum(np.frombuffer(blob, "<u2"), dtype=np.int64))
                held += len(parts[-1])
                if held > BUFFER:
                    counts = np.zeros(width, np.int64) if counts is None else counts
                    for x in parts:
                        np.add.at(counts, x, 1)
                    parts, held = [], 0
        if now is not None:
            yield done(now, *counted(parts, counts))

    dealt = blobs.select("range", "wide", "blob").repartition(tasks, "range").sortWithinPartitions("range")
    return dealt.mapInArrow(tidy(per_task), "top long, n long, range int, bits binary, total long, squares double")


@dataclass(frozen=True)
class Order:
    """What a task knows of frequencies: a fixed-size filter of repeated shingles and the most frequent ones."""

    twice: np.ndarray
    tops: np.ndarray
    level: np.ndarray

    def keys(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a from rare to frequent, and which of it may occur in another document."""
        top = a >> U64(64 - COUNT_BITS)
        base = top >> U64(COUNT_BITS - RANGE_BITS) << U64(FILTER_BITS - RANGE_BITS)
        shared = np.ones(len(a), bool)
        for bit in _filter_bits(top & U64((1 << (COUNT_BITS - RANGE_BITS)) - 1)):
            bit += base
            shared &= (self.twice[bit >> U64(3)] >> (U64(7) - (bit & U64(7))).astype(np.uint8)) & 1 == 1
        if not len(self.tops) or not shared.any():
            return a, shared
        level = np.zeros(len(a), np.uint8)
        at = np.flatnonzero(shared)
        i = np.minimum(np.searchsorted(self.tops, top[at]), len(self.tops) - 1)
        level[at] = np.where(self.tops[i] == top[at], self.level[i], 0)
        if not level.any():
            return a, shared
        order = np.argsort(level, kind="stable")
        return a[order], shared[order]


def _filter(found: DataFrame) -> np.ndarray:
    """The filter that the ranges' bits make up."""
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = 1 << (FILTER_BITS - RANGE_BITS - 3)
    bits = found.filter("range IS NOT NULL").select("range", "bits").toArrow()
    for r, b in zip(bits["range"].to_pylist(), bits["bits"].to_pylist()):
        out[r * size : (r + 1) * size] = np.frombuffer(b, np.uint8)
    return out


def _order(found: DataFrame) -> tuple[Order, float]:
    """The order and the mean length of the list that a shingle meets."""
    levels = {r["level"]: r["k"] for r in found.filter("top IS NOT NULL").groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("k")).collect()}
    least, known = 3, sum(levels.values())
    while known > MAX_FREQUENT:
        known -= levels.get(least, 0)
        least += 1
    rows = found.filter(F.col("top").isNotNull() & (F.col("n") >= F.lit(1 << least))).select("top", F.floor(F.log2("n")).cast("int").alias("level")).toArrow()
    top, level = rows["top"].to_numpy().astype(U64), rows["level"].to_numpy().astype(np.uint8)
    by = np.argsort(top)
    total, squares = found.agg(F.sum("total"), F.sum("squares")).first()
    return Order(_filter(found), top[by], level[by]), (squares / total if total else 1.0)


def choose_boundary(sizes: dict[int, int], list_length: float, s: Settings) -> int:
    """The set size up to which keying by pairs costs less than scanning lists; 3 keys none by pairs.

    Costs are rows: a list posting also meets a share of the mean list, a pair of rare shingles meets next to nothing.
    """
    best, boundary = None, 3
    for b in range(3, 65):
        small = sum(k * (p * (p - 1) // 2) for n, k in sizes.items() if n <= b and not s.alone(n) for p in (n - s.need(n) + 2,))
        lists = sum(k * (n - s.need(n) + 1) * (1 + min(list_length, 64.0)) for n, k in sizes.items() if n >= s.need(b + 1) and not s.alone(n))
        if best is None or small + lists < best:
            best, boundary = small + lists, b
    return boundary


def _postings(docs: DataFrame, order, boundary: int, s: Settings) -> DataFrame:
    """Rows (key, cls, n, at): the keys by which a set may be met, and the place of the key's first shingle in its order."""
    from_list = s.need(boundary + 1)

    def keys(a: np.ndarray, known: Order) -> tuple[np.ndarray, np.ndarray]:
        n, out, at = len(a), [], []
        ordered, shared = known.keys(a)
        if n <= boundary:
            p = min(n, n - s.need(n) + 2)
            i, j = np.triu_indices(p, 1)
            ok = shared[i] & shared[j]
            i, j = i[ok], j[ok]
            out.append(mix(ordered[i] * _MULT[1] + ordered[j] * _MULT[2]))
            at.append(i)
        if n >= from_list:
            i = np.flatnonzero(shared[: n - s.need(n) + 1])
            out.append(ordered[i])
            at.append(i)
        return (np.concatenate(out), np.concatenate(at)) if out else (a[:0], np.zeros(0, np.int64))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = order.value, set()
        for batch in batches:
            for _, _, data, offs in text_chunks(batch, "text"):
                key, cls, n, place = [], [], [], []
                for a in shingle_sets(data, offs, s.words):
                    if not len(a) or s.alone(len(a)) or (c := class_key(a)) in seen:
                        continue
                    seen.add(c)
                    k, at = keys(a, known)
                    if len(k):
                        key.append(k)
                        place.append(at)
                        cls.append(np.full(len(k), c, np.int64))
                        n.append(np.full(len(k), len(a), np.int32))
                if len(seen) > 500_000:
                    seen.clear()
                if key:
                    yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(key).view(np.int64)), "cls": pa.array(np.concatenate(cls)), "n": pa.array(np.concatenate(n)), "at": pa.array(np.concatenate(place).astype(np.int32))})

    return docs.select("text").mapInArrow(tidy(per_task), "key long, cls long, n int, at int")


def _sets(docs: DataFrame, s: Settings) -> DataFrame:
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in text_chunks(batch, "text"):
                sets = shingle_sets(data, offs, s.words)
                yield pa.RecordBatch.from_pydict({"cls": pa.array([class_key(a) for a in sets], pa.int64()), "body": pa.array([a.astype("<u8", copy=False).tobytes() for a in sets], pa.binary())})

    return docs.select("text").mapInArrow(tidy(per_task), "cls long, body binary")


def _verified(pairs: DataFrame, docs: DataFrame, first_ids: DataFrame, s: Settings, folder: str) -> DataFrame:
    """Stored pairs (a, b) of classes with linked: whether their sets, made anew from one text of each class, overlap enough.

    Only sets of classes in a pair move, once for each pair. A class that is in many pairs as a is copied for runs of HUB_MEMBERS of them.
    """
    count = pairs.count()
    few = count <= MAX_BROADCAST_IDS
    known = F.broadcast if few else (lambda df: df)
    tasks = min(10_000, max(pairs.sparkSession.sparkContext.defaultParallelism, -(-count // TASK_PAIRS)))
    sized = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k")).select("a", F.ceil(F.col("k") / F.lit(HUB_MEMBERS)).cast("int").alias("parts"))
    heads = sized.select(F.col("a").alias("cls"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    members = pairs.join(sized, "a").select(F.col("b").alias("cls"), "a", F.pmod(F.hash("b"), F.col("parts")).alias("part"), F.lit(1).alias("role"))
    parts = stored(heads.unionByName(members), f"{folder}/parts")
    ids = stored(parts.select("cls").distinct().join(first_ids, "cls").select("first_id").distinct(), f"{folder}/ids")
    sets = _sets(docs.select(_id().alias("first_id"), "text").join(known(ids), "first_id", "left_semi"), s)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, body = None, np.zeros(0, U64)
        for batch in batches:
            a, b, linked = [], [], []
            for key, role, cls, raw in zip(*(batch.column(i) for i in range(4))):
                own = np.frombuffer(raw.as_buffer(), "<u8")
                if role.as_py() == 0:
                    head, body = key.as_py(), own
                elif head == key.as_py():
                    a.append(head)
                    b.append(cls.as_py())
                    small, large = sorted((own, body), key=len)
                    common = 0
                    if 100 * len(small) >= s.percent * len(large):
                        at = np.searchsorted(large, small)
                        common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    linked.append(100 * common >= s.percent * (len(own) + len(body) - common))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "linked": pa.array(linked, pa.bool_())})

    rows = sets.join(known(parts), "cls").repartition(tasks, "a", "part").sortWithinPartitions("a", "part", "role").select("a", "role", "cls", "body")
    return stored(rows.mapInArrow(tidy(per_task), "a long, b long, linked boolean").distinct(), f"{folder}/verified")


def _id():
    """The document id as a key: a null id is the least number."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _may_reach(a: str, b: str, s: Settings):
    """Whether sets whose first common shingle is this key's can still overlap enough, by what is left of both after it."""
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at"))
    return left * F.lit(100 + s.percent) >= F.lit(s.percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _mixed(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (key, cls, n, at, deg, root) of the keys whose classes lie in several components."""
    placed = shared.join(parts, shared["cls"] == parts["node"], "left").select("key", "cls", "n", "at", "deg", F.coalesce("root", "cls").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key")
    return placed.join(mixed, "key")


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    done = tried.select(F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi"))
    return pairs.join(done, (F.least("a", "b") == F.col("_lo")) & (F.greatest("a", "b") == F.col("_hi")), "left_anti")


def _possible(x: str, y: str, s: Settings):
    return (F.least(f"{x}.n", f"{y}.n") * 100 >= F.greatest(f"{x}.n", f"{y}.n") * s.percent) & (F.col(f"{x}.root") != F.col(f"{y}.root")) & _may_reach(x, y, s)


def _nearest(shared: DataFrame, parts: DataFrame, tried: DataFrame, s: Settings, turn: int) -> DataFrame:
    """For each component at most one pair (a, b) with another, the one with most keys: each key matches its members with one of them.

    In the first two turns that is the class that shares most keys, later a class of some other component each turn.
    """
    left = _mixed(shared, parts)
    by = F.struct("deg", F.xxhash64("cls", F.lit(turn))) if turn < 2 else F.struct(F.xxhash64("root", F.lit(turn)), F.col("deg"))
    pick = F.max_by(F.struct("cls", "n", "at", "root"), by)
    hubs = left.groupBy("key").agg(pick.alias("h")).select("key", "h.*")
    both = left.alias("x").join(hubs.alias("y"), (F.col("x.key") == F.col("y.key")) & _possible("x", "y", s))
    pairs = both.groupBy(F.col("x.root").alias("root"), F.col("y.cls").alias("a"), F.col("x.cls").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    best = F.max_by(F.struct("a", "b"), F.struct("k", -F.col("a"), -F.col("b")))
    return _untried(pairs, tried).groupBy("root").agg(best.alias("p")).select("p.a", "p.b").distinct()


def _across(shared: DataFrame, parts: DataFrame, tried: DataFrame, s: Settings, folder: str) -> DataFrame:
    """All pairs (a, b) of classes of different components that share a key and may reach the overlap, unless tried.

    Under each key the classes outside of its largest component meet all others, so a group of copies does not meet itself. Whether
    a pair may reach the overlap depends on sizes and places alone: first a key's distinct (size, place) are matched with
    each other, then the classes of those that may, so a key that many unlike texts share lists no pairs that cannot link.
    """
    rows = _mixed(shared, parts)
    sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("most"))
    rows = stored(rows.join(main, "key").select("key", "cls", "n", "at", "root", (F.col("root") == F.col("most")).alias("main")), f"{folder}/open")
    kinds = rows.groupBy("key", "n", "at").agg(F.max(~F.col("main")).alias("some"))
    x, y = kinds.filter("some").alias("x"), kinds.alias("y")
    size = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * s.percent
    able = x.join(y, (F.col("x.key") == F.col("y.key")) & size & _may_reach("x", "y", s)).select("x.key", "x.n", "x.at", F.col("y.n").alias("n2"), F.col("y.at").alias("at2"))
    left = rows.filter("NOT main").join(able, ["key", "n", "at"]).select("key", F.col("n2").alias("n"), F.col("at2").alias("at"), F.col("cls").alias("a"), F.col("root").alias("root_a"))
    both = left.join(rows, ["key", "n", "at"]).filter((F.col("root") != F.col("root_a")) & (F.col("main") | (F.col("a") < F.col("cls"))))
    return _untried(both.select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b")).distinct(), tried)


def join_ngrams(spark: SparkSession, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, class_key and n_copies of every document of docs (doc_id, text).

    Documents link when the Jaccard similarity of their sets of word shingles is at least percent / 100; shingles, and whole sets
    where all of them are equal, are told by hashes of 64 bits, so a wrong link needs such hashes to meet by chance. component_id is the smallest doc_id reached by links. A text with fewer words than a shingle is one shingle; a null
    or empty text has no shingle and links with nothing. Equal sets form one class, so
    repeated rows and copies are one member of the join. Rows with a null doc_id join like others and have a null
    component_id where no member has an id. Other columns of docs are not read.
    """
    s, folder = settings, shared_dir(spark)
    small_batches(spark)
    described = stored(_describe(docs, s), f"{folder}/described")
    own = described.filter("cls IS NOT NULL")
    found = stored(_frequencies(described.filter("range IS NOT NULL")), f"{folder}/frequencies")
    order, length = _order(found)
    sizes = {r["n"]: r["k"] for r in own.filter("n > 0").groupBy(F.least("n", F.lit(512)).alias("n")).agg(F.count(F.lit(1)).alias("k")).collect()}
    boundary = choose_boundary(sizes, length, s)

    postings = stored(_postings(docs, spark.sparkContext.broadcast(order), boundary, s), f"{folder}/postings")
    # How many keys a class shares: what copies were made from shares more of its keys than the edited copies.
    met = postings.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo != hi").select("key")
    common = stored(postings.join(met, "key"), f"{folder}/common")
    degree = common.groupBy("cls").agg(F.count(F.lit(1)).alias("deg"))
    shared = stored(common.join(degree, "cls").select("key", "cls", "n", "at", "deg"), f"{folder}/shared")
    first_ids = stored(own.filter("n > 0").groupBy("cls").agg(F.min(_id()).alias("first_id")), f"{folder}/first_ids")

    # First each class is compared with one hub, the one that it shares most keys with: no more pairs than classes.
    alone = shared.limit(0).select(F.col("cls").alias("node"), F.col("cls").alias("root"))
    none_tried = shared.limit(0).select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    tried = _verified(stored(_nearest(shared, alone, none_tried, s, 0), f"{folder}/hubs"), docs, first_ids, s, f"{folder}/first")
    parts = stored(components(tried.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))), f"{folder}/parts")

    # Then, in rounds, each component is compared with one other: no more pairs than components, which at least halve
    # while pairs link. What is left after them, pairs that do not link or only few, is compared whole.
    for i in range(MERGE_ROUNDS + 1):
        whole = i == MERGE_ROUNDS
        pairs = stored(_across(shared, parts, tried, s, folder) if whole else _nearest(shared, parts, tried, s, i + 1), f"{folder}/round{i}/found")
        if not pairs.limit(1).count():  # another turn may still find some
            continue
        now = _verified(pairs, docs, first_ids, s, f"{folder}/round{i}")
        tried = tried.unionByName(now)
        links = now.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        if links.limit(1).count():
            parts = merged(parts, links, f"{folder}/parts{i}")

    none = F.lit(-(1 << 63))
    grouped = first_ids.join(parts, first_ids["cls"] == parts["node"], "left").select("cls", "first_id", F.coalesce("root", "cls").alias("root"))
    real = F.when(F.col("first_id") != none, F.col("first_id"))
    least = own.filter("n > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("id"))
    rooted = grouped.join(least, "cls", "left").select("cls", "root", F.coalesce("id", real).alias("id"))
    roots = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = rooted.join(roots, "root").select("cls", "component_id")
    copies = own.groupBy("cls").agg(F.count(F.lit(1)).alias("n_copies"))
    table = of_class.join(copies, "cls")
    return own.filter("n > 0").join(table, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("cls").alias("class_key"), "n_copies").unionByName(
        own.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_key"), F.lit(1).cast("long").alias("n_copies"))
    )
