"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target proportions."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from townledger.llm.common import shared_dir, small_batches, stored, tidy
from townledger.llm.tokenfiles import encoded
from townledger.llm.tokens import default_path, encoder

#: Sources that weights name or with at least one in so many bytes have a queue of their own; the others are dealt into one.
MAX_QUEUES = 256
REST = "\x00rest"
#: Tokens that a dealt source has in each round at least, and sources that one group of the rest holds on average at most.
QUANTUM, GROUP_SOURCES = 8, 100_000


@dataclass(frozen=True)
class Phase:
    """A run of windows in which the same queues are served, each for a given number of its tokens.

    Queue j gets an equal quantum counts[j] * size / total in each window, in whole tokens: what rounding withholds is its
    deficit, carried to the next window, so after window k it has had its quantum times k to within one token.
    """

    queues: tuple[str, ...]
    starts: tuple[int, ...]
    counts: tuple[int, ...]
    first_sequence: int

    def total(self) -> int:
        return sum(self.counts)


def make_phases(totals: Mapping[str, int], size: int, weights: Mapping[str, float] | None = None) -> list[Phase]:
    """Phases over at most MAX_QUEUES + 1 queues. Weights are target token proportions; by default each queue's own share.

    When a queue runs dry, the others go on in their proportions in a new phase. Queues that weights do not name come last.
    """
    left = {q: n for q, n in sorted(totals.items()) if n > 0}
    taken = dict.fromkeys(left, 0)
    phases: list[Phase] = []
    at = 0
    while left:
        want = {q: float(weights.get(q, 0.0)) if weights else float(n) for q, n in left.items()}
        if not any(want.values()):
            want = {q: float(n) for q, n in left.items()}
        live = sorted(q for q in left if want[q] > 0)
        if len(live) > size // 4:
            raise ValueError(f"{len(live)} queues; windows of {size} tokens hold {size // 4}")
        if weights:
            dry = min(live, key=lambda q: (left[q] / want[q], q))
            counts = [left[q] if q == dry else min(left[q], max(1, int(want[q] * (left[dry] / want[dry])))) for q in live]
        else:
            counts = [left[q] for q in live]
        phases.append(Phase(tuple(live), tuple(taken[q] for q in live), tuple(counts), at))
        at += sum(counts) // size + (sum(counts) % size).bit_count()
        for q, n in zip(live, counts):
            taken[q] += n
            left[q] -= n
            if not left[q]:
                del left[q]
    return phases


class Layout:
    """Places runs of a queue's tokens in sequences of a phase.

    A queue with a quantum under two tokens is paid one token each time that its deficit has grown to one, until the last full
    window; the other queues share what is left of each window in their proportions.
    """

    def __init__(self, phase: Phase, size: int) -> None:
        self.phase, self.size, self.all = phase, size, phase.total()
        self.full = self.all // size
        self.small = [c * size < 2 * self.all for c in phase.counts] if self.full else [False] * len(phase.counts)
        self.below, self.large = [], 0
        for c, few in zip(phase.counts, self.small):
            self.below.append(self.large)
            self.large += 0 if few else c
        self._rests: dict[int, int] = {}
        # The last window is no longer than what is left; it is cut at powers of two, which need no padding.
        self.tail, rest = [], self.all - self.full * size
        for bit in reversed(range(size.bit_length())):
            if rest >> bit & 1:
                self.tail.append(1 << bit)
        self.tail_at = [0, *np.cumsum(self.tail).tolist()]

    def _paid(self, j: int, k: int) -> int:
        """Tokens of a small queue in the first k windows."""
        return self.phase.counts[j] * min(k, self.full) // self.full

    def _rest(self, k: int) -> int:
        """Tokens of the other queues in the first k windows."""
        if k > self.full:
            return self.large
        if k not in self._rests:
            if len(self._rests) > 10_000:
                self._rests.clear()
            self._rests[k] = self.size * k - sum(self._paid(j, k) for j, few in enumerate(self.small) if few)
        return self._rests[k]

    def _upto(self, x: int, k: int) -> int:
        """Of the first x tokens of a round of the other queues, those in the first k windows."""
        return x if k > self.full else x * self._rest(k) // self.large

    def served(self, j: int, k: int) -> int:
        if self.small[j]:
            return self._paid(j, k)
        return self._upto(self.below[j] + self.phase.counts[j], k) - self._upto(self.below[j], k)

    def offset(self, j: int, k: int) -> int:
        """Where queue j begins in window k: small queues stand last."""
        if self.small[j]:
            return self._rest(k + 1) - self._rest(k) + sum(self._paid(i, k + 1) - self._paid(i, k) for i in range(j) if self.small[i])
        return self._upto(self.below[j], k + 1) - self._upto(self.below[j], k)

    def pieces(self, j: int, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(first token, end token, sequence, offset) for tokens [start, end) of queue j of the phase."""
        k = min(self.full, start * self.all // (self.phase.counts[j] * self.size))
        while k > 0 and self.served(j, k) > start:
            k -= 1
        while self.served(j, k + 1) <= start:
            k += 1
        while start < end:
            had, stop = self.served(j, k), min(end, self.served(j, k + 1))
            if stop > start:
                offset = self.offset(j, k) + start - had
                if k < self.full:
                    yield start, stop, self.phase.first_sequence + k, offset
                else:
                    while start < stop:
                        i = bisect_right(self.tail_at, offset) - 1
                        n = min(stop - start, self.tail_at[i + 1] - offset)
                        yield start, start + n, self.phase.first_sequence + k + i, offset - self.tail_at[i]
                        start, offset = start + n, offset + n
                start = stop
            k += 1


@dataclass(frozen=True)
class Deal:
    """One of several streams that are dealt into one: its tokens are [below, below + count) of whole, in rounds of size tokens.

    With a quantum of two tokens a round or more, what a stream has had after a round never falls.
    """

    below: int
    count: int
    whole: int
    size: int

    def _upto(self, x: int, k: int) -> int:
        return x if k > self.whole // self.size else x * self.size * k // self.whole

    def served(self, k: int) -> int:
        return self._upto(self.below + self.count, k) - self._upto(self.below, k)

    def places(self, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(first token, end token, place in the dealt stream) for tokens [start, end)."""
        k = min(self.whole // self.size, start * self.whole // (self.count * self.size))
        while k > 0 and self.served(k) > start:
            k -= 1
        while start < end:
            had, stop = self.served(k), min(end, self.served(k + 1))
            if stop > start:
                yield start, stop, k * self.size + self._upto(self.below, k + 1) - self._upto(self.below, k) + start - had
                start = stop
            k += 1


def round_size(whole: int, least: int) -> int:
    return -(-QUANTUM * whole // least)


def deal_groups(totals: Mapping[str, int]) -> dict[str, list[Deal]]:
    """For each group the deals, inner first, that bring its tokens into one stream: always the two smallest are dealt into one."""
    heap = [(n, i, [g]) for i, (g, n) in enumerate(sorted(totals.items())) if n > 0]
    heapq.heapify(heap)
    found: dict[str, list[Deal]] = {g: [] for _, _, (g,) in heap}
    while len(heap) > 1:
        (a, i, few), (b, _, many) = heapq.heappop(heap), heapq.heappop(heap)
        for below, n, names in ((0, a, few), (a, b, many)):
            for g in names:
                found[g].append(Deal(below, n, a + b, round_size(a + b, a)))
        heapq.heappush(heap, (a + b, i, few + many))
    return found


def _dealt(deals: list[Deal], start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(first token, end token, place in the last stream) for tokens [start, end) of the first."""
    if not deals:
        yield start, end, start
        return
    for s, e, at in deals[0].places(start, end):
        for s2, e2, to in _dealt(deals[1:], at, at + e - s):
            yield s + s2 - at, s + e2 - at, to


def pack(
    spark: SparkSession, docs: DataFrame, size: int = 2048, path: str | None = None, end: int | None = 1, weights: Mapping[str, float] | None = None, key: str = "doc_id", text: str = "text", source: str = "source", with_ids: bool = False
) -> DataFrame:
    """One row for each piece of a document: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue.

    Each document's ids (whole text, then the end id) are encoded once and stored; its place in its
    source follows from the totals of (task, source), and the place of each piece from the closed form of the deficits,
    so no queue of any length passes through one task. Sources without a queue are dealt into the queue REST in
    proportion: first into groups of sources of about one size (a factor of two), then the groups into one.

    A null text is empty (its end id alone), a null source is a queue of its own kind ("\\x00null"). Repeated rows are
    packed each. Without an end id an empty text gives no piece. An empty table gives no piece. size is a power of two.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    path, folder = path or default_path(), shared_dir(spark)
    small_batches(spark)
    name = F.coalesce(F.col(source).cast("string"), F.lit("\x00null"))
    by_source = docs.select(name.alias("q"), F.octet_length(text).alias("b")).groupBy("q").agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    by_source = stored(by_source, f"{folder}/sources")
    whole = by_source.agg(F.sum("b")).first()[0] or 0
    own = frozenset(r["q"] for r in by_source.filter(F.col("b") * F.lit(MAX_QUEUES) >= F.lit(whole)).orderBy(F.desc("b"), "q").limit(MAX_QUEUES).collect()) | frozenset(weights or ())
    kind = docs.schema[key].dataType.simpleString()

    def encode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, had = TaskContext.get().partitionId(), {}
        for batch in batches:
            names = batch.column(2).to_pylist()
            for lo, hi, flat, at in encoded(batch, "t", path, end):
                n, raw = np.diff(at), flat.astype("<u4", copy=False).tobytes()
                before = np.empty(hi - lo, np.int64)
                for i, q in enumerate(names[lo:hi]):
                    before[i] = had.get(q, 0)
                    had[q] = int(before[i] + n[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([part] * (hi - lo), pa.int32()), pa.array(names[lo:hi], pa.string()), pa.array(before), pa.array(n), pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(raw)])], names=["k", "part", "source", "before", "n", "ids"]
                )
        encoder(path).forget()

    tokens = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), name.alias("q")).mapInArrow(tidy(encode_part), f"k {kind}, part int, source string, before long, n long, ids binary")
    tokens = stored(tokens, f"{folder}/tokens")

    part_totals = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = part_totals.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    by_source = part_totals.groupBy("source").agg(F.sum("n").alias("n"))
    named = F.col("source").isin(*own) if own else F.lit(False)
    totals = {r["source"]: r["n"] for r in by_source.filter(named).collect()}
    # Of the others only the totals of their groups come to the driver; each source's place in its group goes with its rows.
    others = by_source.filter(~named & (F.col("n") > 0)).withColumn("c", F.length(F.bin("n")))
    split = {r["c"]: -(-r["k"] // GROUP_SOURCES) for r in others.groupBy("c").agg(F.count(F.lit(1)).alias("k")).collect()}
    groups: dict[str, tuple[int, int]] = {}
    if split:
        parts = F.create_map(*(F.lit(x) for p in split.items() for x in p))[F.col("c")]
        others = others.withColumn("g", F.concat_ws(".", "c", F.pmod(F.xxhash64("source"), parts)))
        groups = {r["g"]: (r["n"], r["least"]) for r in others.groupBy("g").agg(F.sum("n").alias("n"), F.min("n").alias("least")).collect()}
        before = Window.partitionBy("g").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
        others = others.select("source", "g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"), F.col("n").alias("count"))
        others = stored(others, f"{folder}/others")
        bases = bases.join(F.broadcast(others) if others.count() <= 1_000_000 else others, "source", "left")
        totals[REST] = sum(n for n, _ in groups.values())
    else:
        bases = bases.select("*", F.lit(None).cast("string").alias("g"), F.lit(None).cast("long").alias("below"), F.lit(None).cast("long").alias("count"))
    deals = deal_groups({g: n for g, (n, _) in groups.items()})
    phases = make_phases(totals, size, weights)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = [Layout(p, size) for p in phases]
        at: dict[str, list[tuple[int, int, int, int]]] = {}
        for i, p in enumerate(phases):
            for j, q in enumerate(p.queues):
                at.setdefault(q, []).append((p.starts[j], p.starts[j] + p.counts[j], i, j))
        for batch in batches:
            ids = batch.column(3)
            raws = ids.to_pylist()
            counts = np.array([len(x) // 4 for x in raws], np.int64)
            row, start, length, crc, seq, off = [], [], [], [], [], []
            for r, (q, a, g, below, count) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 4, 5, 6)))):
                raw, n = raws[r], int(counts[r])
                if g is None:
                    runs = [(a, a + n, a)]
                elif n:
                    runs = _dealt([Deal(below, count, groups[g][0], round_size(*groups[g])), *deals[g]], a, a + n)
                else:
                    runs = []
                for first, last, b in runs:
                    m = last - first
                    for lo, hi, i, j in at.get(q, ()):
                        if lo < b + m and hi > b:
                            for s, e, sequence, offset in layouts[i].pieces(j, max(b, lo) - lo, min(b + m, hi) - lo):
                                s, e = s + lo - b + first - a, e + lo - b + first - a
                                row.append(r)
                                start.append(s)
                                length.append(e - s)
                                crc.append(zlib.crc32(raw[4 * s : 4 * e]))
                                seq.append(sequence)
                                off.append(offset)
            row = np.array(row, np.int64)
            out = {"k": batch.column(0).take(pa.array(row)), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": counts[row], "sequence_id": seq, "offset": off}
            long = {c: pa.array(v, pa.int64()) for c, v in out.items() if c != "k"}
            extra = {"queue": batch.column(1).take(pa.array(row))}
            if with_ids:
                extra["ids"] = pa.array([np.frombuffer(raws[r][4 * s : 4 * (s + n)], "<i4") for r, s, n in zip(row, start, length)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({"k": out["k"], **long, **extra})

    # One row for each task and queue; beyond what a broadcast may hold, Spark joins it by shuffle.
    small = bases.count() <= 1_000_000
    placed = tokens.join(F.broadcast(bases) if small else bases, ["source", "part"]).select(
        "k", F.when(F.col("g").isNull(), F.col("source")).otherwise(F.lit(REST)).alias("queue"), (F.col("base") + F.col("before")).alias("a"), "ids", "g", "below", "count"
    )
    pieces = placed.mapInArrow(tidy(cut), f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string" + ", ids array<int>" * with_ids)
    return pieces.withColumnRenamed("k", key)
