"""Incremental work: what is new, the state of jobs from their events, and event-time windows, in batch and as streams."""

from __future__ import annotations

import pandas as pd
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from townledger.operators.ordered import running_sums

# The states of a job, after how long without an end it is run anew, and how often it is tried.
STATES = ("queued", "running", "done", "failed", "dead")
STALE_MS, MOST_ATTEMPTS = 900_000, 5

Job = tuple[str, int, int]


def pending(work: DataFrame, done: DataFrame, keys: list[str], digest: str = "digest") -> DataFrame:
    """Work whose key has no finished run with the same digest."""
    return work.join(done.select(*keys, digest).distinct(), [*keys, digest], "left_anti")


def enqueue(jobs: DataFrame, queue: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs to add: one for each key that has no queued or running job."""
    active = queue.filter(F.col("status").isin("queued", "running")).select(*keys)
    return jobs.dropDuplicates(keys).join(active, keys, "left_anti")


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key: one pass of partial maxima, no sort of a whole key."""
    rest = [c for c in events.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order))
    return events.groupBy(*keys).agg(top.alias("_e")).select(*keys, "_e.*")


def budget_cutoff(calls: DataFrame, group: str, order: str, cost: str, limit: float) -> DataFrame:
    """calls with allowed: whether what was spent before and the call's own cost stay within the limit."""
    return running_sums(calls, [group], [order], {"_spent": F.col(cost)}).withColumn("allowed", F.col("_spent") <= limit).drop("_spent")


def tumbling(events: DataFrame, at: str, width: str, *keys: str, watermark: str | None = None) -> DataFrame:
    """Counts and sums of value by windows; with a watermark for a stream."""
    e = events.withWatermark(at, watermark) if watermark else events
    return e.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, key: str, watermark: str | None = None) -> DataFrame:
    e = events.withWatermark(at, watermark) if watermark else events
    return e.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class JobState(StatefulProcessor):
    """The life of one job: what it is now is kept as state, and a claim sets a timer that puts a stale job back.

    State: status, attempts, and from when on it may run or since when it has run, in milliseconds.
    """

    def __init__(self, stale_ms: int, most: int) -> None:
        self.stale_ms, self.most = stale_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, attempts int, since long")

    def _put(self, job: Job) -> None:
        self.state.update(job)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job[0] == "running":
            self.handle.registerTimer(job[2] + self.stale_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job: Job = self.state.get() if self.state.exists() else ("queued", 0, -(1 << 62))
        events = pd.concat(list(rows), ignore_index=True)
        events = events.assign(ms=events["at"].astype("datetime64[ms]").astype("int64")).sort_values(["ms", "event"])
        for event, ms in zip(events["event"].tolist(), events["ms"].tolist(), strict=True):
            job = after(job, event, ms, self.most, self.stale_ms)
        self._put(job)
        yield pd.DataFrame({"job_id": [key[0]], "status": [job[0]], "attempts": [job[1]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, attempts, since = self.state.get()
        if status == "running" and since + self.stale_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self._put(("queued", attempts, since + self.stale_ms))
            yield pd.DataFrame({"job_id": [key[0]], "status": ["queued"], "attempts": [attempts]})

    def close(self) -> None:
        pass


def after(job: Job, event: str, ms: int, most: int = MOST_ATTEMPTS, stale_ms: int = STALE_MS) -> Job:
    """A job after an event at ms; an event that its state does not allow changes nothing.

    claim runs a queued job that may run by then, complete and fail_for_good end a running one, fail puts it back to wait (dead
    after the last attempt), release gives its attempt back, retry starts a dead one anew. A job that has run for stale_ms is
    queued again before the event counts.
    """
    status, attempts, since = job
    if status == "running" and ms >= since + stale_ms:
        status, since = "queued", since + stale_ms
    if event == "claim" and status == "queued" and since <= ms:
        return "running", attempts + 1, ms
    if event == "retry" and status == "dead":
        return "queued", 0, ms
    if status == "running":
        if event == "complete":
            return "done", attempts, ms
        if event == "fail_for_good":
            return "failed", attempts, ms
        if event == "fail":
            return ("dead", attempts, ms) if attempts >= most else ("queued", attempts, ms + 1000 * min(600, 5 * 2 ** (attempts - 1)))
        if event == "release":
            return "queued", attempts - 1, ms
    return status, attempts, since


def job_states(events: DataFrame, stale: int = STALE_MS, most: int = MOST_ATTEMPTS, late: str = "600 seconds") -> DataFrame:
    """A stream of (job_id, status, attempts) from one of (job_id, event, at): the state of each job after a batch with events of it, or after its timer.

    Events may come late by the time given; what a job's own events say of stale runs does not wait for the timer. State is three
    values and at most one timer a job, in a RocksDB state store, which the session must name as its provider.
    """
    seen = events.withWatermark("at", late)
    return seen.groupBy("job_id").transformWithStateInPandas(JobState(stale, most), "job_id long, status string, attempts int", "update", "EventTime")
