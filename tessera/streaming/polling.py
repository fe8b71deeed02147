"""Streams: the batch-job poll state machine and an append-only journal."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STALL_SECONDS, DETACH_SECONDS, MAX_ERRORS = 3600, 4 * 3600, 10
STATE = "started double, done long, moved double, errors int, outcome string"
OUT = "job string, at timestamp, outcome string, done long, errors int"


def step(state: tuple, at: float, status: str, done: int) -> tuple:
    """One poll: (started, done, moved_at, errors, outcome) -> the same. An outcome is final.

    ended, failed, expired and canceled come from the poll; else too many errors in a row give
    poll_failed, no progress for STALL_SECONDS stalled, and DETACH_SECONDS in all detached."""
    started, best, moved, errors, outcome = state
    if outcome:
        return state
    if status == "error":
        errors += 1
        return started, best, moved, errors, "poll_failed" if errors >= MAX_ERRORS else ""
    errors = 0
    if done > best:
        best, moved = done, at
    if status in ("ended", "failed", "expired", "canceled"):
        return started, best, moved, errors, status
    if at - moved >= STALL_SECONDS:
        return started, best, moved, errors, "stalled"
    if at - started >= DETACH_SECONDS:
        return started, best, moved, errors, "detached"
    return started, best, moved, errors, ""


def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A job's polls in order. A job that no poll reaches for STALL_SECONDS of the clock is stalled (detached if it
    has run for DETACH_SECONDS). A finished job's state is kept for DETACH_SECONDS, against late polls, then goes."""
    now = tuple(state.get) if state.exists else None
    if state.hasTimedOut:
        if now is None or now[4]:
            state.remove()
            return
        at = state.getCurrentProcessingTimeMs() / 1000 if hasattr(state, "getCurrentProcessingTimeMs") else time.time()
        now = (*now[:4], "detached" if at - now[0] >= DETACH_SECONDS else "stalled")
        yield pd.DataFrame({"job": [key[0]], "at": [pd.Timestamp(at, unit="s")], "outcome": [now[4]], "done": [now[1]], "errors": [now[3]]})
    for pdf in batches:
        for r in pdf.sort_values("at").itertuples():
            at = r.at.timestamp()
            before = now or (at, -1, at, 0, "")
            now = step(before, at, r.status, int(r.done))
            if now[4] and not before[4]:
                yield pd.DataFrame({"job": [key[0]], "at": [r.at], "outcome": [now[4]], "done": [now[1]], "errors": [now[3]]})
    if now is not None:
        state.update(now)
        state.setTimeoutDuration(1000 * (DETACH_SECONDS if now[4] else STALL_SECONDS))


def poll_outcomes(polls: DataFrame) -> DataFrame:
    """A stream of (job, at, status, done) polls -> one row when a job reaches its outcome."""
    return polls.groupBy("job").applyInPandasWithState(watch, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def journal(events: DataFrame, at: str = "at", delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts of a journal stream by event window and level, with late events up to ``delay`` (an addition)."""
    return events.withWatermark(at, delay).groupBy(F.window(at, window), "level").agg(F.count("*").alias("n"))
