"""Structured Streaming forms of the queue, the state machine and the limiter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.workqueue import MAX_ATTEMPTS, _seconds


def deduplicated(jobs: DataFrame, key: str, at: str, delay: str = "10 minutes") -> DataFrame:
    """At most one row a key within the watermark: a job that is queued again is the same job."""
    return jobs.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def rate_limiter(requests: DataFrame, key: str, at: str, tie: str, window: float, limit: int, delay: str | None = None) -> DataFrame:
    """(key, tie, allowed): a request counts if fewer than ``limit`` counted ones lie within the window before it. State: those alone.

    With ``delay`` (``at`` is a timestamp) requests later than that are left out, and a key's state goes when the watermark
    has passed its last request by the window; without, state stays and requests are judged batch by batch as they come.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        live = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(list(dict.fromkeys((at, tie))))
        out = []
        for t, i in zip(rows[at], rows[tie], strict=True):
            live = [x for x in live if x > t - window]
            ok = len(live) < limit
            if ok:
                live.append(t)
            out.append((k[0], i, ok))
        state.update((live,))
        if delay:
            state.setTimeoutTimestamp(max(int((max(rows[at]) + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, tie, "allowed"])

    kinds = {c: requests.schema[c].dataType.simpleString() for c in (key, tie)}
    rows = requests.withWatermark(at, delay).select(key, F.col(at).alias("_at"), _seconds(requests, at).alias(at), tie) if delay else requests.select(key, _seconds(requests, at).alias(at), tie)
    timeout = GroupStateTimeout.EventTimeTimeout if delay else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{tie}` {kinds[tie]}, allowed boolean", "live array<double>", "append", timeout)


def status_machine(moves: DataFrame, key: str, at: str, tie: str, state_col: str, allowed: dict[str, list[str]]) -> DataFrame:
    """(key, tie, from_state, to_state, legal): an illegal move leaves the state as it is. A key's first state is taken as it comes."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(list(dict.fromkeys((at, tie))))
        out = []
        for i, to in zip(rows[tie], rows[state_col], strict=True):
            legal = now is None or to in allowed.get(now, [])
            out.append((k[0], i, now, to, legal))
            now = to if legal else now
        state.update((now,))
        yield pd.DataFrame(out, columns=[key, tie, "from_state", "to_state", "legal"])

    kinds = {c: moves.schema[c].dataType.simpleString() for c in (key, tie)}
    return moves.select(*dict.fromkeys((key, at, tie, state_col))).groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{tie}` {kinds[tie]}, from_state string, to_state string, legal boolean", "now string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, kind: str, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts by tumbling or sliding window; late rows beyond the watermark are left out."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, delay).groupBy(w, kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "90 seconds", delay: str = "10 minutes") -> DataFrame:
    """Runs of heartbeats of a key without a longer gap."""
    return events.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def route_attempts(jobs: DataFrame, attempt: str, done: str, dead: str, process: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A started query: each batch is processed and written once by its number; jobs tried too often go to the dead letters."""

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        process(batch.filter(F.col(attempt) <= MAX_ATTEMPTS)).write.mode("overwrite").parquet(f"{done}/batch={number}")
        batch.filter(F.col(attempt) > MAX_ATTEMPTS).write.mode("overwrite").parquet(f"{dead}/batch={number}")
        batch.unpersist()

    return jobs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
