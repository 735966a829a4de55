"""Queues, leases, status machines and limits over tables; ``dossierlake.streaming`` has the same over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of an application in the order of a work list.
STATUS_ORDER = ["READY_FOR_REVIEW", "NEEDS_INFORMATION", "PROCESSING", "QUEUED", "UPLOADED", "FAILED", "REVIEWED", "CANCELLED"]
MAX_ATTEMPTS, SLOTS, SLOT_SECONDS, LEASE_SECONDS = 3, 2, 900, 90


def priority(status: Column | str) -> Column:
    """0 to 7 by status, 9 for others."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(STATUS_ORDER) for x in (s, i)]), F.col(status) if isinstance(status, str) else status), F.lit(9))


def work_list(rows: DataFrame, status: str, created: str, key: str, limit: int) -> DataFrame:
    """The first rows by priority, the newest first; a top-k, not a full sort."""
    return rows.orderBy(priority(status), F.desc(created), key).limit(limit)


def claimable(rows: DataFrame, status: str, locked_until: str, now: Column, reclaim: bool = True) -> DataFrame:
    """Pending and dispatched rows whose lease is over or missing; with ``reclaim`` also those in work under a lapsed lease."""
    free = F.col(locked_until).isNull() | (F.col(locked_until) < now)
    states = ["PENDING", "DISPATCHED"] + ["PROCESSING"] * reclaim
    return rows.filter(F.col(status).isin(states) & free & ((F.col(status) != "PROCESSING") | F.col(locked_until).isNotNull()))


def claim(rows: DataFrame, status: str, locked_until: str, created: str, key: str, now: Column, limit: int, lease: int = LEASE_SECONDS) -> DataFrame:
    """``rows`` after the oldest ``limit`` claimable ones have been taken under a lease."""
    taken = claimable(rows, status, locked_until, now).orderBy(created, key).limit(limit).select(F.col(key).alias("_k"))
    mine = F.col("_k").isNotNull()
    return rows.join(F.broadcast(taken), F.col(key) == F.col("_k"), "left").select(  # limit bounds it
        *[F.when(mine, "PROCESSING").otherwise(F.col(c)).alias(c) if c == status else F.when(mine, now + F.make_interval(secs=F.lit(lease))).otherwise(F.col(c)).alias(c) if c == locked_until else F.col(c) for c in rows.columns]
    )


def settled(rows: DataFrame, key: str, status: str, locked_until: str, retries: str, outcomes: DataFrame, now: Column) -> DataFrame:
    """``rows`` after ``outcomes`` (key, outcome, seconds), one a job: ack completes it, retry puts it back and fail ends it, both with a try more;
    extend gives its lease ``seconds`` from now. Jobs without an outcome stay as they are."""
    told = outcomes.select(F.col(key).alias("_k"), F.col("outcome").alias("_o"), F.col("seconds").alias("_s"))
    o = F.col("_o")
    new = {
        status: F.when(o == "ack", "COMPLETED").when(o == "retry", "PENDING").when(o == "fail", "FAILED").otherwise(F.col(status)),
        locked_until: F.when(o == "extend", now + F.make_interval(secs=F.col("_s"))).when(~F.coalesce(o.isin("ack", "retry", "fail"), F.lit(False)), F.col(locked_until)),
        retries: F.when(o.isin("retry", "fail"), F.col(retries) + 1).otherwise(F.col(retries)),
    }
    return rows.join(told, F.col(key) == F.col("_k"), "left").select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])


def after_publish(rows: DataFrame, published: str, status: str, retries: str, most: int = MAX_ATTEMPTS) -> DataFrame:
    """PENDING rows after a publishing attempt (boolean column; null: not tried): PUBLISHED, or a retry more, or FAILED at the last one."""
    tried = (F.col(status) == "PENDING") & F.col(published).isNotNull()
    more = F.col(retries) + 1
    new = F.when(tried & F.col(published), "PUBLISHED").when(tried & (more >= most), "FAILED").otherwise(F.col(status))
    return rows.select(*[new.alias(c) if c == status else F.when(tried & ~F.col(published), more).otherwise(F.col(c)).alias(c) if c == retries else F.col(c) for c in rows.columns if c != published])


def transitions(rows: DataFrame, key: str, at: str, tie: str, state: str) -> DataFrame:
    """Each row with the state before it."""
    return rows.withColumn("from_state", F.lag(state).over(Window.partitionBy(key).orderBy(at, tie)))


def illegal(moves: DataFrame, state: str, allowed: dict[str, list[str]]) -> DataFrame:
    """Moves from a state to one that it doesn't allow."""
    table = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return moves.filter(F.col("from_state").isNotNull() & ~F.coalesce(F.array_contains(F.element_at(table, F.col("from_state")), F.col(state)), F.lit(False)))


def merge_history(existing: Column, new: Column) -> Column:
    """The existing entries and then the new ones that aren't among them."""
    return F.concat(existing, F.filter(new, lambda x: ~F.array_contains(existing, x)))


def merge_rows(existing: DataFrame, new: DataFrame, key: str, entry: str) -> DataFrame:
    """``merge_history`` of rows: the existing ones and the new ones of which the key's existing ones don't have the entry. Nulls are equal."""
    have = existing.select(F.col(key).alias("_k"), F.col(entry).alias("_e")).distinct()
    return existing.unionByName(new.join(have, F.col(key).eqNullSafe(F.col("_k")) & F.col(entry).eqNullSafe(F.col("_e")), "left_anti"))


def admit(times: list[float], window: float, limit: int) -> list[tuple[bool, int, int]]:
    """(allowed, remaining, retry_after) of requests in order: a request counts only if it was allowed."""
    live: list[float] = []
    out = []
    for t in times:
        live = [x for x in live if x > t - window]
        if len(live) >= limit:
            out.append((False, 0, max(1, int(live[0] + window - t) + 1)))
        else:
            live.append(t)
            out.append((True, limit - len(live), 0))
    return out


def _seconds(rows: DataFrame, at: str) -> Column:
    """A time as seconds; a number as it is."""
    return F.col(at).cast("timestamp").cast("double") if rows.schema[at].dataType.typeName().startswith("timestamp") else F.col(at).cast("double")


def rate_limited(rows: DataFrame, key: str, at: str, tie: str, window: float, limit: int) -> DataFrame:
    """``key, tie, allowed, remaining, retry_after``. Whether a request counts depends on all before it, so a key's requests are taken in order.

    A key's requests go through one task, sorted by Spark and streamed: only the ``limit`` live ones are held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, live = object(), []
        for df in batches:
            out = []
            for k, i, t in zip(df["k"], df["i"], df["t"], strict=True):
                if k != owner:
                    owner, live = k, []
                live = [x for x in live if x > t - window]
                if len(live) >= limit:
                    out.append((k, i, False, 0, max(1, int(live[0] + window - t) + 1)))
                else:
                    live.append(t)
                    out.append((k, i, True, limit - len(live), 0))
            yield pd.DataFrame(out, columns=[key, tie, "allowed", "remaining", "retry_after"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, tie)}
    ordered = rows.select(F.col(key).alias("k"), F.col(tie).alias("i"), _seconds(rows, at).alias("t")).repartition("k").sortWithinPartitions("k", "t", "i")
    return ordered.mapInPandas(run, f"`{key}` {kinds[key]}, `{tie}` {kinds[tie]}, allowed boolean, remaining int, retry_after int")


def slots(rows: DataFrame, key: str, at: str, job: str, action: str, most: int = SLOTS, ttl: float = SLOT_SECONDS) -> DataFrame:
    """``key, job, granted`` for each request of a job slot: at most ``most`` live ones a key; releases and lapses free them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, held = object(), {}
        for df in batches:
            out = []
            for k, j, t, a in zip(df["k"], df["j"], df["t"], df["a"], strict=True):
                if k != owner:
                    owner, held = k, {}
                held = {x: s for x, s in held.items() if s > t - ttl}
                if a == "release":
                    held.pop(j, None)
                    continue
                ok = j in held or len(held) < most
                if ok:
                    held[j] = t
                out.append((k, j, ok))
            yield pd.DataFrame(out, columns=[key, job, "granted"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, job)}
    ordered = rows.select(F.col(key).alias("k"), F.col(job).alias("j"), _seconds(rows, at).alias("t"), F.col(action).alias("a")).repartition("k").sortWithinPartitions("k", "t", "j")
    return ordered.mapInPandas(run, f"`{key}` {kinds[key]}, `{job}` {kinds[job]}, granted boolean")
