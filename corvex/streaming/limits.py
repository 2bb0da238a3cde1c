"""Keyed state over time: sliding-window rate limits and idempotency claims, in batch and as streams.

A key's decisions depend on the ones before, so a key's requests are read in order by one task; what it keeps of a key is
bounded (the limit's log, one claim), and rows stream through without gathering a group.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMITS = {"reasoning": 10, "fast": 30, "balanced": 30, "local": 30}
DEFAULT_LIMIT, WINDOW_S = 120, 60
LOCK_S, EXPIRY_S = 15 * 60, 24 * 3600


def decide(log: deque, now: float, limit: int, window: float = WINDOW_S) -> tuple[bool, int, int]:
    """(allowed, remaining, retry after) of a request at `now`; the log keeps allowed requests only."""
    while log and log[0] <= now - window:
        log.popleft()
    if len(log) >= limit:
        return False, 0, max(int(window - (now - log[0])), 1)
    log.append(now)
    return True, max(limit - len(log), 0), 0


def rate_limit(requests: DataFrame, limit: int | None = None) -> DataFrame:
    """request_id, key, allowed, remaining and retry_after for requests (request_id, key, profile, ts), in time order within a key."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, log = None, deque()
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.key != key:
                    key, log = r.key, deque()
                out.append((r.request_id, r.key, *decide(log, r.at, limit or LIMITS.get(r.profile, DEFAULT_LIMIT))))
            yield pd.DataFrame(out, columns=["request_id", "key", "allowed", "remaining", "retry_after"])

    timed = requests.select("request_id", "key", "profile", F.col("ts").cast("timestamp").cast("double").alias("at"))
    return timed.repartition("key").sortWithinPartitions("key", "at", "request_id").mapInPandas(fold, "request_id long, key string, allowed boolean, remaining int, retry_after int")


def rate_limit_stream(requests: DataFrame, limit: int | None = None) -> DataFrame:
    """The same decisions over a stream of requests; a key's log is its state, dropped when it has been quiet for a window."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0]) if state.exists else deque()
        out = []
        for r in pd.concat(list(batches)).sort_values(["at", "request_id"]).itertuples():
            out.append((r.request_id, key[0], *decide(log, r.at, limit or LIMITS.get(r.profile, DEFAULT_LIMIT))))
        state.update((list(log),))
        state.setTimeoutDuration(WINDOW_S * 1000)
        yield pd.DataFrame(out, columns=["request_id", "key", "allowed", "remaining", "retry_after"])

    timed = requests.select("request_id", "key", "profile", F.col("ts").cast("timestamp").cast("double").alias("at"))
    return timed.groupBy("key").applyInPandasWithState(fold, "request_id long, key string, allowed boolean, remaining int, retry_after int", "log array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def claim(state: tuple | None, now: float, request_hash: str, outcome: str) -> tuple[tuple, str]:
    """The next state (hash, status, locked at, expires) of a key and what its request meets: new, reclaimed, replay or conflict."""
    if state is None or state[3] <= now:
        return (request_hash, outcome, now, now + EXPIRY_S), "new" if state is None else "reclaimed"
    known, status, locked, _ = state
    if known != request_hash:
        return state, "conflict"
    if status == "failed" or (status == "in_progress" and now - locked >= LOCK_S):
        return (request_hash, outcome, now, now + EXPIRY_S), "reclaimed"
    return state, "replay" if status == "completed" else "conflict"


def idempotency(requests: DataFrame) -> DataFrame:
    """request_id and result of each claim (request_id, key, request_hash, outcome, ts), in time order within a key."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.key != key:
                    key, state = r.key, None
                state, result = claim(state, r.at, r.request_hash, r.outcome)
                out.append((r.request_id, result))
            yield pd.DataFrame(out, columns=["request_id", "result"])

    timed = requests.select("request_id", "key", "request_hash", "outcome", F.col("ts").cast("timestamp").cast("double").alias("at"))
    return timed.repartition("key").sortWithinPartitions("key", "at", "request_id").mapInPandas(fold, "request_id long, result string")


def respond(requests: DataFrame, execute: Callable[[DataFrame], Column], replay: Callable[[Column, DataFrame], Column] | None = None, resource_id: Callable[[Column], Column] | None = None) -> DataFrame:
    """request_id, result, response and resource_id of each claim (as `idempotency`).

    A new or reclaimed request is executed: `execute` makes its response from the request's columns. A replay gets the
    response of the request that holds the claim, passed through `replay`, if one is given; a conflict gets none, and so does
    a request whose outcome is not completed. `resource_id` reads the resource's id from a response. The callbacks give columns.
    """
    decided = requests.join(idempotency(requests), "request_id")
    done = F.col("result").isin("new", "reclaimed")
    own = decided.withColumn("__done", done).withColumn("__own", F.when(done & (F.col("outcome") == "completed"), execute(decided)))
    order = Window.partitionBy("key").orderBy(F.col("ts").cast("timestamp"), "request_id").rowsBetween(Window.unboundedPreceding, 0)
    held = own.withColumn("__held", F.last(F.when(F.col("__done"), F.struct(F.col("__own").alias("response"))), ignorenulls=True).over(order)["response"])
    again = replay(F.col("__held"), held) if replay else F.col("__held")
    answered = held.withColumn("response", F.when(F.col("__done"), F.col("__own")).when(F.col("result") == "replay", again))
    return answered.select("request_id", "result", "response", (resource_id(F.col("response")) if resource_id else F.lit(None).cast("string")).alias("resource_id"))
