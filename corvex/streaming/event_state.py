"""Rate limits and idempotency claims of a stream in event time: the decisions of the batch form, whatever the order of arrival.

A key's requests wait in its state until the watermark has passed them, then are decided in order of time and request id. One
timer a key is set, at its first waiting request or, when none waits, at the time its state says nothing any more; so a
quiet key leaves no state. Requests behind the watermark are late: Spark drops them before the state, and they get no
decision and count for nothing.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corvex.streaming.limits import DEFAULT_LIMIT, EXPIRY_S, LIMITS, WINDOW_S, claim, decide

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = "request_id long, at double, detail string, outcome string"


class InOrder(StatefulProcessor):
    """Requests of a key in event-time order. A subclass decides one (`step`) over a state of its own, which it reads and writes whole."""

    columns = ("request_id", "key")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.timer = handle.getValueState("timer", "at long")
        self.known = handle.getValueState("known", self.kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            some = batch[["request_id", "at", "detail", "outcome"]]
            self.waiting.appendList(list(some.itertuples(index=False, name=None)))
            low = float(some["at"].min())
            first = low if first is None else min(first, low)
        if first is not None:
            self._set(first, True)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        self.timer.clear()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[1], r[0])) if self.waiting.exists() else []
        now, later = [r for r in rows if r[1] <= passed], [r for r in rows if r[1] > passed]
        state, out = self.read(), []
        for r in now:
            state, result = self.step(state, r)
            out.append((r[0], key[0], *result))
        if later:
            self.waiting.put(later)
        elif rows:
            self.waiting.clear()
        ends = self.ends(state)
        if ends is None or ends <= passed:
            self.known.clear()
            ends = None
        elif now:
            self.write(state)
        if later or ends is not None:
            self._set(later[0][1] if later else ends, False)
        if out:
            yield pd.DataFrame(out, columns=list(self.columns))

    def _set(self, at: float, sooner: bool) -> None:
        """The key's timer, if there is none or (sooner) a later one."""
        mark = int(at * 1000)
        if self.timer.exists():
            held = self.timer.get()[0]
            if held <= mark or not sooner:
                return
            self.handle.deleteTimer(held)
        self.handle.registerTimer(mark)
        self.timer.update((mark,))


class RateLimits(InOrder):
    kept = T.StructType([T.StructField("log", T.ArrayType(T.DoubleType()))])
    columns = ("request_id", "key", "allowed", "remaining", "retry_after")

    def __init__(self, limit: int | None):
        self.limit = limit

    def read(self) -> deque:
        return deque(self.known.get()[0]) if self.known.exists() else deque()

    def write(self, log: deque) -> None:
        self.known.update((list(log),))

    def step(self, log: deque, r: tuple) -> tuple[deque, tuple]:
        return log, decide(log, r[1], self.limit or LIMITS.get(r[2], DEFAULT_LIMIT))

    def ends(self, log: deque) -> float | None:
        return log[-1] + WINDOW_S if log else None


class Claims(InOrder):
    kept = T.StructType([T.StructField("hash", T.StringType()), T.StructField("status", T.StringType()), T.StructField("locked", T.DoubleType()), T.StructField("expires", T.DoubleType())])
    columns = ("request_id", "key", "result")

    def read(self) -> tuple | None:
        return tuple(self.known.get()) if self.known.exists() else None

    def write(self, state: tuple | None) -> None:
        if state is not None:
            self.known.update(state)

    def step(self, state: tuple | None, r: tuple) -> tuple[tuple, tuple]:
        state, result = claim(state, r[1], r[2], r[3])
        return state, (result,)

    def ends(self, state: tuple | None) -> float | None:
        # an expired claim still makes the next one "reclaimed", not "new": it is kept for as long again
        return state[3] + EXPIRY_S if state else None


def _run(requests: DataFrame, processor: InOrder, schema: str, detail: str, outcome, delay: str) -> DataFrame:
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the only one with several states a key
    timed = requests.withWatermark("ts", delay).select("request_id", F.col("key").cast("string"), F.col(detail).alias("detail"), outcome.alias("outcome"), F.col("ts").cast("timestamp").cast("double").alias("at"), "ts")
    return timed.groupBy("key").transformWithStateInPandas(processor, schema, "append", "EventTime")


def rate_limit_stream(requests: DataFrame, limit: int | None = None, delay: str = "10 minutes") -> DataFrame:
    """`limits.rate_limit` of a stream (request_id, key, profile, ts) that arrives at most `delay` out of order."""
    return _run(requests, RateLimits(limit), "request_id long, key string, allowed boolean, remaining int, retry_after int", "profile", F.lit(None).cast("string"), delay)


def idempotency_stream(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """`limits.idempotency` of a stream (request_id, key, request_hash, outcome, ts) that arrives at most `delay` out of order.

    A claim is forgotten two days after it was made: one day after it has expired.
    """
    return _run(requests, Claims(), "request_id long, key string, result string", "request_hash", F.col("outcome"), delay)
