"""Rates and budgets: audits of event tables, schedules, and the limiters that call tasks use."""

from __future__ import annotations

import threading
import time
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.config import Settings
from tagmill.functions.text import duration_text


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def sliding_window(events: DataFrame, ts: str, seconds: float, tokens: str | None = None, by: list[str] | None = None) -> DataFrame:
    """events with n_window and tokens_window: what lies in the half-open window that ends with the event.

    An event leaves when its age reaches the window. Events of one instant see each other. by: independent limiters. Time is
    cut into spans as long as the window; an event counts in its own span and in the next, so each span of each limiter is
    a partition and a single limiter over all events is many tasks. A window is the rest of the span before, after the place
    in it that the event has in its own, and its own span up to the event. Both are running sums, from one end of a span each:
    a frame that moves at both ends is summed anew for each instant. Nothing is subtracted, so sums of doubles keep their digits."""
    width = int(seconds * 1e6)
    cols, keys = [f"_c{i}" for i in range(len(events.columns))], [f"_k{i}" for i in range(len(by or []))]
    # names of our own, one column each: none clashes, and what the caller drops is never read
    flat = events.select("*", *(F.col(c) for c in by or []), micros(F.col(ts)), F.col(tokens) if tokens else F.lit(0)).toDF(*cols, *keys, "_us", "_tokens")
    placed = flat.withColumn("_at", F.pmod("_us", F.lit(width))).withColumn("_begin", F.col("_us") - F.col("_at"))
    # a null instant is in no window but that of its own kind
    there = placed.withColumn("_span", F.explode(F.when(F.col("_begin").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(F.col("_begin"), F.col("_begin") + F.lit(width)))))
    own = F.col("_begin").eqNullSafe(F.col("_span"))
    there = there.select(*keys, "_span", "_at", "_tokens", own.alias("_own"), *(F.when(own, F.col(c)).alias(c) for c in cols))
    span = Window.partitionBy(*keys, "_span")
    later = span.orderBy(F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, -1)
    seen = there.withColumns({"_n0": F.count(F.when(~F.col("_own"), 1)).over(later), "_t0": F.sum(F.when(~F.col("_own"), F.col("_tokens"))).over(later)}).filter("_own")
    upto = span.orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumns({"_n1": F.count(F.lit(1)).over(upto), "_t1": F.sum("_tokens").over(upto)})
    total = F.coalesce(F.col("_t0") + F.col("_t1"), "_t0", "_t1").cast(seen.schema["_t1"].dataType)
    return seen.select(*cols, F.col("_n0") + F.col("_n1"), total).toDF(*events.columns, "n_window", "tokens_window")


def cycle(ts: Column, anchor: Column, seconds: float) -> Column:
    """Number of the tumbling cycle, from 1, aligned to the anchor across idle cycles."""
    return (F.lit(1) + F.floor((micros(ts) - micros(anchor)) / F.lit(int(seconds * 1e6)))).cast("long")


def cycle_usage(events: DataFrame, ts: str, status: str, seconds: float) -> DataFrame:
    """cycle, n_success, n_reserved, n_counted; the anchor is the first event. Failures free their place."""
    anchor = events.agg(F.min(ts).alias("_anchor"))  # one row
    numbered = events.crossJoin(F.broadcast(anchor)).withColumn("cycle", cycle(F.col(ts), F.col("_anchor"), seconds))
    used = numbered.groupBy("cycle").agg(F.count_if(F.col(status) == "success").alias("n_success"), F.count_if(F.col(status) == "reserved").alias("n_reserved"))
    return used.withColumn("n_counted", F.col("n_success") + F.col("n_reserved"))


def window_capacity(max_requests: int, max_tokens: int, tokens_per_request: int) -> int:
    """Requests a window admits; 0 means no limit. Every request costs the same, so tokens are requests."""
    limits = [x for x in (max_requests, max_tokens // tokens_per_request if max_tokens else 0) if x]
    return min(limits, default=0)


def admission(index: Column, capacity: int, seconds: float) -> Column:
    """When the request of that place (from 0) in a burst is admitted."""
    return F.floor(index / F.lit(capacity)) * F.lit(seconds) if capacity else F.lit(0.0)


@dataclass(frozen=True)
class Plan:
    """How the shared budgets are dealt out: every call task gets an equal part of the window's requests."""

    tasks: int
    per_task: int  # requests a window, 0: no limit
    seconds: float
    chunk: int  # items of one committed chunk
    cycle_seconds: float
    cycle_calls: int

    @classmethod
    def of(cls, s: Settings, chunk: int = 2000) -> Plan:
        capacity = window_capacity(s.window_requests, s.window_tokens, s.tokens_per_call)
        if s.window_tokens and s.tokens_per_call > s.window_tokens:
            raise ValueError("a single call needs more tokens than a window has")
        tasks = min(s.workers, capacity) if capacity else s.workers
        return cls(tasks, capacity // tasks if capacity else 0, s.rate_limit_window, min(chunk, s.cycle_max_calls) if s.cycle_max_calls else chunk, s.cycle_duration, s.cycle_max_calls)

    def describe(self) -> str:
        rate = f"{self.per_task} calls per task in {duration_text(self.seconds)}" if self.per_task else "no rate limit"
        return f"{self.tasks} tasks, {rate}" + (f", {self.cycle_calls} successes in {duration_text(self.cycle_seconds)}" if self.cycle_calls else "")


class SlidingLimiter:
    """At most n admissions in any window; threads of one task share it."""

    def __init__(self, n: int, seconds: float, clock=time.monotonic, sleep=time.sleep):
        self.n, self.seconds, self.clock, self.sleep = n, seconds, clock, sleep
        self.lock, self.times = threading.Lock(), deque()

    def acquire(self, stop=lambda: False) -> bool:
        """False if stopped while waiting."""
        if not self.n:
            return not stop()
        while not stop():
            with self.lock:
                now = self.clock()
                while self.times and now - self.times[0] >= self.seconds:
                    self.times.popleft()
                if len(self.times) < self.n:
                    self.times.append(now)
                    return True
                wait = self.seconds - (now - self.times[0])
            self.sleep(min(max(wait, 0.001), 0.2))
        return False


class CycleBudget:
    """The driver's view of the cycle limit: how many calls the current cycle still admits.

    State is a small dict (anchor, cycle, counted) that the caller keeps beside the ledger, so a restart goes on where the
    last run stopped: calls that were begun and never settled count until their cycle ends."""

    def __init__(self, seconds: float, calls: int, state: dict | None = None, clock=time.time):
        self.seconds, self.calls, self.clock = seconds, calls, clock
        self.state = dict(state or {})

    def _roll(self) -> None:
        now = self.clock()
        if "anchor" not in self.state:
            self.state = {"anchor": now, "cycle": 1, "success": 0, "reserved": 0}
        at = 1 + int((now - self.state["anchor"]) // self.seconds)
        if at > self.state["cycle"]:
            self.state |= {"cycle": at, "success": 0, "reserved": 0}

    def free(self) -> int:
        if not self.calls:
            return 1 << 31
        self._roll()
        return self.calls - self.state["success"] - self.state["reserved"]

    def wait(self) -> float:
        """Seconds until the next cycle."""
        self._roll()
        return self.state["anchor"] + self.state["cycle"] * self.seconds - self.clock()

    def reserve(self, n: int) -> int:
        if self.calls:
            self._roll()
            self.state["reserved"] += n
        return self.state.get("cycle", 0)

    def settle(self, n: int, successes: int, cycle: int) -> None:
        """Reservations of an earlier cycle have ended with it."""
        if self.calls:
            self._roll()
            if cycle == self.state["cycle"]:
                self.state["reserved"] -= n
                self.state["success"] += successes
