"""Deduplication, circuit breaking, holding and rate limiting over recorded message streams.

Times are microseconds. Decisions that depend on earlier decisions run as ordered folds, whose
small states cross partition borders; counts over time ranges are plain Spark.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..effects import SECOND, BreakerEffect, Bucket, BucketEffect, DedupeEffect
from ..functions import fixed
from ..scale import Fold, ordered_fold, ranked, running_sum, trailing
from ..session import durable


@dataclass(frozen=True)
class BreakerOptions:
    threshold: float = fixed.BREAKER_THRESHOLD
    window: int = fixed.BREAKER_WINDOW_S * SECOND
    half_open: int = fixed.BREAKER_HALF_OPEN_S * SECOND
    min_events: int = fixed.BREAKER_MIN_EVENTS


def _out(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


# columns that the folds add
DEDUPE_OUT = _out(("is_duplicate", T.BooleanType()))
BREAKER_OUT = _out(("on_arrival", T.StringType()), ("state", T.StringType()), ("trip", T.BooleanType()))
BUCKET_OUT = _out(("passed", T.BooleanType()))
LIMIT_OUT = _out(("allowed", T.BooleanType()))
PATH_OUT = _out(("outcome", T.StringType()))


# ---- dedupe -----------------------------------------------------------------------

def seen_before(first: int | None, t: int, ttl: int) -> bool:
    """Whether an id first seen at ``first`` is still remembered at ``t``."""
    return first is not None and t - first <= ttl


def dedupe_fold(time: str, ttl: int) -> Fold:
    """State: first sighting of the id."""
    def fold(first: int | None, rows: pd.DataFrame) -> tuple[dict, int | None]:
        flags = []
        for t in rows[time].tolist():
            dup = seen_before(first, t, ttl)
            if not dup:
                first = t
            flags.append(dup)
        return {"is_duplicate": flags}, first

    return fold


def dedupe_ttl(messages: DataFrame, msg_id: str = "msg_id", time: str = "t", tie: str = "event_id",
               ttl: int = fixed.DEDUPE_TTL_S * SECOND, partitions: int | None = None) -> DataFrame:
    """``is_duplicate``: the id was first seen no more than ``ttl`` ago. Null and empty ids are never duplicates."""
    has_id = F.coalesce(F.col(msg_id).cast("string") != "", F.lit(False))
    named = messages.filter(has_id)
    made = ordered_fold(named, F.col(msg_id), [time, tie], dedupe_fold(time, ttl), lambda: None, DEDUPE_OUT, partitions, DedupeEffect(time, ttl))
    unnamed = messages.filter(~has_id).withColumn("is_duplicate", F.lit(False))
    return made.unionByName(unnamed)


# ---- breaker ------------------------------------------------------------------------

def window_error_rate(outcomes: DataFrame, key: str, time: str, failed: str, window: int = fixed.BREAKER_WINDOW_S * SECOND,
                      min_events: int = fixed.BREAKER_MIN_EVENTS) -> DataFrame:
    """Outcomes, failures and error rate of the trailing window; the rate is null below ``min_events``."""
    out = trailing(outcomes, [key], time, window, {"events": F.lit(1), "failures": F.col(failed).cast("int")})
    return out.withColumn("error_rate", F.when(F.col("events") >= min_events, F.col("failures") / F.col("events")))


def breaker_step(mode: str, tripped: int, t: int, half_open: int) -> str:
    """State on looking at the breaker at ``t``: an open breaker becomes half open after a while."""
    return "half_open" if mode == "open" and t - tripped >= half_open else mode


def new_breaker() -> tuple:
    return ("closed", 0)


def breaker_fold(time: str, failed: str, options: BreakerOptions) -> Fold:
    """State: mode and, unless closed, trip time. Rows carry the trip condition as ``__full``."""
    def fold(state: tuple, rows: pd.DataFrame) -> tuple[dict, tuple]:
        mode, tripped = state
        before, after, trip = [], [], []
        for t, bad, full in zip(rows[time].tolist(), rows[failed].tolist(), rows["__full"].tolist()):
            mode = breaker_step(mode, tripped, t, options.half_open)
            before.append(mode)
            opens = (mode == "half_open" and bad) or (mode == "closed" and full)
            if opens:
                mode, tripped = "open", t
            elif mode == "half_open":
                mode, tripped = "closed", 0
            after.append(mode)
            trip.append(bool(opens))
        return {"on_arrival": before, "state": after, "trip": trip}, (mode, tripped)

    return fold


def circuit_breaker(outcomes: DataFrame, key: str, time: str, tie: str, failed: str, options: BreakerOptions = BreakerOptions(),
                    bucket: int = 60 * SECOND, partitions: int | None = None) -> DataFrame:
    """Breaker of each outcome: state ``on_arrival``, ``state`` after it, ``trip`` and the number of ``trips`` so far.

    The trip condition is a window count and needs no state; the fold keeps mode and trip time.
    Outcomes during an open breaker only enter the window.
    """
    rated = window_error_rate(outcomes, key, time, failed, options.window, options.min_events)
    rated = rated.withColumn("__full", F.coalesce(F.col("error_rate") >= options.threshold, F.lit(False)))
    rated = rated.drop("events", "failures", "error_rate")
    made = ordered_fold(rated, F.col(key), [time, tie], breaker_fold(time, failed, options), new_breaker, BREAKER_OUT, partitions,
                        BreakerEffect(time, failed, options.half_open))
    # read twice below, so that the fold is not run twice
    made = durable(made.drop("__full"))
    return running_sum(made, [key], [time, tie], F.floor(F.col(time) / bucket), F.col("trip").cast("int"), "trips")


def hold_while_open(stated: DataFrame, key: str, time: str, tie: str, capacity: int = fixed.HOLD_CAPACITY,
                    bucket: int = 60 * SECOND) -> DataFrame:
    """Messages that arrive at an open breaker: ``held`` up to the capacity, later ones ``overflow``.

    The buffer is drained when the breaker closes, so the capacity counts per trip.
    """
    waiting = durable(stated.filter(F.col("on_arrival") == "open"))
    numbered = ranked(waiting, [key, "trips"], [time, tie], F.floor(F.col(time) / bucket), "position")
    return numbered.withColumn("status", F.when(F.col("position") <= capacity, "held").otherwise("overflow"))


# ---- limiters ------------------------------------------------------------------------

def bucket_of(rate_hz: float, compat: bool = False) -> Bucket:
    """It holds ``max(rate, 1)`` tokens, ``rate`` with ``compat``."""
    return Bucket(rate_hz, rate_hz if compat else max(rate_hz, 1.0))


def bucket_fold(time: str, bucket: Bucket) -> Fold:
    """State: credit left and time of the last message."""
    def fold(state: tuple, rows: pd.DataFrame) -> tuple[dict, tuple]:
        credit, last = state
        passed = []
        for t in rows[time].tolist():
            ok, credit = bucket.take(credit, last, t)
            last = t
            passed.append(ok)
        return {"passed": passed}, (credit, last)

    return fold


def token_bucket(messages: DataFrame, key: str, time: str, tie: str, rate_hz: float, compat: bool = False,
                 partitions: int | None = None) -> DataFrame:
    """``passed``: a token was left. The bucket holds ``max(rate, 1)`` tokens, ``rate`` with ``compat``."""
    bucket = bucket_of(rate_hz, compat)
    return ordered_fold(messages, F.col(key), [time, tie], bucket_fold(time, bucket), lambda: (bucket.full, None), BUCKET_OUT, partitions, BucketEffect(time, bucket))


def limit_fold(time: str, cost: str, limit: int, window: int) -> Fold:
    """State: recorded hits of the window, at most the limit and one cost more."""
    def fold(state: tuple, rows: pd.DataFrame) -> tuple[dict, tuple]:
        hits = deque(state)
        used = sum(n for _, n in hits)
        allowed = []
        for t, c in zip(rows[time].tolist(), rows[cost].tolist()):
            while hits and t - hits[0][0] >= window:
                used -= hits.popleft()[1]
            ok = used < limit
            if ok:
                hits.append((t, int(c)))
                used += int(c)
            allowed.append(ok)
        return {"allowed": allowed}, tuple(hits)

    return fold


def sliding_rate_limit(requests: DataFrame, key: str, time: str, tie: str, cost: str, exempt: Column | None = None,
                       limit: int = fixed.REQUEST_LIMIT, window: int = 60 * SECOND, partitions: int | None = None) -> DataFrame:
    """``allowed``: fewer than ``limit`` recorded hits in the window; refusals record nothing.

    A request whose ``exempt`` is null is not exempt.
    """
    fold = limit_fold(time, cost, limit, window)
    if exempt is None:
        return ordered_fold(requests, F.col(key), [time, tie], fold, tuple, LIMIT_OUT, partitions)
    exempt = F.coalesce(exempt, F.lit(False))
    free = requests.filter(exempt).withColumn("allowed", F.lit(True))
    return ordered_fold(requests.filter(~exempt), F.col(key), [time, tie], fold, tuple, LIMIT_OUT, partitions).unionByName(free)


# ---- the whole message path ------------------------------------------------------------

@dataclass(frozen=True)
class PathOptions:
    breaker: BreakerOptions = BreakerOptions()
    ttl: int = fixed.DEDUPE_TTL_S * SECOND
    capacity: int = fixed.HOLD_CAPACITY
    rate_hz: float | None = None
    outcomes_per_message: int = 1

    def bucket(self) -> Bucket:
        return _buckets(self.rate_hz)


@lru_cache(maxsize=64)
def _buckets(rate_hz: float) -> Bucket:
    return bucket_of(rate_hz)


def new_path_state() -> dict:
    return {"mode": "closed", "tripped": 0, "held": 0, "window": deque(), "wrong": 0, "seen": {}, "tokens": None, "last": None}


def path_step(s: dict, t: int, msg_id: str | None, transform_ok: bool, write_ok: bool, o: PathOptions) -> str:
    """Outcome of one message; ``s`` is changed in place."""
    b = o.breaker
    s["mode"] = breaker_step(s["mode"], s["tripped"], t, b.half_open)
    if s["mode"] == "open":
        s["held"] += 1
        return "held" if s["held"] <= o.capacity else "overflow"
    if msg_id is not None and msg_id != "":
        if seen_before(s["seen"].get(msg_id), t, o.ttl):
            return "duplicate"
        s["seen"][msg_id] = t
    if o.rate_hz is not None:
        bucket = o.bucket()
        ok, s["tokens"] = bucket.take(bucket.full if s["tokens"] is None else s["tokens"], s["last"], t)
        s["last"] = t
        if not ok:
            _record(s, t, True, b)
            return "limited"
    if not transform_ok:
        _record(s, t, False, b)
        return "transform_error"
    if o.outcomes_per_message > 1:
        _record(s, t, True, b)
    _record(s, t, write_ok, b)
    return "delivered" if write_ok else "write_failed"


def _record(s: dict, t: int, ok: bool, b: BreakerOptions) -> None:
    window = s["window"]
    window.append((t, ok))
    s["wrong"] += not ok
    while window[0][0] < t - b.window:
        s["wrong"] -= not window.popleft()[1]
    s["mode"] = breaker_step(s["mode"], s["tripped"], t, b.half_open)
    if s["mode"] == "half_open":
        s["mode"] = "closed" if ok else "open"
        if ok:
            s["held"], s["tripped"] = 0, 0
        else:
            s["tripped"] = t
    elif s["mode"] == "closed":
        if len(window) >= b.min_events and s["wrong"] / len(window) >= b.threshold:
            s["mode"], s["tripped"] = "open", t


def path_fold(time: str, msg_id: str, transform_ok: str, write_ok: str, options: PathOptions) -> Fold:
    """State: breaker, its window, held count, remembered ids and tokens."""
    def fold(state: dict, rows: pd.DataFrame) -> tuple[dict, dict]:
        s = {**state, "window": deque(state["window"]), "seen": dict(state["seen"])}
        outcomes = []
        for t, m, a, w in zip(rows[time].tolist(), rows[msg_id].tolist(), rows[transform_ok].tolist(), rows[write_ok].tolist()):
            outcomes.append(path_step(s, t, m, a, w, options))
        # what has run out by the last message no longer matters
        while s["window"] and s["window"][0][0] < t - options.breaker.window:
            s["wrong"] -= not s["window"].popleft()[1]
        s["seen"] = {k: v for k, v in s["seen"].items() if seen_before(v, t, options.ttl)}
        return {"outcome": outcomes}, s

    return fold


def process_messages(messages: DataFrame, key: str, time: str, tie: str, msg_id: str, transform_ok: str, write_ok: str,
                     options: PathOptions = PathOptions(), partitions: int | None = None) -> DataFrame:
    """``outcome`` of each message of a bridge: breaker, hold, dedupe, limiter, transform, write."""
    return ordered_fold(messages, F.col(key), [time, tie], path_fold(time, msg_id, transform_ok, write_ok, options), new_path_state, PATH_OUT, partitions)


def runner_counts(processed: DataFrame, key: str, outcome: str = "outcome") -> DataFrame:
    """Delivered messages and errors per bridge; every drop counts as an error."""
    ok = F.col(outcome) == "delivered"
    return processed.groupBy(key).agg(F.count_if(ok).alias("messages"), F.count_if(~ok).alias("errors"))
