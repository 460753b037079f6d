"""The ordered folds as streaming operators.

A key's state lives in the state store. Rows of a micro-batch are put in time order, so a stream
agrees with the batch form as long as no row arrives in a later batch than its successors.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed
from ..operators import registry as rg
from ..operators import resilience as rs
from ..scale import Fold

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FoldProcessor(StatefulProcessor):
    """Applies a fold per key; with ``idle_us`` the state goes when the watermark has passed that long."""

    def __init__(self, fold: Fold, init: Callable[[], object], order: list[str], idle_us: int | None) -> None:
        self.fold, self.initial, self.order, self.idle_us = fold, init, order, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "value binary, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.order, ignore_index=True)
        saved = self.state.get() if self.state.exists() else None
        state = pickle.loads(saved[0]) if saved else self.initial()
        cols, state = self.fold(state, pdf)
        last = int(pdf[self.order[0]].iloc[-1])
        self.state.update((pickle.dumps(state), last))
        if self.idle_us is not None:
            self.handle.registerTimer((last + self.idle_us) // 1000 + 1)
        yield pdf.drop(columns=["__k"], errors="ignore").assign(**cols)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            last = self.state.get()[1]
            if expiredTimerInfo.getExpiryTimeInMs() > (last + self.idle_us) // 1000:
                self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def stream_fold(df: DataFrame, key: Column, order: list[str], fold: Fold, init: Callable[[], object], out: T.StructType,
                idle_us: int | None = None) -> DataFrame:
    """Streaming form of ``ordered_fold``. ``idle_us`` needs a watermark on the stream."""
    schema = T.StructType(df.schema.fields + out.fields)
    processor = FoldProcessor(fold, init, order, idle_us)
    mode = "None" if idle_us is None else "EventTime"
    keyed = df.withColumn("__k", key.cast("string"))
    return keyed.groupBy("__k").transformWithStateInPandas(processor, schema, "Append", mode)


def dedupe_ttl(messages: DataFrame, msg_id: str = "msg_id", time: str = "t", tie: str = "event_id",
               ttl: int = fixed.DEDUPE_TTL_S * rs.SECOND, watermarked: bool = True) -> DataFrame:
    """Exact TTL deduplication; an id is forgotten once the watermark has passed its TTL."""
    has_id = F.coalesce(F.col(msg_id).cast("string") != "", F.lit(False))
    named = messages.filter(has_id)
    made = stream_fold(named, F.col(msg_id), [time, tie], rs.dedupe_fold(time, ttl), lambda: None, rs.DEDUPE_OUT, ttl if watermarked else None)
    return made.unionByName(messages.filter(~has_id).withColumn("is_duplicate", F.lit(False)))


def dedupe_at_least(messages: DataFrame, msg_id: str, event_time: str, ttl: str) -> DataFrame:
    """Built-in deduplication: remembers an id for at least ``ttl``."""
    return messages.withWatermark(event_time, ttl).dropDuplicatesWithinWatermark([msg_id])


def token_bucket(messages: DataFrame, key: str, time: str, tie: str, rate_hz: float, watermarked: bool = True) -> DataFrame:
    """An idle bucket refills, so its state may go after ``capacity / rate`` seconds."""
    bucket = rs.bucket_of(rate_hz)
    idle = bucket.full // bucket.gain + 1 if watermarked else None
    return stream_fold(messages, F.col(key), [time, tie], rs.bucket_fold(time, bucket), lambda: (bucket.full, None), rs.BUCKET_OUT, idle)


def sliding_rate_limit(requests: DataFrame, key: str, time: str, tie: str, cost: str, limit: int = fixed.REQUEST_LIMIT,
                       window: int = 60 * rs.SECOND, watermarked: bool = True) -> DataFrame:
    return stream_fold(requests, F.col(key), [time, tie], rs.limit_fold(time, cost, limit, window), tuple, rs.LIMIT_OUT, window if watermarked else None)


def process_messages(messages: DataFrame, key: str, time: str, tie: str, msg_id: str, transform_ok: str, write_ok: str,
                     options: rs.PathOptions = rs.PathOptions()) -> DataFrame:
    """Breaker, hold, dedupe, limiter and outcome of each message in one stateful operator per bridge."""
    fold = rs.path_fold(time, msg_id, transform_ok, write_ok, options)
    return stream_fold(messages, F.col(key), [time, tie], fold, rs.new_path_state, rs.PATH_OUT)


def circuit_breaker(outcomes: DataFrame, key: str, time: str, tie: str, failed: str, options: rs.BreakerOptions = rs.BreakerOptions()) -> DataFrame:
    """Breaker with its window of outcomes in the state."""
    step = rs.breaker_fold(time, failed, options)

    def fold(state: tuple, rows: pd.DataFrame) -> tuple[dict, tuple]:
        window, inner = deque(state[0]), state[1]
        wrong = sum(b for _, b in window)
        full = []
        for t, bad in zip(rows[time].tolist(), rows[failed].tolist()):
            while window and window[0][0] < t - options.window:
                wrong -= window.popleft()[1]
            window.append((t, bool(bad)))
            wrong += bool(bad)
            full.append(len(window) >= options.min_events and wrong / len(window) >= options.threshold)
        cols, inner = step(inner, rows.assign(__full=full))
        return cols, (tuple(window), inner)

    return stream_fold(outcomes, F.col(key), [time, tie], fold, lambda: ((), rs.new_breaker()), rs.BREAKER_OUT)


def register_or_drift(samples: DataFrame, order: list[str], threshold: float = fixed.DRIFT_THRESHOLD) -> DataFrame:
    return stream_fold(samples, F.col("node_id"), order, rg.drift_fold(threshold), lambda: None, rg.DRIFT_OUT)


# ---- approvals ------------------------------------------------------------------------

def _plain(value, kind: T.DataType):
    """A cell of a data frame as the value that the state keeps."""
    if value is None or value != value:
        return None
    if isinstance(kind, T.IntegralType):
        return int(value)
    return bool(value) if isinstance(kind, T.BooleanType) else value


class ApprovalProcessor(StatefulProcessor):
    """Staged rows wait for the first decision within the timeout.

    Decisions may arrive before what they decide and out of order, so a row is settled when the
    watermark has passed its decision or its deadline; then nothing earlier can come. Decisions are
    kept up to the watermark, staged rows until they are settled, so an idle key leaves no state.
    """

    def __init__(self, staged: T.StructType, time: str, tie: str, timeout: int) -> None:
        self.fields, self.time, self.tie, self.timeout = staged.fields, time, tie, timeout
        self.at = [f.name for f in staged.fields].index(time), [f.name for f in staged.fields].index(tie)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.staged = handle.getListState("staged", T.StructType(self.fields))
        order = self.fields[self.at[1]]
        self.decided = handle.getListState("decided", T.StructType([T.StructField("at", T.LongType()), T.StructField("tie", order.dataType), T.StructField("approved", T.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for pdf in rows:
            is_staged = pdf["is_staged"].astype(bool)
            mine, theirs = pdf[is_staged], pdf[~is_staged]
            if len(mine):
                self.staged.appendList([tuple(_plain(v, f.dataType) for v, f in zip(row, self.fields)) for row in zip(*[mine[f.name].tolist() for f in self.fields])])
                due.update((int(t) + self.timeout) // 1000 + 1 for t in mine[self.time].tolist())
            if len(theirs):
                kind = self.fields[self.at[1]].dataType
                self.decided.appendList([(int(t), _plain(x, kind), bool(a)) for t, x, a in zip(theirs[self.time].tolist(), theirs[self.tie].tolist(), theirs["approved"].tolist())])
                due.update(int(t) // 1000 + 1 for t in theirs[self.time].tolist())
        for at in due:
            self.handle.registerTimer(at)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs() * 1000
        decided = sorted(self.decided.get()) if self.decided.exists() else []
        keep, out = [], []
        for row in self.staged.get() if self.staged.exists() else ():
            t, tie = row[self.at[0]], row[self.at[1]]
            i = bisect_right(decided, (t, tie, True))
            found = decided[i] if i < len(decided) and decided[i][0] - t <= self.timeout else None
            if found is not None and found[0] < past:
                out.append((*row, "approved" if found[2] else "rejected", found[0]))
            elif t + self.timeout < past:
                out.append((*row, "timed_out", None))
            else:
                keep.append(tuple(row))
        self._put(self.staged, keep)
        self._put(self.decided, [d for d in decided if d[0] >= past])
        names = [f.name for f in self.fields] + ["outcome", "decided_at"]
        yield pd.DataFrame(out, columns=names, dtype=object) if out else pd.DataFrame()

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        elif state.exists():
            state.clear()

    def close(self) -> None:
        pass


def resolve_approvals(staged: DataFrame, decisions: DataFrame, keys: list[str], time: str = "t", tie: str = "seq", event_time: str = "ts",
                      timeout: int = 60_000_000, delay: str = "10 seconds") -> DataFrame:
    """Streaming form of the batch operator: one row per staged pair, with its first decision or ``timed_out``.

    ``event_time`` is the timestamp of ``time`` (microseconds); rows later than ``delay`` are lost.
    """
    columns = T.StructType([f for f in staged.schema.fields if f.name != event_time])
    asked = staged.withColumns({"approved": F.lit(None).cast("boolean"), "is_staged": F.lit(True)})
    told = decisions.select(*keys, time, tie, event_time, "approved").withColumn("is_staged", F.lit(False))
    both = asked.unionByName(told, allowMissingColumns=True).withWatermark(event_time, delay)
    out = T.StructType([*columns.fields, T.StructField("outcome", T.StringType()), T.StructField("decided_at", T.LongType())])
    return both.groupBy(*keys).transformWithStateInPandas(ApprovalProcessor(columns, time, tie, timeout), out, "Append", "EventTime")
