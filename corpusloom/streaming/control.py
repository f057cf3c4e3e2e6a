"""State machines over request logs: rate control with pauses and halts, and liveness, by arbitrary state and timers.

Rows of a key wait in list state until the watermark has passed them, and are
then folded in the order of their times.  So the events that come out do not depend
on how the log is cut into files and batches; rows behind the watermark are
dropped by Spark and counted in the progress of the query.

Each call of the state store and each timer is a message between Python and the JVM, so
their number goes by keys and batches, not by rows: the rows of a batch wait packed in one
value, and a key has a timer for its first waiting row, not one for each.

A domain's state is one row: rate, baseline, counters, end of the pause, and two bounded
lists (latencies of the window, errors of the last requests).  A pause ends by an
event-time timer, whether or not further requests come.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

# The rule that rates follow.
MIN_RATE, RATE_STEP, WINDOW, BASELINE_N, SLOWER = 0.25, 0.5, 500, 100, 1.5
ERRORS, LEAST_ERRORS, ERROR_SHARE, ERRORS_IN_A_ROW = 200, 50, 0.20, 12
PAUSE_MS = 60_000
RATE_LIMITED = (428, 429, 503)
NOT_ERRORS = (404, 410)


#: Timers stand at whole ticks; the log is folded up to the last tick that the watermark has passed.
TICK_MS = 1000
#: A waiting row; no status is NO_STATUS.
WAITS, NO_STATUS = np.dtype([("at", "<i8"), ("id", "<i8"), ("latency", "<f8"), ("status", "<i4")]), -(2**31)
#: So many rows are Python values at once.
UNPACKED = 1 << 16


def tick(at: int) -> int:
    """The first tick at or after a time."""
    return -(-at // TICK_MS) * TICK_MS


def nearest_rank(values: list[float], q: float) -> float:
    s = sorted(values)
    return s[min(len(s) - 1, math.ceil(q * len(s)) - 1)] if s else 0.0


@dataclass
class Control:
    """What is remembered of a domain beside its lists; baseline under 0: not known yet, paused_until 0: not paused."""

    rate: float = 1.0
    baseline: float = -1.0
    in_window: int = 0
    limited: bool = False
    in_a_row: int = 0
    paused_until: int = 0
    halted: bool = False


@dataclass(frozen=True)
class Rule:
    cap: float = 4.0
    window: int = WINDOW
    baseline_n: int = BASELINE_N
    pause_ms: int = PAUSE_MS
    errors: int = ERRORS
    least_errors: int = LEAST_ERRORS
    in_a_row: int = ERRORS_IN_A_ROW


def is_error(status: int | None) -> bool:
    return status is None or status >= 500 or (status >= 400 and status not in NOT_ERRORS)


def step(rule: Rule, c: Control, latencies: list[float], errors: list[bool], at: int, latency: float, status: int | None) -> list[tuple[int, str, float]]:
    """Folds one request at a time in milliseconds into the state; gives the events (time, kind, value).

    After a halt nothing changes any more.  In a pause requests count, but a further limit does not halve the rate again.
    """
    out = resume(c, at)
    if c.halted:
        return out
    bad = is_error(status)
    errors.append(bad)
    del errors[: -rule.errors]
    c.in_a_row = c.in_a_row + 1 if bad else 0
    c.in_window += 1
    if status is not None:
        latencies.append(latency)
        if c.baseline < 0 and len(latencies) >= rule.baseline_n:
            c.baseline = nearest_rank(latencies, 0.95)
            out.append((at, "baseline", c.baseline))
    if status in RATE_LIMITED:
        c.limited = True
        if not c.paused_until:
            c.rate, c.paused_until, c.in_window = max(MIN_RATE, c.rate / 2), at + rule.pause_ms, 0
            latencies.clear()
            out.append((at, "pause", c.rate))
    if c.in_window >= rule.window:
        if not c.limited and latencies and c.baseline >= 0 and nearest_rank(latencies, 0.95) <= SLOWER * c.baseline and c.rate < rule.cap:
            c.rate = min(rule.cap, c.rate + RATE_STEP)
            out.append((at, "rate_up", c.rate))
        c.in_window, c.limited = 0, False
        latencies.clear()
    share = sum(errors) / len(errors)
    if (len(errors) >= rule.least_errors and share > ERROR_SHARE) or (c.in_a_row >= rule.in_a_row and share > 0.5):
        c.halted = True
        out.append((at, "halt", share))
    return out


def resume(c: Control, now: int) -> list[tuple[int, str, float]]:
    """The end of a pause that lies at or before ``now``."""
    if not c.paused_until or c.paused_until > now:
        return []
    ended, c.paused_until = c.paused_until, 0
    return [(ended, "resume", c.rate)]


_CONTROL = "rate double, baseline double, in_window long, limited boolean, in_a_row long, paused_until long, halted boolean, latencies array<double>, errors array<boolean>"


def packed(rows: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(rows), WAITS)
    for name in WAITS.names:
        out[name] = rows[name].to_numpy()
    return out


def unpacked(rows: np.ndarray) -> Iterator[tuple]:
    for k in range(0, len(rows), UNPACKED):
        yield from rows[k : k + UNPACKED].tolist()


class _Ordered(StatefulProcessor):
    """Holds rows until the watermark has passed them; ``fold`` sees them in the order of time and id."""

    key_name: str
    result: tuple[str, ...]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for batch in rows:
            new = packed(batch)
            self.waiting.appendValue((new.tobytes(),))
            first = int(new["at"].min()) if first is None else min(first, int(new["at"].min()))
        if first is not None:
            self.handle.registerTimer(tick(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() // TICK_MS * TICK_MS
        held = np.concatenate([np.empty(0, WAITS), *(np.frombuffer(r[0], WAITS) for r in self.waiting.get())])
        ready, later = held[held["at"] <= now], held[held["at"] > now]
        if len(later):
            self.handle.registerTimer(tick(int(later["at"].min())))
        if len(ready):
            if len(later):
                self.waiting.put([(later.tobytes(),)])
            else:
                self.waiting.clear()
        made = self.fold(ready[np.lexsort((ready["id"], ready["at"]))], now)
        if made:
            yield pd.DataFrame([(*key, *e) for e in made], columns=[self.key_name, *self.result])

    def fold(self, ready: np.ndarray, now: int) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _RateControl(_Ordered):
    result = ("at", "event", "value")

    def __init__(self, key_name: str, rule: Rule):
        self.key_name, self.rule = key_name, rule

    def init(self, handle) -> None:
        super().init(handle)
        self.control = handle.getValueState("control", _CONTROL)

    def fold(self, ready: np.ndarray, now: int) -> list[tuple]:
        held, n = self.control.get(), len(fields(Control))
        c = Control(rate=min(1.0, self.rule.cap)) if held is None else Control(*held[:n])
        latencies, errors = ([], []) if held is None else map(list, held[n:])
        out: list[tuple] = []
        for at, _, latency, status in unpacked(ready):
            if c.halted:
                break
            out += step(self.rule, c, latencies, errors, at, latency, None if status == NO_STATUS else status)
        out += resume(c, now)
        if len(ready) or out:
            self.control.update((*asdict(c).values(), latencies, errors))
        if c.paused_until:
            self.handle.registerTimer(tick(c.paused_until))
        return out


class _Liveness(_Ordered):
    result = ("at", "event")

    def __init__(self, key_name: str, silence_ms: int):
        self.key_name, self.silence_ms = key_name, silence_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at long")

    def fold(self, ready: np.ndarray, now: int) -> list[tuple]:
        held = self.last.get()
        last, out = None if held is None else held[0], []
        for at, *_ in unpacked(ready):
            if last is not None and at - last >= self.silence_ms:
                out.append((last + self.silence_ms, "DEAD"))
                last = None
            if last is None:
                out.append((at, "RUNNING"))
            last = at
        if last is not None and last + self.silence_ms <= now:
            out.append((last + self.silence_ms, "DEAD"))
            self.last.clear()
        elif last is not None:
            self.last.update((last,))
            self.handle.registerTimer(tick(last + self.silence_ms))
        return out


class _Heartbeat(StatefulProcessor):
    """Liveness by the clock of the cluster."""

    def __init__(self, key_name: str, silence_ms: int):
        self.key_name, self.silence_ms = key_name, silence_ms

    def init(self, handle) -> None:
        self.handle, self.due = handle, handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for _ in rows:
            pass
        fresh = not self.due.exists()
        if not fresh:
            self.handle.deleteTimer(self.due.get()[0])
        due = timerValues.getCurrentProcessingTimeInMs() + self.silence_ms
        self.due.update((due,))
        self.handle.registerTimer(due)
        if fresh:
            yield pd.DataFrame({self.key_name: [key[0]], "event": ["RUNNING"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.due.clear()
        yield pd.DataFrame({self.key_name: [key[0]], "event": ["DEAD"]})

    def close(self) -> None:
        pass


def _use_rocksdb(rows: DataFrame) -> None:
    """Lists and timers need the state store that keeps column families."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _prepared(rows: DataFrame, key: str, late: str, latency: str, status: str) -> DataFrame:
    """The columns of WAITS, none of them null: no latency is 0, no status is NO_STATUS, rows without an id come first."""
    at, number = "CAST(unix_millis(ts) AS long) AS at", f"coalesce(CAST({status} AS int), {NO_STATUS}) AS status"
    seconds = f"coalesce(nanvl(CAST({latency} AS double), 0D), 0D) AS latency"
    return rows.where(f"{key} IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).selectExpr(key, "ts", at, f"coalesce(CAST(event_id AS long), {-(2**63)}) AS id", seconds, number)


def rate_control(requests: DataFrame, key: str, key_type: str, late: str, rule: Rule = Rule(), latency: str = "latency", status: str = "status") -> DataFrame:  # noqa: B008
    """(key, at, event, value) of a stream of requests (key, ts, event_id, latency in seconds, HTTP status): baseline, pause, resume, rate_up, halt."""
    _use_rocksdb(requests)
    rows = _prepared(requests, key, late, latency, status)
    return rows.groupBy(key).transformWithStateInPandas(_RateControl(key, rule), f"{key} {key_type}, at long, event string, value double", "append", "eventTime")


def liveness(events: DataFrame, key: str, key_type: str, late: str, silence_ms: int) -> DataFrame:
    """(key, at, event): RUNNING at the first event and at the first after a silence, DEAD where nothing came for ``silence_ms``; the times are those of the log."""
    _use_rocksdb(events)
    rows = _prepared(events, key, late, "CAST(NULL AS double)", "CAST(NULL AS int)")
    return rows.groupBy(key).transformWithStateInPandas(_Liveness(key, silence_ms), f"{key} {key_type}, at long, event string", "append", "eventTime")


def heartbeats(events: DataFrame, key: str, key_type: str, silence_ms: int) -> DataFrame:
    """(key, event): RUNNING at the first row of a key, DEAD once no row of it has come for ``silence_ms`` of processing time, with or without other input."""
    _use_rocksdb(events)
    return events.where(f"{key} IS NOT NULL").groupBy(key).transformWithStateInPandas(_Heartbeat(key, silence_ms), f"{key} {key_type}, event string", "append", "processingTime")


def unseen(events: DataFrame, earlier: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Rows of a stream that neither came before within ``late`` nor stand in the table ``earlier`` of former batches."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys).join(earlier.select(*keys).distinct(), keys, "left_anti")


def dropped(query) -> int:
    """The rows that a query has dropped because they came behind the watermark."""
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in p["stateOperators"])
