"""Streams that carry state for each key: sessions that expire, alarms that close without input, a meter over events out of order,
revisions checked against the current one.

Each is a ``transformWithState`` over one small state; state lives in RocksDB beside the checkpoint, so a restart goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quaverlake.functions.times import DAY
from quaverlake.operators.engagement import CONTROLS, KEEP_DAYS
from quaverlake.session import ship_package
from quaverlake.streaming.sinks import run_available
from quaverlake.streaming.usage import IDLE_MS, MAX_TICK_MS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    ship_package(spark)
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_stateful(stream: DataFrame, output: str = "append", keys: tuple[str, ...] = (), root: str | None = None) -> DataFrame:
    """:func:`run_available` for a stream of this module; the same ``root`` again goes on with the state kept there."""
    with rocksdb_state(stream.sparkSession):
        return run_available(stream, output, keys, root)


def _added(a: int | None, b: int | None) -> int | None:
    """A sum that leaves out what is missing."""
    return b if a is None else a if b is None else a + b


# --- sessions ---------------------------------------------------------------------------------------

_FIRSTS = ("job_id", "surface", "platform")
_SUMS = ("seconds", "playing_seconds", *[f"e_{c}" for c in CONTROLS])
_SESSION_STATE = ", ".join(["session_id string", "at long", "seq long", *[f"{c} string" for c in _FIRSTS], "last_at long", "reports long", "admin boolean", *[f"{c} long" for c in _SUMS]])
_SESSION_OUT = ", ".join(["user_id string", "session_id string", *[f"{c} string" for c in _FIRSTS], "started_at long", "last_at long", "expires_at long", "reports long", "admin boolean",
                          *[f"{c} long" for c in _SUMS], "expired boolean"])


class _Sessions(StatefulProcessor):
    """The live sessions of one person as a list, with one timer, for the session that ends first: state and timer are asked for once a person
    and micro-batch, however many of the sessions have reports in it."""

    def __init__(self, keep_seconds: int):
        self.keep = keep_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("session", _SESSION_STATE)
        self.names = [c.split()[0] for c in _SESSION_STATE.split(", ")]

    def _held(self) -> dict[str | None, dict]:
        return {x[0]: dict(zip(self.names, x)) for x in self.state.get()}

    def _row(self, key: tuple, s: dict, expired: bool) -> Row:
        return Row(user_id=key[0], session_id=s["session_id"], **{c: s[c] for c in _FIRSTS}, started_at=s["at"], last_at=s["last_at"], expires_at=s["at"] + self.keep, reports=s["reports"],
                   admin=s["admin"], **{c: s[c] for c in _SUMS}, expired=expired)

    def _due(self, held: dict[str | None, dict]) -> int | None:
        """When the first session ends, in milliseconds."""
        return (min(s["at"] for s in held.values()) + self.keep) * 1000 if held else None

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, changed = self._held(), {}
        known, due = set(held), self._due(held)
        for r in rows:
            s = held.get(r["session_id"])
            if s is None:
                s = held[r["session_id"]] = (dict.fromkeys(self.names) | {"session_id": r["session_id"], "at": r["at"], "seq": r["seq"], "last_at": r["at"], "reports": 0, "admin": False}
                                             | {c: r[c] for c in _FIRSTS})
            elif (r["at"], r["seq"]) < (s["at"], s["seq"]):
                s.update({"at": r["at"], "seq": r["seq"]} | {c: r[c] for c in _FIRSTS})
            s["last_at"] = max(s["last_at"], r["at"])
            s["reports"] += 1
            s["admin"] = s["admin"] or bool(r["admin"])
            for c in _SUMS:
                s[c] = _added(s[c], r[c])
            changed[r["session_id"]] = s
        if due != self._due(held):
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(self._due(held))
        if known.isdisjoint(changed):
            self.state.appendList([tuple(s.values()) for s in changed.values()])
        else:
            self.state.put([tuple(s.values()) for s in held.values()])
        for s in changed.values():
            yield self._row(key, s, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, now = self._held(), timerValues.getCurrentWatermarkInMs()
        over = [s for s in held.values() if (s["at"] + self.keep) * 1000 <= max(expiredTimerInfo.getExpiryTimeInMs(), now - 1)]
        for s in over:
            del held[s["session_id"]]
            yield self._row(key, s, True)
        if held:
            self.state.put([tuple(s.values()) for s in held.values()])
            self.handle.registerTimer(self._due(held))
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def session_changes(reports: DataFrame, late: str = "1 hour", keep_days: int = KEEP_DAYS) -> DataFrame:
    """ST-01 with state that ends: the row of a session each time reports reach it, and once more, ``expired``, when its days are over.

    ``reports`` is a stream of wide counters (``single_control``); ``at`` is when a report arrived, and the watermark follows it by ``late``. The first
    values are those of the earliest report, as in batch. ``keep_days`` after its start a session's state goes, also when nothing arrives for it
    any more; a report after that begins a new session of the same name. Reports without a time are left out. The live sessions of one person lie together: those of ``keep_days``.
    """
    timed = reports.where("at IS NOT NULL").select("user_id", "session_id", "at", "seq", *_FIRSTS, "admin", *[F.col(c).cast("long").alias(c) for c in _SUMS],
                                                    F.timestamp_seconds("at").alias("arrived")).withWatermark("arrived", late)
    return timed.groupBy("user_id").transformWithState(_Sessions(keep_days * DAY), _SESSION_OUT, "Update", "EventTime")


def session_table(reports: DataFrame, root: str | None = None, late: str = "1 hour", keep_days: int = KEEP_DAYS) -> DataFrame:
    """The live sessions after all reports there are; run again with the same ``root`` it goes on from there."""
    rows = run_stateful(session_changes(reports, late, keep_days), "update", ("user_id", "session_id"), root)
    return rows.where("NOT expired").drop("expired")


# --- alarms -----------------------------------------------------------------------------------------

_PICK = {"Maximum": lambda v: v[0], "Minimum": lambda v: v[1], "Sum": lambda v: v[2], "Average": lambda v: v[2] / v[3]}
_COMPARE = {"GreaterThanThreshold": lambda v, t: v > t, "GreaterThanOrEqualToThreshold": lambda v, t: v >= t,
            "LessThanThreshold": lambda v, t: v < t, "LessThanOrEqualToThreshold": lambda v, t: v <= t}


class _Alarms(StatefulProcessor):
    def __init__(self, statistic: str, op: str, threshold: float, evaluation_periods: int, period_seconds: int):
        self.statistic, self.op, self.threshold, self.needed, self.period_ms = statistic, op, threshold, evaluation_periods, period_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "period long", "most double, least double, total double, n long")
        self.run = handle.getValueState("run", "last long, breaches long, first long, worst double")

    def _end(self, period: int) -> int:
        return (period + 1) * self.period_ms

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new: dict[int, tuple] = {}
        for r in rows:
            v = r["value"]
            if v is not None:
                p = r["at_ms"] // self.period_ms
                a = new.get(p)
                new[p] = (v, v, v, 1) if a is None else (max(a[0], v), min(a[1], v), a[2] + v, a[3] + 1)
        for p, b in new.items():
            if self.open.containsKey((p,)):
                a = self.open.getValue((p,))
                b = (max(a[0], b[0]), min(a[1], b[1]), a[2] + b[2], a[3] + b[3])
            else:
                self.handle.registerTimer(self._end(p))
            self.open.updateValue((p,), b)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        p = expiredTimerInfo.getExpiryTimeInMs() // self.period_ms - 1
        value = None
        if self.open.containsKey((p,)):
            value = _PICK[self.statistic](self.open.getValue((p,)))
            self.open.removeKey((p,))
        last, breaches, first, worst = self.run.get() if self.run.exists() else (None, 0, None, None)
        if value is not None and _COMPARE[self.op](value, self.threshold):
            breaches = breaches + 1 if last == p - 1 else 1
            if breaches >= self.needed:
                began = first is None
                first, worst = (p, value) if began else (first, max(worst, value))
                if began:
                    yield Row(dimension=key[0], state="alarm", first_period=first, last_period=None, worst=value)
                if self._end(p + 1) > timerValues.getCurrentWatermarkInMs():
                    self.handle.registerTimer(self._end(p + 1))  # the next period ends too when nothing comes
                elif not self.open.containsKey((p + 1,)):  # it is over already, and nothing came
                    yield Row(dimension=key[0], state="ok", first_period=first, last_period=p, worst=worst)
                    first = worst = None
            self.run.update((p, breaches, first, worst))
        else:
            if first is not None:
                yield Row(dimension=key[0], state="ok", first_period=first, last_period=last, worst=worst)
            self.run.clear()

    def close(self) -> None:
        pass


def alarm_stream(metrics: DataFrame, statistic: str, op: str, threshold: float, evaluation_periods: int, period_seconds: int, watermark: str) -> DataFrame:
    """ST-09 from end to end as a stream: ``alarm`` when the last ``evaluation_periods`` periods have all breached, ``ok`` with the whole run when it is over.

    ``metrics``: dimension, at (timestamp), value. A period closes when the watermark passes its end, with or without input; one without data, or
    with nulls alone, does not breach. State is the open periods and the run of each dimension.
    """
    timed = metrics.select("dimension", F.unix_millis("at").alias("at_ms"), F.col("value").cast("double").alias("value"), "at").withWatermark("at", watermark)
    return timed.groupBy("dimension").transformWithState(_Alarms(statistic, op, threshold, evaluation_periods, period_seconds),
                                                         "dimension string, state string, first_period long, last_period long, worst double", "Append", "EventTime")


# --- the activity meter ---------------------------------------------------------------------------------

class _Meter(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, kind string, visible boolean, playing boolean")
        self.clock = handle.getValueState("clock", "opened long, tick long, input long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["at_ms"], r["seq"], r["kind"], r["visible"], r["playing"]) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(x[0] for x in new))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [x for x in held if x[0] <= now], [x for x in held if x[0] > now]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])
        else:
            self.waiting.clear()
        if not ready:
            return
        opened, tick, heard = self.clock.get() if self.clock.exists() else (ready[0][0], None, None)
        for at, seq, kind, visible, playing in ready:
            if kind == "tick":
                elapsed = min(MAX_TICK_MS, max(0, at - (opened if tick is None else tick)))
                awake = min(elapsed, max(0, (opened if heard is None else heard) + IDLE_MS - (at - elapsed)))
                yield Row(session_id=key[0], seq=seq, at_ms=at, active_ms=0 if not visible else elapsed if playing else awake, playing_ms=elapsed if visible and playing else 0)
                tick = at
            else:
                heard = at
        self.clock.update((opened, tick, heard))

    def close(self) -> None:
        pass


def activity_stream(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """ST-02 as a stream: the ticks of :func:`usage.activity`, whatever order events come in.

    Events (session_id string, at_ms, seq, kind, visible, playing) wait in the state of their session until the watermark, ``late`` behind the latest
    event, has passed them, and are then read in order of time and seq. Waiting events are those of the last ``late``; what comes later than
    that is dropped.
    """
    timed = events.select("session_id", "at_ms", "seq", "kind", "visible", "playing", F.timestamp_millis("at_ms").alias("at")).withWatermark("at", late)
    return timed.groupBy("session_id").transformWithState(_Meter(), "session_id string, seq long, at_ms long, active_ms long, playing_ms long", "Append", "EventTime")


# --- revisions ------------------------------------------------------------------------------------------

class _Revisions(StatefulProcessor):
    def __init__(self, keys: Sequence[str]):
        self.keys = tuple(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "revision long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        current = self.current.get()[0] if self.current.exists() else 0
        for seq, revision in sorted((r["seq"], r["revision"]) for r in rows):
            accepted = revision == current
            current += accepted
            yield Row(**dict(zip(self.keys, key)), seq=seq, revision=revision, accepted=accepted)
        self.current.update((current,))

    def close(self) -> None:
        pass


def revision_stream(saves: DataFrame, keys: Sequence[str] = ("job_id", "user_id")) -> DataFrame:
    """ST-13 as a stream: each save with ``accepted``: true if it was based on the current revision, which then grows by one.

    State is the current revision of each document. Saves count in the order they arrive; those of one micro-batch by ``seq``. A save without a
    revision is refused.
    """
    kinds = ", ".join(f"{k} {saves.schema[k].dataType.simpleString()}" for k in keys)
    asked = saves.select(*keys, F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("revision").cast("long"), F.lit(-1)).alias("revision"))
    return asked.groupBy(*keys).transformWithState(_Revisions(keys), f"{kinds}, seq long, revision long, accepted boolean", "Append", "None")
