"""Follow-up timers: an application waits, becomes overdue, turns cold, is retired."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from oppflow.functions import fixed

OUTPUT = "app long, day date, state string"
STATES = ("apps array<long>, applied array<date>, last array<date>, sent array<int>, state array<string>, wake date")
# What the session must be set to while the query is started and run.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
DAY = dt.timedelta(days=1)


def daily_touches(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """``(app, day, applied, followups)``: events summed per application and day.

    Dates are the grain of the rules, and the sum keeps what a timer has to hold in
    memory to one row per day however many events an application receives.
    """
    daily = events.withWatermark("ts", delay) if events.isStreaming else events
    return daily.groupBy(F.window("ts", "1 day").alias("w"), "app").agg(
        F.count(F.when(F.col("kind") == "applied", 1)).cast("int").alias("applied"),
        F.count(F.when(F.col("kind") == "followup", 1)).cast("int").alias("followups"),
    ).select("app", F.col("w.start").alias("ts"), "applied", "followups", "w")


def deadlines(state: tuple, cfg: dict) -> list[tuple[dt.date, str]]:
    """What happens next to a running application if nothing else does."""
    applied, last, sent, name = state
    due = []
    if name == "waiting":
        wait = cfg["applied_first"] if sent == 0 else cfg["applied_subsequent"]
        due.append((last + wait * DAY, "overdue"))
    due.append((applied + (cfg["retire_days"] + 1) * DAY, "retired"))
    return sorted(due)


def advance(state, until: dt.date, cfg: dict):
    """Run the deadlines up to a day; returns the new state and what was passed."""
    passed = []
    while state is not None and state[3] != "retired":
        day, name = deadlines(state, cfg)[0]
        if day > until:
            break
        state = (state[0], state[1], state[2], name)
        passed.append((day, name))
    return state, passed


def touch(state, day: dt.date, applied: int, followups: int, cfg: dict):
    """One day of events: the first application starts the clock, a follow-up resets it."""
    passed = []
    if state is None:
        if not applied:
            return None, passed
        state = (day, day, 0, "waiting")
        passed.append((day, "waiting"))
    if followups and state[3] != "retired":
        sent = state[2] + followups
        name = "cold" if sent >= cfg["applied_max_followups"] else "waiting"
        if name != state[3]:
            passed.append((day, name))
        state = (state[0], day, sent, name)
    return state, passed


def replay(state, days, until, cfg):
    """Days in order, each after the deadlines before it; then up to ``until``."""
    out = []
    for day, applied, followups in days:
        state, passed = advance(state, day, cfg)
        out += passed
        state, passed = touch(state, day, applied, followups, cfg)
        out += passed
    if until is not None:
        state, passed = advance(state, until, cfg)
        out += passed
    return state, out


def _passed_day(watermark_ms: int) -> dt.date:
    """The last day that lies wholly before the watermark."""
    return pd.Timestamp(watermark_ms, unit="ms").date() - DAY


def _tracked(rows: pd.DataFrame) -> list[tuple]:
    """States from tracker rows; nothing sent yet, and waiting since the application, unless the row says otherwise."""
    out = []
    for row in rows.itertuples():
        last = row.applied if pd.isna(row.last) else row.last
        sent = 0 if pd.isna(row.sent) else int(row.sent)
        out.append((row.applied, last, sent, row.state or "waiting"))
    return out


def _as_frame(passed: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({
        "app": pd.Series([a for a, _, _ in passed], dtype="int64"),
        "day": pd.Series([d for _, d, _ in passed], dtype="object"),
        "state": pd.Series([s for _, _, s in passed], dtype="object"),
    })


#: Applications are dealt to so many buckets by hash.  Part of what a checkpoint holds, as in ``postings_state``.
BUCKETS = 256


def _bucket():
    return F.pmod(F.hash(F.col("app").cast("long")), F.lit(BUCKETS)).alias("bucket")


class FollowUpTimers(StatefulProcessor):
    """Keeps one small state per application and wakes up at the next deadline.

    The states of a bucket are one value and share a timer, for the earliest of their deadlines: a call from Python
    costs far more than the states that it brings along.
    """

    def __init__(self, cfg: dict):
        self.cfg = cfg

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("applications", STATES)

    def _load(self) -> tuple[dict[int, tuple], dt.date | None]:
        held = self.value.get()
        if held is None:
            return {}, None
        apps, *parts, wake = held
        return dict(zip(apps, zip(*parts))), wake

    def _store(self, states: dict[int, tuple], wake: dt.date | None, now_ms: int) -> None:
        """A timer that is no longer needed fires all the same and finds nothing to do."""
        due = min((deadlines(s, self.cfg)[0][0] for s in states.values() if s[3] != "retired"), default=None)
        if due is not None and (wake is None or due < wake):
            # Fires once the watermark has passed the whole day.
            when = int(pd.Timestamp(due + DAY).timestamp() * 1000)
            self.handle.registerTimer(max(when, now_ms + 1))
            wake = due
        if states:
            self.value.update((list(states), *map(list, zip(*states.values())), wake))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Applications that a tracker knows already; what they passed before is not reported again."""
        states, wake = self._load()
        states.update(zip(map(int, initialState["app"]), _tracked(initialState)))
        self._store(states, wake, timerValues.getCurrentWatermarkInMs())

    def handleInputRows(self, key, rows, timerValues):
        days: dict[int, list] = {}
        for batch in rows:
            for app, ts, applied, followups in zip(batch["app"], batch["ts"], batch["applied"], batch["followups"]):
                days.setdefault(int(app), []).append((ts.date(), int(applied), int(followups)))
        # Days before the watermark are complete, so their deadlines can run at once.
        mark = timerValues.getCurrentWatermarkInMs()
        states, wake = self._load()
        yield self._move(states, wake, days, mark, _passed_day(mark) if mark > 0 else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        states, _ = self._load()
        yield self._move(states, None, {app: [] for app in states}, mark, _passed_day(mark))

    def _move(self, states: dict, wake: dt.date | None, days: dict[int, list], mark: int, until: dt.date | None):
        """Applications through their new days and up to ``until``; what they passed."""
        out = []
        for app, touched in days.items():
            state, passed = replay(states.get(app), sorted(touched), until, self.cfg)
            out += [(app, *p) for p in passed]
            if state is not None:
                states[app] = state
        self._store(states, wake, mark)
        return _as_frame(out)

    def close(self) -> None:
        pass


def _tracker_rows(tracker: DataFrame) -> DataFrame:
    """One row per application that has applied; of several the one last touched, then the one furthest along."""
    rows = tracker.filter("app IS NOT NULL AND applied IS NOT NULL").select(
        F.col("app").cast("long"), F.col("applied").cast("date"), F.col("last").cast("date"),
        F.col("sent").cast("int"), F.col("state").cast("string"),
    )
    newest = F.struct(F.coalesce("last", "applied").alias("touched"), "sent", "applied", "last", "state")
    return rows.groupBy("app").agg(F.max(newest).alias("t")).select("app", "t.applied", "t.last", "t.sent", "t.state")


def stream_follow_up_timers(
    events: DataFrame, cfg: dict | None = None, delay: str = "1 day", tracker: DataFrame | None = None
):
    """Transitions of every application as event time passes.

    ``events`` is (ts, app, kind).  A timer fires when the watermark passes its day;
    events after retirement change nothing.  Start the query under ``SETTINGS``.

    ``tracker``, ``(app, applied, last, sent, state)``, holds the applications that were under way before the
    first event: the query starts from their states and with their timers set.  It is read when the query starts
    anew, not when it carries on from a checkpoint.  Null ``last``, ``sent`` and ``state`` mean that nothing
    was sent yet.
    """
    cfg = {**fixed.CADENCE, "retire_days": fixed.RETIRE_DAYS, **(cfg or {})}
    start = None if tracker is None else _tracker_rows(tracker).withColumn("bucket", _bucket()).groupBy("bucket")
    return daily_touches(events, delay).withColumn("bucket", _bucket()).groupBy("bucket").transformWithStateInPandas(
        FollowUpTimers(cfg), OUTPUT, "append", "eventTime", start
    )


def follow_up_transitions(
    events: DataFrame, until: dt.date, cfg: dict | None = None, tracker: DataFrame | None = None
) -> DataFrame:
    """The batch form: all transitions up to a day, from the same daily sums and the same tracker.

    A model to test the stream with: an application is replayed in one task, which holds a row per day of it.
    """
    cfg = {**fixed.CADENCE, "retire_days": fixed.RETIRE_DAYS, **(cfg or {})}

    def run(key, rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        days = sorted((r.ts.date(), int(r.applied), int(r.followups)) for r in rows.itertuples())
        days = [d for d in days if d[0] <= until]
        state = next(iter(_tracked(start)), None)
        return _as_frame([(key[0], *p) for p in replay(state, days, until, cfg)[1]])

    daily = daily_touches(events).drop("w")
    if tracker is None:
        tracker = events.sparkSession.createDataFrame([], "app long, applied date, last date, sent int, state string")
    return daily.groupBy("app").cogroup(_tracker_rows(tracker).groupBy("app")).applyInPandas(run, OUTPUT)
