"""The state behind reposts: the URLs of every role and day, for as long as a posting may still arrive late."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

OUTPUT = "company string, title string, day date, urls long"
DAY = dt.timedelta(days=1)


def _end_of(day: dt.date) -> int:
    """The millisecond after a day, in UTC."""
    return int(dt.datetime.combine(day + DAY, dt.time(), dt.timezone.utc).timestamp() * 1000)


def _counts(days: list[tuple[str, str, dt.date, int]]) -> pd.DataFrame:
    columns = list(zip(*days)) or [[]] * 4
    return pd.DataFrame({
        "company": pd.Series(columns[0], dtype="object"),
        "title": pd.Series(columns[1], dtype="object"),
        "day": pd.Series(columns[2], dtype="object"),
        "urls": pd.Series(columns[3], dtype="int64"),
    })


def _text(value) -> str | None:
    return None if pd.isna(value) else value


#: Roles are dealt to so many buckets by hash.  Part of what a checkpoint holds: a query goes on with the number it began with.
BUCKETS = 256


class DailyPostings(StatefulProcessor):
    """Per bucket of roles a map from day to the URLs seen on it, and a timer per day that lets go of it.

    A timer fires when the watermark has passed its day: rows of that day would be dropped as
    too late from then on, so its count is final.  A batch reads and writes the days that it has rows of, with
    all roles of the bucket on them: a call from Python costs far more than the rows that it brings along.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day date", "companies array<string>, titles array<string>, urls array<string>")

    def handleInputRows(self, key, rows, timerValues):
        arrived: dict[dt.date, set] = {}
        for batch in rows:
            for day, *row in zip(batch["day"], batch["company"], batch["title"], batch["url"]):
                arrived.setdefault(day, set()).add(tuple(map(_text, row)))
        known = self.days.exists()
        changed = []
        for day, seen in sorted(arrived.items()):
            before = self.days.getValue((day,)) if known else None
            held = set(zip(*before)) if before else set()
            new = seen - held
            if new:
                held |= new
                self.days.updateValue((day,), tuple(map(list, zip(*held))))
                self.handle.registerTimer(_end_of(day))
                urls = Counter(row[:2] for row in held)
                changed += [(*role, day, urls[role]) for role in {row[:2] for row in new}]
        yield _counts(changed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        end = dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, dt.timezone.utc)
        self.days.removeKey((end.date() - DAY,))
        yield _counts([])

    def close(self) -> None:
        pass
