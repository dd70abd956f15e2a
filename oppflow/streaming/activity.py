"""Weekly activity and reposts over a stream of dated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oppflow.functions.text import iso_week
from oppflow.streaming.jobs import run_to_table
from oppflow.streaming.postings_state import BUCKETS, OUTPUT, DailyPostings
from oppflow.streaming.timers import SETTINGS


def stream_weekly_activity(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Rows per ISO week.  Day 0 of the epoch is a Thursday, so weeks start 4 days on."""
    week = F.window("ts", "7 days", startTime="4 days")
    return rows.withWatermark("ts", delay).groupBy(week.alias("w")).agg(
        F.count(F.lit(1)).alias("rows")
    ).select(iso_week(F.to_date("w.start")).alias("week"), "rows")


#: How long after the newest posting an older one is still counted.
LATE = "90 days"


def stream_daily_postings(postings: DataFrame, late: str = LATE) -> DataFrame:
    """URLs per role and day so far, to be written in update mode; a changed count comes again.

    A URL counts once per day.  The state holds the URLs of the days from ``late`` before the newest posting
    on, so a posting counts however late it arrives within that time, in this run or a later one.  Older ones are
    dropped.  Start the query under ``timers.SETTINGS``.
    """
    bucket = F.pmod(F.hash("company", "title"), F.lit(BUCKETS))
    dated = postings.select("ts", F.to_date("ts").alias("day"), "company", "title", "url", bucket.alias("bucket"))
    return dated.withWatermark("ts", late).groupBy("bucket").transformWithStateInPandas(
        DailyPostings(), OUTPUT, "update", "eventTime"
    )


def repost_windows(daily: DataFrame, days: int = 90, n: int = 2) -> DataFrame:
    """Roles posted n or more times within the days up to one of their postings.

    ``daily`` is what the stream has written: the latest count of a role and day holds.
    """
    latest = daily.groupBy("company", "title", "day").agg(F.max_by("urls", "batch_id").alias("urls"))
    window = (
        Window.partitionBy("company", "title").orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    )
    return latest.withColumn("urls", F.sum("urls").over(window)).filter(F.col("urls") >= n).select(
        "company", "title", F.date_add("day", 1).alias("window_end"), "urls"
    )


def stream_reposts(
    postings: DataFrame, days: int = 90, n: int = 2, late: str = LATE, path: str | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """Reposted roles after all that has arrived; windows that are still open count too."""
    daily = run_to_table(stream_daily_postings(postings, late), "update", path, checkpoint, SETTINGS)
    return repost_windows(daily, days, n)


def reposts_of(postings: DataFrame, days: int = 90, n: int = 2) -> DataFrame:
    """The batch form over a table of postings."""
    daily = postings.groupBy("company", "title", F.to_date("ts").alias("day")).agg(
        F.count_distinct(F.struct("url")).alias("urls")
    )
    return repost_windows(daily.withColumn("batch_id", F.lit(0)), days, n)
