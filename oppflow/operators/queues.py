"""The tracker as ordered work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.functions.classify import literal_map, normalize_status
from oppflow.functions.text import effective_applied_date, posted_date
from oppflow.operators.funnel import count_if
from oppflow.operators.ranks import desc, with_rank

GROUP_INDEX = {s: i for i, (_, ids, _) in enumerate(fixed.QUEUE_GROUPS) for s in ids}
GROUP_RULE = {i: rule for i, (_, _, rule) in enumerate(fixed.QUEUE_GROUPS)}


def queue_group(status_id) -> Column:
    """Index of a status's group; an unknown status stays visible in the first."""
    c = F.col(status_id) if isinstance(status_id, str) else status_id
    return F.coalesce(F.try_element_at(literal_map(GROUP_INDEX), c), F.lit(0))


def _queue_keys(apps: DataFrame) -> tuple[DataFrame, list]:
    df = apps.withColumns({
        "queue_group": queue_group(normalize_status("status")),
        "_sent": effective_applied_date("notes", "date"),
        "_posted": posted_date("notes"),
    })
    rule = F.try_element_at(literal_map(GROUP_RULE), F.col("queue_group"))
    lanes = fixed.EFFORT_LANES
    lane = None
    for i, (_, lowest) in enumerate(lanes):
        test = F.col("priority") >= lowest
        lane = F.when(test, F.lit(i)) if lane is None else lane.when(test, F.lit(i))
    by_lane = rule == "lane"
    by_date = rule == "date"
    fresh = by_lane & (lane < len(lanes) - 1)
    keys = [
        F.col("queue_group"),
        F.when(by_lane, lane),
        desc(F.when(fresh, F.col("_posted"))),
        desc(F.when(by_date, F.col("_sent"))),
        desc("priority"),
        desc(F.when(~by_date, F.col("_sent"))),
        desc(F.when(~by_date, F.col("odds"))),
        F.col("pos"),
    ]
    return df, keys


def sort_tracker(apps: DataFrame, file: str | None = "file", then: tuple = ()) -> DataFrame:
    """Tracker rows with ``queue_rank``, their place in their file's queue.

    The keys form a total order that ends in the old position, so sorting a sorted
    tracker changes nothing.  ``then`` are columns that order rows of the same position.
    """
    df, keys = _queue_keys(apps)
    ranked = with_rank(df, [*keys, *then], "queue_rank", [file] if file else None)
    return ranked.drop("_sent", "_posted")


def queue_position(apps: DataFrame) -> DataFrame:
    """Group and place within the group, across both files."""
    df, keys = _queue_keys(apps)
    ranked = with_rank(df, keys[1:], "group_rank", ["queue_group"])
    return ranked.drop("_sent", "_posted")


def moved_rows(sorted_apps: DataFrame, index: str = "index") -> DataFrame:
    """Rows the sort put somewhere else; ``index`` is the 1-based old place."""
    return sorted_apps.filter(F.col("queue_rank") != F.col(index))


def view_status_rank(status_id) -> Column:
    order = {s: i for i, s in enumerate(fixed.VIEW_STATUS_ORDER)}
    c = F.col(status_id) if isinstance(status_id, str) else status_id
    return F.coalesce(F.try_element_at(literal_map(order), c), F.lit(9))


def tab_filter(tab: str) -> Column:
    if tab == "all":
        return F.lit(True)
    if tab == "top":
        return (F.col("score") >= 4.0) & (F.col("status_id") != "skip")
    return F.col("status_id") == tab


TABS = ["all", "evaluated", "applied", "interview", "top", "skip"]


def view_order(mode: str) -> list:
    keys = {
        "score": [desc("score")],
        "date": [desc("date")],
        "company": [F.lower("company")],
        "status": [view_status_rank("status_id")],
    }
    return keys[mode]


def queue_view(apps: DataFrame, tab: str = "all", sort: str = "score", grouped: bool = False):
    """The rows of a tab with ``view_rank``; grouped views sort by status first.

    The grouped view repeats the chosen order inside a group; by status it falls
    back to the score.
    """
    df = apps.withColumn("status_id", normalize_status("status")).filter(tab_filter(tab))
    order = view_order(sort)
    if grouped:
        inner = view_order("score") if sort == "status" else order
        order = [view_status_rank("status_id"), *inner]
    return with_rank(df, [*order, F.col("pos")], "view_rank")


def view_sorts(apps: DataFrame, mode: str, grouped: bool = False) -> DataFrame:
    return queue_view(apps, "all", mode, grouped)


def queue_tabs(apps: DataFrame) -> DataFrame:
    """Rows per tab, all tabs counted in one pass."""
    one = apps.withColumn("status_id", normalize_status("status")).agg(
        *[count_if(tab_filter(t)).alias(t) for t in TABS]
    )
    rows = F.array(*[F.struct(F.lit(t).alias("tab"), F.col(t).alias("rows")) for t in TABS])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def archive_split(apps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(live, archive)``: rows that can no longer change leave the queue."""
    closed = F.col("_status").isin(fixed.CLOSED_STATUSES)
    df = apps.withColumn("_status", normalize_status("status"))
    return df.filter(~closed).drop("_status"), df.filter(closed).drop("_status")


def archive_move(live: DataFrame, archive: DataFrame) -> tuple[DataFrame, DataFrame]:
    keep, move = archive_split(live)
    return keep, archive.unionByName(move)


def union_live_archive(live: DataFrame, archive: DataFrame) -> DataFrame:
    """Both halves of the tracker; analysis and deduplication read this."""
    return live.withColumn("archived", F.lit(False)).unionByName(
        archive.withColumn("archived", F.lit(True))
    )


def next_batch(items: DataFrame, state: DataFrame, start: int = 0, retry_failed: bool = False,
               max_retries: int = 2) -> DataFrame:
    """Items still to be processed; a failed one until its retries are used up."""
    last = state.groupBy("id").agg(F.max_by(F.struct("status", "retries"), "pos").alias("s"))
    status = F.coalesce("s.status", F.lit("none"))
    retries = F.coalesce("s.retries", F.lit(0))
    joined = items.filter((F.col("id") >= start) & (F.coalesce("url", F.lit("")) != "")).join(
        last, "id", "left"
    )
    if retry_failed:
        wanted = (status == "failed") & (retries < max_retries)
    else:
        wanted = (status != "completed") & ~((status == "failed") & (retries >= max_retries))
    return joined.filter(wanted).select(*items.columns)


def batch_summary(state: DataFrame) -> DataFrame:
    """Totals per state and the mean score cut (not rounded) to one decimal."""
    scored = F.when(F.col("status") == "completed", F.col("score").try_cast("decimal(12,4)"))
    return state.agg(
        F.count(F.lit(1)).alias("total"),
        count_if(F.col("status") == "completed").alias("completed"),
        count_if(F.col("status") == "failed").alias("failed"),
        count_if(~F.col("status").isin("completed", "failed") | F.col("status").isNull()).alias("pending"),
        F.count(scored).alias("scored"),
        (F.floor(F.avg(scored) * 10) / 10).cast("double").alias("avg_score"),
    )


def additions_order(files: DataFrame, name: str = "file") -> DataFrame:
    """Incoming files with the number their name carries and their merge order."""
    digits = F.regexp_replace(F.col(name), r"\D", "")
    numbered = files.withColumn(
        "file_number", F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))
    )
    return with_rank(numbered, [F.col("file_number"), F.col(name)], "merge_order")
