"""Follow-up cadence and retirement of applications nobody answered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.functions.classify import (
    follow_up_urgency, next_follow_up_date, normalize_status, status_symbol,
)
from oppflow.functions.text import days_between, effective_applied_date, extract_contacts
from oppflow.operators.ranks import with_rank

URGENCIES = ["urgent", "overdue", "waiting", "cold"]
ACTIONABLE = ["applied", "responded", "interview"]


def latest_followup(followups: DataFrame) -> DataFrame:
    """Count and last date per application, summed up before the shuffle."""
    return followups.groupBy("app_num").agg(
        F.count(F.lit(1)).alias("sent"), F.max("date").alias("last_sent")
    )


def followup_join(apps: DataFrame, followups: DataFrame) -> DataFrame:
    per_app = latest_followup(followups).withColumnRenamed("app_num", "num")
    return apps.join(per_app, "num", "left").withColumn(
        "sent", F.coalesce("sent", F.lit(0).cast("bigint"))
    )


def cadence(apps: DataFrame, followups: DataFrame, as_of, cfg: dict | None = None) -> DataFrame:
    """Open applications with their age, follow-ups, urgency and next date."""
    today = F.lit(as_of).cast("date")
    open_apps = apps.withColumn("status_id", normalize_status("status")).filter(
        F.col("status_id").isin(ACTIONABLE)
    ).withColumn("applied_on", effective_applied_date("notes", "date"))
    df = followup_join(open_apps, followups).withColumns({
        "days_since": days_between("applied_on", today),
        "days_since_last": days_between("last_sent", today),
    })
    df = df.withColumns({
        "urgency": follow_up_urgency("status_id", "days_since", "days_since_last", "sent", cfg),
        "next_date": next_follow_up_date("status_id", "applied_on", "last_sent", "sent", cfg),
        "contacts": extract_contacts("notes"),
    })
    return df.withColumn("days_until_next", days_between(today, "next_date"))


def overdue(df: DataFrame) -> DataFrame:
    return df.filter(F.col("urgency").isin("overdue", "urgent"))


def urgency_rank(col: str = "urgency"):
    chain = None
    for i, name in enumerate(URGENCIES):
        test = F.col(col) == name
        chain = F.when(test, F.lit(i)) if chain is None else chain.when(test, F.lit(i))
    return chain.otherwise(F.lit(9))


def urgency_order(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Most pressing first, file order within; the order is a column."""
    return with_rank(df, [urgency_rank(), F.col(pos)], "urgency_position")


def cadence_summary(df: DataFrame) -> DataFrame:
    counts = [F.count(F.when(F.col("urgency") == u, 1)).alias(u) for u in URGENCIES]
    return df.agg(F.count(F.lit(1)).alias("actionable"), *counts)


def retire_stale(apps: DataFrame, as_of, days: int = fixed.RETIRE_DAYS, stamp: bool = True):
    """Applied rows older than the window become ignored, with a note saying so."""
    today = F.lit(as_of).cast("date")
    age = days_between(effective_applied_date("notes", "date"), today)
    stale = (normalize_status("status") == "applied") & (age > days)
    base = F.regexp_replace(F.coalesce("notes", F.lit("")), r"[;\s]+$", "")
    sep = F.when(base == "", F.lit("")).when(base.rlike("[.!?]$"), F.lit(" ")).otherwise(F.lit("; "))
    note = F.concat(
        base, sep, F.lit("Retired "), today.cast("string"), F.lit(" (no response after "),
        age.cast("string"), F.lit("d)"),
    )
    return apps.withColumns({
        "retired": stale,
        "status": F.when(stale, status_symbol(F.lit("ignored"))).otherwise(F.col("status")),
        "notes": F.when(stale & F.lit(stamp), note).otherwise(F.col("notes")),
    })
