"""Counts over the whole tracker: metrics, funnel, histogram, weekly activity.

Every operator is one partially aggregated pass with a result of fixed size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.functions.classify import normalize_status, stage_rank
from oppflow.functions.stats import fixed_places, percent, rate
from oppflow.functions.text import first_filled, iso_week


def with_status(apps: DataFrame) -> DataFrame:
    return apps.withColumn("status_id", normalize_status("status"))


def literal_rows(df: DataFrame, rows: list, schema: str) -> DataFrame:
    """A handful of fixed rows as a table."""
    return df.sparkSession.createDataFrame(rows, schema)


def count_if(test):
    return F.count(F.when(test, 1))


def has_output(output="output"):
    c = F.coalesce(F.col(output), F.lit(""))
    return F.contains(c, F.lit("✅")) | F.contains(c, F.lit("]("))


def status_funnel(apps: DataFrame) -> DataFrame:
    """Rows and share per status id."""
    counts = with_status(apps).groupBy("status_id").agg(F.count(F.lit(1)).alias("rows"))
    return share_of_total(counts, "rows", "pct")


def share_of_total(counts: DataFrame, column: str, name: str) -> DataFrame:
    """Whole-number percentage of the total, for an already aggregated table."""
    # The total is one row; a window over everything would gather the counts in one task.
    total = counts.agg(F.sum(column).alias("_total")).withColumn("_all", F.lit(True))
    return (
        counts.withColumn("_all", F.lit(True)).join(F.broadcast(total), "_all")
        .withColumn(name, percent(column, F.col("_total"))).drop("_all", "_total")
    )


def queue_metrics(apps: DataFrame) -> DataFrame:
    """Total, average and best score over scored rows, rows with output, actionable."""
    scored = F.when(F.col("score") > 0, F.col("score"))
    return with_status(apps).agg(
        F.count(F.lit(1)).alias("total"),
        fixed_places(F.coalesce(F.avg(scored), F.lit(0.0)), 4).alias("avg_score"),
        F.coalesce(F.max(scored), F.lit(0.0)).alias("top_score"),
        count_if(has_output()).alias("with_output"),
        count_if(~F.col("status_id").isin(fixed.CLOSED_STATUSES)).alias("actionable"),
        count_if(F.col("status_id") == "offer").alias("offers"),
    )


FUNNEL_STAGES = [
    ("Evaluated", None),
    ("Applied", ["applied", "responded", "interview", "offer", "rejected", "ignored"]),
    ("Responded", ["responded", "interview", "offer"]),
    ("Interview", ["interview", "offer"]),
    ("Offer", ["offer"]),
]


def cumulative_funnel(apps: DataFrame) -> DataFrame:
    """Everything that reached at least a stage; rejected and ignored were applied."""
    one = with_status(apps).agg(*[
        (F.count(F.lit(1)) if ids is None else count_if(F.col("status_id").isin(ids))).alias(label)
        for label, ids in FUNNEL_STAGES
    ])
    rows = F.array(*[
        F.struct(
            F.lit(i).cast("bigint").alias("step"), F.lit(label).alias("stage"),
            F.col(label).alias("rows"),
            (rate("Applied", "Evaluated") if i == 1 else
             F.lit(1.0) if i == 0 else rate(label, "Applied")).alias("part"),
        )
        for i, (label, _) in enumerate(FUNNEL_STAGES)
    ])
    return one.select(F.explode(rows).alias("r")).select(
        "r.step", "r.stage", "r.rows", fixed_places(F.col("r.part") * 100, 4).alias("pct")
    )


def score_histogram(apps: DataFrame, score: str = "score") -> DataFrame:
    """Five score bands over scored rows; an empty band is kept with 0."""
    bands = [("<3.0", 0.0, 3.0), ("3.0-3.4", 3.0, 3.5), ("3.5-3.9", 3.5, 4.0),
             ("4.0-4.4", 4.0, 4.5), ("4.5-5.0", 4.5, float("inf"))]
    s = F.col(score)
    one = apps.filter(s > 0).agg(*[
        count_if((s >= low) & (s < high)).alias(label) for label, low, high in bands
    ])
    rows = F.array(*[
        F.struct(F.lit(label).alias("band"), F.col(f"`{label}`").alias("rows"))
        for label, _, _ in bands
    ])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def weekly_activity(apps: DataFrame, weeks: int = 8) -> DataFrame:
    """Rows per ISO week, for the last weeks that have any."""
    return (
        apps.filter("date IS NOT NULL").groupBy(iso_week("date").alias("week"))
        .agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("week").desc()).limit(weeks)
    )


def tracker_stats(apps: DataFrame) -> DataFrame:
    """Totals, average score, share with output and with report."""
    scored = F.when(F.col("score") > 0, F.col("score"))
    return apps.agg(
        F.count(F.lit(1)).alias("total"),
        fixed_places(F.coalesce(F.avg(scored), F.lit(0.0)), 4).alias("avg_score"),
        percent(count_if(has_output()), F.count(F.lit(1))).alias("pct_output"),
        percent(count_if(first_filled("report") != ""), F.count(F.lit(1))).alias("pct_report"),
    )


def furthest_stage(stages: DataFrame, key: str = "num") -> DataFrame:
    """The furthest stage each application reached, by the ladder's rank."""
    ranked = stages.withColumn("_rank", stage_rank("stage")).filter("_rank IS NOT NULL")
    names = F.create_map(*[F.lit(x) for i, r, _ in fixed.STAGES for x in (r, i)])
    return ranked.groupBy(key).agg(F.max("_rank").alias("_rank")).select(
        key, names[F.col("_rank")].alias("furthest"), F.col("_rank").cast("bigint").alias("rank")
    )
