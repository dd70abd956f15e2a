"""Registered queries: streaming forms, run over all that is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.plans.registry import register
from oppflow.streaming import activity, intake, jobs, timers


def event_stream(v):
    """The event table as a stream, its local timestamps read as UTC; a folder or a single file."""
    path = f"{v.sf_dir.rstrip('/')}/events.parquet"
    reader = v.spark.readStream.schema(v.table("events").schema)
    file = v.spark._jvm.org.apache.hadoop.fs.Path(path)
    if file.getFileSystem(v.spark._jsc.hadoopConfiguration()).getFileStatus(file).isDirectory():
        stream = reader.parquet(path)
    else:  # a file source watches folders
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@register("stream_intake", """
    SELECT DISTINCT 'https://jobs.example.com/' || user_id || '/' || event_type AS url, 'Company ' || user_id AS company,
           event_type AS title FROM events e
    WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = e.user_id
        AND e.event_type = CASE WHEN c_mktsegment = 'BUILDING' THEN 'click' ELSE 'purchase' END)""")
def stream_intake(v):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "/click").otherwise("/purchase")
    known = v.table("customer").select(
        F.concat(F.lit("https://jobs.example.com/"), F.col("c_custkey").cast("string"), kind).alias("url"),
        F.lit("").alias("company"), F.lit("").alias("title"),
    )
    postings = intake.event_postings(event_stream(v))
    return intake.stream_intake(postings, known).select("url", "company", "title")


@register("stream_weekly_activity", """
    SELECT strftime(ts, '%G-W%V') AS week, count(*) AS rows FROM events GROUP BY 1""")
def stream_weekly_activity(v):
    out = jobs.run_to_table(activity.stream_weekly_activity(event_stream(v)), "update")
    return out.groupBy("week").agg(F.max_by("rows", "batch_id").alias("rows"))


@register("stream_reposts", """
    WITH daily AS (SELECT company, title, day, count(*) AS n FROM (
        SELECT DISTINCT user_id AS company, event_type AS title, event_id % 5 AS url, CAST(ts AS DATE) AS day FROM events)
        GROUP BY ALL),
    windows AS (SELECT company, title, day, sum(n) OVER (PARTITION BY company, title ORDER BY day
        RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW) AS urls FROM daily)
    SELECT CAST(company AS VARCHAR) AS company, title, CAST(day + INTERVAL 1 DAY AS DATE) AS window_end,
        urls::BIGINT AS urls FROM windows WHERE urls >= 2""")
def stream_reposts(v):
    postings = event_stream(v).select(
        "ts", F.col("user_id").cast("string").alias("company"), F.col("event_type").alias("title"),
        (F.col("event_id") % 5).cast("string").alias("url"),
    )
    return activity.stream_reposts(postings)


def touches_of(events):
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'applied' WHEN 'click' THEN 'followup' ELSE 'view' END")
    return events.select("ts", (F.col("user_id") * 40 + F.hour("ts")).alias("app"), kind.alias("kind"))


# The states one after another, day by day of each application; at last up to the day that the watermark has passed.
_WAIT, _RETIRE, _MOST = fixed.CADENCE["applied_first"], fixed.RETIRE_DAYS + 1, fixed.CADENCE["applied_max_followups"]
_DUE = """list_concat(
            CASE WHEN late THEN [{'day': last + %d, 'state': 'overdue'}] ELSE [] END,
            CASE WHEN gone THEN [{'day': applied + %d, 'state': 'retired'}] ELSE [] END)""" % (_WAIT, _RETIRE)


def _ticked(relation: str, day: str) -> str:
    """A state with the deadlines up to a day: overdue unless retired before, retired."""
    return f"""(SELECT *, COALESCE(state = 'waiting' AND last + {_WAIT} <= {day} AND last <= applied + {_RETIRE - _WAIT}, false) AS late,
            COALESCE(state <> 'retired' AND applied + {_RETIRE} <= {day}, false) AS gone FROM {relation})"""


@register("stream_follow_up_timers", f"""
    WITH RECURSIVE passed_day AS (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) - 1 AS until FROM events),
    touches AS MATERIALIZED (
        SELECT app, day, first, followups, row_number() OVER (PARTITION BY app ORDER BY day) AS i FROM (
            SELECT user_id * 40 + hour(ts) AS app, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'signup') AS first,
                count(*) FILTER (event_type = 'click') AS followups FROM events GROUP BY 1, 2), passed_day
        WHERE day <= until),
    walk AS (
        SELECT DISTINCT app, 0::BIGINT AS i, NULL::DATE AS applied, NULL::DATE AS last, 0::BIGINT AS sent,
            NULL::VARCHAR AS state, []::STRUCT(day DATE, state VARCHAR)[] AS passed FROM touches
        UNION ALL
        SELECT app, i, applied, CASE WHEN moved THEN day ELSE last END, CASE WHEN moved THEN sent + followups ELSE sent END,
            CASE WHEN moved THEN after ELSE state END,
            CASE WHEN moved AND after <> state THEN list_append(passed, {{'day': day, 'state': after}}) ELSE passed END
        FROM (
            SELECT *, COALESCE(followups > 0 AND state <> 'retired', false) AS moved,
                CASE WHEN sent + followups >= {_MOST} THEN 'cold' ELSE 'waiting' END AS after
            FROM (
                SELECT app, i, day, followups, sent, CASE WHEN born THEN day ELSE applied END AS applied,
                    CASE WHEN born THEN day ELSE last END AS last,
                    CASE WHEN born THEN 'waiting' WHEN gone THEN 'retired' WHEN late THEN 'overdue' ELSE state END AS state,
                    CASE WHEN born THEN [{{'day': day, 'state': 'waiting'}}] ELSE {_DUE} END AS passed
                FROM (
                    SELECT *, state IS NULL AND first > 0 AS born
                    FROM {_ticked("(SELECT w.app, t.i, t.day, t.first, t.followups, w.applied, w.last, w.sent, w.state FROM walk w JOIN touches t ON t.app = w.app AND t.i = w.i + 1)", "day")}
                )))),
    ended AS (
        SELECT app, {_DUE} AS passed FROM {_ticked("(SELECT app, arg_max(applied, i) AS applied, arg_max(last, i) AS last, arg_max(state, i) AS state FROM (SELECT * FROM walk WHERE state IS NOT NULL) GROUP BY app), passed_day", "until")})
    SELECT app, p.day AS day, p.state AS state FROM (
        SELECT app, unnest(passed) AS p FROM (SELECT app, passed FROM walk UNION ALL SELECT app, passed FROM ended))""")
def stream_follow_up_timers(v):
    stream = timers.stream_follow_up_timers(touches_of(event_stream(v)))
    return jobs.run_to_table(stream, "append", settings=timers.SETTINGS).drop("batch_id")
