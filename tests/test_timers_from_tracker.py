"""Follow-up timers that start from a tracker."""

import datetime as dt

from oppflow.streaming import jobs, timers

TRACKER = "app long, applied date, last date, sent int, state string"


def day(n):
    return dt.date(2024, 1, n)


def test_timers_go_on_from_a_tracker(spark, tmp_path):
    tracker = spark.createDataFrame([
        (1, day(1), None, None, None),            # nothing sent: overdue on the 8th, retired on the 16th
        (2, day(2), day(5), 1, "waiting"),        # the follow-up of the 10th makes it cold
        (3, day(1), day(2), 1, "overdue"),        # overdue is not reported again
        (4, day(1), day(3), 0, "retired"),        # stays retired, whatever comes
        (5, day(1), day(1), 0, "waiting"), (5, day(1), day(4), 1, "waiting"),  # the later row counts
        (None, day(1), None, None, None), (6, None, None, None, None),          # no application
    ], TRACKER)
    rows = [(day(10), 2, "followup"), (day(10), 4, "followup"), (day(11), 7, "applied"), (day(9), 1, "view"), (day(25), 99, "view")]
    folder = f"{tmp_path}/in"
    events = spark.createDataFrame([(dt.datetime(d.year, d.month, d.day, 12), a, k) for d, a, k in rows], "ts timestamp, app long, kind string")
    events.coalesce(1).write.parquet(folder)
    stream = timers.stream_follow_up_timers(spark.readStream.schema(events.schema).parquet(folder), tracker=tracker)
    got = sorted(tuple(r)[:3] for r in jobs.run_to_table(stream, "append", settings=timers.SETTINGS).collect())
    assert got == [
        (1, day(8), "overdue"), (1, day(16), "retired"), (2, day(10), "cold"), (2, day(17), "retired"),
        (3, day(16), "retired"), (5, day(11), "overdue"), (5, day(16), "retired"),
        (7, day(11), "waiting"), (7, day(18), "overdue"),
    ]
    batch = timers.follow_up_transitions(events, day(23), tracker=tracker)
    assert sorted(map(tuple, batch.collect())) == got


def test_applications_share_their_state(spark, tmp_path):
    """A state per application cost a dozen calls from Python each; now a bucket's applications are one value."""
    rows = [(day(1 + i % 9), i, k) for i in range(2000) for k in ("applied", "followup") if k == "applied" or i % 3 == 0]
    rows += [(day(29), 5000, "view")]
    folder = f"{tmp_path}/in"
    events = spark.createDataFrame([(dt.datetime(d.year, d.month, d.day, 12), a, k) for d, a, k in rows], "ts timestamp, app long, kind string")
    events.coalesce(1).write.parquet(folder)
    stream = timers.stream_follow_up_timers(spark.readStream.schema(events.schema).parquet(folder))
    table = jobs.run_to_table(stream, "append", checkpoint=f"{tmp_path}/offsets", settings=timers.SETTINGS)
    got = sorted(tuple(r)[:3] for r in table.collect())
    assert got == sorted(map(tuple, timers.follow_up_transitions(events, day(27)).collect())) and len(got) > 4000
    kept = spark.read.format("statestore").option("path", f"{tmp_path}/offsets").option("stateVarName", "applications").load()
    assert kept.count() <= 256
