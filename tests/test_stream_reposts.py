"""Reposts over a stream: late postings count, days that are over are let go, the batch form agrees."""

import datetime as dt
import random

from oppflow.streaming import activity
from tests.test_streams import POSTING

START = dt.datetime(2024, 1, 1)


def arrive(spark, folder, rows):
    """Rows of (day number, url, company, title)."""
    made = [(START + dt.timedelta(days=d, hours=7), k, url, c, t) for k, (d, url, c, t) in enumerate(rows)]
    spark.createDataFrame(made, POSTING).coalesce(1).write.mode("append").parquet(folder)


def runner(spark, tmp_path, **options):
    folder, path, offsets = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/offsets"

    def poll():
        stream = spark.readStream.schema(POSTING).option("maxFilesPerTrigger", 1).parquet(folder)
        found = activity.stream_reposts(stream, path=path, checkpoint=offsets, **options)
        return sorted((r.company, r.title, (r.window_end - START.date()).days - 1, r.urls) for r in found.collect())

    return folder, poll


def test_posting_sixty_days_late_in_a_second_run(spark, tmp_path):
    folder, poll = runner(spark, tmp_path)
    arrive(spark, folder, [(0, "u1", "c", "t"), (100, "u9", "d", "t")])
    assert poll() == []
    # The newest posting is of day 100.  Day 40 is within ninety days of it, and of the posting of day 0.
    arrive(spark, folder, [(40, "u2", "c", "t"), (40, "u2", "c", "t")])
    assert poll() == [("c", "t", 40, 2)]
    # The same URL on the same day again changes nothing, on another day it counts.
    arrive(spark, folder, [(40, "u2", "c", "t"), (41, "u2", "c", "t"), (41, None, "c", "t")])
    assert poll() == [("c", "t", 40, 2), ("c", "t", 41, 4)]
    # More than ninety days late: dropped.
    arrive(spark, folder, [(9, "u3", "c", "t")])
    assert poll() == [("c", "t", 40, 2), ("c", "t", 41, 4)]
    assert poll() == [("c", "t", 40, 2), ("c", "t", 41, 4)]


def test_days_before_the_watermark_are_let_go(spark, tmp_path):
    folder, poll = runner(spark, tmp_path, late="10 days")
    arrive(spark, folder, [(0, "u1", "c", "t"), (1, "u2", "c", "t")])
    poll()
    arrive(spark, folder, [(50, "u3", "c", "t")])
    poll()
    arrive(spark, folder, [(51, "u4", "c", "t")])
    assert poll() == [("c", "t", 1, 2), ("c", "t", 50, 3), ("c", "t", 51, 4)]
    kept = spark.read.format("statestore").option("path", f"{tmp_path}/offsets").option("stateVarName", "days").load()
    assert sorted((r.key.day - START.date()).days for r in kept.selectExpr("user_map_key AS key").collect()) == [50, 51]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(80), f"u{rng.randrange(12)}", f"c{rng.randrange(4)}", rng.choice("st")) for _ in range(400)]
    folder, poll = runner(spark, tmp_path)
    for at in range(0, 400, 100):
        arrive(spark, folder, rows[at:at + 100])
        if at == 100:
            poll()
    table = spark.read.schema(POSTING).parquet(folder)
    want = sorted((r.company, r.title, (r.window_end - START.date()).days - 1, r.urls) for r in activity.reposts_of(table).collect())
    # A window's later part may have been filled after it was first written.
    assert poll() == want and len(want) > 100


def test_roles_share_their_state(spark, tmp_path):
    """A state entry per role and day cost three calls from Python each; now a bucket's roles of a day are one."""
    folder, poll = runner(spark, tmp_path)
    arrive(spark, folder, [(0, f"u{i}", f"c{i}", "t") for i in range(1500)] + [(1, None, None, "t"), (1, "u", "c1", None)])
    assert poll() == []
    arrive(spark, folder, [(1, f"v{i}", f"c{i}", "t") for i in range(1500)])
    assert poll() == sorted((f"c{i}", "t", 1, 2) for i in range(1500))
    kept = spark.read.format("statestore").option("path", f"{tmp_path}/offsets").option("stateVarName", "days").load()
    assert kept.count() <= 2 * 256
