"""Streams over files and folders, runs that carry on, and runs without input."""

import datetime as dt

import pytest

from oppflow.plans.queries import QUERIES
from oppflow.streaming import activity, intake, jobs, timers

POSTING = "ts timestamp, pos long, url string, company string, title string"


@pytest.mark.parametrize("name", [
    "stream_intake", "stream_weekly_activity", "stream_reposts", "stream_follow_up_timers"])
def test_folder_equals_file(spark, sf_dir, tmp_path, name):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet(f"{sf_dir}/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    from_folder = QUERIES[name](spark, str(tmp_path))
    from_file = QUERIES[name](spark, sf_dir)
    rows = sorted(map(str, from_folder.collect()))
    assert rows and rows == sorted(map(str, from_file.collect()))


def arrive(spark, folder, day, rows):
    when = dt.datetime(2024, 1, day)
    spark.createDataFrame([(when, *r) for r in rows], POSTING).coalesce(1).write.mode("append").parquet(folder)


def test_intake_carries_on(spark, tmp_path):
    folder, path, offsets = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/offsets"
    known = spark.createDataFrame([("https://a/1", "", "")], "url string, company string, title string")
    arrive(spark, folder, 1, [(1, "https://a/1", "Old", "x"), (2, "https://a/2", "Acme", "Dev"), (3, "https://a/2", "Acme", "Dev")])

    def poll():
        stream = spark.readStream.schema(POSTING).parquet(folder)
        return sorted(r.url for r in intake.stream_intake(stream, known, path, offsets).collect())

    assert poll() == ["https://a/2"]
    assert poll() == ["https://a/2"]
    arrive(spark, folder, 2, [(4, "https://a/2", "Other", "y"), (5, "https://a/5", "ACME", "dev"), (6, "https://a/6", "New", "z")])
    assert poll() == ["https://a/2", "https://a/6"]
    batches = jobs.batch_table(spark, f"{path}/accepted", spark.createDataFrame([], POSTING).drop("ts").schema)
    first, second = sorted(r.batch_id for r in batches.collect())
    assert first == 0 < second


def test_later_runs_read_only_what_is_new(spark, tmp_path):
    folder = f"{tmp_path}/in"
    read = []

    def poll():
        stream = spark.readStream.schema(POSTING).parquet(folder)
        jobs.run_batches(stream, "append", lambda batch, _: read.append(batch.count()), f"{tmp_path}/offsets")

    arrive(spark, folder, 1, [(k, f"u{k}", "c", "t") for k in range(5)])
    poll()
    arrive(spark, folder, 2, [(9, "u9", "c", "t")])
    poll()
    assert [n for n in read if n] == [5, 1]


def test_reposts_of_open_windows(spark, tmp_path):
    folder = f"{tmp_path}/in"
    arrive(spark, folder, 1, [(1, "u1", "c", "t"), (2, "u1", "c", "t"), (3, "u9", "d", "t")])
    arrive(spark, folder, 31, [(4, "u2", "c", "t")])
    later = dt.datetime(2024, 5, 1)
    spark.createDataFrame([(later, 5, "u3", "c", "t")], POSTING).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(POSTING).parquet(folder)
    rows = [tuple(r) for r in activity.stream_reposts(stream).collect()]
    # 1 May is 91 days after 31 January: the two earlier postings have left its window.
    assert rows == [("c", "t", dt.date(2024, 2, 1), 2)]


def test_no_input(spark, tmp_path):
    spark.createDataFrame([], POSTING).write.parquet(f"{tmp_path}/in")
    known = spark.createDataFrame([], "url string, company string, title string")
    for run in (lambda s: intake.stream_intake(s, known), activity.stream_reposts,
                lambda s: jobs.run_to_table(activity.stream_weekly_activity(s), "update")):
        assert run(spark.readStream.schema(POSTING).parquet(f"{tmp_path}/in")).collect() == []


def test_settings_are_put_back(spark):
    (key,) = timers.SETTINGS
    before = spark.conf.get(key, None)
    with jobs.settings_for(spark, timers.SETTINGS):
        assert spark.conf.get(key) == timers.SETTINGS[key]
    assert spark.conf.get(key, None) == before
