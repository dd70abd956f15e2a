"""Appends to inbox and history that stop half-way and are repeated."""

import datetime as dt

import pytest

from oppflow.sources import sinks

DAY = dt.date(2026, 1, 1)


def rows(spark, *urls):
    return spark.createDataFrame([(u, "s", "t", "c") for u in urls], "url string, source string, title string, company string")


def urls(spark, path, history):
    return sorted(r.url for r in sinks.committed_rows(spark, path, history).collect())


def test_a_run_that_stopped_between_the_tables(spark, tmp_path, monkeypatch):
    inbox, history = str(tmp_path / "inbox"), str(tmp_path / "history")
    assert sinks.append_postings(rows(spark, "a"), inbox, history, DAY, "first")

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as broken:
        broken.setattr(sinks, "history_rows", killed)
        with pytest.raises(RuntimeError):
            sinks.append_postings(rows(spark, "b", "c"), inbox, history, DAY, "second")
    assert urls(spark, inbox, history) == urls(spark, history, history) == ["a"]
    # the retry sees one posting less: what the first attempt wrote is replaced
    assert sinks.append_postings(rows(spark, "b"), inbox, history, DAY, "second")
    assert not sinks.append_postings(rows(spark, "b"), inbox, history, DAY, "second")
    assert urls(spark, inbox, history) == urls(spark, history, history) == ["a", "b"]


def test_unnamed_runs_and_runs_without_rows(spark, tmp_path):
    inbox, history = str(tmp_path / "inbox"), str(tmp_path / "history")
    for day in (1, 2):
        assert sinks.append_postings(rows(spark, "a", None), inbox, history, dt.date(2026, 1, day))
    assert sinks.append_postings(rows(spark), inbox, history, DAY, "empty")
    got = sinks.committed_rows(spark, history, history)
    assert got.groupBy("scan_date").count().count() == 2 and got.count() == 4
    assert {r.status for r in got.collect()} == {"added"}
    with pytest.raises(ValueError):
        sinks.append_postings(rows(spark, "a"), inbox, history, DAY, "../other")


def test_nothing_is_read_before_the_first_run_is_complete(spark, tmp_path):
    path = str(tmp_path / "inbox")
    rows(spark, "a").write.parquet(f"{path}/run_id=run-x")
    assert sinks.committed_rows(spark, path, str(tmp_path / "history")).count() == 0
