"""Funnel, calibration, cadence, quality and streaming rules on small rows."""

import datetime as dt

from pyspark.sql import functions as F

from oppflow.operators import cadence, calibration, corpus, funnel, patterns, quality, scan, scores
from oppflow.plans.registry import Inputs


def test_cumulative_funnel(spark):
    apps = spark.createDataFrame([(s,) for s in ("", "✅", "❌", "👻", "🎯", "⏭️")], "status string")
    rows = {r.stage: r.rows for r in funnel.cumulative_funnel(apps).collect()}
    assert rows == {"Evaluated": 6, "Applied": 4, "Responded": 1, "Interview": 1, "Offer": 0}
    empty = {r.stage: (r.rows, r.pct) for r in funnel.cumulative_funnel(apps.limit(0)).collect()}
    assert empty["Applied"] == (0, 0.0)


def sent(spark, rows):
    return spark.createDataFrame(rows, "priority double, fit double, odds double, contact long, stages_passed long, furthest_stage string")


def test_calibration(spark):
    df = sent(spark, [(3.0, 3.5, 0.0, 1, 1, "screen"), (3.4, 3.5, 0.0, 0, 0, None), (4.5, 3.5, 1.0, 1, 2, ""), (3.5, 3.5, 5.0, 1, 9, None), (1.0, 3.5, 5.0, 1, 4, "final")])
    bands = {(r.score, r.band): (r.n, r.k) for r in calibration.banded_rates(df).collect()}
    assert bands["priority", "3.0-3.4"] == (2, 1) and bands["priority", "3.5-3.9"] == (1, 1)
    assert bands["odds", "<3.0"] == (3, 2) and bands["fit", "4.5+"] == (0, 0) and len(bands) == 15
    assert calibration.median_stages(df).first()[0] == 3.0
    assert {r.stage: r.rows for r in calibration.furthest_stage_histogram(df).collect()} == {"screen": 1, "unknown": 2, "final": 1}
    assert {r.score: r.r for r in calibration.score_correlation(df).collect()}["fit"] == 0.0
    gates = {(r.cut, r.side): (r.n, r.k) for r in calibration.gate_options(df).collect()}
    assert gates[3.5, "above"] == (2, 2) and gates[3.5, "below"] == (3, 2)
    none = df.limit(0)
    assert calibration.median_stages(none).first()[0] == 0.0
    assert calibration.base_rate(none).first().asDict() == {"n": 0, "k": 0, "rate": 0.0, "lo": 0.0, "hi": 0.0}


def test_retire(spark):
    rows = [(1, "✅", dt.date(2026, 1, 17), "n"), (2, "✅", dt.date(2026, 1, 16), "Done."), (3, "✅", dt.date(2026, 1, 16), "x; "),
            (4, "✅", dt.date(2025, 1, 1), ""), (5, "🎯", dt.date(2025, 1, 1), "n")]
    df = spark.createDataFrame(rows, "pos long, status string, date date, notes string")
    got = {r.pos: (r.retired, r.status, r.notes) for r in cadence.retire_stale(df, dt.date(2026, 1, 31)).collect()}
    assert got[1] == (False, "✅", "n") and got[5][0] is False
    assert got[2] == (True, "👻", "Done. Retired 2026-01-31 (no response after 15d)")
    assert got[3][2] == "x; Retired 2026-01-31 (no response after 15d)"
    assert got[4][2].startswith("Retired 2026-01-31 (no response after 395d)")
    assert cadence.retire_stale(df, dt.date(2026, 1, 31), stamp=False).filter("pos = 2").first().notes == "Done."


def test_scores(spark):
    names = ["north_star", "cv_match", "level_fit", "missed_requirements", "hard_blockers", "significant_gaps", "soft_gaps",
             "high_competition", "compensation", "company_tier", "location_fit", "growth"]
    df = spark.createDataFrame([(5.0, 5.0, 5.0, m, b, 0, 0, 0, 4.0, 4.0, 4.0, 4.0) for m, b in ((0, 0), (1, 1), (3, 4))], names)
    rows = scores.composite_scores(df).select(*[F.round(c, 3) for c in ("fit", "odds", "priority")]).collect()
    assert [tuple(r) for r in rows] == [(5.0, 5.0, 4.7), (3.0, 1.5, 2.85), (2.5, 0.5, 2.35)]


def test_lint_rules(spark):
    text = """Led work -- driving change. 2021 – 2024, Nov 2024 – Present and `a — b`.
## Work Experience
### Acme | PM | 2020
_Product: X_
### Beta | PM | 2021
text
### Candidate
## Projects
### Side | live | url"""
    rows = corpus.lint_documents(spark.createDataFrame([(1, text), (2, "a — b 1,200 engineers robust")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.label) for r in rows} == {
        (1, "EMDASH_CONTINUATION"), (1, "MISSING_PRODUCT_SUBTITLE"), (2, "DASH_IN_MD"), (2, "INTERNAL_NUMBERS"), (2, "CLICHE_VERBS")}
    assert [r.sample for r in rows if r.label == "MISSING_PRODUCT_SUBTITLE"] == ["Beta"]


def test_duplicates_and_links(spark):
    df = spark.createDataFrame([(1, "A-B", "PM, x", "[1](../reports/1.md)"), (2, "ab", "pm x", ""), (3, "C", "PM", "[2](../reports/2.md)")],
                               "pos long, company string, role string, report string")
    assert {(r.pos, r.copies) for r in quality.exact_duplicates(df).collect()} == {(1, 2), (2, 2)}
    files = spark.createDataFrame([("reports/1.md",)], "path string")
    assert [r.pos for r in quality.broken_links(df, files).collect()] == [3]


def test_reposts(spark):
    day = dt.date(2026, 1, 1)
    rows = [("A", "PM", f"u{i}", day + dt.timedelta(days=d)) for i, d in enumerate((0, 89, 300, 391))] + [("A", "PM", "u0", day + dt.timedelta(days=5)), ("B", "PM", "v", day)]
    df = spark.createDataFrame(rows, "company string, title string, url string, first_seen date")
    got = [(r.company, r.urls, r.most_in_window, str(r.reposted_on)) for r in scan.reposts(df).collect()]
    assert got == [("a", 4, 2, "2026-03-31")]
    assert scan.reposts(df.filter("url in ('u2','u3')")).count() == 0


def test_blockers_count_against_all_applications(spark):
    schema = "outcome string, gaps array<struct<description:string,severity:string,mitigation:string>>"
    df = spark.createDataFrame([("negative", [("Python", "hard", ""), ("Go", "hard", "")]), ("positive", None), ("pending", []), ("negative", [("Rust", "soft", "")])], schema)
    assert [(r.blocker, r.frequency, r.percentage) for r in patterns.blocker_analysis(df).collect()] == [("stack-mismatch", 2, 50)]


def test_timer_stream_equals_batch(spark, sf_dir):
    from oppflow.plans.q_streams import touches_of
    from oppflow.plans.queries import QUERIES
    from oppflow.streaming import timers

    events = Inputs(spark, sf_dir).table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.agg(F.max("ts")).first()[0]
    until = (last - dt.timedelta(days=2)).date()
    streamed = sorted(map(tuple, QUERIES["stream_follow_up_timers"](spark, sf_dir).collect()))
    batch = sorted(map(tuple, timers.follow_up_transitions(touches_of(events), until).collect()))
    assert streamed == batch and batch


def test_plans_stay_scalable(spark, sf_dir):
    """No query multiplies its inputs, and hot keys are cut before the shuffle."""
    from oppflow.plans.queries import QUERIES

    for name in ("tracked_by_url", "seen_keys", "collapse_openings", "reposts", "cumulative_funnel", "enrich_urls", "integrity_report"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    plan = QUERIES["tracked_by_url"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    plan = QUERIES["weekly_activity"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
