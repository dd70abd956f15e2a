"""Each step of the URL chain, and who reaches it."""

from oppflow.operators import enrich

APPS = "pos long, company string, role string, url string, has_report boolean, report_url string, batch_id long, report_number string"


def frames(spark):
    apps = spark.createDataFrame([
        (1, "Acme", "Data Lead", "https://own/1", True, "https://report/1", 1, "7"),
        (2, "Acme", "Data Lead", "", True, "https://report/2", 1, "7"),
        (3, "Acme", "Data Lead", None, True, None, 1, "7"),
        (4, "Acme", "Data Lead", "n/a", True, None, 99, "007"),
        (5, "Acme", "Data Lead", "", False, "https://report/5", 1, "7"),
        (6, "Beta", "Cloud Lead", "", None, None, None, None),
        (7, "Gamma", None, "", False, None, None, None),
        (8, None, "Data Lead", "", False, None, None, None),
        (5, "Acme", "Data Lead", "", False, "https://report/5", 1, "7"),
    ], APPS)
    items = spark.createDataFrame([(1, "https://batch/1", 1, "Beta", "Cloud Lead"), (2, None, 2, "Gamma", "x"), (3, "https://batch/3", 3, None, "y")],
                                  "id long, job_url string, pos long, company string, role string")
    state = spark.createDataFrame([(3, "completed", "7", 1), (1, "failed", "8", 2)], "id long, status string, report_num string, pos long")
    history = spark.createDataFrame([("acme", "Lead of Data", "https://history/1", 1), ("acme", "Sales", "https://history/2", 2), ("gamma", "x", "file", 3)],
                                    "company string, title string, url string, pos long")
    return apps, items, state, history


def test_every_step(spark):
    got = sorted((r.pos, r.url_from, r.job_url) for r in enrich.enrich_urls(*frames(spark)).collect() if r.url_from)
    assert got == [
        (1, "own", "https://own/1"), (2, "report", "https://report/2"), (3, "batch id", "https://batch/1"),
        (4, "report number", "https://batch/3"), (5, "history", "https://history/1"), (5, "history", "https://history/1"),
        (6, "batch company", "https://batch/1"),
    ]
    out = enrich.enrich_urls(*frames(spark))
    assert out.count() == 9 and out.columns[-2:] == ["job_url", "url_from"]


def test_rows_with_a_url_reach_no_later_step(spark, monkeypatch):
    seen, real = [], enrich.best_role_match
    monkeypatch.setattr(enrich, "best_role_match", lambda apps, c: seen.append(apps) or real(apps, c))
    enrich.enrich_urls(*frames(spark)).collect()
    reached = [sorted({r.pos for r in df.collect()}) for df in seen]
    assert reached == [[5, 6, 7, 8], [6, 7, 8]]
