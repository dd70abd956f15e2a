"""Readers on literal text and payloads."""

import datetime as dt

from oppflow.sources import boards, cards, lines, reports, sinks, tables


def text_lines(spark, text, file="f"):
    rows = [(file, i + 1, line) for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, line_no long, line string")


CANONICAL = """# Applications

| Date | Company | Role | Fit | Odds | Priority | Status | Output | Report | Location | Reasoning | URL |
| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |
| 2026-08-25 | Borealis \\| Data | Product Lead (f\\|m\\|x) | 3.8/5 | 2.6/5 | 3.3/5 |  | - | [260](../reports/260-x.md) | Wien | ok | https://x.io |
| not a date | A | B | 1/5 | 1/5 | 1/5 | | | | | | |"""


def test_canonical_tracker(spark):
    row = lines.read_tracker(text_lines(spark, CANONICAL)).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.num, r.company, r.role, r.fit, r.odds, r.priority, r.score, r.status) == (
        260, "Borealis | Data", "Product Lead (f|m|x)", 3.8, 2.6, 3.3, 3.8, "")
    assert (r.output, r.location, r.notes, r.url, r.date) == ("-", "Wien", "ok", "https://x.io", dt.date(2026, 8, 25))


def test_legacy_and_headerless_trackers(spark):
    legacy = """| # | Fecha | Empresa | Puesto | Score | Estado | PDF | Informe | Notas |
|---|---|---|---|---|---|---|---|---|
| 7 | 2026-03-01 | Acme | PM | **4.1/5** | aplicado | ✅ | [7](r.md) | n |"""
    r = lines.read_tracker(text_lines(spark, legacy)).first()
    assert (r.num, r.company, r.score, r.status, r.notes, r.url) == (7, "Acme", 4.1, "aplicado", "n", "")
    bare = """| 2026-03-01 | Acme | PM | 4.1/5 | 3/5 | 3.5/5 | ✅ | - | [9](r.md) | Wien | n | u |
| 12 | 2026-03-02 | Beta | PM | 3/5 | ✅ | - | [12](r.md) | n |"""
    rows = {r.company: r for r in lines.read_tracker(text_lines(spark, bare)).collect()}
    assert (rows["Acme"].priority, rows["Acme"].num) == (3.5, 9)
    assert (rows["Beta"].score, rows["Beta"].num, rows["Beta"].priority) == (3.0, 12, 0.0)


def test_lines_from_files_are_numbered(spark, tmp_path):
    for name, n in (("a.md", 5000), ("b.md", 3)):
        (tmp_path / name).write_text("\n".join(f"{name} {i}" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = lines.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5003
    assert all(r.line == f"{r.file.split('/')[-1]} {r.line_no}" for r in got)


def test_inbox_lines(spark):
    text = """- [ ] https://x.io/1 | Acme \\| Co | PM | Wien | tier S | posted 2026-08-01
- [ ] https://x.io/2 | Acme | PM | Developer Platform | Wien | title-generic
- [x] https://x.io/3 | Acme | PM
- [ ] no url | Acme | PM
not an entry https://x.io/4 | a | b"""
    rows = {r.url: r for r in lines.read_inbox_lines(text_lines(spark, text)).collect()}
    assert set(rows) == {f"https://x.io/{i}" for i in (1, 2, 3)}
    one, two, three = (rows[f"https://x.io/{i}"] for i in (1, 2, 3))
    assert (one.company, one.title, one.location, one.tier, str(one.posted)) == ("Acme | Co", "PM", "Wien", "S", "2026-08-01")
    assert (two.title, two.location, two.title_generic, two.tier) == ("PM | Developer Platform", "Wien", True, None)
    assert (three.title, three.location, three.posted) == ("PM", "", None)


def test_additions(spark):
    files = [
        ("400.tsv", "400\t2026-08-25\tNorthwind\tAI Senior PM\t4/5\t3/5\t3.4/5\tApplied\t-\t[400](reports/400.md)\tWien\tn\tu"),
        ("401.tsv", "nope\tnot\tenough"), ("402.tsv", ""),
        ("403.tsv", "403\t2026-08-25\tA\tPM\t3.9/5\trechazado\t-\t[403](r.md)\tn"),
        ("404.tsv", "x\t2026-08-25\tA\tPM\tApplied\t3/5\t-\t[4](r.md)"),
        ("405.tsv", "| 405 | 2026-08-25 | A | PM | 4/5 | 3/5 | 3.4/5 | dup | - | [405](./reports/405.md) | Wien | n | u |"),
    ]
    good, bad = lines.read_additions(spark.createDataFrame(files, "file string, content string"))
    rows = {r.num: r for r in good.collect()}
    assert set(rows) == {400, 403, 405}
    assert (rows[400].status, rows[400].report, rows[400].priority) == ("✅", "[400](../reports/400.md)", "3.4/5")
    assert (rows[403].status, rows[403].priority, rows[403].odds) == ("❌", "3.9/5", "-")
    assert (rows[405].status, rows[405].report) == ("🚫", "[405](../reports/405.md)")
    assert {r.file_no: r.reason for r in bad.collect()} == {401: "3 fields", 402: "empty", 404: "invalid entry number"}


def test_typed_tables(spark):
    text = "# note\n\ncompany\tdate\tstages_passed\treport\nAcme\t2026-01-02\tx\t12"
    row = tables.parse_outcomes(text_lines(spark, text)).first()
    assert (row.company, row.date, row.stages_passed, row.report) == ("Acme", dt.date(2026, 1, 2), 0, 12)
    text = "url\tfirst_seen\tsource\ttitle\tcompany\tstatus\nu1\t2026-01-02\tx\tPM\tAcme\tadded\n\t2026\tx\tb\tc\td"
    rows = tables.parse_history(text_lines(spark, text)).collect()
    assert [(r.url, r.title) for r in rows] == [("u1", "PM")]
    text = "| # | App# | Date | Company | Role | Channel | Contact | Notes |\n|--|--|\n| 1 | 7 | 2026-01-02 | A | PM | mail | Jo | hi |"
    row = tables.parse_followups(text_lines(spark, text)).first()
    assert (row.num, row.app_num, row.channel, row.notes) == (1, 7, "mail", "hi")
    text = "| Date | Company | Role | Reason |\n| --- | --- | --- | --- |\n| 2026-01-02 | Acme | * | no |"
    assert [(r.company, r.role) for r in tables.parse_exclusions(text_lines(spark, text)).collect()] == [("Acme", "*")]


def test_board_payloads(spark):
    payloads = [
        ("A", "greenhouse", '{"jobs":[{"title":"PM","absolute_url":"u","location":{"name":"Wien"},"first_published":"","updated_at":"2024-01-02T00:00:00Z"}]}'),
        ("B", "lever", '[{"text":"PM","hostedUrl":"u","categories":{"location":"Graz"},"createdAt":1704153600000}]'),
        ("C", "lever", '{"ok":false}'), ("D", "workable", '{"jobs":[{"title":"PM","url":"u","city":"Linz","state":"","country":"Austria"}]}'),
        ("E", "ashby", "{}"), ("F", "comeet", '[{"name":"PM","url_active_page":"a","position_url":"p"}]'), ("G", "ashby", "not json"),
    ]
    rows = {r.company: r for r in boards.ingest_postings(
        spark.createDataFrame(payloads, "company string, provider string, payload string")).collect()}
    assert set(rows) == {"A", "B", "D", "F"}
    assert (str(rows["A"].posted), rows["A"].source, str(rows["B"].posted)) == ("2024-01-02", "greenhouse-api", "2024-01-02")
    assert (rows["D"].location, rows["F"].url, rows["F"].posted) == ("Linz, Austria", "a", None)


def test_cards_and_titles(spark):
    html = ('<ul><li class="x"><a data-entity-urn="urn:li:jobPosting:1234567"></a><span class="sr-only">PM &amp; more</span>'
            '<h4 class="base-search-card__subtitle"><a href="c"> Acme </a></h4><time datetime="2024-01-02"></time></li>'
            '<li><h3 class="base-search-card__title">No id</h3></li></ul>')
    row = cards.parse_search_cards(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert [(r.job_id, r.title, r.company, r.location, str(r.posted)) for r in row] == [
        ("1234567", "PM & more", "Acme", "", "2024-01-02")]
    heads = {"Senior AI PM (Remote) @ EverAI": ("Senior AI PM (Remote)", "EverAI"),
             "AI Engineer at Orbit": ("AI Engineer", "Orbit"), "PM | Acme": ("PM", "Acme"), "plain": (None, None)}
    df = spark.createDataFrame([(h,) for h in heads], "h string").select("h", cards.split_search_title("h").alias("s"))
    assert {r.h: (r.s.title, r.s.company) for r in df.collect()} == heads


def test_report(spark):
    text = """**URL:** https://x.io/1
| **Arquetipo** | Platform |
| Remote | Hybrid |
| Comp | 3/5 |
| Global | **4.2/5** |

| Gap | Severity | Mitigation |
|---|---|---|
| Go \\| Rust | Hard | learn |
| Visa | soft |

rest | x |"""
    row = reports.parse_reports(spark.createDataFrame([(1, text)], "id int, text string")).first()
    assert (row.archetype, row.remote, row.global_score, row.comp_score, row.seniority) == ("Platform", "Hybrid", 4.2, 3.0, None)
    assert [(g.description, g.severity, g.mitigation) for g in row.gaps] == [("Go | Rust", "hard", "learn"), ("Visa", "soft", "")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("u", "s", "t", "c")], "url string, source string, title string, company string")
    for day in (1, 2):
        sinks.append_postings(df, str(tmp_path / "inbox"), str(tmp_path / "history"), dt.date(2026, 1, day))
    assert spark.read.parquet(str(tmp_path / "history")).count() == 2
    sinks.write_document(df, str(tmp_path / "doc"))
    sinks.write_review(df, str(tmp_path / "review"))
    assert spark.read.json(str(tmp_path / "doc")).first().url == "u"


def test_ingest_reads_the_payloads_once(spark, sf_dir):
    from oppflow.plans.queries import QUERIES

    plan = QUERIES["ingest_postings"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 1
    shares = QUERIES["share_of_total"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in shares
