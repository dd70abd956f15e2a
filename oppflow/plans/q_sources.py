"""Registered queries: readers over text and payloads that Spark writes from the tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from oppflow.functions import classify as C
from oppflow.functions import fixed
from oppflow.functions import text as T
from oppflow.plans import duck as D
from oppflow.plans.duck import with_views
from oppflow.plans.registry import register
from oppflow.sources import boards, cards, lines, reports, sinks, tables
from oppflow.session import durable, scratch_path

# --- board payloads ------------------------------------------------------------
_URL = "'https://jobs.example.com/' || p_partkey"
_STAMP = "'2024-01-' || lpad(CAST(1 + p_size % 28 AS STRING), 2, '0') || 'T23:30:00-05:00'"
_MILLIS = "CAST((1704067200 + CAST(p_size AS BIGINT) * 86400) * 1000 AS STRING)"
_JSON = {
    "greenhouse": f"""to_json(named_struct('jobs', array(named_struct('title', title, 'absolute_url', {_URL},
        'location', named_struct('name', 'Wien'), 'first_published', CASE WHEN p_size % 2 = 0 THEN {_STAMP} ELSE '' END,
        'updated_at', {_STAMP}), named_struct('title', title || ' II', 'absolute_url', '', 'location', null,
        'first_published', null, 'updated_at', null))))""",
    "ashby": f"""to_json(named_struct('jobs', array(named_struct('title', title, 'jobUrl', {_URL},
        'location', 'Wien', 'publishedAt', {_STAMP}))))""",
    "lever": f"""'[{{"text":' || to_json(array(title)) || '}}]'""",
    "comeet": f"""to_json(array(named_struct('name', title, 'url_comeet_hosted_page', CASE WHEN p_size % 3 = 0 THEN {_URL} END,
        'url_active_page', CASE WHEN p_size % 3 = 1 THEN {_URL} ELSE '' END, 'position_url', {_URL},
        'location', named_struct('name', 'Wien'), 'time_updated', {_STAMP})))""",
    "workable": f"""to_json(named_struct('jobs', array(named_struct('title', title, 'shortlink', '', 'url', {_URL},
        'city', 'Wien', 'state', '', 'country', 'Austria', 'published_on', '', 'created_at', {_STAMP}))))""",
}
_JSON["lever"] = f"""regexp_replace(to_json(array(named_struct('text', title, 'hostedUrl', {_URL},
    'categories', named_struct('location', 'Wien'), 'createdAt', {_MILLIS}))), '"createdAt":"(\\\\d+)"', '"createdAt":$1')"""
_DAY = "DATE '2024-01-02' + CAST(p_size % 28 AS INTEGER)"
_POSTED = {p: _DAY for p in _JSON}
_POSTED["lever"] = "DATE '2024-01-01' + CAST(p_size AS INTEGER)"
_LOCATION = {p: "Wien" for p in _JSON}
_LOCATION["workable"] = "Wien, Austria"


def payloads_of(v, provider: str | None = None):
    titles = v.titles
    if provider:
        payload = F.expr(_JSON[provider])
        return titles.select(F.concat(F.lit("Board "), F.col("p_partkey").cast("string")).alias("company"),
                             F.lit(provider).alias("provider"), payload.alias("payload"))
    chain = None
    for i, p in enumerate(_JSON):
        test = F.col("p_partkey") % 5 == i
        value = F.struct(F.lit(p).alias("provider"), F.expr(_JSON[p]).alias("payload"))
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return titles.select(
        F.concat(F.lit("Board "), F.col("p_partkey").cast("string")).alias("company"), chain.alias("b")
    ).select("company", "b.*")


def _board_sql(provider: str, where: str = "true") -> str:
    first = f"""SELECT 'Board ' || p_partkey AS company, 0::BIGINT AS ordinal, title, {_URL} AS url,
        '{_LOCATION[provider]}' AS location, {_POSTED[provider]} AS posted, '{provider}-api' AS source
        FROM titles WHERE {where}"""
    if provider != "greenhouse":
        return first
    return first + f""" UNION ALL SELECT 'Board ' || p_partkey, 1, title || ' II', '', '', NULL, 'greenhouse-api'
        FROM titles WHERE {where}"""


for _provider in boards.PROVIDERS:
    register(f"parse_board_{_provider}", with_views(["titles"], _board_sql(_provider)))(
        lambda v, p=_provider: boards.parse_board(payloads_of(v, p), p)
    )


@register("ingest_postings", with_views(["titles"], " UNION ALL ".join(
    _board_sql(p, f"p_partkey % 5 = {i}") for i, p in enumerate(_JSON))))
def ingest_postings(v):
    return boards.ingest_postings(payloads_of(v))


_PAGES = """CASE s_suppkey % 9 WHEN 0 THEN 'https://jobs.lever.co/acme' || s_suppkey || '/x'
    WHEN 1 THEN 'https://jobs.ashbyhq.com/acme' || s_suppkey WHEN 2 THEN 'https://apply.workable.com/acme' || s_suppkey || '?a=1'
    WHEN 3 THEN 'https://job-boards.eu.greenhouse.io/acme' || s_suppkey WHEN 4 THEN 'https://acme.example.com/careers'
    ELSE 'https://job-boards.greenhouse.io/acme' || s_suppkey END"""
_API = """CASE s_suppkey % 9 WHEN 5 THEN 'https://boards-api.greenhouse.io/v1/boards/a' || s_suppkey || '/jobs'
    WHEN 6 THEN 'https://www.comeet.co/careers-api/' || s_suppkey WHEN 7 THEN 'https://internal.example.com' ELSE '' END"""


@register("board_targets", f"""
    SELECT s_name AS name, CASE k WHEN 0 THEN 'lever' WHEN 1 THEN 'ashby' WHEN 2 THEN 'workable' WHEN 3 THEN 'greenhouse'
           WHEN 5 THEN 'greenhouse' WHEN 6 THEN 'comeet' WHEN 8 THEN 'greenhouse' END AS provider,
           CASE k WHEN 0 THEN 'https://api.lever.co/v0/postings/acme' || s_suppkey
           WHEN 1 THEN 'https://api.ashbyhq.com/posting-api/job-board/acme' || s_suppkey || '?includeCompensation=true'
           WHEN 2 THEN 'https://apply.workable.com/api/v1/widget/accounts/acme' || s_suppkey
           WHEN 3 THEN 'https://boards-api.greenhouse.io/v1/boards/acme' || s_suppkey || '/jobs'
           WHEN 5 THEN 'https://boards-api.greenhouse.io/v1/boards/a' || s_suppkey || '/jobs'
           WHEN 6 THEN 'https://www.comeet.co/careers-api/' || s_suppkey
           WHEN 8 THEN 'https://boards-api.greenhouse.io/v1/boards/acme' || s_suppkey || '/jobs' END AS endpoint
    FROM (SELECT *, s_suppkey % 9 AS k FROM supplier WHERE s_acctbal > 0)""")
def board_targets(v):
    companies = v.table("supplier").select(
        F.col("s_name").alias("name"), F.expr(_PAGES).alias("careers_url"), F.expr(_API).alias("api"),
        (F.col("s_acctbal") > 0).alias("enabled"),
    )
    targets, skipped = boards.board_targets(companies)
    none = F.lit(None).cast("string")
    return targets.unionByName(skipped.select("name", none.alias("provider"), none.alias("endpoint")))


# --- inbox lines ---------------------------------------------------------------
def inbox_text_of(v):
    df = v.posting.withColumns({
        "company": F.expr("CASE WHEN pos % 4 = 0 THEN company || ' | HR' ELSE company END"),
        "title": F.expr("CASE WHEN pos % 5 = 0 THEN title || ' (m|w|d)' ELSE title END"),
        "tier": F.expr("CASE pos % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'C' END"),
        "posted": F.expr("CASE WHEN pos % 2 = 0 THEN posted END"),
        "title_generic": F.expr("pos % 7 = 0"),
    })
    # Every sixth line has an unescaped bar, which splits its title in two.
    line = lines.inbox_line()
    return df.select("pos", F.when(F.col("pos") % 6 == 5, F.replace(line, F.lit(" | tier"), F.lit(" | extra | tier")))
                     .otherwise(line).alias("line"))


@register("read_inbox_lines", with_views(["posting"], """
    SELECT pos, url, CASE WHEN pos % 4 = 0 THEN company || ' | HR' ELSE company END AS company,
        CASE WHEN pos % 5 = 0 THEN title || ' (m|w|d)' ELSE title END
        || CASE WHEN pos % 6 = 5 AND pos % 3 < 2 AND location <> '' THEN ' | ' || location ELSE '' END AS title,
        CASE WHEN pos % 6 = 5 AND pos % 3 < 2 THEN 'extra' ELSE location END AS location,
        CASE pos % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'C' END AS tier, CASE WHEN pos % 2 = 0 THEN posted END AS posted,
        pos % 7 = 0 AS title_generic FROM posting"""))
def read_inbox_lines(v):
    return lines.read_inbox_lines(inbox_text_of(v))


# --- tracker tables ------------------------------------------------------------
CANONICAL_HEADER = "| Date | Company | Role | Fit | Odds | Priority | Status | Output | Report | Location | Reasoning | URL |"
LEGACY_HEADER = "| # | Fecha | Empresa | Puesto | Score | Estado | PDF | Informe | Notas |"


def tracker_text_of(v):
    """The tracker as two text files: the live half canonical, the archive legacy."""
    def score(c):
        return F.concat(F.lit("**"), F.col(c).cast("string"), F.lit("/5**"))

    def row(*cells):
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    esc = T.escape_cell
    canonical = row(F.col("date").cast("string"), esc("company"), esc(F.concat(F.col("role"), F.lit(" (m|w)"))), score("fit"),
                    score("odds"), score("priority"), F.col("status"), F.col("output"), F.col("report"),
                    esc("location"), esc("notes"), F.col("url"))
    legacy = row(F.col("num").cast("string"), F.col("date").cast("string"), esc("company"), esc("role"), score("fit"),
                 F.col("status"), F.col("output"), F.col("report"), esc("notes"))
    app = v.app
    body = app.select("file", (F.col("pos") + 5).alias("line_no"),
                      F.when(F.col("archived"), legacy).otherwise(canonical).alias("line"))
    head = app.select("file").distinct().select("file", F.explode(F.array(
        F.struct(F.lit(1).cast("bigint").alias("line_no"), F.lit("# Applications").alias("line")),
        F.struct(F.lit(3).cast("bigint").alias("line_no"),
                 F.when(F.col("file") == "live", F.lit(CANONICAL_HEADER)).otherwise(F.lit(LEGACY_HEADER)).alias("line")),
        F.struct(F.lit(4).cast("bigint").alias("line_no"), F.lit("| --- | --- | --- |").alias("line")),
    )).alias("h")).select("file", "h.line_no", "h.line")
    # Written once: the reader passes over its lines twice.
    return durable(head.unionByName(body))


_REPORT_NO = "TRY_CAST(NULLIF(regexp_extract(report, '\\[(\\d+)\\]', 1), '') AS BIGINT)"
_TRACKER_SQL = f"""
    SELECT file, pos, CASE WHEN archived THEN COALESCE(NULLIF(num, 0), NULLIF({_REPORT_NO}, 0)) ELSE NULLIF({_REPORT_NO}, 0) END AS num,
        date, company, CASE WHEN archived THEN role ELSE role || ' (m|w)' END AS role, fit,
        CASE WHEN archived THEN 0.0::DOUBLE ELSE odds END AS odds,
        CASE WHEN archived THEN 0.0::DOUBLE ELSE priority END AS priority, status, output, report,
        CASE WHEN archived THEN '' ELSE location END AS location, trim(notes) AS notes,
        CASE WHEN archived THEN '' ELSE url END AS url FROM app"""
_TRACKER_COLUMNS = ["file", "num", "date", "company", "role", "fit", "odds", "priority", "status", "output", "report",
                    "location", "notes", "url"]


@register("read_tracker", with_views(["app"], _TRACKER_SQL))
def read_tracker(v):
    return lines.read_tracker(tracker_text_of(v)).select((F.col("pos") - 5).alias("pos"), *_TRACKER_COLUMNS)


@register("read_tracker_all", with_views(["app"], "SELECT pos - 0 AS pos, file, archived FROM app"))
def read_tracker_all(v):
    text = tracker_text_of(v)
    both = lines.read_tracker_all(text.filter("file = 'live'"), text.filter("file = 'archive'"))
    return both.select((F.col("pos") - 5).alias("pos"), "file", "archived")


# --- incoming evaluations ------------------------------------------------------
def addition_files_of(v):
    tab = F.lit("\t")
    no, day = F.col("file_no").cast("string"), F.col("date").cast("string")
    score = F.concat(F.col("priority").cast("string"), F.lit("/5"))
    report = F.replace("report", F.lit("(../reports"), F.lit("(reports"))
    full = F.concat_ws("\t", no, day, "company", "role", score, score, score, F.lit("Applied"), F.lit("-"), report,
                       "location", "notes", F.lit("-"))
    piped = F.concat(F.lit("| "), F.concat_ws(" | ", no, day, "company", "role", score, score, score, F.lit("✅"), F.lit("-"),
                                              report, F.lit("Wien"), "notes", F.lit("-")), F.lit(" |"))
    legacy = F.concat_ws("\t", no, day, "company", "role", F.lit("entrevista"), score, F.lit("-"), report, "notes")
    swapped = F.concat_ws("\t", no, day, "company", "role", score, F.lit("ghosted"), F.lit("-"), report, "notes")
    broken = F.concat(F.lit("nope"), tab, F.lit("not"), tab, F.lit("enough"))
    unnumbered = F.concat_ws("\t", F.lit("x"), day, "company", "role", F.lit("Applied"), score, F.lit("-"), report)
    forms = [full, piped, legacy, swapped, broken, unnumbered]
    chain = None
    for i, form in enumerate(forms):
        test = F.col("file_no") % 6 == i
        chain = F.when(test, form) if chain is None else chain.when(test, form)
    return v.addition.select(F.concat(F.lit("add-"), no, F.lit(".tsv")).alias("file"), chain.alias("content"))


@register("read_additions", with_views(["addition"], """
    SELECT file_no, CASE WHEN k < 4 THEN file_no END AS num, CASE WHEN k < 4 THEN date END AS date,
        CASE WHEN k < 4 THEN company END AS company, CASE WHEN k < 4 THEN priority || '/5' END AS priority,
        CASE k WHEN 0 THEN priority || '/5' WHEN 1 THEN priority || '/5' WHEN 2 THEN '-' WHEN 3 THEN '-' END AS odds,
        CASE k WHEN 0 THEN '✅' WHEN 1 THEN '✅' WHEN 2 THEN '🎯' WHEN 3 THEN '👻' END AS status,
        CASE WHEN k < 4 THEN report END AS report, CASE WHEN k < 4 THEN notes END AS notes,
        CASE k WHEN 4 THEN '3 fields' WHEN 5 THEN 'invalid entry number' END AS reason
    FROM (SELECT *, file_no % 6 AS k FROM addition) WHERE NOT (file_no = 0 AND k < 4)
    UNION ALL SELECT file_no, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'invalid entry number'
    FROM addition WHERE file_no = 0"""))
def read_additions(v):
    good, bad = lines.read_additions(addition_files_of(v))
    columns = ["num", "date", "company", "priority", "odds", "status", "report", "notes"]
    return good.select("file_no", *columns, F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("file_no", "reason"), allowMissingColumns=True
    )


# --- typed tables --------------------------------------------------------------
def tsv_of(df, key: str, columns: list[str], header: str, file: str):
    body = df.select(F.lit(file).alias("file"), (F.col(key) + 3).alias("line_no"),
                     F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line"))
    spark = df.sparkSession
    head = spark.createDataFrame([(file, 1, header), (file, 2, "")], "file string, line_no bigint, line string")
    # Written once: the reader passes over its lines several times.
    return durable(head.unionByName(body))


@register("read_scan_history", with_views(["posting"], """
    SELECT pos, url, posted AS first_seen, source, title, company, 'added' AS status FROM posting"""))
def read_scan_history(v):
    df = v.posting.withColumn("status", F.lit("added"))
    text = tsv_of(df, "pos", ["url", "posted", "source", "title", "company", "status"],
                  "url\tfirst_seen\tportal\ttitle\tcompany\tstatus", "history")
    return tables.parse_history(text).select(
        (F.col("pos") - 3).alias("pos"), "url", "first_seen", "source", "title", "company", "status"
    )


@register("read_outcomes", with_views(["app", "outcome"], """
    SELECT pos, company, date, NULLIF(report, 0) AS report, stages_passed, NULLIF(furthest_stage, '') AS furthest_stage
    FROM outcome"""))
def read_outcomes(v):
    df = v.outcome.withColumns({"first_contact": F.lit(""), "outcome": F.lit("open"), "reason": F.lit("")})
    text = tsv_of(df, "pos", ["company", "date", "first_contact", "stages_passed", "furthest_stage", "outcome", "reason",
                              "report"],
                  "company\tdate\tfirst_contact\tstages_passed\tfurthest_stage\toutcome\treason\treport", "outcomes")
    return tables.parse_outcomes(text).select(
        (F.col("pos") - 3).alias("pos"), "company", "date", "report", "stages_passed", "furthest_stage"
    )


@register("read_followups", """
    SELECT o_orderkey AS num, o_custkey AS app_num, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS channel FROM orders""")
def read_followups(v):
    df = v.table("orders").select(
        F.lit("followups").alias("file"), F.col("o_orderkey").alias("line_no"),
        F.concat(F.lit("| "), F.concat_ws(" | ", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"),
                 F.to_date("o_orderdate").cast("string"), F.lit("Acme"), F.lit("PM"), "o_orderpriority",
                 F.lit("Jo"), F.lit("n")), F.lit(" |")).alias("line"),
    )
    return tables.parse_followups(df).select("num", "app_num", "date", "channel")


@register("read_exclusions", with_views(["exclusion"], "SELECT pos, date, company, role, reason FROM exclusion"))
def read_exclusions(v):
    df = v.exclusion.select(
        F.lit("excluded").alias("file"), F.col("pos").alias("line_no"),
        F.concat(F.lit("| "), F.concat_ws(" | ", F.col("date").cast("string"), T.escape_cell("company"),
                                          T.escape_cell("role"), T.escape_cell("reason")), F.lit(" |")).alias("line"),
    )
    header = df.sparkSession.createDataFrame(
        [("excluded", -2, "| Date | Company | Role | Reason |"), ("excluded", -1, "| --- | --- | --- | --- |")],
        "file string, line_no bigint, line string",
    )
    return tables.parse_exclusions(header.unionByName(df)).select("pos", "date", "company", "role", "reason")


# --- reports -------------------------------------------------------------------
_REPORT = """'# ' || title || chr(10) || '**URL:** https://r.example.com/' || p_partkey || chr(10) || '**Batch ID:** ' || p_partkey
    || chr(10) || '| **Archetype** | ' || CASE p_size % 3 WHEN 0 THEN 'Platform' WHEN 1 THEN 'AI | ' ELSE 'DevEx' END || ' |' || chr(10)
    || '| Nivel | Senior |' || chr(10) || '| Remote | Hybrid |' || chr(10) || '| Team size | ' || p_size || ' people |' || chr(10)
    || '| Salario | 100k |' || chr(10) || '| Industry | Tools |' || chr(10) || chr(10)
    || '| CV Match | ' || (p_size % 5) || '.5/5 |' || chr(10) || '| North Star | 4/5 |' || chr(10) || '| Comp | 3.5/5 |' || chr(10)
    || '| Cultural | 2/5 |' || chr(10) || '| Red flags | -0.5 |' || chr(10) || '| **Global** | **4.1/5** |' || chr(10) || chr(10)
    || '| Gap | Severity | Mitigation |' || chr(10) || '| --- | --- | --- |' || chr(10)
    || '| Go ' || p_size || ' | Hard | learn |' || chr(10) || '| Visa \\| permit | Soft |  |' || chr(10) || chr(10) || 'Done.'"""


def report_texts_of(v):
    return v.titles.select("p_partkey", F.expr(_REPORT.replace("\\|", "\\\\|")).alias("text"))


@register("parse_reports", with_views(["titles"], """
    SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Platform' WHEN 1 THEN 'AI' ELSE 'DevEx' END AS archetype,
        'Senior' AS seniority, 'Hybrid' AS remote, p_size || ' people' AS team_size, '100k' AS comp, 'Tools' AS domain,
        (p_size % 5)::DOUBLE + 0.5::DOUBLE AS cv_match, 4.0::DOUBLE AS north_star, 3.5::DOUBLE AS comp_score,
        2.0::DOUBLE AS cultural, (-0.5)::DOUBLE AS red_flags, 4.1::DOUBLE AS global_score,
        'Go ' || p_size || ':hard:learn;Visa | permit:soft:' AS gaps FROM titles"""))
def parse_reports(v):
    df = reports.parse_reports(report_texts_of(v))
    gaps = F.array_join(F.transform("gaps", lambda g: F.concat_ws(":", g["description"], g["severity"], g["mitigation"])), ";")
    return df.withColumn("gaps", gaps)


@register("report_header_links", with_views(["titles"], """
    SELECT p_partkey, 'https://r.example.com/' || p_partkey AS report_url, p_partkey AS batch_id FROM titles"""))
def report_header_links(v):
    df = report_texts_of(v)
    return df.select("p_partkey", *[c.alias(n) for n, c in reports.report_header_links("text").items()])


# The four list cells in every spelling, some missing, some longer than the list shows.
_SUMMARY = """concat('# Report ', num, chr(10),
    CASE num % 3 WHEN 0 THEN concat('| **Arquetipo detectado** | AI ', p_name, ' |') WHEN 1 THEN concat('**Arquetipo:** Platform ', p_size)
        ELSE '' END, chr(10),
    CASE num % 4 WHEN 0 THEN concat('| **TL;DR** | ', repeat(concat(p_name, ' '), p_size), ' |') WHEN 1 THEN concat('**tl;dr:**  short ', num, '  ||')
        WHEN 2 THEN '' ELSE concat('| **TL;DR** | ', num, ' |', chr(10), '**TL;DR:** not this') END, chr(10),
    '| **Remote** | Hybrid ', num % 7, ' | ', chr(10),
    CASE num % 5 WHEN 0 THEN '' ELSE concat('**Comp** | ', num, '-', num + 10, 'k || ') END)"""


def _summary_sql(*patterns: str) -> str:
    cells = ", ".join(f"NULLIF(regexp_extract(body, {D.quote(p)}, 1), '')" for p in patterns)
    return f"trim(rtrim(trim(COALESCE({cells})), '|'))"


@register("report_summary", with_views(["report_source"], f"""
    SELECT num, {_summary_sql('(?i)\\*\\*Arquetipo(?:\\s+detectado)?\\*\\*\\s*\\|\\s*(.+)', '(?i)\\*\\*Arquetipo:\\*\\*\\s*(.+)')} AS archetype,
        CASE WHEN length(t) > 120 THEN substr(t, 1, 117) || '...' ELSE t END AS tldr,
        {_summary_sql('(?i)\\*\\*Remote\\*\\*\\s*\\|\\s*(.+)')} AS remote,
        {_summary_sql('(?i)\\*\\*Comp\\*\\*\\s*\\|\\s*(.+)')} AS comp
    FROM (SELECT *, {_summary_sql('(?i)\\*\\*TL;DR\\*\\*\\s*\\|\\s*(.+)', '(?i)\\*\\*TL;DR:\\*\\*\\s*(.+)')} AS t FROM summaries)""",
    f"summaries AS MATERIALIZED (SELECT num, {_SUMMARY} AS body FROM report_source)"))
def report_summary(v):
    df = v.report_source.select("num", F.expr(_SUMMARY).alias("text"))
    return df.select("num", *[c.alias(n) for n, c in reports.report_summary("text").items()])


# Facts a real corpus rarely carries: prose is scanned whole and yields nothing or noise.
@register("parse_reports_corpus", with_views(["doc"], """
    SELECT doc_id, NULL::VARCHAR AS archetype, 0::BIGINT AS gaps FROM doc"""))
def parse_reports_corpus(v):
    df = reports.parse_reports(v.doc)
    return df.select("doc_id", "archetype", F.size("gaps").cast("bigint").alias("gaps"))


# --- pages ---------------------------------------------------------------------
_CARD = """html || '<ul><li><div data-entity-urn="urn:li:jobPosting:' || (1000000 + page_id) || '"><h3 class="base-search-card__title">'
    || chr(10) || '  ' || regexp_extract(html, '<title>(.*?)</title>', 1) || chr(10) || '</h3><h4 class="base-search-card__subtitle">'
    || CASE page_id % 3 WHEN 0 THEN '<a class="hidden-nested-link" href="x">Acme &amp; Co</a>' WHEN 1 THEN '<a href="y"> Acme </a>'
       ELSE '' END || '</h4><span class="job-search-card__location">M&#252;nchen&nbsp;&#x1F600;</span><time datetime="2024-02-1'
    || (page_id % 10) || '"></time></div></li></ul>'"""


@register("parse_search_cards", with_views(["page"], """
    SELECT page_id, job_id, CASE page_id % 3 WHEN 0 THEN 'Acme & Co' ELSE 'Acme' END AS company,
        trim(regexp_replace(replace(t, '&amp;', '&'), '\\s+', ' ', 'g')) AS title, 'München 😀' AS location,
        DATE '2024-02-10' + CAST(page_id % 10 AS INTEGER) AS posted, 'https://www.linkedin.com/jobs/view/' || job_id AS url
    FROM (SELECT page_id, CAST(1000000 + page_id AS VARCHAR) AS job_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS t
          FROM page) WHERE page_id % 3 < 2 AND trim(t) <> ''"""))
def parse_search_cards(v):
    pages = v.page.select("page_id", F.expr(_CARD).alias("html"))
    return cards.parse_search_cards(pages).drop("card")


@register("harvest_urls", with_views(["page"], """
    SELECT page_id, ordinal - 1 AS ordinal, regexp_replace(u, '[.,]+$', '') AS url
    FROM (SELECT page_id, unnest(us) AS u, generate_subscripts(us, 1) AS ordinal FROM (
        SELECT page_id, regexp_extract_all(html || ' see [link](' || url || '), ' || url || '. | ' || url || ' |',
               'https?://[^\\s|)\\]]+') AS us FROM page))"""))
def harvest_urls(v):
    text = F.expr("html || ' see [link](' || url || '), ' || url || '. | ' || url || ' |'")
    return cards.harvest_urls(v.page.select("page_id", text.alias("t")), "t")


_BODY_TAIL = """CASE page_id % 10 WHEN 0 THEN ' This job has expired.' WHEN 1 THEN ' Position has been filled' WHEN 2 THEN ' 663 JOBS FOUND'
    WHEN 3 THEN ' diese Stelle ist bereits besetzt' ELSE '' END"""
_STRIP = ("(?i)<style\\b[^>]*>[\\s\\S]*?</style>|<script\\b[^>]*>[\\s\\S]*?</script>|<[^>]*>|<[^>]*$")


@register("classify_liveness", with_views(["page"], f"""
    SELECT page_id, CASE WHEN status = 404 THEN 'expired' WHEN final_url LIKE '%error=true%' THEN 'expired'
        WHEN regexp_matches(body, {D.quote('(?i)' + '|'.join(fixed.EXPIRED_TEXTS))}) THEN 'expired'
        WHEN page_id % 4 = 0 THEN 'active' WHEN regexp_matches(body, '(?i)\\d+\\s+jobs?\\s+found') THEN 'expired'
        WHEN length(regexp_replace(body, '^\\s+|\\s+$', '', 'g')) < 300 THEN 'expired' ELSE 'uncertain' END AS result
    FROM (SELECT page_id, CASE page_id % 17 WHEN 0 THEN 404 ELSE 200 END AS status,
        url || CASE page_id % 13 WHEN 0 THEN '&error=true' ELSE '' END AS final_url,
        regexp_replace(html, {D.quote(_STRIP)}, '', 'g') || {_BODY_TAIL} AS body FROM page)"""))
def classify_liveness(v):
    df = v.page.select(
        "page_id", F.expr("CASE page_id % 17 WHEN 0 THEN 404 ELSE 200 END").alias("status"),
        F.expr("url || CASE page_id % 13 WHEN 0 THEN '&error=true' ELSE '' END").alias("final_url"),
        F.concat(T.page_text("html"), F.expr(_BODY_TAIL)).alias("body"),
        F.expr("CASE WHEN page_id % 4 = 0 THEN array('Share', 'Apply for this Job') ELSE array('Reapplying') END").alias("controls"),
    )
    return df.select("page_id", C.classify_liveness("status", "final_url", "body", "controls")["result"].alias("result"))


_TYPESET = "replace(replace(replace(replace(html, '%%%', '…'), '***', '“q”'), '###', '—' || chr(160)), '$$$', '‘–’')"
_COUNTED = f"regexp_replace({_TYPESET}, {D.quote(_STRIP)}, '', 'g')"


def _count(chars: str) -> str:
    return f"(length(t) - length(translate(t, {D.quote(chars)}, '')))"


@register("ats_normalize", with_views(["page"], "SELECT page_id, " + ", ".join(
    f"{_count(chars)} AS {name}" for name, (chars, _) in fixed.CLEANED_CHARACTERS.items()) + f""",
    length(h) + 2 * {_count('…')} - {_count(fixed.CLEANED_CHARACTERS['zero_width'][0])} AS cleaned_length
    FROM (SELECT page_id, {_TYPESET} AS h, {_COUNTED} AS t FROM page)"""))
def ats_normalize(v):
    # chr() of Spark stops at Latin-1, which the no-break space still is.
    df = v.page.select("page_id", F.expr(_TYPESET).alias("h"))
    return df.select("page_id", *[c.alias(n) for n, c in T.ats_counts("h").items()],
                     F.length(T.ats_normalize("h")).cast("bigint").alias("cleaned_length"))


# One of every kind after each title; what they must become is written out in the SQL.
_ENTITIES = [
    "&lt;b&gt; &quot;q&quot;", "&#65;&#x42;", "&#x1F600;", "no&nbsp;&#160;break", "it&apos;s", "&unknown; &# &amp",
    "&#252;&#X20ac;", "&amp;lt; once", "&#x110000;", "&#" + "0" * 50 + "90;",
]


@register("decode_entities", with_views(["page"], """
    SELECT page_id, trim(regexp_replace(replace(t, '&amp;', '&'), '\\s+', ' ', 'g')) || ' ' || CASE page_id % 10
        WHEN 0 THEN '<b> "q"' WHEN 1 THEN 'AB' WHEN 2 THEN '😀' WHEN 3 THEN 'no break' WHEN 4 THEN 'it''s'
        WHEN 5 THEN '&unknown; &# &amp' WHEN 6 THEN 'ü€' WHEN 7 THEN '&lt; once' WHEN 8 THEN '&#x110000;' ELSE 'Z' END AS title
    FROM (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS t FROM page)"""))
def decode_entities(v):
    more = F.element_at(F.array(*map(F.lit, _ENTITIES)), (F.col("page_id") % 10 + 1).cast("int"))
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return v.page.select("page_id", T.decode_entities(F.concat(title, F.lit(" "), more)).alias("title"))


# --- scalar functions ----------------------------------------------------------
@register("dedup_keys", with_views(["posting"], f"""
    SELECT pos, unnest(list_filter([url, 'li:' || ({D.job_id('url')})], lambda k: k IS NOT NULL)) AS key FROM posting"""))
def dedup_keys(v):
    return v.posting.select("pos", F.explode(T.dedup_keys("url")).alias("key"))


@register("report_links", with_views(["app"], f"""
    SELECT pos, {_REPORT_NO} AS number, CASE WHEN report <> '' THEN 'reports/' || regexp_extract(report, '\\[(\\d+)\\]', 1)
           || '-x.md' END AS path FROM app"""))
def report_links(v):
    return v.app.select("pos", T.report_num("report").alias("number"), T.report_path("report", F.lit("data")).alias("path"))


@register("sent_and_posted_dates", with_views(["app"], f"""
    SELECT pos, {D.SENT_ON} AS sent_on, {D.POSTED_ON} AS posted_on FROM app"""))
def sent_and_posted_dates(v):
    return v.app.select("pos", T.effective_applied_date("notes", "date").alias("sent_on"), T.posted_date("notes").alias("posted_on"))


@register("normalize_company", with_views(["companies"], f"""
    SELECT company, {D.company_key('company')} AS letters, {D.company_words('company')} AS words,
           {D.company_base('company')} AS base, count(*) AS n FROM companies GROUP BY 1, 2, 3, 4"""))
def normalize_company(v):
    return v.companies.groupBy(
        "company", T.company_key("company").alias("letters"), T.company_words("company").alias("words"),
        T.company_base("company").alias("base"),
    ).agg(F.count(F.lit(1)).alias("n"))


@register("normalize_role", with_views(["titles"], f"""
    SELECT p_partkey, {D.normal_role('title')} AS role, {D.group_title('title')} AS opening,
           array_to_string({D.role_tokens('title')}, ' ') AS tokens, {D.stem('title')} AS stem,
           array_to_string(list_sort({D.dedup_bag('title')}), ' ') AS bag FROM titles"""))
def normalize_role(v):
    return v.titles.select(
        "p_partkey", T.normalize_role("title").alias("role"), T.group_title("title").alias("opening"),
        F.array_join(T.role_tokens("title"), " ").alias("tokens"), T.stem_key("title").alias("stem"),
        F.array_join(F.array_sort(T.dedup_tokens("title")), " ").alias("bag"),
    )


@register("split_row", with_views(["posting"], """
    SELECT pos, company || ' | x' AS first_cell, title AS second_cell, 5::BIGINT AS cells FROM posting"""))
def split_row(v):
    row = F.concat(F.lit("| "), T.escape_cell(F.concat(F.col("company"), F.lit(" | x"))), F.lit(" |  "),
                   T.escape_cell("title"), F.lit("  | |"))
    cells = T.split_row(row)
    return v.posting.select("pos", cells[1].alias("first_cell"), cells[2].alias("second_cell"),
                            F.size(cells).cast("bigint").alias("cells"))


@register("split_search_result_title", with_views(["titles"], """
    SELECT p_partkey, p_name AS title, 'Acme ' || p_partkey AS company FROM part"""))
def split_search_result_title(v):
    mark = "CASE p_partkey % 4 WHEN 0 THEN ' @ ' WHEN 1 THEN ' | ' WHEN 2 THEN ' — ' ELSE ' at ' END"
    df = v.table("part").select("p_partkey", F.expr(f"p_name || {mark} || 'Acme ' || p_partkey").alias("headline"))
    return df.select("p_partkey", cards.split_search_title("headline").alias("s")).select("p_partkey", "s.*")


@register("truncate", with_views(["titles"], """
    SELECT p_partkey, CASE WHEN length(title) > 20 THEN substr(title, 1, 19) || '…' ELSE title END AS shown FROM titles"""))
def truncate(v):
    return v.titles.select("p_partkey", T.truncate("title", 20).alias("shown"))


# --- sinks ---------------------------------------------------------------------
@register("append_postings", with_views(["posting"], """
    SELECT t.name AS table_name, DATE '2000-07-01' AS scan_date, t.status, count(*) AS rows, count(DISTINCT url) AS urls,
        min(title) AS first_title, max(company) AS last_company
    FROM posting, (VALUES ('history', 'added'), ('inbox', NULL)) t(name, status) GROUP BY ALL"""))
def append_postings(v):
    spark = v.spark
    inbox, history = scratch_path(spark, "inbox"), scratch_path(spark, "history")
    for _ in range(2):  # the second time is a retry of the first
        sinks.append_postings(v.posting, inbox, history, dt.date(2000, 7, 1), run_id="2000-07-01")
    written = sinks.committed_rows(spark, history, history).select(F.lit("history").alias("table_name"), "scan_date", "status", "url", "title", "company")
    listed = sinks.committed_rows(spark, inbox, history).select(
        F.lit("inbox").alias("table_name"), "scan_date", F.lit(None).cast("string").alias("status"), "url", "title", "company")
    return written.unionByName(listed).groupBy("table_name", "scan_date", "status").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("url").alias("urls"),
        F.min("title").alias("first_title"), F.max("company").alias("last_company"),
    )
