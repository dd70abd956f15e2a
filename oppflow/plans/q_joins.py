"""Registered queries: lookups, deduplication, merging and URL enrichment."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from oppflow.functions import classify as C
from oppflow.functions import text as T
from oppflow.operators import calibration, dedup, enrich, merge, quality, scan, seen
from oppflow.plans import duck as D
from oppflow.plans.duck import with_views
from oppflow.plans.q_rules import AS_OF_DATE, TITLE_CLASS_SQL, TITLE_FILTER, only_named
from oppflow.plans.registry import register
from oppflow.sources import lines

APP_AS_POSTING = {"role": "title"}
SINCE = dt.date(1996, 6, 1)


def as_posting(apps):
    return apps.withColumnsRenamed(APP_AS_POSTING)


# --- seen keys and new postings ------------------------------------------------
def _keys_sql(relation: str, title: str = "title") -> str:
    return f"""
        SELECT 'url' AS kind, url AS key FROM {relation} WHERE url <> ''
        UNION SELECT 'url', 'li:' || ({D.job_id('url')}) FROM {relation} WHERE ({D.job_id('url')}) IS NOT NULL
        UNION SELECT 'role', {D.role_key('company', title)} FROM {relation} WHERE company <> '' AND {title} <> ''"""


SEEN_SQL = f"seen AS MATERIALIZED ({_keys_sql('history')} UNION {_keys_sql('app', 'role')})"


def seen_of(v):
    return seen.seen_keys(v.history, as_posting(v.app))


@register("seen_keys", with_views(["history", "app"], "SELECT kind, key FROM seen", SEEN_SQL))
def seen_keys(v):
    return seen_of(v)


@register("union_seen_sources", with_views(["history", "app", "posting"], f"""
    SELECT kind, count(*) AS keys FROM (SELECT * FROM seen UNION {_keys_sql('posting')}) GROUP BY kind""", SEEN_SQL))
def union_seen_sources(v):
    return seen.seen_keys(v.history, as_posting(v.app), v.posting).groupBy("kind").agg(
        F.count(F.lit(1)).alias("keys")
    )


NEW_SQL = f"""
    keyed AS MATERIALIZED (SELECT *, 'li:' || ({D.job_id('url')}) AS job, {D.role_key('company', 'title')} AS rk FROM posting),
    fresh AS MATERIALIZED (SELECT * FROM keyed
      WHERE url NOT IN (SELECT key FROM seen WHERE kind = 'url')
        AND COALESCE(job, '') NOT IN (SELECT key FROM seen WHERE kind = 'url')
        AND rk NOT IN (SELECT key FROM seen WHERE kind = 'role'))"""


@register("new_postings", with_views(["history", "app", "posting"], "SELECT pos, url, company, title FROM fresh",
                                     SEEN_SQL, NEW_SQL))
def new_postings(v):
    return seen.new_postings(v.posting, seen_of(v)).select("pos", "url", "company", "title")


def _scan_keys(relation: str) -> str:
    return f"""SELECT pos, 'url ' || url AS key FROM {relation}
        UNION ALL SELECT pos, 'job ' || ({D.job_id('url')}) FROM {relation} WHERE ({D.job_id('url')}) IS NOT NULL
        UNION ALL SELECT pos, 'role ' || {D.role_key('company', 'title')} FROM {relation}"""


@register("first_wins_within_scan", with_views(
    ["posting"], "SELECT pos, url, company, title FROM posting JOIN firsts USING (pos)",
    D.greedy("firsts", _scan_keys("posting"))))
def first_wins_within_scan(v):
    return scan.dedup_within_scan(v.posting).select("pos", "url", "company", "title")


STAGED_SQL = [SEEN_SQL, D.tier_ctes("posting"), f"""
    judged AS MATERIALIZED (SELECT *, {TITLE_CLASS_SQL} AS class FROM posting JOIN tiers USING (location))""",
    NEW_SQL.replace("FROM posting)", "FROM judged WHERE class = 'pass' AND keep)"),
    D.greedy("firsts", _scan_keys("fresh")), """
    staged AS MATERIALIZED (SELECT *, CASE WHEN class <> 'pass' THEN 'filtered by title' WHEN NOT keep THEN 'out of tier'
        WHEN pos IN (SELECT pos FROM firsts) THEN 'new' ELSE 'duplicate' END AS stage FROM judged)"""]


@register("scan_summary", with_views(["history", "app", "posting"], """
    SELECT stage, count(*) AS rows FROM staged GROUP BY stage""", *STAGED_SQL))
def scan_summary(v):
    return scan.scan_summary(scan.scan_stages(v.posting, seen_of(v), TITLE_FILTER))


@register("new_by_tier", with_views(["history", "app", "posting"], """
    SELECT COALESCE(tier, '?') AS tier, count(*) AS rows FROM staged WHERE stage = 'new' GROUP BY 1""", *STAGED_SQL))
def new_by_tier(v):
    return scan.new_by_tier(scan.scan_stages(v.posting, seen_of(v), TITLE_FILTER))


# The share of the scan that does not depend on the order of the postings.
@register("scan_filtered_stages", with_views(["posting"], f"""
    SELECT stage, count(*) AS rows FROM (
        SELECT CASE WHEN {TITLE_CLASS_SQL} <> 'pass' THEN 'filtered by title' WHEN NOT keep THEN 'out of tier'
               ELSE 'compared' END AS stage FROM posting JOIN tiers USING (location)) GROUP BY stage""",
    D.tier_ctes("posting")))
def scan_filtered_stages(v):
    staged = scan.scan_stages(v.posting, seen_of(v), TITLE_FILTER)
    stage = F.when(F.col("stage").isin("new", "duplicate"), F.lit("compared")).otherwise(F.col("stage"))
    return staged.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("rows"))


@register("empty_boards", with_views(["companies", "posting"], """
    SELECT DISTINCT company AS name FROM companies WHERE company NOT IN (
        SELECT CASE WHEN posted >= DATE '2000-01-01' THEN company ELSE 'Closed ' || company END FROM posting)"""))
def empty_boards(v):
    targets = v.companies.select(F.col("company").alias("name")).distinct()
    named = F.expr("CASE WHEN posted >= DATE'2000-01-01' THEN company ELSE 'Closed ' || company END")
    return scan.empty_boards(targets, v.posting.withColumn("company", named))


@register("engaged_intersection", with_views(["posting", "app"], """
    SELECT pos, company FROM posting WHERE lower(trim(company)) IN
        (SELECT lower(trim(CASE WHEN status = '🎯' THEN company ELSE 'Other ' || company END)) FROM app)"""))
def engaged_intersection(v):
    return seen.engaged_intersection(v.posting, only_named(v.app, "🎯")).select("pos", "company")


# --- lookups -------------------------------------------------------------------
@register("first_seen_lookup", with_views(["posting", "history"], f"""
    SELECT posting.pos, h.first_seen FROM posting LEFT JOIN
        (SELECT {D.url_key('url')} AS k, arg_max(first_seen, pos) AS first_seen FROM history GROUP BY 1) h
        ON {D.url_key('url')} = h.k"""))
def first_seen_lookup(v):
    return seen.first_seen_lookup(v.posting, v.history).select("pos", "first_seen")


@register("since_filter", with_views(["posting", "history"], f"""
    SELECT posting.pos, h.first_seen FROM posting JOIN
        (SELECT {D.url_key('url')} AS k, arg_max(first_seen, pos) AS first_seen FROM history GROUP BY 1) h
        ON {D.url_key('url')} = h.k WHERE h.first_seen >= DATE '{SINCE}'"""))
def since_filter(v):
    return seen.since_filter(v.posting, v.history, SINCE).select("pos", "first_seen")


_BY_URL = f"""tracked AS MATERIALIZED (
    SELECT {D.url_key('url', True)} AS k, max(pos) AS tracked_pos FROM app WHERE url <> '' GROUP BY 1)"""


@register("tracked_by_url", with_views(["posting", "app"], f"""
    SELECT p.pos, app.role AS tracked_role, app.date AS tracked_date
    FROM (SELECT pos, {D.url_key('url', True)} AS k FROM posting) p
    LEFT JOIN tracked ON tracked.k = p.k LEFT JOIN app ON app.pos = tracked_pos""", _BY_URL))
def tracked_by_url(v):
    return seen.tracked_by_url(v.posting, v.app).select(
        "pos", F.col("by_url.role").alias("tracked_role"), F.col("by_url.date").alias("tracked_date")
    )


_EXCL = f"""excl AS MATERIALIZED (
    SELECT lower(company) AS c, CASE WHEN role = '*' THEN '*' ELSE {D.normal_role('role')} END AS r,
           arg_max(reason, pos) AS reason FROM exclusion GROUP BY 1, 2)"""


@register("exclusion_match", with_views(["posting", "exclusion"], f"""
    SELECT p.pos, COALESCE(a.reason, b.reason) AS reason
    FROM (SELECT pos, lower(trim(company)) AS c, {D.normal_role('title')} AS r FROM posting) p
    LEFT JOIN excl a ON a.c = p.c AND a.r = p.r LEFT JOIN excl b ON b.c = p.c AND b.r = '*'""", _EXCL))
def exclusion_match(v):
    return seen.exclusion_match(v.posting, v.exclusion).select(
        "pos", F.col("excluded.reason").alias("reason")
    )


@register("known_company", with_views(["posting", "app"], """
    SELECT pos, lower(trim(company)) IN (
        SELECT lower(trim(CASE WHEN status = '💰' THEN company ELSE 'Other ' || company END)) FROM app) AS known
    FROM posting"""))
def known_company(v):
    return seen.mark_company(v.posting, only_named(v.app, "💰"), "known").select("pos", "known")


@register("curated_company", with_views(["posting", "curated"], """
    SELECT pos, lower(trim(company)) IN (SELECT lower(trim(company)) FROM curated) AS curated FROM posting"""))
def curated_company(v):
    return seen.mark_company(v.posting, v.curated, "curated").select("pos", "curated")


HISTORY_SQL = f"""
    entries AS MATERIALIZED (SELECT lower(trim(company)) AS c, {D.normal_role('role')} AS n, pos, status, date, role FROM app),
    asked AS MATERIALIZED (SELECT pos, lower(trim(company)) AS c, {D.normal_role('title')} AS n FROM posting),
    same AS (SELECT asked.pos, min(e.pos) AS same_pos FROM asked JOIN entries e USING (c, n) GROUP BY 1),
    prior AS (SELECT asked.pos, same_pos, e.pos AS e_pos, e.status, e.date, e.role
              FROM asked LEFT JOIN same USING (pos) JOIN entries e ON e.c = asked.c),
    summary AS MATERIALIZED (
        SELECT pos, max(same_pos) AS same_pos, count(*) FILTER (e_pos IS DISTINCT FROM same_pos) AS others_total,
               min(e_pos) FILTER (e_pos IS DISTINCT FROM same_pos) AS other1,
               list_sort(list(e_pos) FILTER (e_pos IS DISTINCT FROM same_pos))[2] AS other2,
               bool_or(status = '❌' AND e_pos IS DISTINCT FROM same_pos) AS rejected_elsewhere
        FROM prior GROUP BY pos)"""


@register("posting_history", with_views(["posting", "app"], """
    SELECT asked.pos, same_pos, COALESCE(others_total, 0) AS others_total, other1, other2,
           COALESCE(rejected_elsewhere, false) AS rejected_elsewhere, summary.pos IS NOT NULL AS known
    FROM asked LEFT JOIN summary USING (pos)""", HISTORY_SQL))
def posting_history(v):
    df = seen.posting_history(v.posting, v.app)
    return df.select(
        "pos", F.col("same_role.pos").alias("same_pos"), F.col("others_total").cast("bigint").alias("others_total"),
        F.try_element_at("others", F.lit(1))["pos"].alias("other1"),
        F.try_element_at("others", F.lit(2))["pos"].alias("other2"), "rejected_elsewhere", "known",
    )


# --- role matching -------------------------------------------------------------
def fuzzy_sql(a: str, b: str) -> str:
    """The strict rule over precomputed ``<x>_set`` and ``<x>_stem``."""
    return f"""CASE WHEN len({a}_set) = 0 OR len({b}_set) = 0 THEN {a}_stem <> '' AND {a}_stem = {b}_stem
        WHEN list_has_all({a}_set, {b}_set) AND list_has_all({b}_set, {a}_set) THEN true
        WHEN list_has_all({a}_set, {b}_set) OR list_has_all({b}_set, {a}_set)
             THEN least(len({a}_set), len({b}_set)) >= 2
        ELSE false END"""


def _tokens(column: str, prefix: str) -> str:
    return f"list_distinct({D.role_tokens(column)}) AS {prefix}_set, {D.stem(column)} AS {prefix}_stem"


@register("role_fuzzy_match", with_views(["app", "posting"], f"""
    SELECT pos, {fuzzy_sql('a', 'b')} AS same FROM (
        SELECT app.pos, {_tokens('role', 'a')}, {_tokens('title', 'b')} FROM app JOIN posting USING (pos))"""))
def role_fuzzy_match(v):
    pairs = v.app.select("pos", "role").join(v.posting.select("pos", "title"), "pos")
    return pairs.select("pos", T.role_fuzzy_match("role", "title").alias("same"))


_OVERLAP_PAIR = """len(a_bag) > 0 AND len(b_bag) > 0 AND len(list_filter(a_bag, lambda w: list_contains(b_bag, w))) >= 2
    AND len(list_filter(a_bag, lambda w: list_contains(b_bag, w))) * 10 >= least(len(a_bag), len(b_bag)) * 6"""


@register("role_overlap_match", with_views(["app"], f"""
    SELECT block, bag_key, pos, (
        SELECT min(o.pos) FROM bags o WHERE o.block = b.block AND o.pos < b.pos AND len(o.bag) >= 2
          AND len(list_filter(o.bag, lambda w: list_contains(b.bag, w))) >= 2
          AND len(list_filter(o.bag, lambda w: list_contains(b.bag, w))) * 10 >= least(len(o.bag), len(b.bag)) * 6
        ) AS repeats
    FROM bags b WHERE len(bag) >= 2""", f"""
    bags AS MATERIALIZED (
        SELECT block, array_to_string(bag, ' ') AS bag_key, min(pos) AS pos, any_value(bag) AS bag
        FROM (SELECT {D.company_words('company')} AS block, list_sort({D.dedup_bag('role')}) AS bag, pos FROM app)
        GROUP BY 1, 2)"""))
def role_overlap_match(v):
    return dedup.earliest_overlap(v.app.withColumn("block", T.company_words("company")))


MATCH_SQL = f"""
    adds AS MATERIALIZED (SELECT *, {D.company_key('company')} AS c, {_tokens('role', 'a')},
        TRY_CAST(NULLIF(regexp_extract(report, '\\[(\\d+)\\]', 1), '') AS BIGINT) AS rn FROM addition),
    rows AS MATERIALIZED (SELECT *, {D.company_key('company')} AS c, {_tokens('role', 'b')},
        TRY_CAST(NULLIF(regexp_extract(report, '\\[(\\d+)\\]', 1), '') AS BIGINT) AS rn FROM app),
    met AS MATERIALIZED (
        SELECT adds.file_no, rows.archived, min(rows.pos) FILTER (adds.rn = rows.rn) AS by_number,
               min(rows.pos) FILTER ({fuzzy_sql('a', 'b')}) AS by_role
        FROM adds JOIN rows ON adds.c = rows.c GROUP BY 1, 2)"""


@register("find_duplicate", with_views(["app", "addition"], """
    SELECT adds.file_no, COALESCE(by_number, by_role) AS match_pos,
           CASE WHEN by_number IS NOT NULL THEN 'report' WHEN by_role IS NOT NULL THEN 'role' END AS match_kind
    FROM adds LEFT JOIN met ON met.file_no = adds.file_no AND NOT met.archived""", MATCH_SQL))
def find_duplicate(v):
    return merge.find_duplicate(v.addition, v.app.filter("NOT archived")).select(
        "file_no", "match_pos", "match_kind"
    )


ACTIONS_SQL = """
    matched AS MATERIALIZED (
        SELECT adds.*, COALESCE(l.by_number, l.by_role) AS live_pos, COALESCE(r.by_number, r.by_role) AS archive_pos,
               adds.priority AS new_score, app.priority AS old_score
        FROM adds LEFT JOIN met l ON l.file_no = adds.file_no AND NOT l.archived
        LEFT JOIN met r ON r.file_no = adds.file_no AND r.archived
        LEFT JOIN app ON app.pos = COALESCE(l.by_number, l.by_role)),
    acted AS MATERIALIZED (
        SELECT *, CASE WHEN live_pos IS NULL AND archive_pos IS NOT NULL THEN 'archived'
            WHEN live_pos IS NULL THEN 'new role' WHEN NOT new_score > old_score THEN 'score not higher'
            WHEN file_no = min(file_no) FILTER (new_score > old_score) OVER (PARTITION BY live_pos) THEN 'score higher'
            ELSE 'row already updated' END AS reason
        FROM matched)"""


@register("merge_actions", with_views(["app", "addition"], """
    SELECT file_no, live_pos, archive_pos, reason,
           CASE reason WHEN 'new role' THEN 'inserted' WHEN 'score higher' THEN 'updated' ELSE 'held' END AS action
    FROM acted""", MATCH_SQL, ACTIONS_SQL))
def merge_actions(v):
    app = v.app
    return merge.merge_actions(app.filter("NOT archived"), app.filter("archived"), v.addition).select(
        "file_no", "live_pos", "archive_pos", "reason", "action"
    )


def _score(c: str) -> str:
    return f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')"


@register("merge_additions", with_views(["app", "addition"], f"""
    SELECT app.pos, app.date, COALESCE(u.company, app.company) AS company, COALESCE(u.role, app.role) AS role,
           COALESCE(u.priority, app.priority) AS priority, app.status, app.url,
           CASE WHEN u.file_no IS NULL THEN app.notes ELSE 'Re-eval ' || u.date || ' (' || {_score('old_score')} || '→'
                || {_score('new_score')} || '). ' || u.notes END AS notes
    FROM app LEFT JOIN (SELECT * FROM acted WHERE reason = 'score higher') u ON u.live_pos = app.pos
    WHERE NOT archived
    UNION ALL
    SELECT NULL, date, company, role, priority, status, url, notes FROM acted WHERE reason = 'new role'
    """, MATCH_SQL, ACTIONS_SQL))
def merge_additions(v):
    app = v.app
    live, _ = merge.merge_additions(app.filter("NOT archived"), app.filter("archived"), v.addition)
    return live.select("pos", "date", "company", "role", "priority", "status", "url", "notes")


_PROGRESS = "CASE lower(status) " + " ".join(
    f"WHEN '{k}' THEN {n}" for k, n in dedup.fixed.ADVANCEMENT.items()) + " ELSE 0 END"


@register("dedup_clusters", with_views(["app"], """
    SELECT k.pos, CASE WHEN b.furthest.progress > k.progress THEN b.furthest.status ELSE k.status END AS status,
           size AS cluster_size, NULLIF(size - 1, 0) AS removed
    FROM best b JOIN clustered k ON k.pos = -b.keep.back""", f"""
    bagged AS MATERIALIZED (SELECT pos, file, {D.company_words('company')} AS block, status, score, {_PROGRESS} AS progress,
        list_sort({D.dedup_bag('role')}) AS bag FROM app),
    sigs AS MATERIALIZED (SELECT file, block, bag, min(pos) AS pos FROM bagged GROUP BY ALL),
    edges AS MATERIALIZED (
        SELECT a.pos AS a, b.pos AS b FROM sigs a JOIN sigs b ON a.file = b.file AND a.block = b.block AND a.pos < b.pos
        WHERE len(a.bag) >= 2 AND len(b.bag) >= 2 AND len(list_filter(a.bag, lambda w: list_contains(b.bag, w))) >= 2
          AND len(list_filter(a.bag, lambda w: list_contains(b.bag, w))) * 10 >= least(len(a.bag), len(b.bag)) * 6)""",
    D.greedy("seeds", """SELECT unnest([a, b]) AS pos, a || ' ' || b AS key FROM edges
        UNION ALL SELECT pos, 'own ' || pos FROM sigs WHERE len(bag) >= 2"""), """
    doubled AS MATERIALIZED (SELECT file, block, word, min(pos) AS pos FROM (
        SELECT file, block, pos, bag, unnest(list_distinct(bag)) AS word FROM sigs WHERE pos IN (SELECT pos FROM seeds))
        WHERE len(list_filter(bag, lambda w: w = word)) >= 2 GROUP BY ALL),
    of_sig AS MATERIALIZED (SELECT s.file, s.block, s.bag, COALESCE(least(s.pos, min(e.a)), s.pos) AS seed
        FROM sigs s LEFT JOIN edges e ON e.b = s.pos AND e.a IN (SELECT pos FROM seeds)
        WHERE len(s.bag) >= 2 GROUP BY s.file, s.block, s.bag, s.pos),
    clustered AS MATERIALIZED (SELECT r.*, CASE WHEN len(r.bag) = 1 AND d.pos < r.pos THEN d.pos
            ELSE COALESCE(o.seed, r.pos) END AS seed
        FROM bagged r LEFT JOIN of_sig o ON o.file = r.file AND o.block = r.block AND o.bag = r.bag
        LEFT JOIN doubled d ON d.file = r.file AND d.block = r.block AND r.bag = [d.word]),
    best AS MATERIALIZED (SELECT seed, count(*) AS size, max({'score': score, 'back': -pos}) AS keep,
        max({'progress': progress, 'score': score, 'back': -pos, 'status': status}) AS furthest
        FROM clustered GROUP BY seed)"""))
def dedup_clusters(v):
    kept, removed = dedup.dedup_clusters(v.app)
    return kept.select("pos", "status", "cluster_size").join(
        removed.groupBy(F.col("kept_pos").alias("pos")).agg(F.count(F.lit(1)).alias("removed")), "pos", "left"
    )


# --- outcomes ------------------------------------------------------------------
LAST_OUTCOME = """last_outcome AS MATERIALIZED (
    SELECT company, date, arg_max(report, pos) AS report, arg_max(stages_passed, pos) AS stages_passed,
           arg_max(furthest_stage, pos) AS furthest_stage FROM outcome GROUP BY company, date)"""
COHORT_SQL = f"""{LAST_OUTCOME},
    cohort AS MATERIALIZED (
        SELECT app_s.*, CASE WHEN o.company IS NULL THEN 0 ELSE 1 END::BIGINT AS contact,
               COALESCE(o.stages_passed, 0) AS stages_passed, o.furthest_stage, o.report AS outcome_report
        FROM app_s LEFT JOIN last_outcome o USING (company, date)
        WHERE status_id IN {D.in_list(C.fixed.SENT_STATUSES)})"""
COHORT_VIEWS = ["app", "app_s", "outcome"]


def cohort_of(v):
    return calibration.cohort(v.app, v.outcome, AS_OF_DATE)


@register("outcome_join", with_views(["app", "outcome"], """
    SELECT pos, o.stages_passed, o.furthest_stage FROM app LEFT JOIN last_outcome o USING (company, date)""",
    LAST_OUTCOME))
def outcome_join(v):
    return calibration.outcome_join(v.app, v.outcome).select(
        "pos", "outcome.stages_passed", "outcome.furthest_stage"
    )


@register("orphan_outcomes", with_views(COHORT_VIEWS, """
    SELECT pos, company, date FROM outcome WHERE (company, date) NOT IN
        (SELECT (company, date) FROM cohort WHERE contact = 1)""", COHORT_SQL))
def orphan_outcomes(v):
    return calibration.orphan_outcomes(cohort_of(v), v.outcome).select("pos", "company", "date")


@register("report_mismatch", with_views(COHORT_VIEWS, """
    SELECT company, date, outcome_report, num AS tracker_report FROM cohort
    WHERE contact = 1 AND outcome_report <> num""", COHORT_SQL))
def report_mismatch(v):
    return calibration.report_mismatch(cohort_of(v))


# --- enrichment ----------------------------------------------------------------
def batch_of(v):
    return lines.read_batch_items(v.item)


_ITEMS_SQL = """items AS MATERIALIZED (
    SELECT id, pos, COALESCE(CASE WHEN contains(notes, '| ') AND starts_with(trim(string_split(notes, '| ')[-1]), 'http')
               THEN trim(string_split(notes, '| ')[-1]) END, CASE WHEN starts_with(url, 'http') THEN url END) AS job_url,
           trim(regexp_extract(string_split(notes, ' | ')[1], '^(.*) @ (.*)$', 1)) AS role,
           trim(regexp_extract(string_split(notes, ' | ')[1], '^(.*) @ (.*)$', 2)) AS company FROM item)"""


@register("read_batch_items", with_views(["item"], "SELECT id, job_url, company, role FROM items", _ITEMS_SQL))
def read_batch_items(v):
    return batch_of(v).select("id", "job_url", "company", "role")


def best_sql(name: str, apps: str, candidates: str) -> str:
    """CTE ``name(block, role, best_pos)`` by brute force over a company's pairs."""
    return f"""
    {name}_r AS MATERIALIZED (SELECT DISTINCT {D.company_base('company')} AS block, role,
        list_filter(string_split_regex(trim(lower(role)), '\\s+'), lambda w: length(w) > 2) AS ws FROM {apps}),
    {name}_t AS MATERIALIZED (SELECT {D.company_base('company')} AS block, lower(title) AS lt, min(pos) AS pos
        FROM {candidates} GROUP BY 1, 2),
    {name} AS MATERIALIZED (
        SELECT block, role, arg_max(pos, (score, -pos)) AS best_pos FROM (
            SELECT r.block, r.role, t.pos, len(list_filter(r.ws, lambda w: contains(t.lt, w))) AS score
            FROM {name}_r r JOIN {name}_t t ON r.block = t.block) GROUP BY 1, 2)"""


@register("best_role_match", with_views(["app", "history"], "SELECT block, role, best_pos FROM best",
                                        "hist AS MATERIALIZED (SELECT company, title, pos FROM (SELECT company, title, min(pos * 1000000 + part_no) AS pos FROM history GROUP BY ALL))",
                                        best_sql("best", "app", "hist")))
def best_role_match(v):
    return enrich.best_role_match(v.app, history_titles(v).select("company", "title", "pos"))


def history_titles(v):
    """One candidate per company and title, placed by the day it was first seen."""
    return v.history.groupBy("company", "title").agg(F.min(F.col("pos") * 1000000 + F.col("part_no")).alias("pos"))


def enrich_inputs(v):
    apps = v.app.select(
        "pos", "company", "role",
        F.when(F.col("url").contains("linkedin"), F.lit("")).otherwise(F.col("url")).alias("url"),
        (F.col("report") != "").alias("has_report"),
        F.expr("CASE WHEN pos % 5 = 0 THEN 'https://report.example.com/' || pos END").alias("report_url"),
        F.expr("CASE WHEN pos % 5 = 1 THEN pos END").alias("batch_id"),
        T.report_num("report").cast("string").alias("report_number"),
    )
    hist = v.history.groupBy("company", "title").agg(
        F.min("url").alias("url"), F.min(F.col("pos") * 1000000 + F.col("part_no")).alias("pos")
    )
    return apps, batch_of(v), v.state, hist


@register("enrich_urls", with_views(["app", "item", "state", "history"], """
    SELECT a.pos, CASE WHEN starts_with(own, 'http') THEN 'own' WHEN has_report AND report_url IS NOT NULL THEN 'report'
            WHEN has_report AND i.job_url IS NOT NULL THEN 'batch id'
            WHEN has_report AND s.job_url IS NOT NULL THEN 'report number'
            WHEN hbest.best_pos IS NOT NULL THEN 'history'
            WHEN best.best_pos IS NOT NULL THEN 'batch company' END AS url_from,
        COALESCE(CASE WHEN starts_with(own, 'http') THEN own END, CASE WHEN has_report THEN report_url END,
            CASE WHEN has_report THEN i.job_url END, CASE WHEN has_report THEN s.job_url END,
            h.url, c.job_url) AS job_url
    FROM a LEFT JOIN items i ON i.id = a.batch_id LEFT JOIN done s ON s.rn = a.report_number
    LEFT JOIN hbest ON hbest.block = a.block AND hbest.role = a.role
    LEFT JOIN hist h ON h.block = a.block AND h.pos = hbest.best_pos
    LEFT JOIN best ON best.block = a.block AND best.role = a.role LEFT JOIN items c ON c.pos = best.best_pos""",
    _ITEMS_SQL, f"""
    a AS MATERIALIZED (SELECT pos, role, {D.company_base('company')} AS block,
        CASE WHEN contains(url, 'linkedin') THEN '' ELSE url END AS own, report <> '' AS has_report,
        CASE WHEN pos % 5 = 0 THEN 'https://report.example.com/' || pos END AS report_url,
        CASE WHEN pos % 5 = 1 THEN pos END AS batch_id,
        CAST(TRY_CAST(NULLIF(regexp_extract(report, '\\[(\\d+)\\]', 1), '') AS BIGINT) AS VARCHAR) AS report_number FROM app),
    spelled AS (SELECT unnest(list_distinct([report_num, CASE WHEN length(report_num) < 3 THEN lpad(report_num, 3, '0')
        ELSE report_num END])) AS rn, state.pos, job_url FROM state JOIN items USING (id)
        WHERE status = 'completed' AND report_num NOT IN ('', '-') AND job_url IS NOT NULL),
    done AS MATERIALIZED (SELECT rn, arg_max(job_url, pos) AS job_url FROM spelled GROUP BY rn),
    hist AS MATERIALIZED (SELECT company, title, {D.company_base('company')} AS block, min(url) AS url,
        min(pos * 1000000 + part_no) AS pos FROM history GROUP BY 1, 2, 3),
    named AS MATERIALIZED (SELECT company, role AS title, pos FROM items WHERE job_url IS NOT NULL)""",
    best_sql("best", "app", "named"), best_sql("hbest", "app", "hist")))
def enrich_urls(v):
    apps, items, state, hist = enrich_inputs(v)
    return enrich.enrich_urls(apps, items, state, hist).select("pos", "url_from", "job_url")


FILE_PATH = """CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'reports/' ELSE 'drafts/' END
    || CAST(c_custkey AS VARCHAR) || '-x.md'"""
FILES_SQL = f"files AS MATERIALIZED (SELECT {FILE_PATH} AS path FROM customer)"


@register("broken_report_links", with_views(["app"], """
    SELECT pos, 'reports/' || k || '-x.md' AS target
    FROM (SELECT pos, regexp_extract(report, '\\[(\\d+)\\]', 1) AS k FROM app WHERE report <> '')
    WHERE 'reports/' || k || '-x.md' NOT IN (SELECT path FROM files)""", FILES_SQL))
def broken_report_links(v):
    return quality.broken_links(v.app, report_files(v)).select("pos", "target")


def report_files(v):
    """One file per customer, some of them in another folder."""
    return v.table("customer").select(F.expr(FILE_PATH.replace("VARCHAR", "STRING")).alias("path"))


PLACES, REMOTE_PLACES = ["Germany", "Austria", "Spain"], ["Europe", "Worldwide"]


@register("search_matrix", f"""
    SELECT query_no, query, place_no, location, remote FROM (
        SELECT p_partkey AS query_no, p_name AS query, place_no, location, remote FROM part,
            (VALUES {', '.join(f"({i}, '{p}', false)" for i, p in enumerate(PLACES))},
                    {', '.join(f"({i}, '{p}', true)" for i, p in enumerate(REMOTE_PLACES))}) l(place_no, location, remote))
    ORDER BY remote, query_no, place_no LIMIT 220""")
def search_matrix(v):
    queries = v.table("part").select(F.col("p_partkey").alias("query_no"), F.col("p_name").alias("query"))
    return scan.search_matrix(queries, PLACES, REMOTE_PLACES, 220)


@register("reposts", with_views(["history"], """
    SELECT company, title, urls, most_in_window, reposted_on FROM (
        SELECT company, title, sum(urls)::BIGINT AS urls, max(w)::BIGINT AS most_in_window,
               min(day) FILTER (w >= 2) AS reposted_on
        FROM (SELECT *, sum(urls) OVER (PARTITION BY company, title ORDER BY day
                     RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW) AS w
              FROM (SELECT company, title, day, count(*) AS urls FROM (
                        SELECT lower(trim(company)) AS company, lower(trim(title)) AS title, url, min(first_seen) AS day
                        FROM history GROUP BY 1, 2, 3) GROUP BY ALL))
        GROUP BY 1, 2) WHERE most_in_window >= 2"""))
def reposts(v):
    return scan.reposts(v.history)
