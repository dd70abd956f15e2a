"""Registered queries: triage, work queues, ordering, batches, set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from oppflow.functions import classify as C
from oppflow.functions import fixed
from oppflow.operators import queues, triage
from oppflow.operators.ranks import with_rank
from oppflow.plans import duck as D
from oppflow.plans.duck import any_word, with_views
from oppflow.plans.q_joins import _BY_URL, _EXCL, HISTORY_SQL
from oppflow.plans.q_rules import TITLE_CLASS_SQL, TITLE_FILTER
from oppflow.plans.registry import register

APP = ["app", "app_s"]


# --- triage --------------------------------------------------------------------
def inbox_of(v):
    return v.posting.withColumns({
        "tier": C.resolve_tier("location")["tier"],
        "title_generic": C.classify_title("title", **TITLE_FILTER) == "generic",
    })


def verdicts_of(v):
    return triage.triage_verdict(inbox_of(v), v.app, v.exclusion, v.curated)


INBOX_VIEWS = ["posting", "app", "exclusion", "curated"]
STATUS_WORD = "COALESCE(" + D.case("{c}", triage.STATUS_WORDS) + ", 'evaluated')"


def _word(column: str) -> str:
    return STATUS_WORD.format(c=column)


INBOX_SQL = f"""{D.tier_ctes('posting')},
    inbox AS MATERIALIZED (SELECT posting.*, tier, {TITLE_CLASS_SQL} = 'generic' AS title_generic
        FROM posting JOIN tiers USING (location)), {HISTORY_SQL}, {_BY_URL}, {_EXCL},
    facts AS MATERIALIZED (
        SELECT i.*, COALESCE(xa.reason, xb.reason) AS excluded, tr.tracked_pos, s.same_pos,
               COALESCE(s.rejected_elsewhere, false) AS rejected_elsewhere, s.pos IS NOT NULL AS known_company,
               lower(trim(i.company)) IN (SELECT lower(trim(company)) FROM curated) AS curated,
               {D.lanes('i.title')} AS lanes, {any_word('i.title', fixed.SENIOR_WORDS)} AS senior,
               {any_word('i.title', fixed.JUNIOR_WORDS)} AS junior, {any_word('i.title', fixed.GERMAN_WORDS)} AS german,
               {any_word('i.title', fixed.TECHNICAL_WORDS)} AS technical, {D.agency('i.company')} AS agency
        FROM inbox i JOIN asked ON asked.pos = i.pos LEFT JOIN summary s ON s.pos = i.pos
        LEFT JOIN excl xa ON xa.c = asked.c AND xa.r = asked.n LEFT JOIN excl xb ON xb.c = asked.c AND xb.r = '*'
        LEFT JOIN tracked tr ON tr.k = {D.url_key('i.url', True)}),
    judged AS MATERIALIZED (
        SELECT f.*, CASE WHEN excluded IS NOT NULL OR tracked_pos IS NOT NULL OR same_pos IS NOT NULL THEN 'skip'
            WHEN junior OR german THEN 'skip' WHEN title_generic AND NOT curated THEN 'unknown'
            WHEN len(lanes) = 0 AND NOT technical AND NOT curated THEN 'skip'
            WHEN senior AND NOT agency AND ((len(prim) > 0 AND COALESCE(tier IN ('S', 'A'), false)) OR len(prim) >= 2
                 OR (curated AND COALESCE(tier IN ('S', 'A'), false))) THEN 'promising' ELSE 'maybe' END AS verdict,
            known_company OR excluded IS NOT NULL OR tracked_pos IS NOT NULL OR same_pos IS NOT NULL AS known
        FROM (SELECT *, list_filter(lanes, lambda l: l <> 'AppSec') AS prim FROM facts) f)"""


@register("triage_verdict", with_views(INBOX_VIEWS, f"""
    SELECT j.pos, verdict, known, array_to_string(lanes, ',') AS lanes, array_to_string(list_filter(CASE
        WHEN excluded IS NOT NULL THEN ['Excluded: ' || excluded]
        WHEN tracked_pos IS NOT NULL THEN ['Already in tracker — ' || {_word('t.status')} || ' on ' || t.date]
        WHEN same_pos IS NOT NULL THEN ['Already in tracker for this role — ' || {_word('r.status')} || ' on ' || r.date]
        WHEN junior THEN ['Below target seniority']
        WHEN german THEN ['German-language title implies German-language role']
        WHEN verdict = 'unknown' THEN ['Title names no domain — needs the JD to judge',
            CASE WHEN tier = 'C' THEN 'tier C location' END, CASE WHEN agency THEN 'agency/staffing listing' END,
            CASE WHEN known_company THEN 'company already in tracker' END]
        WHEN verdict = 'skip' THEN ['No archetype signal in title or company']
        ELSE [CASE WHEN len(lanes) > 0 THEN array_to_string(lanes[1:2], ' + ') || ' lane'
                   WHEN technical THEN 'technical PM, domain not named in title' END,
            CASE WHEN curated THEN 'on your curated dev-tools company list' END,
            CASE WHEN NOT senior THEN 'title reads below senior' END,
            CASE WHEN agency THEN 'agency/staffing listing, employer hidden' END,
            CASE WHEN tier = 'C' THEN 'tier C location' END,
            CASE WHEN rejected_elsewhere THEN 'rejected here before on another role' END] END,
        lambda x: x IS NOT NULL), '; ') AS why
    FROM judged j LEFT JOIN app t ON t.pos = tracked_pos LEFT JOIN app r ON r.pos = same_pos""", INBOX_SQL))
def triage_verdict(v):
    return verdicts_of(v).select(
        "pos", "verdict", "known", F.array_join("lanes", ",").alias("lanes"), F.array_join("why", "; ").alias("why")
    )


def _cell(alias: str) -> str:
    return f"COALESCE(NULLIF({alias}.status, ''), '·')"


@register("history_cells", with_views(["posting", "app"], f"""
    SELECT asked.pos, array_to_string(list_filter([
        CASE WHEN s.pos IS NOT NULL THEN {_cell('s')} || ' same role, ' || {_word('s.status')} || ' ' || s.date END,
        CASE WHEN a.pos IS NOT NULL THEN {_cell('a')} || ' ' || {_word('a.status')} || ' ' || a.date || ': '
            || CASE WHEN length(a.role) > 34 THEN substr(a.role, 1, 33) || '…' ELSE a.role END END,
        CASE WHEN b.pos IS NOT NULL THEN {_cell('b')} || ' ' || {_word('b.status')} || ' ' || b.date || ': '
            || CASE WHEN length(b.role) > 34 THEN substr(b.role, 1, 33) || '…' ELSE b.role END END,
        CASE WHEN others_total > 2 THEN '+' || (others_total - 2) || ' more' END], lambda x: x IS NOT NULL), ' | ') AS cells
    FROM asked LEFT JOIN summary USING (pos) LEFT JOIN app s ON s.pos = same_pos LEFT JOIN app a ON a.pos = other1
    LEFT JOIN app b ON b.pos = other2""", HISTORY_SQL))
def history_cells(v):
    from oppflow.operators.seen import posting_history

    df = posting_history(v.posting, v.app)
    return df.select("pos", F.array_join(triage.history_cells(), " | ").alias("cells"))


OPENING_SQL = f"""
    keyed AS MATERIALIZED (SELECT *, {D.opening()} AS opening,
        CASE tier WHEN 'S' THEN 0 WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 ELSE 9 END AS tr FROM {{source}}),
    ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY opening ORDER BY tr, pos) AS rn,
        count(*) OVER (PARTITION BY opening) AS postings FROM keyed),
    places AS (SELECT opening, list(location ORDER BY first_rn) AS others FROM (
        SELECT opening, location, min(rn) AS first_rn FROM ordered WHERE rn > 1 AND location <> '' GROUP BY ALL) GROUP BY 1),
    collapsed AS MATERIALIZED (
        SELECT ordered.*, CASE WHEN postings > 1 THEN 'also posted in ' || COALESCE(array_to_string(others[1:3], '; '),
               (postings - 1) || ' other location(s)') END AS also_posted
        FROM ordered LEFT JOIN places USING (opening) WHERE rn = 1)"""


@register("collapse_openings", with_views(["posting"], "SELECT pos, also_posted, postings FROM collapsed",
    f"""{D.tier_ctes('posting')}, inbox AS MATERIALIZED (SELECT posting.*, tier FROM posting JOIN tiers USING (location))""",
    OPENING_SQL.format(source="inbox")))
def collapse_openings(v):
    return triage.collapse_openings(inbox_of(v)).select("pos", "also_posted", "postings")


def marked_of(v):
    """The inbox with a verdict from the title alone, enough to drive the queue."""
    lanes = F.size(C.detect_lanes("title"))
    verdict = (
        F.when(C.title_flags("title")["junior"] | C.title_flags("title")["german"], F.lit("skip"))
        .when(F.col("title_generic"), F.lit("unknown")).when(lanes > 0, F.lit("promising")).otherwise(F.lit("maybe"))
    )
    return inbox_of(v).withColumns({"verdict": verdict, "known": F.col("pos") % 3 == 0})


MARKED_SQL = f"""{D.tier_ctes('posting')},
    marked AS MATERIALIZED (SELECT posting.*, tier, pos % 3 = 0 AS known, {D.opening()} AS opening,
        CASE WHEN {any_word('title', fixed.JUNIOR_WORDS)} OR {any_word('title', fixed.GERMAN_WORDS)} THEN 'skip'
             WHEN {TITLE_CLASS_SQL} = 'generic' THEN 'unknown' WHEN len({D.lanes('title')}) > 0 THEN 'promising'
             ELSE 'maybe' END AS verdict FROM posting JOIN tiers USING (location)),
    gone AS MATERIALIZED (SELECT * FROM (SELECT *, bool_and(verdict = 'skip' OR (verdict = 'unknown' AND NOT known))
        OVER (PARTITION BY opening) AS drained FROM marked) WHERE drained)"""


@register("drainable_groups", with_views(["posting"], "SELECT pos, verdict FROM gone", MARKED_SQL))
def drainable_groups(v):
    return triage.drainable_groups(marked_of(v)).select("pos", "verdict")


@register("drain_except", with_views(["posting"], """
    SELECT pos, url, 'inbox' AS side FROM marked WHERE pos NOT IN (SELECT pos FROM gone)
    UNION ALL SELECT NULL, url, 'drained' FROM gone""", MARKED_SQL))
def drain_except(v):
    rows = marked_of(v)
    left, lines = triage.drain_except(rows, triage.drainable_groups(rows), dt.date(2000, 7, 1))
    return left.select("pos", "url", F.lit("inbox").alias("side")).unionByName(
        lines.select(F.lit(None).cast("bigint").alias("pos"), "url", F.col("status").alias("side"))
    )


_VERDICT_RANK = "CASE verdict WHEN 'promising' THEN 0 WHEN 'maybe' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END"
_TIER_RANK = "CASE tier WHEN 'S' THEN 0 WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 ELSE 9 END"


@register("order_triage", with_views(["posting"], f"""
    SELECT pos, row_number() OVER (ORDER BY {_VERDICT_RANK}, {_TIER_RANK}, posted DESC NULLS LAST, company, pos)
           AS review_rank FROM marked""", MARKED_SQL))
def order_triage(v):
    rows = marked_of(v).select("pos", "verdict", "tier", "posted", "company")
    return triage.order_triage(rows).select("pos", "review_rank")


@register("shortlist", with_views(["posting"], """
    SELECT pos, company, posted FROM marked WHERE verdict = 'promising'
    ORDER BY posted DESC NULLS LAST, company, pos LIMIT 25""", MARKED_SQL))
def shortlist(v):
    return triage.shortlist(marked_of(v)).select("pos", "company", "posted")


@register("verdict_counts", with_views(["posting"], """
    SELECT verdict, count(*) AS rows FROM collapsed GROUP BY 1""", MARKED_SQL, OPENING_SQL.format(source="marked").replace("*, " + D.opening() + " AS opening", "*")))
def verdict_counts(v):
    return triage.verdict_counts(triage.collapse_openings(marked_of(v)))


@register("triage_review_table", with_views(["posting", "app"], f"""
    SELECT asked.pos, CASE WHEN length(p.company) > 32 THEN substr(p.company, 1, 31) || '…' ELSE p.company END AS company,
           COALESCE(NULLIF(array_to_string({D.lanes('p.title')}[1:2], ', '), ''), '—') AS lane,
           COALESCE(CAST(p.posted AS VARCHAR), '') AS posted FROM asked JOIN posting p USING (pos)""", HISTORY_SQL))
def triage_review_table(v):
    df = verdicts_of(v)
    table = triage.review_table(df.withColumn("url", F.col("pos").cast("string")))
    return table.select(F.col("url").cast("bigint").alias("pos"), "company", "lane", "posted")


# --- work queues ---------------------------------------------------------------
_GROUP = """CASE status_id WHEN 'evaluated' THEN 0 WHEN 'interview' THEN 1 WHEN 'responded' THEN 1 WHEN 'offer' THEN 1
    WHEN 'applied' THEN 2 WHEN 'skip' THEN 3 WHEN 'rejected' THEN 4 WHEN 'discarded' THEN 4 WHEN 'ignored' THEN 5 ELSE 0 END"""
QUEUE_SQL = f"""
    grouped AS MATERIALIZED (SELECT *, {_GROUP} AS g, {D.POSTED_ON} AS posted_on,
        CASE WHEN priority >= 4 THEN 0 WHEN priority >= 3.5 THEN 1 ELSE 2 END AS lane FROM app_s)"""
_WITHIN = """CASE WHEN g = 0 THEN lane END, CASE WHEN g = 0 AND lane < 2 THEN posted_on END DESC NULLS LAST,
    CASE WHEN g IN (1, 2) THEN sent_on END DESC NULLS LAST, priority DESC,
    CASE WHEN g NOT IN (1, 2) THEN sent_on END DESC NULLS LAST, CASE WHEN g NOT IN (1, 2) THEN odds END DESC NULLS LAST, pos"""
_QUEUE_RANK = f"row_number() OVER (PARTITION BY file ORDER BY g, {_WITHIN})"


@register("sort_tracker", with_views(APP, f"SELECT pos, file, {_QUEUE_RANK} AS queue_rank FROM grouped", QUEUE_SQL))
def sort_tracker(v):
    return queues.sort_tracker(v.app).select("pos", "file", "queue_rank")


@register("queue_position", with_views(APP, f"""
    SELECT pos, g AS queue_group, row_number() OVER (PARTITION BY g ORDER BY {_WITHIN}) AS group_rank FROM grouped""", QUEUE_SQL))
def queue_position(v):
    return queues.queue_position(v.app).select("pos", "queue_group", "group_rank")


@register("moved_rows", with_views(APP, f"""
    SELECT pos, queue_rank, index FROM (SELECT pos, {_QUEUE_RANK} AS queue_rank,
        row_number() OVER (PARTITION BY file ORDER BY pos) AS index FROM grouped) WHERE queue_rank <> index""", QUEUE_SQL))
def moved_rows(v):
    numbered = with_rank(v.app, [F.col("pos")], "index", ["file"])
    return queues.moved_rows(queues.sort_tracker(numbered, then=("index",))).select("pos", "queue_rank", "index")


_VIEW_RANK = "CASE status_id " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(fixed.VIEW_STATUS_ORDER)) + " ELSE 9 END"
_TAB = {"all": "true", "top": "score >= 4 AND status_id <> 'skip'",
        **{t: f"status_id = '{t}'" for t in ("evaluated", "applied", "interview", "skip")}}
_MODES = {"score": "score DESC", "date": "date DESC", "company": "lower(company)", "status": _VIEW_RANK}


@register("queue_view", with_views(APP, f"""
    SELECT pos, row_number() OVER (ORDER BY {_VIEW_RANK}, date DESC, pos) AS view_rank FROM app_s WHERE {_TAB['top']}"""))
def queue_view(v):
    return queues.queue_view(v.app, "top", "date", grouped=True).select("pos", "view_rank")


@register("queue_tabs", with_views(APP, " UNION ALL ".join(
    f"SELECT '{t}' AS tab, count(*) AS rows FROM app_s WHERE {_TAB[t]}" for t in queues.TABS)))
def queue_tabs(v):
    return queues.queue_tabs(v.app)


for _mode, _order in _MODES.items():
    register(f"view_sort_{_mode}", with_views(APP, f"""
        SELECT pos, row_number() OVER (ORDER BY {_order}, pos) AS view_rank FROM app_s"""))(
        lambda v, mode=_mode: queues.view_sorts(v.app, mode).select("pos", "view_rank")
    )


@register("archive_move", with_views(APP, f"""
    SELECT pos, CASE WHEN archived OR status_id IN {D.in_list(fixed.CLOSED_STATUSES)} THEN 'archive' ELSE 'live' END AS side
    FROM app_s"""))
def archive_move(v):
    app = v.app
    live, archive = queues.archive_move(app.filter("NOT archived"), app.filter("archived"))
    return live.select("pos", F.lit("live").alias("side")).unionByName(
        archive.select("pos", F.lit("archive").alias("side"))
    )


@register("union_live_archive", with_views(["app"], "SELECT pos, file, archived FROM app"))
def union_live_archive(v):
    app = v.app
    both = queues.union_live_archive(
        app.filter("file = 'live'").drop("archived"), app.filter("file = 'archive'").drop("archived")
    )
    return both.select("pos", "file", "archived")


# --- batches -------------------------------------------------------------------
@register("next_batch", with_views(["item", "state"], """
    SELECT id, url FROM item LEFT JOIN (SELECT id, status, retries FROM state) s USING (id)
    WHERE id >= 100 AND url <> '' AND NOT (COALESCE(status, 'none') = 'completed')
      AND NOT (COALESCE(status, 'none') = 'failed' AND retries >= 2)"""))
def next_batch(v):
    return queues.next_batch(v.item, v.state, start=100).select("id", "url")


@register("next_batch_retry", with_views(["item", "state"], """
    SELECT id, url FROM item JOIN state USING (id) WHERE item.url <> '' AND status = 'failed' AND retries < 2"""
    .replace("SELECT id, url", "SELECT id, item.url AS url")))
def next_batch_retry(v):
    return queues.next_batch(v.item, v.state, retry_failed=True).select("id", "url")


@register("batch_summary", with_views(["state"], """
    SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed,
           count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status NOT IN ('completed', 'failed')) AS pending,
           count(TRY_CAST(score AS DECIMAL(12,4))) FILTER (status = 'completed') AS scored,
           (floor(sum(TRY_CAST(score AS DECIMAL(12,4))) FILTER (status = 'completed') * 10
            / count(TRY_CAST(score AS DECIMAL(12,4))) FILTER (status = 'completed')) / 10)::DOUBLE AS avg_score FROM state"""))
def batch_summary(v):
    return queues.batch_summary(v.state)


@register("additions_order", with_views(["addition"], """
    SELECT file, file_number, row_number() OVER (ORDER BY file_number, file) AS merge_order
    FROM (SELECT 'add-' || file_no || '.tsv' AS file, file_no AS file_number FROM addition)"""))
def additions_order(v):
    files = v.addition.select(F.concat(F.lit("add-"), F.col("file_no").cast("string"), F.lit(".tsv")).alias("file"))
    return queues.additions_order(files)
