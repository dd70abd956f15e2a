"""Registered queries: classification rules, filters and scalar functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from oppflow.functions import classify as C
from oppflow.functions import fixed
from oppflow.functions import text as T
from oppflow.functions.regex import WORD
from oppflow.functions.stats import fixed_places
from oppflow.operators import cadence, calibration, corpus, merge, quality, queues, scores, seen
from oppflow.plans import duck as D
from oppflow.plans.duck import any_word, places, with_views
from oppflow.plans.registry import register
from oppflow.plans.views import AS_OF

AS_OF_DATE = dt.date.fromisoformat(AS_OF)
TITLE_FILTER = {
    "role_gate": ["Manager", "Owner", "PM", "Platform", "API", "Cloud", "widget"],
    "negative": ["Junior", "Leiter", "old "],
    "positive": ["AI", "Platform", "API", "Security", "red "],
}


def _contains_any(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {D.quote(t.lower())})" for t in terms) + ")"


TITLE_CLASS_SQL = (
    f"CASE WHEN NOT {_contains_any('title', TITLE_FILTER['role_gate'])} THEN 'reject' "
    f"WHEN {_contains_any('title', TITLE_FILTER['negative'])} THEN 'reject' "
    f"WHEN {_contains_any('title', TITLE_FILTER['positive'])} THEN 'pass' ELSE 'generic' END"
)


# --- places --------------------------------------------------------------------
@register("normalize_location", with_views(["posting"], """
    SELECT location, trim(regexp_replace(regexp_replace(replace(lower(strip_accents(location)), '.', ''),
           '[|/,;()\\[\\]—–-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS norm, count(*) AS postings
    FROM posting GROUP BY 1, 2"""))
def normalize_location(v):
    return v.posting.groupBy("location", T.normalize_location("location").alias("norm")).agg(
        F.count(F.lit(1)).alias("postings")
    )


@register("resolve_location_tier", with_views(["posting"], """
    SELECT pos, location, tier, score, country, reason, keep FROM posting JOIN tiers USING (location)""",
    D.tier_ctes("posting")))
def resolve_location_tier(v):
    return v.posting.withColumn("t", C.resolve_tier("location")).select("pos", "location", "t.*")


@register("has_token", with_views(["posting"], """
    SELECT pos, regexp_matches(lower(location), '\\bus\\b') AS us, regexp_matches(lower(location), '\\beu\\b') AS eu,
           regexp_matches(lower(location), '\\buk\\b') AS uk FROM posting"""))
def has_token(v):
    low = F.lower("location")
    return v.posting.select("pos", *[T.has_token(low, t).alias(t) for t in ("us", "eu", "uk")])


# --- titles and companies ------------------------------------------------------
@register("classify_title", with_views(["posting"], f"SELECT pos, title, {TITLE_CLASS_SQL} AS class FROM posting"))
def classify_title(v):
    return v.posting.select("pos", "title", C.classify_title("title", **TITLE_FILTER).alias("class"))


@register("filter_title_pass", with_views(["posting"], """
    SELECT pos, title FROM classed WHERE class = 'pass'""",
    f"classed AS MATERIALIZED (SELECT pos, title, {TITLE_CLASS_SQL} AS class FROM posting)"))
def filter_title_pass(v):
    return v.posting.filter(C.classify_title("title", **TITLE_FILTER) == "pass").select("pos", "title")


def only_named(app, status):
    """Every application; those with another status are at companies of other names."""
    return app.withColumn("company", F.when(F.col("status") == status, F.col("company")).otherwise(
        F.concat(F.lit("Other "), F.col("company"))))


@register("keep_generic_if_engaged", with_views(["posting", "app"], f"""
    SELECT pos, company, title FROM posting
    WHERE {TITLE_CLASS_SQL} <> 'generic'
       OR lower(trim(company)) IN (
           SELECT lower(trim(CASE WHEN status = '✅' THEN company ELSE 'Other ' || company END)) FROM app)"""))
def keep_generic_if_engaged(v):
    marked = v.posting.withColumn(
        "title_generic", C.classify_title("title", **TITLE_FILTER) == "generic"
    )
    return seen.keep_generic_if_engaged(marked, only_named(v.app, "✅")).select(
        "pos", "company", "title"
    )


@register("detect_lanes", with_views(["posting"], f"""
    SELECT pos, array_to_string({D.lanes('title')}, ',') AS lanes FROM posting"""))
def detect_lanes(v):
    return v.posting.select("pos", F.array_join(C.detect_lanes("title"), ",").alias("lanes"))


@register("title_flags", with_views(["posting"], f"""
    SELECT pos, {any_word('title', fixed.SENIOR_WORDS)} AS senior,
           {any_word('title', fixed.JUNIOR_WORDS)} AS junior,
           {any_word('title', fixed.GERMAN_WORDS)} AS german,
           {any_word('title', fixed.TECHNICAL_WORDS)} AS technical FROM posting"""))
def title_flags(v):
    return v.posting.select("pos", *[c.alias(n) for n, c in C.title_flags("title").items()])


@register("is_agency", with_views(["posting"], f"""
    SELECT company, {D.agency('company')} AS agency, count(*) AS postings FROM posting GROUP BY 1, 2"""))
def is_agency(v):
    return v.posting.groupBy("company", C.is_agency("company").alias("agency")).agg(
        F.count(F.lit(1)).alias("postings")
    )


# --- status --------------------------------------------------------------------
@register("normalize_status", with_views(["app", "app_s"], "SELECT pos, status, status_id FROM app_s"))
def normalize_status(v):
    return v.app.select("pos", "status", C.normalize_status("status").alias("status_id"))


_T = "trim(replace(COALESCE(status, ''), '**', ''))"
_REPAIRED = f"""
    SELECT pos, status, notes, CASE
        WHEN {_T} IN ('', '-', '—') THEN ''
        WHEN {_T} IN ('✅', '📬', '🎯', '💰', '❌', '🚫', '👻', '⏭️') THEN {_T}
        WHEN regexp_matches(lower({_T}), '^aplicado\\s+\\d{{4}}') THEN '✅'
        WHEN lower({_T}) = 'monitor' THEN '⏭️'
        WHEN lower({_T}) IN ('applied', 'sent') THEN '✅' WHEN lower({_T}) = 'rejected' THEN '❌'
        WHEN lower({_T}) = 'ghosted' THEN '👻' WHEN lower({_T}) = 'evaluada' THEN '' END AS cell
    FROM app"""


@register("repair_status", with_views(["app"], f"""
    SELECT pos, CASE WHEN cell IS NULL THEN status ELSE cell END AS status,
           COALESCE(cell <> status, false) AS changed, cell IS NULL AS is_unknown FROM ({_REPAIRED})"""))
def repair_status(v):
    fixed_rows, unknown = quality.repair_status(v.app)
    marks = unknown.select("pos", F.lit(True).alias("is_unknown"))
    return fixed_rows.join(marks, "pos", "left").select(
        "pos", "status", "changed", F.coalesce("is_unknown", F.lit(False)).alias("is_unknown")
    )


@register("classify_outcome", with_views(["app", "app_s"], f"""
    SELECT status_id, {D.outcome_of('status_id')} AS outcome, count(*) AS n FROM app_s GROUP BY 1, 2"""))
def classify_outcome(v):
    s = v.app.select(C.normalize_status("status").alias("status_id"))
    return s.groupBy("status_id", C.classify_outcome("status_id").alias("outcome")).agg(
        F.count(F.lit(1)).alias("n")
    )


@register("set_status", with_views(["app"], """,
    upd AS (SELECT pos AS update_no, date, company, role, CASE pos % 3 WHEN 0 THEN '🎯' WHEN 1 THEN '❌' END AS cell
            FROM app),
    firsts AS (SELECT date, company, role, min(pos) AS pos FROM app GROUP BY ALL),
    last AS (SELECT date, company, role, arg_max(cell, update_no) AS cell FROM upd WHERE cell IS NOT NULL GROUP BY ALL),
    hits AS (SELECT firsts.pos, cell FROM firsts JOIN last USING (date, company, role))
    SELECT app.pos, COALESCE(cell, status) AS status, NULL::VARCHAR AS reason FROM app LEFT JOIN hits USING (pos)
    UNION ALL SELECT update_no, NULL, 'unknown status' FROM upd WHERE cell IS NULL
    """).replace(") ,", "),"))
def set_status(v):
    app = v.app
    updates = app.select(
        F.col("pos").alias("update_no"), "date", "company", "role",
        F.expr("CASE pos % 3 WHEN 0 THEN 'Interview' WHEN 1 THEN '**rechazada**' ELSE 'who knows' END").alias("status"),
    )
    result, rejects = merge.apply_status_updates(app, updates)
    return result.select("pos", "status", F.lit(None).cast("string").alias("reason")).unionByName(
        rejects.select(F.col("update_no").alias("pos"), F.lit(None).cast("string").alias("status"), "reason")
    )


# --- report classes ------------------------------------------------------------
@register("classify_remote", with_views(["app"], f"""
    SELECT pos, CASE WHEN src = '' THEN 'unknown'
        WHEN {any_word('src', [*fixed.REMOTE_GEO, fixed.REMOTE_GEO_EXTRA])} THEN 'geo-restricted'
        WHEN {any_word('src', fixed.REMOTE_HYBRID)} THEN 'hybrid/onsite'
        WHEN {any_word('src', fixed.REMOTE_GLOBAL)} THEN 'global remote'
        WHEN {any_word('src', fixed.REMOTE_REGIONAL)} THEN 'regional remote' ELSE 'unknown' END AS bucket
    FROM (SELECT pos, COALESCE(NULLIF(location, ''), notes) AS src FROM app)"""))
def classify_remote(v):
    return v.app.select(
        "pos", C.classify_remote(T.first_filled("location", "notes")).alias("bucket")
    )


_TEAM = ("CASE p_size % 7 WHEN 0 THEN 'about ' || p_size || ' people' WHEN 1 THEN '1,' || lpad(p_size, 3, '0') || '+'"
         " WHEN 2 THEN 'small, elite team' WHEN 3 THEN 'Large organisation' WHEN 4 THEN p_size || '-' || p_size * 9"
         " WHEN 5 THEN '' ELSE 'founding' END")


@register("classify_company_size", f"""
    SELECT p_partkey, team, CASE WHEN team = '' THEN 'unknown'
        WHEN len(runs) > 0 AND list_contains(nums, NULL::DOUBLE) THEN 'enterprise'
        WHEN len(runs) > 0 AND len(list_filter(nums, lambda n: n IS NULL)) > 0 THEN 'enterprise'
        WHEN len(runs) > 0 AND list_max(nums) <= 50 THEN 'startup'
        WHEN len(runs) > 0 AND list_max(nums) <= 500 THEN 'scaleup' WHEN len(runs) > 0 THEN 'enterprise'
        WHEN {any_word('team', fixed.SIZE_SMALL)} THEN 'startup'
        WHEN {any_word('team', fixed.SIZE_LARGE)} THEN 'enterprise' ELSE 'unknown' END AS size_class
    FROM (SELECT *, list_transform(runs, lambda r: TRY_CAST(replace(r, ',', '') AS DOUBLE)) AS nums
          FROM (SELECT p_partkey, team, regexp_extract_all(team, '[\\d,]+') AS runs
                FROM (SELECT p_partkey, {_TEAM.replace('lpad(p_size, 3', 'lpad(CAST(p_size AS VARCHAR), 3')} AS team FROM part)))""")
def classify_company_size(v):
    teams = v.table("part").select("p_partkey", F.expr(_TEAM).alias("team"))
    return teams.select("p_partkey", "team", C.classify_company_size("team").alias("size_class"))


_GAP = ("CASE p_size % 9 WHEN 0 THEN 'Needs Go and Rust' WHEN 1 THEN 'visa for the region' WHEN 2 THEN 'Staff level'"
        " WHEN 3 THEN 'office twice a week' WHEN 4 THEN 'Vue.js and Node.js, React Native, C++ or .NET'"
        " WHEN 5 THEN 'hybrid' WHEN 6 THEN 'gopher skills, PostgreSQL and kubernetes' WHEN 7 THEN 'US-only'"
        " ELSE 'German' END || ' for ' || p_name")
_SEV = "CASE p_partkey % 4 WHEN 0 THEN 'Hard' WHEN 1 THEN 'Soft gap' WHEN 2 THEN 'nice-to-have' ELSE 'medium' END"


def blocker_sql(text: str, severity: str) -> str:
    whens = " ".join(f"WHEN {any_word(text, terms)} THEN '{name}'" for name, terms in fixed.BLOCKERS)
    return (f"CASE WHEN contains(lower({severity}), 'nice') OR contains(lower({severity}), 'soft') THEN NULL "
            f"{whens} ELSE 'other' END")


@register("classify_blocker", f"""
    SELECT p_partkey, {blocker_sql('gap', 'sev')} AS blocker
    FROM (SELECT p_partkey, {_GAP} AS gap, {_SEV} AS sev FROM part)""")
def classify_blocker(v):
    gaps = v.table("part").select("p_partkey", F.expr(_GAP).alias("gap"), F.expr(_SEV).alias("sev"))
    return gaps.select("p_partkey", C.classify_blocker("gap", "sev").alias("blocker"))


TECH_SQL = ("list_transform(regexp_extract_all({c}, " + D.quote("(?i)\\b(?:" + "|".join(fixed.TECH_TERMS) + ")\\b")
            + "), lambda t: upper(t[1]) || t[2:])")


@register("extract_tech_terms", f"""
    SELECT skill, count(*) AS n FROM (
        SELECT unnest({TECH_SQL.format(c='gap')}) AS skill FROM (SELECT {_GAP} AS gap FROM part))
    GROUP BY skill""")
def extract_tech_terms(v):
    gaps = v.table("part").select(F.expr(_GAP).alias("gap"))
    return gaps.select(F.explode(C.extract_tech_terms("gap")).alias("skill")).groupBy("skill").agg(
        F.count(F.lit(1)).alias("n")
    )


# --- cadence -------------------------------------------------------------------
_FU = "fu AS (SELECT app_num, count(*) AS sent, max(date) AS last_sent FROM followup GROUP BY app_num)"
_CADENCE = f"""
    cad AS (
        SELECT pos, num, status_id, sent_on, COALESCE(sent, 0) AS sent, last_sent,
               DATE '{AS_OF}' - sent_on AS days_since, DATE '{AS_OF}' - last_sent AS days_since_last
        FROM app_s LEFT JOIN fu ON num = app_num WHERE status_id IN ('applied', 'responded', 'interview')),
    judged AS (
        SELECT *, CASE status_id
            WHEN 'applied' THEN CASE WHEN sent >= 2 THEN 'cold' WHEN sent = 0 AND days_since >= 7 THEN 'overdue'
                WHEN sent > 0 AND days_since_last >= 7 THEN 'overdue' ELSE 'waiting' END
            WHEN 'responded' THEN CASE WHEN days_since < 1 THEN 'urgent' WHEN days_since >= 3 THEN 'overdue'
                ELSE 'waiting' END
            ELSE CASE WHEN days_since >= 1 THEN 'overdue' ELSE 'waiting' END END AS urgency,
            CASE status_id
            WHEN 'applied' THEN CASE WHEN sent >= 2 THEN NULL WHEN sent = 0 THEN sent_on + 7 ELSE last_sent + 7 END
            WHEN 'responded' THEN COALESCE(last_sent, sent_on) + 3 ELSE sent_on + 1 END AS next_date
        FROM cad)"""
_CADENCE_VIEWS = ["app", "app_s", "followup"]


def cadence_of(v):
    return cadence.cadence(v.app, v.followup, AS_OF_DATE)


@register("follow_up_urgency", with_views(_CADENCE_VIEWS, """
    SELECT pos, status_id, sent, days_since, days_since_last, urgency FROM judged""", _FU, _CADENCE))
def follow_up_urgency(v):
    return cadence_of(v).select(
        "pos", "status_id", "sent", "days_since", "days_since_last", "urgency"
    )


@register("next_follow_up_date", with_views(_CADENCE_VIEWS, f"""
    SELECT pos, next_date, next_date - DATE '{AS_OF}' AS days_until_next FROM judged""", _FU, _CADENCE))
def next_follow_up_date(v):
    return cadence_of(v).select("pos", "next_date", "days_until_next")


@register("overdue_filter", with_views(_CADENCE_VIEWS, """
    SELECT pos, urgency FROM judged WHERE urgency IN ('overdue', 'urgent')""", _FU, _CADENCE))
def overdue_filter(v):
    return cadence.overdue(cadence_of(v)).select("pos", "urgency")


@register("urgency_order", with_views(_CADENCE_VIEWS, """
    SELECT pos, urgency, row_number() OVER (ORDER BY CASE urgency WHEN 'urgent' THEN 0 WHEN 'overdue' THEN 1
           WHEN 'waiting' THEN 2 ELSE 3 END, pos) AS urgency_position FROM judged""", _FU, _CADENCE))
def urgency_order(v):
    return cadence.urgency_order(cadence_of(v).select("pos", "urgency"))


@register("cadence_summary", with_views(_CADENCE_VIEWS, """
    SELECT count(*) AS actionable, count(*) FILTER (urgency = 'urgent') AS urgent,
           count(*) FILTER (urgency = 'overdue') AS overdue, count(*) FILTER (urgency = 'waiting') AS waiting,
           count(*) FILTER (urgency = 'cold') AS cold FROM judged""", _FU, _CADENCE))
def cadence_summary(v):
    return cadence.cadence_summary(cadence_of(v))


@register("latest_followup", with_views(["followup"], """
    SELECT app_num, count(*) AS sent, max(date) AS last_sent FROM followup GROUP BY app_num"""))
def latest_followup(v):
    return cadence.latest_followup(v.followup)


@register("followup_join", with_views(["app", "followup"], """
    SELECT num, COALESCE(sent, 0) AS sent, last_sent FROM app LEFT JOIN fu ON num = app_num""", _FU))
def followup_join(v):
    return cadence.followup_join(v.app, v.followup).select("num", "sent", "last_sent")


@register("extract_contacts", with_views(["app"], """
    SELECT pos, 'jane' || regexp_extract(notes, 'jane(\\d+)@', 1) || '@example.com' AS email, 'Jane Roe' AS name
    FROM app WHERE contains(notes, '@example.com')"""))
def extract_contacts(v):
    return v.app.select("pos", F.explode(T.extract_contacts("notes")).alias("c")).select("pos", "c.email", "c.name")


# --- scores --------------------------------------------------------------------
@register("effort_lane", with_views(["app"], """
    SELECT CASE WHEN priority >= 4.0 THEN 'full' WHEN priority >= 3.5 THEN 'light' ELSE 'none' END AS lane,
           count(*) AS n, min(priority) AS lowest, max(priority) AS highest FROM app GROUP BY 1"""))
def effort_lane(v):
    return v.app.groupBy(C.effort_lane("priority").alias("lane")).agg(
        F.count(F.lit(1)).alias("n"), F.min("priority").alias("lowest"), F.max("priority").alias("highest")
    )


_COMPONENTS = {
    "north_star": "1 + o_orderkey % 5", "cv_match": "1 + o_orderkey % 4", "level_fit": "1 + o_orderkey % 3",
    "missed_requirements": "o_custkey % 4", "hard_blockers": "o_custkey % 2", "significant_gaps": "o_custkey % 3",
    "soft_gaps": "o_custkey % 5", "high_competition": "o_orderkey % 2", "compensation": "1 + o_custkey % 5",
    "company_tier": "1 + o_custkey % 3", "location_fit": "1 + o_orderkey % 5", "growth": "1 + o_custkey % 4",
}


@register("composite_scores", f"""
    SELECT o_orderkey, {places('fit', 4)} AS fit, {places('odds', 4)} AS odds, {places('opportunity', 4)} AS opportunity,
           {places('0.4::DOUBLE * fit + 0.3::DOUBLE * odds + 0.3::DOUBLE * opportunity', 4)} AS priority
    FROM (SELECT *, greatest(fit - 1.5::DOUBLE * hard_blockers - 0.5::DOUBLE * significant_gaps
                             - 0.2::DOUBLE * soft_gaps - 0.3::DOUBLE * high_competition, 0.5::DOUBLE) AS odds,
                 0.3::DOUBLE * compensation + 0.3::DOUBLE * company_tier + 0.2::DOUBLE * location_fit
                 + 0.2::DOUBLE * growth AS opportunity
          FROM (SELECT *, CASE WHEN missed_requirements >= 2 THEN least(raw, 2.5::DOUBLE)
                               WHEN missed_requirements = 1 THEN least(raw, 3.0::DOUBLE) ELSE raw END AS fit
                FROM (SELECT *, 0.4::DOUBLE * north_star + 0.4::DOUBLE * cv_match + 0.2::DOUBLE * level_fit AS raw
                      FROM (SELECT o_orderkey, {', '.join(f'{e} AS {n}' for n, e in _COMPONENTS.items())} FROM orders))))""")
def composite_scores(v):
    df = v.table("orders").select("o_orderkey", *[F.expr(e).alias(n) for n, e in _COMPONENTS.items()])
    out = scores.composite_scores(df)
    return out.select(
        "o_orderkey", *[fixed_places(c, 4).alias(c) for c in ("fit", "odds", "opportunity", "priority")]
    )


_OFFER = {k: f"1 + (o_orderkey * {i + 3} + o_custkey) % 5" for i, k in enumerate(fixed.OFFER_WEIGHTS)}


@register("compare_offers", f"""
    SELECT offer_id, total, rank() OVER (ORDER BY total DESC) AS rank FROM (
        SELECT o_orderkey AS offer_id, {places(' + '.join(f'{w}::DOUBLE * ({_OFFER[k]})' for k, w in fixed.OFFER_WEIGHTS.items()), 6)} AS total
        FROM orders)""")
def compare_offers(v):
    df = v.table("orders").select(
        F.col("o_orderkey").alias("offer_id"), *[F.expr(e).alias(k) for k, e in _OFFER.items()]
    )
    return scores.compare_offers(df).select("offer_id", "total", "rank")


@register("posting_age_signal", with_views(["app"], f"""
    SELECT pos, CASE WHEN p IS NULL THEN 'caution' WHEN DATE '{AS_OF}' - p < 30 THEN 'good'
                     WHEN DATE '{AS_OF}' - p < 60 THEN 'mixed' ELSE 'concerning' END AS signal
    FROM (SELECT pos, {D.POSTED_ON} AS p FROM app)"""))
def posting_age_signal(v):
    return v.app.select(
        "pos", C.posting_age_signal(T.posted_date("notes"), F.lit(AS_OF_DATE)).alias("signal")
    )


# --- filters that change rows --------------------------------------------------
@register("retire_stale", with_views(["app", "app_s"], f"""
    SELECT pos, retired, CASE WHEN retired THEN '👻' ELSE status END AS status,
           CASE WHEN retired THEN base || CASE WHEN base = '' THEN '' WHEN regexp_matches(base, '[.!?]$') THEN ' '
                ELSE '; ' END || 'Retired {AS_OF} (no response after ' || age || 'd)' ELSE notes END AS notes
    FROM (SELECT *, DATE '{AS_OF}' - sent_on AS age, regexp_replace(notes, '[;\\s]+$', '') AS base,
                 status_id = 'applied' AND DATE '{AS_OF}' - sent_on > 14 AS retired FROM app_s WHERE NOT archived)"""))
def retire_stale(v):
    return cadence.retire_stale(v.app.filter("NOT archived"), AS_OF_DATE).select(
        "pos", "retired", "status", "notes"
    )


@register("archive_split", with_views(["app", "app_s"], """
    SELECT pos, CASE WHEN status_id IN ('skip', 'rejected', 'discarded', 'ignored') THEN 'archive' ELSE 'live' END
           AS side FROM app_s WHERE NOT archived"""))
def archive_split(v):
    live, archive = queues.archive_split(v.app.filter("NOT archived"))
    return live.select("pos", F.lit("live").alias("side")).unionByName(
        archive.select("pos", F.lit("archive").alias("side"))
    )


@register("min_age_filter", with_views(["app", "app_s"], f"""
    SELECT num, DATE '{AS_OF}' - sent_on AS age FROM app_s
    WHERE status_id IN {D.in_list(fixed.SENT_STATUSES)} AND DATE '{AS_OF}' - sent_on >= 365"""))
def min_age_filter(v):
    return calibration.min_age(calibration.cohort(v.app, v.outcome, AS_OF_DATE), 365).select("num", "age")


# --- corpus rules --------------------------------------------------------------
def _lint_sql() -> str:
    parts = [
        f"SELECT doc_id, {D.quote(label)} AS label, substr(regexp_extract(body, {D.quote(p)}), 1, 80) AS sample "
        f"FROM linted WHERE regexp_matches(body, {D.quote(p)})"
        + (" AND name NOT LIKE '%cover letter%'" if label == corpus.TITLE_RULE else "")
        for label, p in LINT
    ]
    day = "(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\s+)?\\d{4}"
    dash = (f"regexp_replace(regexp_replace(body, '({day})\\s*[–—]\\s*({day}|Present|present)', '\\1-\\2', 'g'), "
            "'`[^`\\n]*`', '``', 'g')")
    parts.append(f"SELECT doc_id, 'DASH_IN_MD', substr(d, 1, 80) FROM (SELECT doc_id, name, {dash} AS d FROM linted) "
                 "WHERE regexp_matches(d, '[—–]') AND NOT ends_with(name, '.html')")
    parts.append("""SELECT doc_id, 'MISSING_PRODUCT_SUBTITLE', substr(trim(string_split(string_split(job, chr(10))[1], '|')[1]), 1, 40)
        FROM (SELECT doc_id, unnest(string_split_regex(list_filter(string_split_regex(body, '(?m)^## '),
                  lambda s: regexp_matches(s, '^(?i:(?:Work )?Experience)'))[1], '(?m)^### ')[2:]) AS job
              FROM linted WHERE NOT ends_with(name, '.html'))
        WHERE contains(string_split(job, chr(10))[1], '|') AND NOT regexp_matches(job, '(?m)^[_*]{0,2}Product:')""")
    return " UNION ALL ".join(parts)


# Each text gets a section of its own and a name, so that every rule and every kind of document is met.
_SECTION = """text || CASE doc_id % 5
    WHEN 0 THEN concat(chr(10), '## Work Experience', chr(10), '### Acme ', doc_id, ' | PM | 2020', chr(10), 'Nov 2020 – Present',
        chr(10), '### Beta | PM', chr(10), '_Product:_ Maps', chr(10), '### Side notes', chr(10), '## Projects', chr(10), '### Own | live')
    WHEN 1 THEN concat(chr(10), 'Senior Product Manager, Platform — with `a — b`; strong match for ', doc_id, ' engineers')
    WHEN 2 THEN concat(chr(10), 'Spearheaded 12,000 repos -- scaling Portfolio Management; שלום')
    WHEN 3 THEN concat(chr(10), 'I lead the Internal Developer Platform team in 2019 – 2021')
    ELSE '' END"""
_NAME = """CASE doc_id % 3 WHEN 0 THEN concat('cv ', doc_id, '.md') WHEN 1 THEN concat('cover letter ', doc_id, '.md')
    ELSE concat('cv ', doc_id, '.html') END"""


# The corpus is invented prose, so rules of the same kind over its own words are added.
LINT = fixed.LINT_RULES + [
    ("REPEATED_THE", r"(?i)\bthe the\b"),
    ("ADDRESS", r"[a-z]+\d*@[a-z0-9.]+\.[a-z]+"),
    ("LONG_NUMBER", r"\b\d{4,}\b"),
]
# An address begins where its run of letters does, so that a long run is searched once.
LINT_FORMS = {
    dict(LINT)["REPEATED_THE"]: (None, rf"(?i)the the(?<!{WORD}the the)(?!{WORD})"),
    dict(LINT)["ADDRESS"]: ("@", r"(?<![a-z])[a-z]++\d*+@[a-z0-9.]+\.[a-z]+"),
}


@register("lint_documents", with_views(
    ["doc"], _lint_sql(), f"linted AS MATERIALIZED (SELECT doc_id, {_SECTION} AS body, {_NAME} AS name FROM doc)"))
def lint_documents(v):
    docs = v.doc.select("doc_id", F.expr(_SECTION).alias("text"), F.expr(_NAME).alias("name"))
    return corpus.lint_documents(docs, rules=LINT, name="name", forms=LINT_FORMS)


# Each text gets a closing line with a figure of its own, as the corpus holds few.
_CLOSING = "text || chr(10) || CASE doc_id % 3 WHEN 0 THEN '# ' WHEN 1 THEN 'About ' ELSE 'NEVER hardcode ' END || n_chars || '+ hours'"


@register("scan_hardcoded_metrics", with_views(["doc"], f"""
    SELECT doc_id, line_no, regexp_extract(line, {D.quote(fixed.METRIC_PATTERN)}) AS metric
    FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line,
                 generate_subscripts(string_split(body, chr(10)), 1) AS line_no
          FROM (SELECT doc_id, {_CLOSING} AS body FROM doc))
    WHERE regexp_matches(line, {D.quote(fixed.METRIC_PATTERN)}) AND NOT contains(line, 'NEVER hardcode')
      AND NOT contains(line, 'NUNCA hardcode') AND NOT starts_with(line, '#') AND NOT starts_with(line, '<!--')"""))
def scan_hardcoded_metrics(v):
    return corpus.scan_metrics(v.doc.withColumn("text", F.expr(_CLOSING)))


LEAKS = ["@mail", "example.com", "password", "AKIA", "+1-"]


@register("scan_personal_data", with_views(["doc"], f"""
    SELECT doc_id, line_no, pattern
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM doc)
    JOIN (VALUES {', '.join(f"({D.quote(p)})" for p in LEAKS)}) p(pattern) ON contains(line, pattern)
    WHERE NOT contains(source, 'src1')"""))
def scan_personal_data(v):
    return corpus.scan_literals(v.doc, LEAKS, ["src1"])
