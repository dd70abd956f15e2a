"""Registered queries: funnels, calibration, pattern analysis, quality counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.functions import text as T
from oppflow.functions.stats import fixed_places
from oppflow.operators import calibration, funnel, patterns, quality
from oppflow.plans import duck as D
from oppflow.plans.duck import any_word, pct, places, with_views
from oppflow.plans.q_joins import COHORT_SQL, COHORT_VIEWS, FILES_SQL, cohort_of, report_files
from oppflow.plans.q_rules import TECH_SQL, _GAP, _SEV, _TEAM, blocker_sql
from oppflow.plans.registry import ORACLES, register
from oppflow.session import durable

CLOSED = D.in_list(fixed.CLOSED_STATUSES)
APP = ["app", "app_s"]


# --- funnel and metrics --------------------------------------------------------
@register("status_funnel", with_views(APP, f"""
    SELECT status_id, rows, {pct('rows', 'sum(rows) OVER ()')} AS pct
    FROM (SELECT status_id, count(*) AS rows FROM app_s GROUP BY 1)"""))
def status_funnel(v):
    return funnel.status_funnel(v.app)


@register("share_of_total", with_views(APP, f"""
    SELECT company, rows, {pct('rows', 'sum(rows) OVER ()')} AS share
    FROM (SELECT company, count(*) AS rows FROM app GROUP BY 1)"""))
def share_of_total(v):
    counts = v.app.groupBy("company").agg(F.count(F.lit(1)).alias("rows"))
    return funnel.share_of_total(counts, "rows", "share")


_OUT = "(contains(output, '✅') OR contains(output, ']('))"


@register("queue_metrics", with_views(APP, f"""
    SELECT count(*) AS total, {places('avg(score) FILTER (score > 0)', 4)} AS avg_score,
           max(score) AS top_score, count(*) FILTER ({_OUT}) AS with_output,
           count(*) FILTER (status_id NOT IN {CLOSED}) AS actionable,
           count(*) FILTER (status_id = 'offer') AS offers FROM app_s"""))
def queue_metrics(v):
    return funnel.queue_metrics(v.app)


def _funnel_sql(source: str, status: str = "status_id") -> str:
    steps = []
    for i, (label, ids) in enumerate(funnel.FUNNEL_STAGES):
        test = "true" if ids is None else f"{status} IN {D.in_list(ids)}"
        base = "count(*)" if i < 2 else f"count(*) FILTER ({status} IN {D.in_list(fixed.SENT_STATUSES)})"
        steps.append(f"SELECT {i}::BIGINT AS step, '{label}' AS stage, count(*) FILTER ({test}) AS rows, "
                     f"{places(f'count(*) FILTER ({test})::DOUBLE / ({base})::DOUBLE * 100', 4)} AS pct FROM {source}")
    return " UNION ALL ".join(steps)


@register("cumulative_funnel", with_views(APP, _funnel_sql("app_s")))
def cumulative_funnel(v):
    return funnel.cumulative_funnel(v.app)


# The event stream read as statuses: each event type is one step of the funnel.
_EVENT_STATUS = ("CASE event_type WHEN 'signup' THEN 'applied' WHEN 'click' THEN 'responded' "
                 "WHEN 'purchase' THEN 'offer' WHEN 'error' THEN 'rejected' ELSE 'evaluated' END")


@register("event_funnel", f"WITH ev AS MATERIALIZED (SELECT {_EVENT_STATUS} AS status_id FROM events) " + _funnel_sql("ev"))
def event_funnel(v):
    return funnel.cumulative_funnel(v.table("events").select(F.expr(_EVENT_STATUS).alias("status")))


@register("score_histogram", with_views(["app"], """
    SELECT band, (SELECT count(*) FROM app WHERE score > 0 AND score >= lo AND score < hi) AS rows
    FROM (VALUES ('<3.0', 0, 3), ('3.0-3.4', 3, 3.5), ('3.5-3.9', 3.5, 4), ('4.0-4.4', 4, 4.5), ('4.5-5.0', 4.5, 99))
         b(band, lo, hi)"""))
def score_histogram(v):
    return funnel.score_histogram(v.app)


@register("weekly_activity", with_views(["app"], """
    SELECT strftime(date, '%G-W%V') AS week, count(*) AS rows FROM app GROUP BY 1 ORDER BY 1 DESC LIMIT 8"""))
def weekly_activity(v):
    return funnel.weekly_activity(v.app)


@register("iso_week", with_views(["app"], """
    SELECT strftime(date, '%G-W%V') AS week, min(date) AS first_day, max(date) AS last_day FROM app GROUP BY 1"""))
def iso_week(v):
    return v.app.groupBy(T.iso_week("date").alias("week")).agg(
        F.min("date").alias("first_day"), F.max("date").alias("last_day")
    )


@register("tracker_stats", with_views(["app"], f"""
    SELECT count(*) AS total, {places('avg(score) FILTER (score > 0)', 4)} AS avg_score,
           {pct(f'count(*) FILTER ({_OUT})', 'count(*)')} AS pct_output,
           {pct("count(*) FILTER (report <> '')", 'count(*)')} AS pct_report FROM app"""))
def tracker_stats(v):
    return funnel.tracker_stats(v.app)


@register("furthest_stage", with_views(["stage"], """
    SELECT num, CASE max(r) WHEN 1 THEN 'screen' WHEN 2 THEN 'hiring_manager' WHEN 3 THEN 'technical'
           WHEN 4 THEN 'case_study' WHEN 5 THEN 'final' ELSE 'offer' END AS furthest, max(r)::BIGINT AS rank
    FROM (SELECT num, CASE stage WHEN 'screen' THEN 1 WHEN 'hm' THEN 2 WHEN 'technical' THEN 3
                 WHEN 'presentation' THEN 4 WHEN 'Onsite' THEN 5 WHEN 'offer' THEN 6 END AS r FROM stage)
    WHERE r IS NOT NULL GROUP BY num"""))
def furthest_stage(v):
    return funnel.furthest_stage(v.stage)


@register("parse_score", with_views(["item"], """
    SELECT id, COALESCE(TRY_CAST(NULLIF(regexp_extract(cell, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE), 0.0::DOUBLE) AS score
    FROM (SELECT id, CASE id % 6 WHEN 0 THEN '**4.1/5**' WHEN 1 THEN 'N/A' WHEN 2 THEN '-' WHEN 3 THEN (id % 5) || '/5'
                 WHEN 4 THEN 'DUP' ELSE (id % 4) || '.5' END AS cell FROM item)"""))
def parse_score(v):
    cell = F.expr("CASE id % 6 WHEN 0 THEN '**4.1/5**' WHEN 1 THEN 'N/A' WHEN 2 THEN '-' "
                  "WHEN 3 THEN (id % 5) || '/5' WHEN 4 THEN 'DUP' ELSE (id % 4) || '.5' END")
    return v.item.select("id", T.parse_score(cell).alias("score"))


# --- calibration ---------------------------------------------------------------
def _rated(k: str = "k", n: str = "n") -> str:
    low, high = D.wilson(k, n)
    return (f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE {places(f'({k})::DOUBLE / ({n})::DOUBLE', 6)} END AS rate, "
            f"{places(low, 6)} AS lo, {places(high, 6)} AS hi")


@register("calibration_cohort", with_views(COHORT_VIEWS, """
    SELECT num, status_id, sent_on, DATE '2000-06-30' - sent_on AS age, contact, stages_passed FROM cohort""", COHORT_SQL))
def calibration_cohort(v):
    return cohort_of(v).select("num", "status_id", "sent_on", "age", "contact", "stages_passed")


@register("base_rate", with_views(COHORT_VIEWS, f"""
    SELECT n, k, {_rated()} FROM (SELECT count(*) AS n, sum(contact)::BIGINT AS k FROM cohort)""", COHORT_SQL))
def base_rate(v):
    return calibration.base_rate(cohort_of(v))


@register("score_correlation", with_views(COHORT_VIEWS, " UNION ALL ".join(
    f"SELECT '{s}' AS score, {places(f'corr({s}, contact)', 6)} AS r FROM cohort" for s in calibration.SCORES), COHORT_SQL))
def score_correlation(v):
    return calibration.score_correlation(cohort_of(v))


_BANDS = "bands(band, b_lo, b_hi) AS (VALUES ('<3.0', 0, 3), ('3.0-3.4', 3, 3.5), ('3.5-3.9', 3.5, 4), ('4.0-4.4', 4, 4.5), ('4.5+', 4.5, 99))"


@register("banded_rates", with_views(COHORT_VIEWS, f"SELECT score, band, n, k, {_rated()} FROM (" + " UNION ALL ".join(
    f"""SELECT '{s}' AS score, band, count(contact) AS n, COALESCE(sum(contact), 0)::BIGINT AS k
        FROM bands LEFT JOIN cohort ON {s} >= b_lo AND {s} < b_hi GROUP BY band""" for s in calibration.SCORES) + ")",
    COHORT_SQL, _BANDS))
def banded_rates(v):
    return calibration.banded_rates(cohort_of(v))


@register("gate_options", with_views(COHORT_VIEWS, f"SELECT cut, side, n, k, {_rated()} FROM (" + " UNION ALL ".join(
    f"""SELECT {cut}::DOUBLE AS cut, '{side}' AS side, count(*) FILTER (priority {op} {cut}) AS n,
        count(*) FILTER (priority {op} {cut} AND contact = 1) AS k FROM cohort"""
    for cut in fixed.GATE_CUTS for side, op in (("above", ">="), ("below", "<"))) + ")", COHORT_SQL))
def gate_options(v):
    return calibration.gate_options(cohort_of(v))


@register("furthest_stage_histogram", with_views(COHORT_VIEWS, """
    SELECT COALESCE(NULLIF(furthest_stage, ''), 'unknown') AS stage, count(*) AS rows
    FROM cohort WHERE contact = 1 GROUP BY 1""", COHORT_SQL))
def furthest_stage_histogram(v):
    return calibration.furthest_stage_histogram(cohort_of(v))


@register("median_stages", with_views(COHORT_VIEWS, """
    SELECT COALESCE(quantile_cont(stages_passed, 0.5), 0)::DOUBLE AS median_stages FROM cohort WHERE contact = 1""",
    COHORT_SQL))
def median_stages(v):
    return calibration.median_stages(cohort_of(v))


def _labelled(v):
    """Real labels as a calibration sample: does text length predict quality?"""
    docs = v.doc.join(v.table("labels"), "doc_id")
    length = F.least(F.col("n_chars") / F.lit(1000.0), F.lit(5.0))
    return docs.select(length.alias("priority"), F.col("quality").cast("bigint").alias("contact"))


_LABELLED = """sample AS MATERIALIZED (SELECT least(n_chars::DOUBLE / 1000, 5) AS priority, quality::BIGINT AS contact
    FROM doc JOIN labels USING (doc_id))"""


@register("label_calibration", with_views(["doc"], f"""
    SELECT 'priority' AS score, band, n, k, {_rated()} FROM (
        SELECT band, count(contact) AS n, COALESCE(sum(contact), 0)::BIGINT AS k
        FROM bands LEFT JOIN sample ON priority >= b_lo AND priority < b_hi GROUP BY band)""", _LABELLED, _BANDS))
def label_calibration(v):
    return calibration.banded_rates(_labelled(v), ["priority"])


@register("label_correlation", with_views(["doc"], f"""
    SELECT 'priority' AS score, {places('corr(priority, contact)', 6)} AS r FROM sample""", _LABELLED))
def label_correlation(v):
    return calibration.score_correlation(_labelled(v), ["priority"])


# --- patterns ------------------------------------------------------------------
# A report per application: the facts a parsed report would carry.
_ARCHETYPE = "CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'Platform' WHEN 2 THEN 'AI' WHEN 3 THEN 'DevEx' ELSE 'Security' END"
_REMOTE = "CASE p_partkey % 6 WHEN 0 THEN 'US-only' WHEN 1 THEN 'Hybrid, 2 days' WHEN 2 THEN 'Work from anywhere' WHEN 3 THEN 'Remote LATAM' ELSE '' END"


def reports_of(v):
    team = F.expr(_TEAM)
    return v.report_source.select(
        "num", F.expr(_ARCHETYPE).alias("archetype"), F.expr(_REMOTE).alias("remote"),
        team.alias("team_size"),
        F.expr(f"CASE WHEN p_size > 5 THEN array(named_struct('description', {_GAP}, 'severity', {_SEV}, 'mitigation', ''), "
               f"named_struct('description', 'Python and ' || p_name, 'severity', 'hard', 'mitigation', 'learn')) "
               "ELSE array() END").alias("gaps"),
    )


def enriched_of(v):
    return patterns.enrich(v.app, reports_of(v))


_TEAM_DUCK = _TEAM.replace("lpad(p_size, 3", "lpad(CAST(p_size AS VARCHAR), 3")
ENRICHED = f"""
    reports AS MATERIALIZED (
        SELECT num, {_ARCHETYPE} AS archetype, {_REMOTE} AS remote, {_TEAM_DUCK} AS team, p_size,
               {_GAP} AS gap, {_SEV} AS sev, 'Python and ' || p_name AS gap2 FROM report_source),
    enriched AS MATERIALIZED (
        SELECT app_s.*, {D.outcome_of('status_id')} AS outcome, COALESCE(NULLIF(archetype, ''), 'Unknown') AS archetype,
               COALESCE(NULLIF(remote, ''), NULLIF(location, ''), NULLIF(notes, ''), '') AS src, team, p_size, gap, sev, gap2,
               regexp_extract_all(COALESCE(team, ''), '[\\d,]+') AS runs
        FROM app_s LEFT JOIN reports USING (num)),
    classed AS MATERIALIZED (
        SELECT *, CASE WHEN src = '' THEN 'unknown'
            WHEN {any_word('src', [*fixed.REMOTE_GEO, fixed.REMOTE_GEO_EXTRA])} THEN 'geo-restricted'
            WHEN {any_word('src', fixed.REMOTE_HYBRID)} THEN 'hybrid/onsite'
            WHEN {any_word('src', fixed.REMOTE_GLOBAL)} THEN 'global remote'
            WHEN {any_word('src', fixed.REMOTE_REGIONAL)} THEN 'regional remote' ELSE 'unknown' END AS remote_bucket,
            CASE WHEN COALESCE(team, '') = '' THEN 'unknown'
            WHEN len(runs) > 0 THEN CASE WHEN len(list_filter(runs, lambda r: TRY_CAST(replace(r, ',', '') AS DOUBLE) IS NULL)) > 0
                THEN 'enterprise' WHEN list_max(list_transform(runs, lambda r: TRY_CAST(replace(r, ',', '') AS DOUBLE))) <= 50
                THEN 'startup' WHEN list_max(list_transform(runs, lambda r: TRY_CAST(replace(r, ',', '') AS DOUBLE))) <= 500
                THEN 'scaleup' ELSE 'enterprise' END
            WHEN {any_word('team', fixed.SIZE_SMALL)} THEN 'startup'
            WHEN {any_word('team', fixed.SIZE_LARGE)} THEN 'enterprise' ELSE 'unknown' END AS company_size
        FROM enriched),
    gaps AS MATERIALIZED (
        SELECT outcome, gap AS description, sev AS severity FROM enriched WHERE p_size > 5
        UNION ALL SELECT outcome, gap2, 'hard' FROM enriched WHERE p_size > 5),
    blockers AS MATERIALIZED (
        SELECT blocker, count(*) AS frequency, {pct('count(*)', '(SELECT count(*) FROM enriched)')} AS percentage
        FROM (SELECT {blocker_sql('description', 'severity')} AS blocker FROM gaps) WHERE blocker IS NOT NULL GROUP BY 1)"""
COUNTS = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in fixed.OUTCOMES)


def _breakdown(dim: str) -> str:
    return f"""SELECT {dim} AS value, count(*) AS total, {COUNTS},
        {pct("count(*) FILTER (outcome = 'positive')", 'count(*)')} AS conversion FROM classed GROUP BY 1"""


def enriched_query(body: str, *more: str) -> str:
    return with_views([*APP, "report_source"], body, ENRICHED, *more)


@register("score_by_outcome", enriched_query("SELECT o.outcome, o.score, " + f"""
    {places('COALESCE(avg(value), 0)', 2)} AS avg, COALESCE(min(value), 0)::DOUBLE AS min,
    COALESCE(max(value), 0)::DOUBLE AS max, count(value) AS n
    FROM (SELECT * FROM (VALUES {', '.join(f"('{o}')" for o in fixed.OUTCOMES)}) a(outcome),
          (VALUES ('fit'), ('odds'), ('priority')) b(score)) o
    LEFT JOIN (SELECT outcome, 'fit' AS score, fit AS value FROM enriched WHERE fit > 0
        UNION ALL SELECT outcome, 'odds', odds FROM enriched WHERE odds > 0
        UNION ALL SELECT outcome, 'priority', priority FROM enriched WHERE priority > 0) e USING (outcome, score)
    GROUP BY 1, 2"""))
def score_by_outcome(v):
    return patterns.score_by_outcome(enriched_of(v))


for _name, _dim in (("archetype", "archetype"), ("remote", "remote_bucket"), ("company_size", "company_size")):
    register(f"breakdown_by_{_name}", enriched_query(_breakdown(_dim)))(
        lambda v, dim=_dim: patterns.breakdown_by(enriched_of(v), dim)
    )


@register("blocker_analysis", enriched_query("SELECT * FROM blockers"))
def blocker_analysis(v):
    return patterns.blocker_analysis(enriched_of(v))


_THRESHOLD = """threshold AS (SELECT COALESCE(floor(min(s) * 10)::DOUBLE / 10, 3.5) AS recommended,
    COALESCE(min(s), 0)::DOUBLE AS lowest, COALESCE(max(s), 0)::DOUBLE AS highest
    FROM (SELECT fit AS s FROM enriched WHERE outcome = 'positive' AND fit > 0))"""


@register("score_threshold", enriched_query("SELECT * FROM threshold", _THRESHOLD))
def score_threshold(v):
    return patterns.score_threshold(enriched_of(v))


_TECH = f"""tech AS MATERIALIZED (SELECT skill, count(*) AS frequency FROM (
    SELECT unnest({TECH_SQL.format(c='description')}) AS skill FROM gaps
    WHERE outcome IN ('negative', 'no_response', 'self_filtered')) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)"""


@register("tech_gaps", enriched_query("SELECT * FROM tech", _TECH))
def tech_gaps(v):
    return patterns.tech_gaps(enriched_of(v))


@register("analysis_guard", enriched_query("""
    SELECT count(*) AS total, count(*) FILTER (status_id <> 'evaluated') AS current, 5::BIGINT AS threshold,
           CASE WHEN count(*) FILTER (status_id <> 'evaluated') < 5 THEN 'not enough data' ELSE 'ok' END AS state FROM enriched"""))
def analysis_guard(v):
    return patterns.analysis_guard(enriched_of(v))


@register("analysis_metadata", enriched_query(f"""
    SELECT count(*) AS total, min(date) AS date_from, max(date) AS date_to, {COUNTS} FROM enriched"""))
def analysis_metadata(v):
    return patterns.analysis_metadata(enriched_of(v))


_BEST = "ORDER BY conversion DESC, total DESC, value LIMIT 1"


@register("best_segment", enriched_query(f"SELECT * FROM ({_breakdown('archetype')}) WHERE total >= 2 {_BEST}"))
def best_segment(v):
    return patterns.best_segment(patterns.breakdown_by(enriched_of(v), "archetype"))


@register("worst_segment", enriched_query(f"""
    SELECT * FROM ({_breakdown('status_id')}) WHERE total >= 2 AND conversion = 0 ORDER BY total DESC, value LIMIT 1"""))
def worst_segment(v):
    return patterns.worst_segment(patterns.breakdown_by(enriched_of(v), "status_id"))


@register("recommendations", enriched_query(f"""
    SELECT 'tighten location filters' AS rule, blocker AS subject, percentage::DOUBLE AS figure, 'high' AS impact
    FROM blockers WHERE blocker = 'geo-restriction' AND percentage >= 20
    UNION ALL SELECT 'filter out roles requiring',
        (SELECT string_agg(skill, ', ' ORDER BY frequency DESC, skill) FROM (SELECT * FROM tech LIMIT 3)),
        percentage::DOUBLE, 'high' FROM blockers WHERE blocker = 'stack-mismatch' AND percentage >= 15
    UNION ALL SELECT 'set minimum score', 'fit', recommended, 'medium' FROM threshold WHERE lowest > 3.0
    UNION ALL SELECT 'double down on archetype', value, conversion::DOUBLE, 'medium' FROM (
        SELECT * FROM ({_breakdown('archetype')}) WHERE total >= 2 {_BEST}) WHERE conversion > 0
    UNION ALL SELECT 'avoid remote policy', value, total::DOUBLE, 'medium' FROM (
        SELECT * FROM ({_breakdown('remote_bucket')}) WHERE total >= 2 AND conversion = 0 ORDER BY total DESC, value LIMIT 1)
    """, _TECH, _THRESHOLD))
def recommendations(v):
    return patterns.recommendations(enriched_of(v))


# Documents are compared by what they say: one row per figure of a section.  Per section the fields that name a row, and
# its figures; those of the calibration are also queries of their own.
_RATE = ["n", "k", "rate", "lo", "hi"]
_CALIBRATION = {
    "base_rate": ([], _RATE, "base_rate"),
    "correlation": (["score"], ["r"], "score_correlation"),
    "bands": (["score", "band"], _RATE, "banded_rates"),
    "gates": (["cut", "side"], _RATE, "gate_options"),
    "furthest_stage": (["stage"], ["rows"], "furthest_stage_histogram"),
    "stages": ([], ["median_stages"], "median_stages"),
}
_UNMATCHED = with_views(COHORT_VIEWS, """
    SELECT 'orphans' AS section, '' AS item, 'rows' AS field, count(*)::DOUBLE AS figure FROM outcome
        WHERE (company, date) NOT IN (SELECT (company, date) FROM cohort WHERE contact = 1)
    UNION ALL SELECT 'mismatches', '', 'rows', count(*) FROM cohort WHERE contact = 1 AND outcome_report <> num""", COHORT_SQL)


def _calibration_sql() -> str:
    parts = [f"SELECT * FROM ({_UNMATCHED})"]
    for section, (names, fields, query) in _CALIBRATION.items():
        item = f"concat_ws(' ', {', '.join([*names, chr(39) * 2])})"
        figures = ", ".join(f"struct_pack(field := '{f}', figure := CAST({f} AS DOUBLE))" for f in fields)
        parts.append(
            f"SELECT section, item, x.field AS field, x.figure AS figure FROM (SELECT '{section}' AS section, {item} AS item, "
            f"unnest([{figures}]) AS x FROM ({ORACLES[query]}))"
        )
    return " UNION ALL ".join(parts)


def _figures(documents, sections: dict):
    """``(section, item, field, figure)`` of the documents of sections."""
    rows = documents.select("section", F.explode(F.from_json("document", "array<map<string,string>>")).alias("m"))

    def figures(section: str, names: list[str], fields: list[str]):
        item = F.concat_ws(" ", *[F.col("m")[n] for n in names], F.lit(""))
        found = F.array(*[
            F.struct(item.alias("item"), F.lit(f).alias("field"), F.col("m")[f].cast("double").alias("figure")) for f in fields
        ])
        return F.when(F.col("section") == section, found)

    every = F.coalesce(*[figures(s, names, fields) for s, (names, fields, _) in sections.items()])
    return rows.select("section", F.explode(every).alias("x")).select("section", "x.*")


@register("calibration_document", _calibration_sql())
def calibration_document(v):
    sections = _CALIBRATION | {"orphans": ([], ["rows"], ""), "mismatches": ([], ["rows"], "")}
    return _figures(calibration.calibration_document(cohort_of(v), v.outcome), sections)


# Per section the fields that name a row, its figures, and the query that has them too.
_SECTIONS = {
    "metadata": ([], ["total", "positive", "negative", "no_response", "self_filtered", "pending"], "analysis_metadata"),
    "funnel": (["status_id"], ["rows", "pct"], "status_funnel"),
    "scores": (["outcome", "score"], ["avg", "min", "max", "n"], "score_by_outcome"),
    "blockers": (["blocker"], ["frequency", "percentage"], "blocker_analysis"),
    "remote": (["value"], ["total", "positive", "conversion"], "breakdown_by_remote"),
    "company_size": (["value"], ["total", "positive", "conversion"], "breakdown_by_company_size"),
    "threshold": ([], ["recommended", "lowest", "highest"], "score_threshold"),
    "tech_gaps": (["skill"], ["frequency"], "tech_gaps"),
}


def _sections_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, concat_ws(' ', {', '.join([*names, chr(39) * 2])}) AS item, '{field}' AS field, "
        f"CAST({field} AS DOUBLE) AS figure FROM ({ORACLES[query]})"
        for section, (names, fields, query) in _SECTIONS.items() for field in fields
    )


@register("analysis_document", _sections_sql())
def analysis_document(v):
    return _figures(patterns.analysis_document(enriched_of(v)), _SECTIONS)


# --- quality -------------------------------------------------------------------
DUP_KEY = f"{D.company_key('company')} || '::' || regexp_replace(lower(role), '[^a-z0-9 ]', '', 'g')"


@register("exact_duplicates", with_views(["app"], f"""
    SELECT duplicate_key, pos, copies, first_pos FROM (
        SELECT duplicate_key, pos, count(*) OVER w AS copies, min(pos) OVER w AS first_pos
        FROM (SELECT {DUP_KEY} AS duplicate_key, pos FROM app) WINDOW w AS (PARTITION BY duplicate_key))
    WHERE copies > 1"""))
def exact_duplicates(v):
    return quality.exact_duplicates(v.app)


@register("status_coverage", with_views(APP, f"""
    SELECT DISTINCT status_id, false AS in_dimension, false AS in_groups FROM app_s
    WHERE status_id NOT IN {D.in_list([i for i, _, _ in fixed.STATUSES])}"""))
def status_coverage(v):
    return quality.status_coverage(v.app)


# Raw tracker cells with the defects the checks look for.
_CELLS = {
    "priority": "CASE num % 11 WHEN 0 THEN '**4.1/5**' WHEN 1 THEN 'N/A' WHEN 2 THEN 'DUP' WHEN 3 THEN '4.1' "
                "ELSE (num % 5) || '.5/5' END",
    "fit": "CASE num % 7 WHEN 0 THEN '-' WHEN 1 THEN 'high' ELSE (num % 5) || '/5' END",
    "odds": "CASE num % 13 WHEN 0 THEN 'N/A' WHEN 1 THEN '3.5 of 5' ELSE '3.5/5' END",
}


def entries_of(v):
    return v.app.select("pos", "company", "role", "status", "output", "report",
                        *[F.expr(e).alias(n) for n, e in _CELLS.items()])


_SCORE_OK = "regexp_matches(trim(replace({c}, '**', '')), '^\\d+\\.?\\d*/5$')"


def _bad(c: str, others: str) -> str:
    return f"NOT {_SCORE_OK.format(c=c)} AND trim(replace({c}, '**', '')) NOT IN {others}"


CHECKS_SQL = f"""
    cells AS MATERIALIZED (SELECT pos, company, role, status, output, report,
        {', '.join(f'{e} AS {n}' for n, e in _CELLS.items())} FROM app),
    checks AS MATERIALIZED (
        SELECT 'status not canonical' AS check, 'error' AS severity, pos::VARCHAR AS key, status AS message
            FROM cells WHERE status = 'in limbo'
        UNION ALL SELECT 'bold in status', 'error', pos::VARCHAR, status FROM cells WHERE contains(status, '**')
        UNION ALL SELECT 'date in status', 'error', pos::VARCHAR, status FROM cells
            WHERE regexp_matches(status, '\\d{{4}}-\\d{{2}}-\\d{{2}}')
        UNION ALL SELECT 'priority format', 'error', pos::VARCHAR, priority FROM cells WHERE {_bad('priority', "('N/A', 'DUP')")}
        UNION ALL SELECT 'fit format', 'error', pos::VARCHAR, fit FROM cells WHERE {_bad('fit', "('-', 'N/A')")}
        UNION ALL SELECT 'odds format', 'error', pos::VARCHAR, odds FROM cells WHERE {_bad('odds', "('-', 'N/A')")}
        UNION ALL SELECT 'bold in score', 'warning', pos::VARCHAR, priority || ' / ' || fit || ' / ' || odds FROM cells
            WHERE contains(priority || fit || odds, '**')
        UNION ALL SELECT 'sent without output', 'warning', pos::VARCHAR, company || ' — ' || role FROM cells
            WHERE (status IN ('✅', '📬', '🎯', '💰', '👻') OR lower(status) IN ('applied', 'responded', 'interview', 'offer', 'ignored'))
              AND trim(output) IN ('', '-'))"""


@register("entry_checks", with_views(["app"], "SELECT * FROM checks", CHECKS_SQL))
def entry_checks(v):
    return quality.entry_checks(entries_of(v))


HEADER = "| Date | Company | Role | Fit | Odds | Priority | Status | Output | Report | Location | Reasoning | URL |"


def lines_of(v):
    """The tracker written out as text: a header, a rule and a line per application."""
    line = F.concat(
        F.lit("| "), F.col("date").cast("string"), F.lit(" | "), T.escape_cell("company"), F.lit(" | "), T.escape_cell("role"),
        F.lit(" | 4/5 | 3/5 | "), F.when(F.col("pos") % 9 == 0, F.lit("4/5 | 5/5")).otherwise(F.lit("4/5")),
        F.lit(" | "), F.col("status"), F.lit(" |  | - | Wien | a\\|b | u"),
        F.when(F.col("pos") % 10 == 0, F.lit("")).otherwise(F.lit(" |")),
    )
    body = v.app.select(F.col("file"), (F.col("pos") + 3).alias("line_no"), line.alias("line"))
    head = v.app.select("file").distinct().select("file", F.explode(F.array(
        F.struct(F.lit(1).cast("bigint").alias("line_no"), F.lit(HEADER).alias("line")),
        F.struct(F.lit(2).cast("bigint").alias("line_no"), F.lit("| --- | --- |").alias("line")),
    )).alias("h")).select("file", "h.line_no", "h.line")
    # Written once: the checks pass over the lines several times.
    return durable(head.unionByName(body))


FORMAT_SQL = """
    SELECT 'row format' AS check, 'error' AS severity, file || ':' || (pos + 3) AS key,
           CASE WHEN pos % 10 = 0 THEN 'row is missing its closing pipe'
                ELSE 'row has 13 columns, expected 12' END AS message
    FROM app WHERE pos % 10 = 0 OR pos % 9 = 0"""


@register("row_format", with_views(["app"], FORMAT_SQL))
def row_format(v):
    return quality.row_format(lines_of(v))


@register("integrity_report", with_views(["app", "addition"], f"""
    SELECT * FROM checks UNION ALL {FORMAT_SQL}
    UNION ALL SELECT 'possible duplicate', 'warning', min(pos)::VARCHAR, count(*) || ' rows: ' || k
        FROM (SELECT pos, {DUP_KEY} AS k FROM app) GROUP BY k HAVING count(*) > 1
    UNION ALL SELECT 'report not found', 'error', pos::VARCHAR, 'reports/' || k || '-x.md'
        FROM (SELECT pos, regexp_extract(report, '\\[(\\d+)\\]', 1) AS k FROM app WHERE report <> '')
        WHERE 'reports/' || k || '-x.md' NOT IN (SELECT path FROM files)
    UNION ALL SELECT 'pending additions', 'warning', '', count(*)::VARCHAR FROM addition""", CHECKS_SQL, FILES_SQL))
def integrity_report(v):
    return quality.integrity_report(entries_of(v), lines_of(v), report_files(v), v.addition)


@register("wilson", f"""
    SELECT p_partkey, {places(D.wilson('k', 'n')[0], 6)} AS lo, {places(D.wilson('k', 'n')[1], 6)} AS hi
    FROM (SELECT p_partkey, (p_partkey % (p_size + 1))::BIGINT AS k, p_size::BIGINT AS n FROM part)""")
def wilson(v):
    from oppflow.functions.stats import wilson as interval

    low, high = interval("k", "n")
    df = v.table("part").select(
        "p_partkey", (F.col("p_partkey") % (F.col("p_size") + 1)).alias("k"), F.col("p_size").alias("n")
    )
    return df.select("p_partkey", fixed_places(low, 6).alias("lo"), fixed_places(high, 6).alias("hi"))
