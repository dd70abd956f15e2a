"""Registered queries: places and literals kept as tables, and the functions under SQL names."""

from __future__ import annotations

from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.functions.sql_functions import register_functions
from oppflow.operators import gazetteer, literals
from oppflow.plans import duck as D
from oppflow.plans.duck import any_word, quote, with_views
from oppflow.plans.registry import register

# --- places --------------------------------------------------------------------
# Nations, customers and segments of a nation are the places; every fifth nation has no known tier.
_PLACES = """
    SELECT n_name AS name, 'country ' || CAST(n_nationkey AS STRING) AS country,
           CASE n_nationkey % 5 WHEN 0 THEN 'S' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' ELSE 'Z' END AS tier,
           n_nationkey AS preference FROM {nation}
    UNION ALL
    SELECT c_name, 'customer ' || CAST(c_custkey AS STRING), CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'C' END, 100
    FROM {customer}
    UNION ALL
    SELECT DISTINCT c_mktsegment || ' ' || n_name, c_mktsegment, CASE WHEN n_nationkey % 2 = 0 THEN 'B' ELSE 'C' END, n_nationkey
    FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'FURNITURE'"""
_PLACE_TEXT = "company || ', ' || location"
_ORDER = "['S', 'A', 'B', 'C']"
_TIER_ROWS = ", ".join(f"({quote(t)}, {v['score']}::DOUBLE)" for t, v in fixed.DEFAULT_TIERS.items())


def _norm(c: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(replace(lower(strip_accents({c})), '.', ''), "
            "'[|/,;()\\[\\]—–-]+', ' ', 'g'), '\\s+', ' ', 'g'))")


def _word_list(c: str) -> str:
    return f"list_filter(string_split_regex({_norm(c)}, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"


_GAZETTEER_CTES = [
    f"gaz AS (SELECT {_word_list('name')} AS w, list_position({_ORDER}, tier) AS rank, preference, country, tier "
    f"FROM ({_PLACES.replace('{', '').replace('}', '')}))",
    "names AS (SELECT w, arg_min(tier, (rank, preference, country)) AS tier, arg_min(country, (rank, preference, country)) "
    "AS country, min((rank, preference, country)) AS best FROM gaz WHERE rank IS NOT NULL GROUP BY w)",
    f"texts AS MATERIALIZED (SELECT DISTINCT {_PLACE_TEXT} AS text FROM posting)",
    f"spans AS (SELECT text, a, b, list_slice(w, a, b) AS w FROM (SELECT text, {_word_list('text')} AS w FROM texts), "
    "LATERAL (SELECT unnest(range(1, len(w) + 1)) AS a), LATERAL (SELECT unnest(range(a, a + 4)) AS b) WHERE b <= len(w))",
    "hits AS MATERIALIZED (SELECT text, a, b, best, tier, country FROM spans JOIN names USING (w))",
    "outer_hits AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.text = h.text "
    "AND o.a <= h.a AND o.b >= h.b AND o.b - o.a > h.b - h.a))",
    "judged AS (SELECT text, arg_min(tier, best) AS tier, arg_min(country, best) AS country FROM outer_hits GROUP BY text)",
    f"reasons AS (SELECT text, CASE WHEN judged.text IS NOT NULL THEN 'country' "
    f"WHEN {any_word('n', map(D.re_escape, fixed.EU_REGION_WORDS))} THEN 'eu-region' "
    f"WHEN {any_word('n', map(D.re_escape, fixed.GLOBAL_REMOTE_WORDS))} "
    f"AND NOT {any_word('n', map(D.re_escape, fixed.OUTSIDE_PLACES))} THEN 'global-remote' "
    f"WHEN {any_word('n', map(D.re_escape, fixed.OUTSIDE_PLACES))} THEN 'outside-scope' "
    f"WHEN {any_word('n', map(D.re_escape, fixed.REMOTE_WORDS))} THEN 'unqualified-remote' ELSE 'unrecognized' END AS reason, "
    f"judged.tier AS place_tier, country FROM (SELECT text, {_norm('text')} AS n FROM texts) LEFT JOIN judged USING (text))",
    f"tier_scores(tier, score) AS (VALUES {_TIER_ROWS})",
]


def _place_frames(v):
    places = v.spark.sql(_PLACES, nation=v.table("nation"), customer=v.table("customer"))
    return v.posting.select("pos", F.expr(_PLACE_TEXT).alias("text")), places


@register("resolve_tier_gazetteer", with_views(["posting"], f"""
    SELECT pos, text, tier, score, country, reason, reason NOT IN ('outside-scope', 'unrecognized') AS keep
    FROM (SELECT pos, {_PLACE_TEXT} AS text FROM posting) JOIN (
        SELECT text, country, reason, CASE WHEN reason = 'country' THEN place_tier
               WHEN reason IN ('eu-region', 'global-remote') THEN 'S' END AS tier FROM reasons) USING (text)
    LEFT JOIN tier_scores USING (tier)""", *_GAZETTEER_CTES))
def resolve_tier_gazetteer(v):
    texts, places = _place_frames(v)
    return gazetteer.resolve_tiers(texts, "text", places).select("pos", "text", "place.*")


@register("places_in_text", with_views(["posting"], """
    SELECT text, a - 1 AS start, b - a + 1 AS n_words, country, tier FROM outer_hits""", *_GAZETTEER_CTES))
def places_in_text(v):
    texts, places = _place_frames(v)
    return gazetteer.places_in(texts, "text", places).select("text", "start", "n_words", "country", "tier")


# --- literals ------------------------------------------------------------------
# Two literals a document: a stretch from the middle of its text, and one that no text holds.
_LITERALS = """
    SELECT substring(text, CAST(floor(length(text) / 2) AS INT) + 1, 5 + CAST(doc_id % 12 AS INT)) AS pattern FROM {doc}
    UNION ALL SELECT 'zz-' || CAST(doc_id AS STRING) FROM {doc}"""


@register("scan_many_literals", with_views(["doc"], """
    SELECT doc_id, line_no, pattern
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM doc)
    JOIN wanted ON contains(line, pattern) WHERE NOT contains(source, 'src1')""",
    f"wanted AS MATERIALIZED (SELECT DISTINCT pattern FROM ({_LITERALS.format(doc='doc')}) WHERE pattern <> '')"))
def scan_many_literals(v):
    return literals.scan_many(v.doc, v.spark.sql(_LITERALS, doc=v.doc), allow=["src1"])


# --- functions under SQL names -------------------------------------------------
@register("sql_functions", with_views(["app"], f"""
    SELECT pos, {D.normal_role('role')} AS role_norm, {D.url_key('url')} AS url_key, {D.company_base('company')} AS company_base,
           {D.status_id('status')} AS status_id, {D.SENT_ON} AS sent_on, {D.POSTED_ON} AS posted_on,
           {D.opening('company', 'role')} AS opening, {_norm('location')} AS location_norm
    FROM app"""))
def sql_functions(v):
    register_functions(v.spark)
    return v.spark.sql("""
        SELECT pos, opp_normalize_role(role) AS role_norm, opp_url_key(url) AS url_key, opp_company_base(company) AS company_base,
               opp_normalize_status(status) AS status_id, opp_effective_applied_date(notes, date) AS sent_on,
               opp_posted_date(notes) AS posted_on, opp_opening_key(company, role) AS opening,
               opp_normalize_location(location) AS location_norm
        FROM {app}""", app=v.app)
