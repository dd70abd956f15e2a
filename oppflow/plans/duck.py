"""Building blocks of the check SQL, written for DuckDB and independent of Spark."""

from __future__ import annotations

from oppflow.functions import fixed
from oppflow.plans.views import duck_view


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def case(expr: str, pairs: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in pairs.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def any_word(column: str, alternatives, tail: str = "") -> str:
    return f"regexp_matches({column}, {quote('(?i)\\b(?:' + '|'.join(alternatives) + ')' + tail + '\\b')})"


def re_escape(term: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c in " _") else c for c in term)


def places(expr: str, n: int) -> str:
    scale = f"{10 ** n}.0::DOUBLE"
    return f"(floor(({expr})::DOUBLE * {scale} + 0.5)::DOUBLE / {scale})"


def pct(part: str, whole: str) -> str:
    return f"COALESCE(floor(({part})::DOUBLE / NULLIF({whole}, 0)::DOUBLE * 100 + 0.5)::BIGINT, 0)"


def replace_all(expr: str, *rules) -> str:
    for pattern, new in rules:
        expr = f"regexp_replace({expr}, {quote(pattern)}, {quote(new)}, 'g')"
    return expr


def status_text(c: str) -> str:
    t = f"trim(replace(COALESCE({c}, ''), '**', ''))"
    return "trim(" + replace_all(t, (r"\s+\d{4}-\d{2}-\d{2}.*$", "")) + ")"


def status_id(c: str) -> str:
    t = status_text(c)
    bare = f"replace(replace({t}, chr(65039), ''), chr(65038), '')"
    symbols = {s.replace("️", ""): i for i, s, _ in fixed.STATUSES if s}
    aliases = {a: i for i, _, al in fixed.STATUSES for a in [i, *al]}
    aliases.update(fixed.LEGACY_STATUS_ALIASES)
    return (
        f"CASE WHEN {t} = '' THEN 'evaluated' ELSE COALESCE({case(bare, symbols)}, "
        f"{case(f'lower({t})', aliases)}, lower({t})) END"
    )


def outcome_of(status: str) -> str:
    return case(status, fixed.OUTCOME_OF_STATUS, "'pending'")


SENT_ON = (
    "COALESCE(TRY_CAST(list_max(regexp_extract_all(notes, "
    "'(?i)applied\\s+(?:on\\s+)?(\\d{4}-\\d{2}-\\d{2})', 1)) AS DATE), date)"
)
POSTED_ON = (
    "TRY_CAST(NULLIF(regexp_extract(notes, '(?i)posted\\s+(?:on\\s+)?(\\d{4}-\\d{2}-\\d{2})', 1), '') AS DATE)"
)


def job_id(c: str) -> str:
    parts = [r"(?i)/jobs/view/(?:[^/?#]*-)?(\d{6,})", r"(?i)currentJobId=(\d{6,})",
             r"(?i)urn:li:jobPosting:(\d{6,})"]
    tries = ", ".join(f"NULLIF(regexp_extract({c}, {quote(p)}, 1), '')" for p in parts)
    return f"CASE WHEN regexp_matches({c}, '(?i)linkedin\\.com') THEN COALESCE({tries}) END"


def url_key(c: str, slash: bool = False) -> str:
    plain = replace_all(c, ("/+$", "")) if slash else c
    return f"COALESCE('li:' || ({job_id(c)}), {plain})"


def role_key(company: str, title: str) -> str:
    return f"lower(trim({company})) || '::' || lower(trim({title}))"


def normal_role(c: str) -> str:
    return "trim(" + replace_all(
        f"lower(COALESCE({c}, ''))",
        (r"\((?:all genders|[mwfdx](?:\s*/\s*[mwfdx])+)\)", " "),
        (r"\b[mwfdx]\s*/\s*[mwfdx](?:\s*/\s*[mwfdx])?\b", " "),
        (r"\btpm\b", " technical product manager "), (r"\bpm\b", " product manager "),
        (r"\bpo\b", " product owner "), (r"\b(?:sr|snr)\b\.?", " senior "),
        (r"\bjr\b\.?", " junior "), ("[^a-z0-9]+", " "),
    ) + ")"


def group_title(c: str) -> str:
    countries = "|".join(fixed.GROUP_COUNTRY_SUFFIXES)
    c = replace_all(c, (rf"(?i)[\s–—-]+(?:{countries})\s*$", ""))
    return "trim(" + replace_all(
        f"lower({c})", (r"\([^)]*\)", " "), (r"\b(?:remote|hybrid|onsite)\b", " "), ("[^a-z0-9]+", " ")
    ) + ")"


def opening(company: str = "company", title: str = "title") -> str:
    return f"lower(trim({company})) || '::' || {group_title(title)}"


def company_key(c: str) -> str:
    return replace_all(f"lower({c})", ("[^a-z0-9]", ""))


def company_words(c: str) -> str:
    return "trim(" + replace_all(f"lower({c})", ("[()]", ""), (r"\s+", " "), ("[^a-z0-9 ]", "")) + ")"


def company_base(c: str) -> str:
    out = f"lower(trim({c}))"
    for s in fixed.COMPANY_SUFFIXES:
        out = replace_all(out, (re_escape(s) + "$", ""))
    return f"trim({out})"


def plain_words(c: str) -> str:
    folded = replace_all(f"lower({c})", (r"[^a-z0-9\s]", " "))
    return f"list_filter(string_split_regex({folded}, '\\s+'), lambda w: w <> '')"


def role_tokens(c: str) -> str:
    return (
        f"list_filter({plain_words(c)}, lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^\\d+$') "
        f"AND w NOT IN {in_list(fixed.ROLE_STOPWORDS)})"
    )


def stem(c: str) -> str:
    return f"array_to_string(list_sort({plain_words(c)}), ' ')"


def dedup_bag(c: str) -> str:
    folded = replace_all(f"lower({c})", ("[()]", " "), (r"\s+", " "), ("[^a-z0-9 /]", ""))
    return (
        f"list_filter(string_split_regex(trim({folded}), '\\s+'), lambda w: length(w) > 2 "
        f"AND w NOT IN {in_list(fixed.DEDUP_STOPWORDS)})"
    )


def lanes(c: str) -> str:
    parts = ", ".join(
        f"CASE WHEN {any_word(c, [re_escape(t) for t in terms], 's?')} THEN {quote(name)} END"
        for name, terms in fixed.TITLE_LANES
    )
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


def agency(c: str) -> str:
    return (f"(lower(trim({c})) IN {in_list(fixed.AGENCY_NAMES)} OR "
            f"{any_word(f'lower(trim({c}))', fixed.AGENCY_WORDS)})")


def wilson(k: str, n: str) -> tuple[str, str]:
    """(low, high) of the Wilson interval, z = 1.96."""
    p, size = f"(({k})::DOUBLE / ({n})::DOUBLE)", f"({n})::DOUBLE"
    d = f"(1 + 3.8416::DOUBLE / {size})"
    mid = f"({p} + 1.9208::DOUBLE / {size})"
    reach = f"(1.96::DOUBLE * sqrt({p} * (1 - {p}) / {size} + 0.9604::DOUBLE / ({size} * {size})))"
    low = f"CASE WHEN ({n}) = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, ({mid} - {reach}) / {d}) END"
    high = f"CASE WHEN ({n}) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, ({mid} + {reach}) / {d}) END"
    return low, high


# --- place cascade -------------------------------------------------------------
def folded_place(term: str) -> str:
    out = "".join(c if c.isascii() and (c.isalnum() or c in "_ ") else " ¦ " for c in term.lower())
    return " ".join(out.split())


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def tier_ctes(source: str) -> str:
    """CTEs up to ``tiers(location, tier, score, country, reason, keep)`` for the distinct
    locations of a relation, with the default tiers."""
    alias = {a: c for c, al in fixed.COUNTRY_ALIASES for a in al}
    late = [c for c, _ in fixed.COUNTRY_ALIASES]
    named = fixed.EU_COUNTRIES + fixed.OTHER_EUROPE + fixed.FURTHER_COUNTRIES
    words = [(folded_place(c), alias.get(c, c), 2000 + late.index(alias[c]) if c in alias else i)
             for i, c in enumerate(named)]
    words += [(folded_place(t), c, 1000 + i)
              for i, (c, cities) in enumerate(fixed.DEFAULT_CITIES.items()) for t in cities]
    kinds = [(folded_place(t), "eu") for t in fixed.EU_REGION_WORDS]
    kinds += [(folded_place(t), "global") for t in fixed.GLOBAL_REMOTE_WORDS]
    kinds += [(folded_place(t), "remote") for t in fixed.REMOTE_WORDS]
    kinds += [(folded_place(t), "outside") for t in fixed.OUTSIDE_PLACES]
    norm = replace_all("replace(lower(strip_accents(location)), '.', '')",
                       (r"[|/,;()\[\]—–-]+", " "), (r"\s+", " "))
    return f"""
    locs AS (SELECT DISTINCT location FROM {source}),
    padded AS (SELECT location, trim({norm}) AS norm,
        ' ' || {replace_all(f"trim({norm})", ("[^a-z0-9_ ]", " ¦ "), (" +", " "))} || ' ' AS pad FROM locs),
    place(word, country, ord) AS (VALUES {_values(words)}),
    kind(word, k) AS (VALUES {_values(kinds)}),
    named AS (
        SELECT location, country, ord,
               CASE WHEN country IN ('austria', 'germany') THEN 1
                    WHEN country IN ('switzerland', 'romania', 'united kingdom') THEN 2
                    WHEN country = 'israel' THEN 3 WHEN country IN ('france', 'belgium') THEN 4
                    WHEN country IN {in_list(fixed.EU_COUNTRIES)} THEN 1 ELSE 3 END AS r
        FROM padded JOIN place ON contains(pad, ' ' || word || ' ')),
    best AS (SELECT location, min(r) AS r, arg_min(country, r * 10000 + ord) AS country
             FROM named GROUP BY location),
    seen_kinds AS (SELECT location, list(DISTINCT k) AS ks FROM padded
                   JOIN kind ON contains(pad, ' ' || word || ' ') GROUP BY location),
    reasons AS (
        SELECT padded.location, best.r, best.country,
               CASE WHEN norm = '' THEN 'no-location' WHEN best.r IS NOT NULL THEN 'country'
                    WHEN list_contains(ks, 'eu') THEN 'eu-region'
                    WHEN list_contains(ks, 'global') AND NOT list_contains(ks, 'outside') THEN 'global-remote'
                    WHEN list_contains(ks, 'outside') THEN 'outside-scope'
                    WHEN list_contains(ks, 'remote') THEN 'unqualified-remote'
                    ELSE 'unrecognized' END AS reason
        FROM padded LEFT JOIN best USING (location) LEFT JOIN seen_kinds USING (location)),
    tiers AS (
        SELECT location, reason, CASE WHEN reason = 'country' THEN country END AS country,
               CASE WHEN reason = 'country' THEN substr('SABC', r, 1)
                    WHEN reason IN ('eu-region', 'global-remote') THEN 'S' END AS tier,
               CASE WHEN reason = 'country' THEN (6 - r)::DOUBLE
                    WHEN reason IN ('eu-region', 'global-remote') THEN 5.0::DOUBLE END AS score,
               reason NOT IN ('outside-scope', 'unrecognized') AS keep
        FROM reasons)"""


DERIVED = {
    "app_s": f"SELECT *, {status_id('status')} AS status_id, {SENT_ON} AS sent_on FROM app",
}


def greedy(name: str, members: str) -> str:
    """CTE ``name(pos)``: rows taken in order unless an earlier taken row shares a key.

    ``members`` gives ``pos, key``.  Each step takes what is first under all its keys
    among the undecided and drops what shares a key with an earlier taken row; the
    statement needs ``WITH RECURSIVE``.
    """
    return f"""
    {name}_steps AS (
        SELECT pos, key, 0 AS state, 0 AS step FROM ({members})
        UNION ALL
        SELECT pos, key, CASE WHEN state <> 0 THEN state WHEN taken THEN 1
               WHEN max(won < pos) OVER (PARTITION BY pos) THEN 2 ELSE 0 END, step + 1
        FROM (SELECT *, min(CASE WHEN state = 1 OR taken THEN pos END) OVER (PARTITION BY key) AS won
              FROM (SELECT *, state = 0 AND NOT max(earliest < pos) OVER (PARTITION BY pos) AS taken
                    FROM (SELECT *, min(CASE WHEN state = 0 THEN pos END) OVER (PARTITION BY key) AS earliest,
                                 max(state = 0) OVER () AS going FROM {name}_steps)))
        WHERE going),
    {name} AS MATERIALIZED (SELECT DISTINCT pos FROM {name}_steps
        WHERE state = 1 AND step = (SELECT max(step) FROM {name}_steps))"""


def with_views(views: list[str], body: str, *more: str) -> str:
    """``WITH`` the named views and further CTE texts, then the body."""
    ctes = [f"{v} AS MATERIALIZED ({duck_view(v) if v not in DERIVED else DERIVED[v]})" for v in views]
    return "WITH RECURSIVE " + ", ".join([*ctes, *[m.strip() for m in more]]) + " " + body
