"""Rule cascades as column expressions: status, title, place, page, report, score.

A cascade is one ``when`` chain: the first rule that holds decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.functions.regex import BOUND, literal, words
from oppflow.functions.text import (
    as_col, bind, blank_to_null, normalize_location, strip_bold,
)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def sql_literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def literal_map(pairs: dict) -> Column:
    """A constant lookup, parsed from one text rather than built entry by entry."""
    return F.expr("map(" + ", ".join(sql_literal(x) for kv in pairs.items() for x in kv) + ")")


# --- status --------------------------------------------------------------------
def _no_selector(text: str) -> str:
    return text.replace("︎", "").replace("️", "")


SYMBOL_TO_STATUS = {_no_selector(s): i for i, s, _ in fixed.STATUSES if s}
STATUS_TO_SYMBOL = {i: s for i, s, _ in fixed.STATUSES}
ALIAS_TO_STATUS = {
    **fixed.LEGACY_STATUS_ALIASES,
    **{a: i for i, _, aliases in fixed.STATUSES for a in [i, *aliases]},
}


def _status_text(raw) -> Column:
    c = F.trim(strip_bold(F.coalesce(as_col(raw), F.lit(""))))
    return F.trim(F.regexp_replace(c, r"\s+\d{4}-\d{2}-\d{2}[\s\S]*$", ""))


def normalize_status(raw) -> Column:
    """Status id of a cell; blank means evaluated, unknown text stays as it is."""
    c = _status_text(raw)
    lower = F.lower(c)
    symbol = F.try_element_at(
        literal_map(SYMBOL_TO_STATUS), F.regexp_replace(c, "[︎️]", "")
    )
    alias = F.try_element_at(literal_map(ALIAS_TO_STATUS), lower)
    return F.when(c == "", F.lit("evaluated")).otherwise(F.coalesce(symbol, alias, lower))


def status_symbol(status_id) -> Column:
    """The cell a status id is stored as; NULL for an unknown id."""
    return F.try_element_at(literal_map(STATUS_TO_SYMBOL), as_col(status_id))


def write_status(raw) -> Column:
    """Cell to store for an incoming status; anything unknown is stored blank."""
    c = F.trim(F.regexp_replace(strip_bold(F.coalesce(as_col(raw), F.lit(""))),
                                r"\s+\d{4}-\d{2}-\d{2}[\s\S]*$", ""))
    lower = F.lower(c)
    known = literal_map(
        {a: STATUS_TO_SYMBOL[i]
         for a, i in {**ALIAS_TO_STATUS, **fixed.WRITE_STATUS_ALIASES}.items()}
    )
    return (
        F.when(c.isin("", "-", "—"), F.lit(""))
        .when(c.isin([s for _, s, _ in fixed.STATUSES if s]), c)
        .otherwise(
            F.coalesce(
                F.try_element_at(known, lower),
                F.when(lower.rlike("^(?:duplicado|dup|repost)"),
                       F.lit(STATUS_TO_SYMBOL["discarded"])),
                F.lit(""),
            )
        )
    )


def repaired_status(raw) -> Column:
    """``(cell, note, known)``: the canonical cell and text that belongs in the notes."""
    c = F.trim(strip_bold(F.coalesce(as_col(raw), F.lit(""))))
    lower = F.lower(c)
    to, repairs = STATUS_TO_SYMBOL, fixed.STATUS_REPAIRS
    duplicate = lower.rlike(repairs["duplicate"] + BOUND)
    repost = lower.rlike(repairs["repost"])
    labels = literal_map({
        a: to[i] for i, _, aliases in fixed.STATUSES for a in [i, *aliases] if a != "monitor"
    })
    cell = (
        F.when(c.isin(repairs["blank"]), F.lit(""))
        .when(c.isin([s for s in to.values() if s]), c)
        .when(duplicate, F.lit(to["discarded"]))
        .when(lower.rlike(repairs["discarded"]), F.lit(to["discarded"]))
        .when(lower.rlike(repairs["rejected"]), F.lit(to["rejected"]))
        .when(lower.rlike(repairs["applied"]), F.lit(to["applied"]))
        .when(lower.isin(repairs["undecided"]), F.lit(""))
        .when(lower == "monitor", F.lit(to["skip"]))
        .when(lower.rlike(repairs["skipped"]), F.lit(to["skip"]))
        .when(repost, F.lit(to["discarded"]))
        .when(lower == "rechazado", F.lit(None).cast("string"))
        .otherwise(F.try_element_at(labels, lower))
    )
    note = F.when(duplicate | repost, F.trim(as_col(raw)))
    return F.struct(cell.alias("cell"), note.alias("note"), cell.isNotNull().alias("known"))


def classify_outcome(status_id) -> Column:
    """Outcome bucket of a status id.  A sent application counts as positive."""
    return F.coalesce(
        F.try_element_at(literal_map(fixed.OUTCOME_OF_STATUS), as_col(status_id)),
        F.lit("pending"),
    )


def stage_rank(stage) -> Column:
    ranks = {a: r for i, r, aliases in fixed.STAGES for a in [i, *aliases]}
    return F.try_element_at(literal_map(ranks), F.lower(F.trim(as_col(stage))))


# --- titles and companies ------------------------------------------------------
def classify_title(title, role_gate=(), negative=(), positive=()) -> Column:
    """reject / pass / generic; generic is the absence of a signal, not a no."""
    lower = F.lower(F.coalesce(as_col(title), F.lit("")))

    def has(terms):
        return any_of(F.contains(lower, F.lit(t.lower())) for t in terms)

    cascade = F.when(F.lit(bool(role_gate)) & ~has(role_gate), F.lit("reject"))
    cascade = cascade.when(has(negative), F.lit("reject"))
    named = F.lit(True) if not positive else has(positive)
    return cascade.when(named, F.lit("pass")).otherwise(F.lit("generic"))


def detect_lanes(title, lanes=fixed.TITLE_LANES) -> Column:
    """The lanes a title names, in list order; a trailing s is tolerated."""
    hits = [
        F.when(as_col(title).rlike(words([literal(t) for t in terms], tail="s?")), F.lit(name))
        for name, terms in lanes
    ]
    return F.array_compact(F.array(*hits))


def title_flags(title) -> dict[str, Column]:
    c = as_col(title)
    return {
        "senior": c.rlike(words(fixed.SENIOR_WORDS)),
        "junior": c.rlike(words(fixed.JUNIOR_WORDS)),
        "german": c.rlike(words(fixed.GERMAN_WORDS)),
        "technical": c.rlike(words(fixed.TECHNICAL_WORDS)),
    }


def is_agency(company) -> Column:
    c = F.lower(F.trim(as_col(company)))
    return c.isin(fixed.AGENCY_NAMES) | c.rlike(words(fixed.AGENCY_WORDS))


# --- places --------------------------------------------------------------------
def place_rules(tiers=None, cities=None) -> dict:
    """Lookup values of the tier cascade, built once from the configuration.

    Each place word carries one number, ``tier rank * 10000 + preference``; the
    smallest number found in a location names both its best tier and the country
    that is reported for it.
    """
    tiers = tiers or fixed.DEFAULT_TIERS
    cities = cities or fixed.DEFAULT_CITIES
    order = [t for t in fixed.TIER_ORDER if t in tiers]

    def flagged(flag):
        return next((t for t in order if tiers[t].get(flag)), None)

    explicit = {}
    for tier in order:
        for country in tiers[tier].get("countries", []):
            explicit[country.lower()] = tier

    def tier_of(country):
        default = flagged("eu") if country in fixed.EU_COUNTRIES else flagged("other_europe")
        return explicit.get(country, default)

    alias_of = {a: c for c, aliases in fixed.COUNTRY_ALIASES for a in aliases}
    renamed = [c for c, _ in fixed.COUNTRY_ALIASES]
    places: dict[str, int] = {}
    country_of: dict[int, str] = {}

    def add(word, country, preference):
        tier = tier_of(country)
        if tier is None:
            return
        number = fixed.TIER_ORDER.index(tier) * 10000 + preference
        places[word] = min(number, places.get(word, number))
        country_of[number] = country

    named = fixed.EU_COUNTRIES + fixed.OTHER_EUROPE + fixed.FURTHER_COUNTRIES
    for i, country in enumerate(named):
        if country in alias_of:
            add(country, alias_of[country], 2000 + renamed.index(alias_of[country]))
        else:
            add(country, country, i)
    for i, (country, names) in enumerate(cities.items()):
        for city in names:
            add(city, country, 1000 + i)
    return {
        "places": places,
        "country_of": country_of,
        "eu_tier": flagged("eu"),
        "global_tier": flagged("global_remote"),
        "scores": {t: tiers[t].get("score") for t in order},
    }


def with_prefixes(term: str, terms) -> list[str]:
    """The term and the dictionary terms it begins with (``mexico`` in ``mexico city``)."""
    return [t for t in terms if term == t or term.startswith(t + " ")]


def place_words(norm: Column, terms) -> Column:
    """The longest dictionary term at every position of a normalised location.

    The search looks ahead without consuming, so overlapping terms are all found.
    """
    by_letter: dict[str, list[str]] = {}
    for t in sorted(terms, key=lambda t: (-len(t), t)):
        by_letter.setdefault(t[0], []).append(literal(t[1:]))
    options = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items()))
    pattern = f"(?<![a-z0-9_])(?=({options})(?![a-z0-9_]))"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(1))


def resolve_tier(location, tiers=None, cities=None, outside=None) -> Column:
    """``(tier, score, country, reason, keep)`` of a free-text location.

    A location that names several places is judged by its best one.
    """
    rules = place_rules(tiers, cities)
    outside = outside or fixed.OUTSIDE_PLACES

    kinds = [fixed.EU_REGION_WORDS, fixed.GLOBAL_REMOTE_WORDS, fixed.REMOTE_WORDS, outside]
    terms = sorted({*rules["places"], *(w for words_ in kinds for w in words_)})
    best_place = {
        t: min(found) for t in terms
        if (found := [rules["places"][p] for p in with_prefixes(t, rules["places"])])
    }
    # Which kinds of word a term stands for, one bit per kind.
    bits = {t: sum(1 << i for i, k in enumerate(kinds) if with_prefixes(t, k)) for t in terms}

    # A map is searched entry by entry, so terms are looked up among those of their first letter.
    facts: dict[str, list[str]] = {}
    for t in terms:
        code = f"{best_place[t]}" if t in best_place else "CAST(NULL AS INT)"
        facts.setdefault(t[0], []).append(f"{sql_literal(t)}, struct({code} AS code, {bits[t]} AS seen)")
    by_letter = F.expr("map(" + ", ".join(f"{sql_literal(c)}, map({', '.join(f)})" for c, f in facts.items()) + ")")

    def judge(hits: Column) -> Column:
        known = F.transform(hits, lambda g: F.try_element_at(F.try_element_at(by_letter, F.left(g, F.lit(1))), g))
        code = F.array_min(F.transform(known, lambda k: k["code"]))
        seen = F.aggregate(known, F.lit(0), lambda acc, k: acc.bitwiseOR(k["seen"]))
        return F.struct(code.alias("code"), seen.alias("seen"))

    def decide(found: Column) -> Column:
        code = found["code"]
        region, anywhere, remote, is_outside = (
            found["seen"].bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(kinds))
        )
        eu = region & F.lit(rules["eu_tier"] is not None)
        anywhere = anywhere & ~is_outside & F.lit(rules["global_tier"] is not None)
        reason = (
            F.when(code.isNotNull(), F.lit("country"))
            .when(eu, F.lit("eu-region"))
            .when(anywhere, F.lit("global-remote"))
            .when(is_outside, F.lit("outside-scope"))
            .when(remote, F.lit("unqualified-remote"))
            .otherwise(F.lit("unrecognized"))
        )
        return F.struct(reason.alias("reason"), code.alias("code"))

    def of_text(norm: Column) -> Column:
        nowhere = F.struct(F.lit("no-location").alias("reason"), F.lit(None).cast("int").alias("code"))
        return F.when(norm == "", nowhere).otherwise(
            bind(bind(place_words(norm, terms), judge), decide)
        )

    return bind(bind(normalize_location(location), of_text), lambda j: _tier_of(j, rules))


def _tier_of(judged: Column, rules: dict) -> Column:
    tier_names = literal_map({i: t for i, t in enumerate(fixed.TIER_ORDER)})
    scores = literal_map({t: float(s) for t, s in rules["scores"].items() if s is not None})
    by_country = judged["reason"] == "country"
    tier = (
        F.when(by_country, F.try_element_at(tier_names, F.floor(judged["code"] / 10000).cast("int")))
        .when(judged["reason"] == "eu-region", F.lit(rules["eu_tier"]))
        .when(judged["reason"] == "global-remote", F.lit(rules["global_tier"]))
    )
    return F.struct(
        tier.alias("tier"),
        F.try_element_at(scores, tier).alias("score"),
        F.when(by_country, F.try_element_at(literal_map(rules["country_of"]), judged["code"])).alias("country"),
        judged["reason"].alias("reason"),
        (~judged["reason"].isin("outside-scope", "unrecognized")).alias("keep"),
    )


# --- pages ---------------------------------------------------------------------
def classify_liveness(status, final_url, body, controls) -> Column:
    """``(result, reason)``: is the posting behind a page still open?"""
    url = F.coalesce(as_col(final_url), F.lit(""))
    text = F.coalesce(as_col(body), F.lit(""))

    def first_text(patterns):
        return F.coalesce(*[F.when(text.rlike(f"(?iu){p}"), F.lit(p)) for p in patterns])

    apply_words = f"(?iu){BOUND}(?:{'|'.join(fixed.APPLY_WORDS)}){BOUND}|" + "|".join(
        fixed.APPLY_PHRASES
    )
    expired_text = first_text(fixed.EXPIRED_TEXTS)
    listing_text = first_text(fixed.LISTING_TEXTS)
    can_apply = F.coalesce(F.exists(as_col(controls), lambda x: x.rlike(apply_words)), F.lit(False))
    matched = F.lit(fixed.LIVENESS_REASONS["pattern"])
    rules = [
        (as_col(status).isin(404, 410), "expired",
         F.concat(F.lit(fixed.LIVENESS_REASONS["http"]), as_col(status).cast("string"))),
        (url.rlike(f"(?i){fixed.EXPIRED_URL}"), "expired", F.concat(F.lit(fixed.LIVENESS_REASONS["redirect"]), url)),
        (expired_text.isNotNull(), "expired", F.concat(matched, expired_text)),
        (can_apply, "active", F.lit(fixed.LIVENESS_REASONS["apply"])),
        (listing_text.isNotNull(), "expired", F.concat(matched, listing_text)),
        (F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) < fixed.MIN_PAGE_CHARS, "expired",
         F.lit(fixed.LIVENESS_REASONS["short"])),
    ]
    chain = None
    for condition, result, reason in rules:
        value = F.struct(F.lit(result).alias("result"), reason.alias("reason"))
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(F.struct(
        F.lit("uncertain").alias("result"),
        F.lit(fixed.LIVENESS_REASONS["no_apply"]).alias("reason"),
    ))


# --- report text ---------------------------------------------------------------
def classify_remote(value) -> Column:
    c = F.lower(as_col(value))
    return (
        F.when(blank_to_null(value).isNull(), F.lit("unknown"))
        .when(c.rlike(words([*fixed.REMOTE_GEO, fixed.REMOTE_GEO_EXTRA])), F.lit("geo-restricted"))
        .when(c.rlike(words(fixed.REMOTE_HYBRID)), F.lit("hybrid/onsite"))
        .when(c.rlike(words(fixed.REMOTE_GLOBAL, symbols=True)), F.lit("global remote"))
        .when(c.rlike(words(fixed.REMOTE_REGIONAL)), F.lit("regional remote"))
        .otherwise(F.lit("unknown"))
    )


def classify_company_size(value) -> Column:
    """Size class of a team-size text.

    A run of commas without a digit is not a number; it compares false with
    every limit, so it lands in the last class, as does any text holding one.
    """
    c = F.lower(as_col(value))
    runs = F.regexp_extract_all(c, F.lit(r"([\d,]+)"), F.lit(1))
    numbers = F.transform(runs, lambda r: F.replace(r, F.lit(","), F.lit("")).try_cast("double"))
    broken = F.exists(numbers, lambda n: n.isNull())
    largest = F.array_max(numbers)
    return (
        F.when(blank_to_null(value).isNull(), F.lit("unknown"))
        .when((F.size(runs) > 0) & ~broken & (largest <= 50), F.lit("startup"))
        .when((F.size(runs) > 0) & ~broken & (largest <= 500), F.lit("scaleup"))
        .when(F.size(runs) > 0, F.lit("enterprise"))
        .when(c.rlike(words(fixed.SIZE_SMALL)), F.lit("startup"))
        .when(c.rlike(words(fixed.SIZE_LARGE)), F.lit("enterprise"))
        .otherwise(F.lit("unknown"))
    )


def classify_blocker(description, severity) -> Column:
    """Kind of a gap, NULL for the soft ones."""
    text, sev = F.lower(as_col(description)), F.lower(as_col(severity))
    chain = F.when(F.contains(sev, F.lit("nice")) | F.contains(sev, F.lit("soft")),
                   F.lit(None).cast("string"))
    for name, terms in fixed.BLOCKERS:
        chain = chain.when(text.rlike(words(terms)), F.lit(name))
    return chain.otherwise(F.lit("other"))


def extract_tech_terms(text) -> Column:
    """Technology names in a text, first letter raised, in order of appearance."""
    pattern = words(fixed.TECH_TERMS, symbols=True)
    hits = F.regexp_extract_all(F.coalesce(as_col(text), F.lit("")), F.lit(pattern), F.lit(0))
    return F.transform(
        hits, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))
    )


# --- scores --------------------------------------------------------------------
def effort_lane(priority, lanes=fixed.EFFORT_LANES) -> Column:
    chain = None
    for name, lowest in lanes:
        test = as_col(priority) >= lowest
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain


def score_band(score, bands=fixed.SCORE_BANDS) -> Column:
    chain = None
    for label, low, high in bands:
        test = (as_col(score) >= low) & (as_col(score) < high)
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    return chain


def weighted(values: dict, weights: dict) -> Column:
    return reduce(lambda a, b: a + b, [as_col(values[k]) * F.lit(w) for k, w in weights.items()])


def posting_age_signal(posted, as_of) -> Column:
    """How the age of a posting reads; an unknown date is never held against it."""
    age = F.datediff(as_col(as_of), as_col(posted))
    return (
        F.when(as_col(posted).isNull(), F.lit("caution"))
        .when(age < 30, F.lit("good"))
        .when(age < 60, F.lit("mixed"))
        .otherwise(F.lit("concerning"))
    )


# --- cadence -------------------------------------------------------------------
def follow_up_urgency(status, days_since, days_since_last, sent, cfg=None) -> Column:
    cfg = {**fixed.CADENCE, **(cfg or {})}
    s, age, last, n = (as_col(x) for x in (status, days_since, days_since_last, sent))
    applied = (
        F.when(n >= cfg["applied_max_followups"], F.lit("cold"))
        .when((n == 0) & (age >= cfg["applied_first"]), F.lit("overdue"))
        .when((n > 0) & (last >= cfg["applied_subsequent"]), F.lit("overdue"))
        .otherwise(F.lit("waiting"))
    )
    responded = (
        F.when(age < cfg["responded_initial"], F.lit("urgent"))
        .when(age >= cfg["responded_subsequent"], F.lit("overdue"))
        .otherwise(F.lit("waiting"))
    )
    interview = F.when(age >= cfg["interview_thankyou"], F.lit("overdue")).otherwise(
        F.lit("waiting")
    )
    return (
        F.when(s == "applied", applied)
        .when(s == "responded", responded)
        .when(s == "interview", interview)
        .otherwise(F.lit("waiting"))
    )


def next_follow_up_date(status, applied_on, last_sent, sent, cfg=None) -> Column:
    cfg = {**fixed.CADENCE, **(cfg or {})}
    s, start, last, n = (as_col(x) for x in (status, applied_on, last_sent, sent))
    applied = (
        F.when(n >= cfg["applied_max_followups"], F.lit(None).cast("date"))
        .when((n == 0) | last.isNull(), F.date_add(start, cfg["applied_first"]))
        .otherwise(F.date_add(last, cfg["applied_subsequent"]))
    )
    return (
        F.when(s == "applied", applied)
        .when(s == "responded",
              F.date_add(F.coalesce(last, start), cfg["responded_subsequent"]))
        .when(s == "interview", F.date_add(start, cfg["interview_thankyou"]))
    )
