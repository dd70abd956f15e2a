"""Scalar text functions: cells, scores, links, URLs, companies, roles, HTML."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.functions.regex import BOUND, WORD, literal, word


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value) -> Column:
    return F.nullif(as_col(value), F.lit(""))


def first_filled(*values) -> Column:
    """First value that is neither NULL nor blank, else ''."""
    return F.coalesce(*[blank_to_null(v) for v in values], F.lit(""))


def found(value, pattern: str, group: int = 1) -> Column:
    """A capture group, or NULL when the pattern does not match."""
    return blank_to_null(F.regexp_extract(as_col(value), pattern, group))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def drop_first(array, n: int) -> Column:
    """An array without its first n entries."""
    a = as_col(array)
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


# --- cells ---------------------------------------------------------------------
def strip_bold(value) -> Column:
    return F.replace(as_col(value), F.lit("**"), F.lit(""))


def clean_cell(value) -> Column:
    return F.trim(F.rtrim(F.trim(as_col(value)), F.lit("|")))


def escape_cell(value) -> Column:
    return F.replace(F.coalesce(as_col(value), F.lit("")), F.lit("|"), F.lit("\\|"))


def split_row_raw(value) -> Column:
    return F.split(as_col(value), r"(?<!\\)\|")


def split_row(value) -> Column:
    """Trimmed and unescaped cells of one pipe row."""
    return F.transform(
        split_row_raw(value), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|"))
    )


def truncate(value, n: int) -> Column:
    c = as_col(value)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


# --- scores and dates ----------------------------------------------------------
def parse_score(value) -> Column:
    """First number in the cell; a cell without one is 0."""
    number = found(strip_bold(value), r"(\d+(?:\.\d+)?)")
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def parse_score_loose(value) -> Column:
    """As ``parse_score`` but a leading point counts (the form merges compare)."""
    digits = F.regexp_extract(strip_bold(value), r"([\d.]+)", 1)
    return F.coalesce(found(digits, r"^(\d*\.?\d*)").try_cast("double"), F.lit(0.0))


def parse_int(value) -> Column:
    """Leading integer of a cell, NULL when it does not start with one."""
    return found(F.trim(as_col(value)), r"^([+-]?\d+)").try_cast("bigint")


def is_iso_date(value) -> Column:
    return F.coalesce(F.trim(as_col(value)).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


def effective_applied_date(notes, date) -> Column:
    """Latest ``applied [on] <date>`` in the notes, else the row's own date."""
    dates = F.regexp_extract_all(
        F.coalesce(as_col(notes), F.lit("")),
        F.lit(r"(?i)applied\s+(?:on\s+)?(\d{4}-\d{2}-\d{2})"),
        F.lit(1),
    )
    return F.coalesce(F.try_to_date(F.array_max(dates)), as_col(date))


def posted_date(notes) -> Column:
    return F.try_to_date(found(notes, r"(?i)posted\s+(?:on\s+)?(\d{4}-\d{2}-\d{2})"))


def to_posted_date(value) -> Column:
    """A board's date, ISO text or epoch milliseconds, as a UTC date."""
    c = blank_to_null(value)
    millis = F.when(c.rlike(r"^\d+$"), F.timestamp_millis(c.try_cast("bigint")))
    return F.to_date(F.coalesce(millis, F.try_to_timestamp(c)))


def iso_week(date) -> Column:
    d = as_col(date)
    year = F.extract(F.lit("YEAROFWEEK"), d).cast("string")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def days_between(start, end) -> Column:
    return F.datediff(as_col(end), as_col(start)).cast("bigint")


# --- report links --------------------------------------------------------------
def report_num(link) -> Column:
    return found(link, r"\[(\d+)\]").try_cast("bigint")


def report_target(link) -> Column:
    return found(link, r"\]\(([^)]+)\)")


def report_path(link, tracker_dir) -> Column:
    """The link's target, resolved against the folder its tracker file lies in."""
    target = report_target(link)
    full = F.when(target.startswith("/"), target).otherwise(
        F.concat(as_col(tracker_dir), F.lit("/"), target)
    )
    none = F.array().cast("array<string>")

    def step(path: Column, part: Column) -> Column:
        can_go_up = (F.size(path) > 0) & (F.try_element_at(path, F.lit(-1)) != "..")
        return (
            F.when(part.isin("", "."), path)
            .when((part == "..") & can_go_up, F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))))
            .otherwise(F.concat(path, F.array(part)))
        )

    parts = F.aggregate(F.split(full, "/"), none, step)
    root = F.when(full.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.when(target.isNotNull(), F.concat(root, F.array_join(parts, "/")))


def report_link_for_write(link) -> Column:
    return F.regexp_replace(
        F.coalesce(as_col(link), F.lit("")), r"\]\((?:\./)?reports/", "](../reports/"
    )


# --- URLs ----------------------------------------------------------------------
def linkedin_job_id(url) -> Column:
    c = as_col(url)
    number = F.coalesce(
        found(c, r"(?i)/jobs/view/(?:[^/?#]*-)?(\d{6,})"),
        found(c, r"(?i)currentJobId=(\d{6,})"),
        found(c, r"(?i)urn:li:jobPosting:(\d{6,})"),
    )
    return F.when(c.rlike(r"(?i)linkedin\.com"), number)


def canonical_job_url(job_id) -> Column:
    return F.concat(F.lit("https://www.linkedin.com/jobs/view/"), as_col(job_id))


def dedup_keys(url) -> Column:
    """Every key a URL is remembered under."""
    c = as_col(url)
    return F.array_compact(F.array(c, F.concat(F.lit("li:"), linkedin_job_id(c))))


def url_key(url, strip_slash: bool = False) -> Column:
    """The one key a URL is looked up by: the job id if there is one, else itself."""
    c = as_col(url)
    plain = F.regexp_replace(c, "/+$", "") if strip_slash else c
    return F.coalesce(F.concat(F.lit("li:"), linkedin_job_id(c)), plain)


def harvested_urls(text) -> Column:
    urls = F.regexp_extract_all(as_col(text), F.lit(r"(https?://[^\s|)\]]+)"), F.lit(1))
    return F.transform(urls, lambda u: F.regexp_replace(u, "[.,]+$", ""))


def role_key(company, title) -> Column:
    return F.concat(
        F.lower(F.trim(as_col(company))), F.lit("::"), F.lower(F.trim(as_col(title)))
    )


# --- companies -----------------------------------------------------------------
def company_key(name) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(as_col(name), F.lit(""))), "[^a-z0-9]", "")


def company_words(name) -> Column:
    """Letters, digits and single spaces."""
    c = F.regexp_replace(F.lower(as_col(name)), "[()]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "[^a-z0-9 ]", "")
    return F.trim(c)


def company_base(name) -> Column:
    """Lower case with each legal suffix removed at most once, in list order."""
    c = F.lower(F.trim(as_col(name)))
    for suffix in fixed.COMPANY_SUFFIXES:
        c = F.regexp_replace(c, literal(suffix) + "$", "")
    return F.trim(c)


# --- roles ---------------------------------------------------------------------
def normalize_role(title) -> Column:
    """Spell out what hand-written rows abbreviate, then fold to plain words."""
    c = F.lower(F.coalesce(as_col(title), F.lit("")))
    # Patterns begin with a character of their own, so that most places are passed over at once.
    letter, slash = "[mwfdx]", r"\s*/\s*"
    c = F.regexp_replace(c, rf"\((?:all genders|{letter}(?:{slash}{letter})+)\)", " ")
    c = F.regexp_replace(c, rf"{letter}(?=\s*/)(?<!{WORD}{letter}){slash}{letter}(?:{slash}{letter})?(?!{WORD})", " ")
    # Two blanks between words, so that each has blanks of its own and is replaced as plain text.
    c = F.concat(F.lit(" "), F.regexp_replace(c, "[^a-z0-9_]+", "  "), F.lit(" "))
    for short, words in fixed.ROLE_ABBREVIATIONS.items():
        c = F.replace(c, F.lit(f" {short} "), F.lit(f" {words} "))
    return F.trim(F.regexp_replace(c, "[ _]+", " "))


def group_title(title) -> Column:
    """What is left of a title once place and work mode are taken away."""
    countries = "|".join(fixed.GROUP_COUNTRY_SUFFIXES)
    c = F.regexp_replace(as_col(title), rf"(?i)[\s–—-]+(?:{countries})\s*$", "")
    c = F.regexp_replace(F.lower(c), r"\([^)]*\)", " ")
    c = F.regexp_replace(c, word("(?:remote|hybrid|onsite)"), " ")
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def opening_key(company, title) -> Column:
    return F.concat(F.lower(F.trim(as_col(company))), F.lit("::"), group_title(title))


def _plain_words(title) -> Column:
    c = F.regexp_replace(F.lower(F.coalesce(as_col(title), F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def role_tokens(title) -> Column:
    """The words that set a role apart (with repeats, in title order)."""
    return F.filter(
        _plain_words(title),
        lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\d+$") & ~w.isin(fixed.ROLE_STOPWORDS),
    )


def stem_key(title) -> Column:
    """Every word of a title, order-independent."""
    return F.array_join(F.array_sort(_plain_words(title)), " ")


def role_fuzzy_match(a, b) -> Column:
    """Whether two titles at one company name the same role (strict rule)."""
    bag_a, bag_b = role_tokens(a), role_tokens(b)
    set_a, set_b = F.array_distinct(bag_a), F.array_distinct(bag_b)
    only_a = F.size(F.array_except(set_a, set_b)) > 0
    only_b = F.size(F.array_except(set_b, set_a)) > 0
    no_words = (F.size(bag_a) == 0) | (F.size(bag_b) == 0)
    return (
        F.when(no_words, (stem_key(a) != "") & (stem_key(a) == stem_key(b)))
        .when(~only_a & ~only_b, F.lit(True))
        .when(only_a & only_b, F.lit(False))
        .otherwise(F.least(F.size(set_a), F.size(set_b)) >= 2)
    )


def dedup_tokens(role) -> Column:
    """The words (with repeats) that count when looking for rows written twice."""
    c = F.regexp_replace(F.lower(F.coalesce(as_col(role), F.lit(""))), "[()]", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "[^a-z0-9 /]", "")
    return F.filter(
        F.split(F.trim(c), r"\s+"),
        lambda w: (F.length(w) > 2) & ~w.isin(fixed.DEDUP_STOPWORDS),
    )


def role_overlap_match(a, b) -> Column:
    """Whether the row ``b`` repeats the earlier row ``a`` (overlap rule)."""
    bag_a, bag_b = dedup_tokens(a), dedup_tokens(b)
    shared = F.size(F.filter(bag_a, lambda w: F.array_contains(bag_b, w)))
    smaller = F.least(F.size(bag_a), F.size(bag_b))
    return (smaller > 0) & (shared >= 2) & (shared * 10 >= smaller * 6)


# --- locations -----------------------------------------------------------------
def _accents() -> tuple[str, str]:
    """Letters that decompose into an ASCII letter plus marks, and that letter."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii():
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


ACCENTED, UNACCENTED = _accents()


def normalize_location(value) -> Column:
    """Lower-case words with accents, points and separators folded away."""
    c = F.translate(F.coalesce(as_col(value), F.lit("")), ACCENTED, UNACCENTED)
    c = F.lower(F.regexp_replace(c, "[̀-ͯ]", ""))
    c = F.regexp_replace(F.replace(c, F.lit("."), F.lit("")), r"[|/,;()\[\]—–-]+", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def has_token(value, token: str) -> Column:
    return as_col(value).rlike(BOUND + literal(token) + BOUND)


# --- contacts ------------------------------------------------------------------
def extract_contacts(notes) -> Column:
    """E-mail addresses in the notes with the name written before each."""
    c = F.coalesce(as_col(notes), F.lit(""))
    emails = F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.\w+)"), F.lit(1))
    named = (
        r"(?i)(?:emailed|contact[:\s]+|to\s+)([A-Z][a-z]+ ?[A-Z]?[a-z]*)\s*(?:at|@|$)"
    )

    def contact(email: Column) -> Column:
        before = F.call_function("substring_index", c, email, F.lit(1))
        return F.struct(
            email.alias("email"), F.trim(found(before, named)).alias("name")
        )

    return F.transform(emails, contact)


# --- HTML ----------------------------------------------------------------------
ENTITY = r"&(?:#[xX]?[0-9a-fA-F]+|[a-zA-Z]+);"


def _one_entity(entity: Column) -> Column:
    code = F.lower(F.substring(entity, F.lit(2), F.length(entity)))
    code = F.regexp_replace(code, ";$", "")
    known = F.create_map(*[F.lit(x) for kv in fixed.HTML_ENTITIES.items() for x in kv])
    hexed = F.when(code.startswith("#x"), F.regexp_extract(code, "^#x([0-9a-f]+)", 1)).otherwise(
        F.hex(F.regexp_extract(code, r"^#(\d+)", 1).try_cast("bigint"))
    )
    padded = F.lpad(F.regexp_replace(hexed, "^0+(?=.)", ""), 8, "0")
    valid = (F.length(hexed) > 0) & (F.length(F.regexp_replace(hexed, "^0+(?=.)", "")) <= 6) & (
        padded <= "0010FFFF"
    )
    numeric = F.when(
        code.startswith("#") & valid,
        F.decode(F.unhex(F.upper(padded)), "UTF-32"),
    )
    return F.coalesce(F.try_element_at(known, code), numeric, entity)


def decode_entities(value) -> Column:
    """Replace entities in one pass, then collapse white space."""
    c = F.coalesce(as_col(value), F.lit(""))
    between = F.split(c, ENTITY, -1)
    entities = F.transform(F.regexp_extract_all(c, F.lit(f"({ENTITY})"), F.lit(1)), _one_entity)
    joined = F.zip_with(
        between, entities, lambda t, e: F.concat(t, F.coalesce(e, F.lit("")))
    )
    return F.trim(F.regexp_replace(F.array_join(joined, ""), "[\\s\\u00a0]+", " "))


# Everything of a page that is not running text: style and script blocks, tags,
# and an opening bracket that is never closed.
MARKUP = (
    r"(?i)<style(?![A-Za-z0-9_])[^>]*>[\s\S]*?</style>"
    r"|<script(?![A-Za-z0-9_])[^>]*>[\s\S]*?</script>|<[^>]*>|<[^>]*$"
)


def page_text(html) -> Column:
    """The running text of a page, joined as it stands."""
    return F.regexp_replace(as_col(html), MARKUP, "")


def _clean(text: Column) -> Column:
    single = {c: new for chars, new in fixed.CLEANED_CHARACTERS.values() for c in chars}
    one_to_one = {c: new for c, new in single.items() if len(new) <= 1}
    kept = [c for c, new in one_to_one.items() if new]
    gone = [c for c, new in one_to_one.items() if not new]
    out = F.translate(text, "".join(kept + gone), "".join(one_to_one[c] for c in kept))
    for c, new in single.items():
        if len(new) > 1:
            out = F.replace(out, F.lit(c), F.lit(new))
    return out


def ats_normalize(html) -> Column:
    """The page with typographic characters of its text made plain; markup is kept."""
    c = as_col(html)
    between = F.transform(F.split(c, MARKUP, -1), _clean)
    markup = F.regexp_extract_all(c, F.lit(f"({MARKUP})"), F.lit(1))
    joined = F.zip_with(between, markup, lambda t, m: F.concat(t, F.coalesce(m, F.lit(""))))
    return F.array_join(joined, "")


def ats_counts(html) -> dict[str, Column]:
    """How many characters of each class ``ats_normalize`` replaces."""
    text = page_text(html)
    return {
        name: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")
        for name, (chars, _) in fixed.CLEANED_CHARACTERS.items()
    }
