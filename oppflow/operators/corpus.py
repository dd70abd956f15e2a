"""Rule scans over whole texts: each job is one pass without a shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.functions.regex import BOUND, WORD
from oppflow.functions.text import blank_to_null, drop_first

# The date ranges whose dash is no dash of the text.
MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DAY = rf"(?:{MONTHS}\s+)?\d{{4}}"
# A month before the first year stays as it is, so the pattern begins at the year and passes over most places at once.
DATE_RANGE = rf"(\d{{4}})\s*[–—]\s*({DAY}|Present|present)"
SAMPLE = 80

LEADING_DIGITS = re.compile(r"(\(\?i\))?\\b\\d\{([1-9]\d*),(\d*)\}")


def ascii_bounds(pattern: str) -> str:
    """A rule's word boundaries, made ASCII; one that opens the rule looks back only.

    A rule that opens with digits looks back from its first digit, so that other places cost no look.
    """
    if digits := LEADING_DIGITS.match(pattern):
        flag, least, most = digits.groups()
        more = f"{int(least) - 1},{int(most) - 1 if most else ''}"
        pattern = f"{flag or ''}\\d(?<!{WORD}\\d)\\d{{{more}}}" + pattern[digits.end():]
    for opening in (r"(?i)\b", r"\b"):
        if pattern.startswith(opening):
            pattern = pattern.replace(opening, opening[:-2] + f"(?<!{WORD})(?={WORD})", 1)
            break
    return pattern.replace(r"\b", BOUND)


def dash_text(text: Column) -> Column:
    """The text with date ranges and inline code taken out of the dash rule."""
    ranges = F.regexp_replace(text, DATE_RANGE, "$1-$2")
    return F.when(F.contains(text, F.lit("`")), F.regexp_replace(ranges, r"`[^`\n]*`", "``")).otherwise(ranges)


def has_dash(text: Column) -> Column:
    return F.contains(text, F.lit("—")) | F.contains(text, F.lit("–"))


def missing_subtitles(text: Column) -> Column:
    """Employers in the experience section whose block has no ``Product:`` line."""
    sections = F.split(text, r"(?m)^## ")
    experience = F.try_element_at(
        F.filter(sections, lambda s: s.rlike("^(?i)(?:Work )?Experience")), F.lit(1)
    )
    blocks = drop_first(F.split(F.coalesce(experience, F.lit("")), r"(?m)^### "), 1)

    def first_line(b):
        return F.call_function("substring_index", b, F.lit("\n"), F.lit(1))

    jobs = F.filter(
        blocks,
        lambda b: F.contains(first_line(b), F.lit("|")) & ~b.rlike(r"(?m)^[_*]{0,2}Product:"),
    )
    return F.transform(
        jobs,
        lambda b: F.left(F.trim(F.call_function("substring_index", first_line(b), F.lit("|"), F.lit(1))), F.lit(40)),
    )


#: The rule about the title that a résumé claims; a letter may name the role it is written for.
TITLE_RULE = "TITLE_WITH_PRODUCT"


def looks_ahead(pattern: str) -> str:
    """A rule ``(?i)(?:word|…)``, with ``\\b`` before the words or not, that compares them only where four letters
    are among the first, second, third and fourth ones of the words."""
    opening, words = re.match(r"\(\?i\)(\\b)?\(\?:([^()]*)\)", pattern).groups()
    letters = zip(*[w[:4].lower() for w in words.split("|")], strict=True)
    ahead = "".join(f"[{''.join(sorted(set(x)))}]" for x in letters)
    rest = pattern.removeprefix("(?i)" + (opening or ""))
    return f"(?i)(?={ahead})" + (f"(?<!{WORD})" if opening else "") + rest


_RULES = dict(fixed.LINT_RULES)
#: By pattern: a text that all its findings hold, or None, and a pattern with the same first finding that is faster to search for.
FORMS = {
    _RULES["CLICHE_VERBS"]: (None, looks_ahead(_RULES["CLICHE_VERBS"])),
    _RULES["OVERSELL_CLOSER"]: (None, looks_ahead(_RULES["OVERSELL_CLOSER"])),
    _RULES["EMDASH_CONTINUATION"]: ("--", _RULES["EMDASH_CONTINUATION"]),
}


def lint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   rules: list | None = None, name: str | None = None, forms: dict | None = None) -> DataFrame:
    """``(key, label, sample)`` for every rule a text breaks, with the first finding.

    ``name`` is a column with the document's file name, which tells its kind: the dash and
    subtitle rules are about Markdown and pass over HTML, the title rule passes over cover
    letters.  Without a name every rule applies.  ``forms`` adds to ``FORMS`` for rules of the caller's.
    """
    c = F.col(text)
    named = F.lower(F.coalesce(F.col(name), F.lit(""))) if name else F.lit("")
    markdown = ~named.endswith(".html")
    letter = F.contains(named, F.lit("cover letter"))
    forms = FORMS | (forms or {})

    def first(label, pattern):
        held, form = forms.get(pattern, (None, pattern))
        finding = F.left(F.regexp_extract(c, ascii_bounds(form), 0), F.lit(SAMPLE))
        if label == TITLE_RULE:
            finding = F.when(~letter, finding)
        return finding if held is None else F.when(F.contains(c, F.lit(held)), finding)

    # Samples are columns of a step of their own, where each is worked out once.
    plain = F.col("_plain")
    samples = [(label, first(label, pattern)) for label, pattern in (rules or fixed.LINT_RULES)]
    samples.append(("DASH_IN_MD", F.when(has_dash(plain), F.left(plain, F.lit(SAMPLE)))))
    subtitles = F.transform(
        F.when(markdown & F.contains(c, F.lit("### ")), missing_subtitles(c)).otherwise(
            F.array().cast("array<string>")),
        lambda s: F.struct(F.lit("MISSING_PRODUCT_SUBTITLE").alias("label"), s.alias("sample")),
    )
    found = docs.withColumn("_plain", F.when(markdown & has_dash(c), dash_text(c))).select(
        key,
        F.array(*[F.struct(F.lit(label).alias("label"), s.alias("sample")) for label, s in samples]).alias("_found"),
        subtitles.alias("_subtitles"),
    )
    broken = F.filter("_found", lambda f: f["sample"] != "")
    return found.select(key, F.explode(F.concat(broken, "_subtitles")).alias("f")).select(
        key, "f.label", "f.sample"
    )


def numbered_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).select(
        key, (F.col("n") + 1).cast("bigint").alias("line_no"), "line"
    )


def scan_metrics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines that hold a number looking like a hard-coded metric, with the first one."""
    lines = numbered_lines(docs, key, text)
    skipped = F.col("line").startswith("#") | F.col("line").startswith("<!--")
    for phrase in fixed.METRIC_SKIP_PHRASES:
        skipped = skipped | F.contains("line", F.lit(phrase))
    metric = blank_to_null(F.regexp_extract("line", ascii_bounds(fixed.METRIC_PATTERN), 0))
    return lines.filter(~skipped).select(key, "line_no", metric.alias("metric")).filter(
        "metric IS NOT NULL"
    )


def scan_literals(docs: DataFrame, patterns: list[str], allow: list[str] = (),
                  key: str = "doc_id", text: str = "text", name: str = "source") -> DataFrame:
    """Lines that hold one of the literal patterns, except in allowed sources."""
    checked = docs
    for allowed in allow:
        checked = checked.filter(~F.contains(F.coalesce(name, F.lit("")), F.lit(allowed)))
    lines = numbered_lines(checked, key, text)
    hits = F.filter(F.array(*map(F.lit, patterns)), lambda p: F.contains(F.col("line"), p))
    return lines.select(key, "line_no", F.explode(hits).alias("pattern"))
