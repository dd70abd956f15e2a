"""Evaluation reports: facts out of Markdown, in English or Spanish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.functions.text import as_col, clean_cell, found, split_row, strip_bold

# Fixed value: the gap table of a report.
GAP_TABLE = r"(?i)\|\s*Gap\s*\|\s*Severity\s*\|.*?\n\|[-|\s]+\n([\s\S]*?)(?:\n\n|\n##|\n\*\*|$)"


def _cell(text: Column, labels: list[str], value: str = r"(.*?)") -> Column:
    options = "|".join(labels)
    return F.trim(found(text, rf"(?i)\|\s*(?:{options})\s*\|\s*{value}\s*\|"))


def report_fields(text) -> dict[str, Column]:
    plain = strip_bold(text)
    return {name: _cell(plain, labels) for name, labels in fixed.REPORT_FIELDS.items()}


def report_scores(text) -> dict[str, Column]:
    plain = strip_bold(text)
    scores = {
        name: _cell(plain, labels, r"([\d.]+)/5").try_cast("double")
        for name, labels in fixed.REPORT_SCORES.items()
    }
    scores["red_flags"] = _cell(plain, ["Red flags"], r"([-+]?[\d.]+)").try_cast("double")
    return scores


def report_gaps(text) -> Column:
    """The gap table as an array of (description, severity, mitigation)."""
    block = F.regexp_extract(as_col(text), GAP_TABLE, 1)
    rows = F.filter(F.split(block, "\n"), lambda r: r.startswith("|"))
    cells = F.transform(rows, lambda r: F.filter(split_row(r), lambda c: c != ""))
    return F.transform(
        F.filter(cells, lambda c: F.size(c) >= 2),
        lambda c: F.struct(
            c[0].alias("description"), F.lower(c[1]).alias("severity"),
            F.coalesce(F.get(c, F.lit(2)), F.lit("")).alias("mitigation"),
        ),
    )


def parse_reports(reports: DataFrame, text: str = "text") -> DataFrame:
    """Six header fields, six scores and the gaps of every report."""
    keep = [c for c in reports.columns if c != text]
    facts = {**report_fields(text), **report_scores(text), "gaps": report_gaps(text)}
    return reports.select(*keep, *[c.alias(n) for n, c in facts.items()])


def report_summary(text) -> dict[str, Column]:
    """The four cells shown in lists; the longest is cut to 120 characters."""
    c = as_col(text)
    tldr = F.coalesce(found(c, r"(?i)\*\*TL;DR\*\*\s*\|\s*(.+)"), found(c, r"(?i)\*\*TL;DR:\*\*\s*(.+)"))
    tldr = clean_cell(tldr)
    archetype = F.coalesce(
        found(c, r"(?i)\*\*Arquetipo(?:\s+detectado)?\*\*\s*\|\s*(.+)"),
        found(c, r"(?i)\*\*Arquetipo:\*\*\s*(.+)"),
    )
    return {
        "archetype": clean_cell(archetype),
        "tldr": F.when(F.length(tldr) > 120, F.concat(F.left(tldr, F.lit(117)), F.lit("..."))).otherwise(tldr),
        "remote": clean_cell(found(c, r"(?i)\*\*Remote\*\*\s*\|\s*(.+)")),
        "comp": clean_cell(found(c, r"(?i)\*\*Comp\*\*\s*\|\s*(.+)")),
    }


def report_header_links(text, first_chars: int | None = None) -> dict[str, Column]:
    """URL and batch id from a report's header, the text up to its first table.

    ``first_chars`` looks no further than that; without it the header has any length.
    """
    c = as_col(text)
    head = F.left(c, F.lit(first_chars)) if first_chars else F.try_element_at(
        F.split(c, r"(?m)^\|", 2), F.lit(1)
    )
    return {
        "report_url": found(head, r"(?m)^\*\*URL:\*\*\s*(https?://\S+)"),
        "batch_id": found(head, r"(?m)^\*\*Batch ID:\*\*\s*(\d+)").try_cast("bigint"),
    }
