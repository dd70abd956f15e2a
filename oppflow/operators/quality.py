"""Data-quality checks over the tracker, its files and its dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.functions.classify import (
    ALIAS_TO_STATUS, STATUS_TO_SYMBOL, normalize_status, repaired_status,
)
from oppflow.functions.text import company_key, report_path, split_row, strip_bold
from oppflow.sources.lines import is_separator, with_header


def exact_duplicates(apps: DataFrame) -> DataFrame:
    """Every row whose company and role occur more than once, with the count.

    The rows stay rows: a role copied a million times is a million result rows on
    many tasks, not one list.
    """
    role = F.regexp_replace(F.lower("role"), "[^a-z0-9 ]", "")
    keyed = apps.select(
        "pos", F.concat_ws("::", company_key("company"), role).alias("duplicate_key")
    )
    copies = keyed.groupBy("duplicate_key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("pos").alias("first_pos")
    ).filter("copies > 1")
    return keyed.join(copies, "duplicate_key")


def broken_links(apps: DataFrame, files: DataFrame, folder: str = "data") -> DataFrame:
    """Rows whose report link points at no file; ``files`` is a listing (``path``)."""
    linked = apps.withColumn("target", report_path("report", F.lit(folder))).filter(
        "target IS NOT NULL"
    )
    return linked.join(files.select(F.col("path").alias("target")), "target", "left_anti")


def status_coverage(apps: DataFrame, statuses: list[str] | None = None,
                    grouped: list[str] | None = None) -> DataFrame:
    """Status ids in use that the dimension or the queue groups do not know."""
    statuses = statuses or list(STATUS_TO_SYMBOL)
    grouped = grouped or [s for _, ids, _ in fixed.QUEUE_GROUPS for s in ids]
    used = apps.select(normalize_status("status").alias("status_id")).distinct()
    return used.select(
        "status_id", F.col("status_id").isin(statuses).alias("in_dimension"),
        F.col("status_id").isin(grouped).alias("in_groups"),
    ).filter("NOT in_dimension OR NOT in_groups")


def repair_status(apps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(fixed, unknown)``: canonical status cells, and those nobody can read.

    What a duplicate or repost cell said moves to the front of the notes; unknown
    cells are listed and left alone.
    """
    df = apps.withColumn("_r", repaired_status("status"))
    note, notes = F.col("_r.note"), F.coalesce("notes", F.lit(""))
    moved = (
        F.when(note.isNull() | F.contains(notes, note), F.col("notes"))
        .when(notes == "", note).otherwise(F.concat_ws(". ", note, notes))
    )
    changed = F.col("_r.known") & (F.col("_r.cell") != F.coalesce("status", F.lit("")))
    result = df.withColumns({
        "changed": changed,
        "status": F.when(changed, F.col("_r.cell")).otherwise(F.col("status")),
        "notes": F.when(changed, moved).otherwise(F.col("notes")),
    }).drop("_r")
    unknown = df.filter("NOT _r.known").select("pos", F.col("status").alias("raw_status"))
    return result, unknown


def is_score_text(c: Column) -> Column:
    return F.coalesce(F.trim(strip_bold(c)).rlike(r"^\d+\.?\d*/5$"), F.lit(False))


SENT_CELLS = [s for i, s, _ in fixed.STATUSES if i in ("applied", "responded", "interview", "offer", "ignored")]
SENT_WORDS = ["applied", "responded", "interview", "offer", "ignored"]


def entry_checks(entries: DataFrame) -> DataFrame:
    """Row checks in one scan: each row yields the list of what is wrong with it.

    ``entries`` holds the raw cells: pos, company, role, fit, odds, priority,
    status, output.
    """
    status = F.coalesce("status", F.lit(""))
    clean = F.trim(F.regexp_replace(F.lower(F.trim(strip_bold(status))), r"\s+\d{4}-\d{2}-\d{2}.*$", ""))
    known = [*STATUS_TO_SYMBOL, *STATUS_TO_SYMBOL.values(), *ALIAS_TO_STATUS]

    def bare(c):
        return F.trim(strip_bold(F.col(c)))

    def issue(test, check, severity, message):
        return F.when(test, F.struct(
            F.lit(check).alias("check"), F.lit(severity).alias("severity"), message.alias("message")
        ))

    def bad_score(c, others):
        return ~is_score_text(F.col(c)) & ~bare(c).isin(others)

    bold = [F.contains(F.coalesce(c, F.lit("")), F.lit("**")) for c in ("priority", "fit", "odds")]
    output = F.trim(F.coalesce("output", F.lit("")))
    issues = F.array_compact(F.array(
        issue(~clean.isin(sorted(set(known))), "status not canonical", "error", status),
        issue(F.contains(status, F.lit("**")), "bold in status", "error", status),
        issue(status.rlike(r"\d{4}-\d{2}-\d{2}"), "date in status", "error", status),
        issue(bad_score("priority", ["N/A", "DUP"]), "priority format", "error", F.col("priority")),
        issue(bad_score("fit", ["-", "N/A"]), "fit format", "error", F.col("fit")),
        issue(bad_score("odds", ["-", "N/A"]), "odds format", "error", F.col("odds")),
        issue(bold[0] | bold[1] | bold[2], "bold in score", "warning",
              F.concat_ws(" / ", "priority", "fit", "odds")),
        issue((status.isin(SENT_CELLS) | F.lower(F.trim(status)).isin(SENT_WORDS))
              & output.isin("", "-"),
              "sent without output", "warning", F.concat_ws(" — ", "company", "role")),
    ))
    return entries.select(F.col("pos").cast("string").alias("key"), F.explode(issues).alias("i")).select(
        "i.check", "i.severity", "key", "i.message"
    )


def row_format(lines: DataFrame) -> DataFrame:
    """Table rows without a closing pipe or with another width than their header."""
    rows = lines.filter(F.col("line").startswith("|") & ~is_separator("line")).withColumn(
        "cells", split_row("line")
    )
    is_header = F.lower(F.get("cells", F.lit(1))).isin("date", "fecha", "#", "num") & (F.size("cells") > 2)
    header = rows.filter(is_header).groupBy("file").agg(
        (F.min_by(F.size("cells"), "line_no") - 2).alias("expected")
    )
    data = with_header(rows.filter(~F.coalesce(is_header, F.lit(False))), header)
    width = F.size("cells") - 2
    message = F.when(
        F.element_at("cells", -1) != "", F.lit("row is missing its closing pipe")
    ).when(
        width != F.col("expected"),
        F.concat(F.lit("row has "), width.cast("string"), F.lit(" columns, expected "),
                 F.col("expected").cast("string")),
    )
    return data.select(
        F.lit("row format").alias("check"), F.lit("error").alias("severity"),
        F.concat_ws(":", "file", F.col("line_no").cast("string")).alias("key"),
        message.alias("message"),
    ).filter("message IS NOT NULL")


def integrity_report(entries: DataFrame, lines: DataFrame, files: DataFrame,
                     pending: DataFrame) -> DataFrame:
    """All checks as ``(check, severity, key, message)`` rows."""
    duplicates = exact_duplicates(entries).groupBy("duplicate_key").agg(
        F.max("copies").alias("copies"), F.min("first_pos").alias("first_pos")
    ).select(
        F.lit("possible duplicate").alias("check"), F.lit("warning").alias("severity"),
        F.col("first_pos").cast("string").alias("key"),
        F.concat(F.col("copies").cast("string"), F.lit(" rows: "), F.col("duplicate_key")).alias("message"),
    )
    links = broken_links(entries, files).select(
        F.lit("report not found").alias("check"), F.lit("error").alias("severity"),
        F.col("pos").cast("string").alias("key"), F.col("target").alias("message"),
    )
    waiting = pending.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(
        F.lit("pending additions").alias("check"), F.lit("warning").alias("severity"),
        F.lit("").alias("key"), F.col("n").cast("string").alias("message"),
    )
    out = entry_checks(entries)
    for part in (duplicates, links, row_format(lines), waiting):
        out = out.unionByName(part)
    return out
