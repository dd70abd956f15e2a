"""Pipe-separated text: inbox lines, tracker tables, incoming evaluations.

The operators work on tables of lines, so one long file is as splittable as many
short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.functions.classify import literal_map, write_status
from oppflow.functions.text import (
    as_col, bind, drop_first, first_filled, found, is_iso_date, parse_int, parse_score, report_link_for_write,
    report_num, split_row,
)

# The markers of an inbox line, and the line under a table head.
MARKER = r"^(?:tier [SABC]|posted \d{4}-\d{2}-\d{2}|title-generic)$"
SEPARATOR_ROW = r"^\|[\s:|-]+\|?\s*$"


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """``(file, line_no, line)`` of text files, numbered without reading a file whole or moving text.

    A block of a file is read by one task in order, so a line's number is its place in its
    block plus the lines of the blocks before.  Only one row per block is exchanged.
    """
    raw = spark.read.text(paths).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    blocks = raw.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return raw.join(F.broadcast(starts), ["file", "_block"]).select(
        "file", (F.col("_id") + F.col("_shift") + 1).alias("line_no"), "line"
    )


#: So many line numbers of a file meet its header together.
HEADER_RUN = 1 << 16


def with_header(rows: DataFrame, header: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` of ``(file, line_no, ...)`` joined with what ``header`` says of their file.

    A file's lines meet its header in runs of line numbers, each run with a copy of the header's rows, so
    that the lines of one long file are dealt out over the tasks.
    """
    run = F.coalesce(F.floor(F.col("line_no") / HEADER_RUN), F.lit(0)).alias("_run")
    runs = rows.select("file", run).distinct().join(header, "file")
    return rows.select("*", run).join(runs, ["file", "_run"], how).drop("_run")


def read_inbox_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Inbox entries out of ``- [ ] url | company | title | location | markers``.

    Markers count wherever they stand after the title; fields left over belong to
    the title, which an unescaped separator most often splits.
    """
    text = F.trim(as_col(line))
    cells = split_row(text)
    df = lines.filter(text.startswith("- [")).withColumn("_cells", cells)
    df = df.withColumn("url", found(F.col("_cells")[0], r"(https?://\S+)"))
    df = df.filter("url IS NOT NULL AND size(_cells) >= 3")
    tail = drop_first("_cells", 3)
    markers = F.filter(tail, lambda c: c.rlike(MARKER))
    plain = F.filter(tail, lambda c: ~c.rlike(MARKER))
    df = df.withColumns({"_markers": markers, "_plain": plain})

    def marker(prefix):
        hit = F.filter("_markers", lambda m: m.startswith(prefix))
        return F.replace(F.try_element_at(hit, F.lit(1)), F.lit(prefix), F.lit(""))

    extra = F.size("_plain")
    title = F.concat(
        F.array(F.col("_cells")[2]), F.slice("_plain", 1, F.greatest(extra - 1, F.lit(0)))
    )
    return df.select(
        *[c for c in lines.columns if c != line], "url",
        F.col("_cells")[1].alias("company"), F.array_join(title, " | ").alias("title"),
        F.when(extra > 0, F.try_element_at("_plain", F.lit(-1))).otherwise(F.lit("")).alias("location"),
        marker("tier ").alias("tier"), F.try_to_date(marker("posted ")).alias("posted"),
        F.array_contains("_markers", "title-generic").alias("title_generic"),
    )


def inbox_line(url="url", company="company", title="title", location="location", tier="tier",
               posted="posted", title_generic="title_generic") -> Column:
    """The line an inbox entry is written as; the reader takes it apart again."""
    def cell(value):
        return F.replace(as_col(value), F.lit("|"), F.lit("\\|"))

    parts = F.array_compact(F.array(
        as_col(url), cell(company), cell(title),
        F.nullif(cell(location), F.lit("")),
        F.concat(F.lit("tier "), as_col(tier)),
        F.concat(F.lit("posted "), as_col(posted).cast("string")),
        F.when(as_col(title_generic), F.lit("title-generic")),
    ))
    return F.concat(F.lit("- [ ] "), F.array_join(parts, " | "))


# --- tracker tables ------------------------------------------------------------
def is_separator(line) -> Column:
    return as_col(line).rlike(SEPARATOR_ROW)


def header_fields(cells: Column) -> Column:
    """Field name of every header cell; NULL for an unknown label or a repeat."""
    labels = F.transform(
        cells,
        lambda c: F.regexp_replace(F.lower(F.trim(F.replace(c, F.lit("**"), F.lit("")))), "[^a-z#]", ""),
    )
    names = F.transform(labels, lambda x: F.try_element_at(literal_map(fixed.HEADER_FIELDS), x))
    return bind(names, lambda all_names: F.transform(
        all_names, lambda n, i: F.when(F.array_position(all_names, n) == i + 1, n)
    ))


HEADER_WORDS = r"(?i)(?:status|estado)"


def read_tracker(lines: DataFrame) -> DataFrame:
    """Tracker rows out of ``(file, line_no, line)``.

    The columns come from the file's own header, the pipe row right above the
    separator; a file without one is read by the shape of each row.  A line counts
    as a row when its date cell holds a date.
    """
    pipes = lines.filter(F.col("line").startswith("|"))
    data = pipes.filter(~is_separator("line")).select("file", "line_no", split_row("line").alias("cells"))
    # A header and the rule below it meet under the header's line number, so finding
    # it takes one pass over the few lines that look like either.
    rule = is_separator("line")
    named = header_fields(split_row("line"))
    slots = pipes.filter(rule | F.col("line").rlike(HEADER_WORDS)).select(
        "file", F.when(rule, F.col("line_no") - 1).otherwise(F.col("line_no")).alias("slot"),
        F.when(~rule, named).alias("fields"),
    )
    header = (
        slots.groupBy("file", "slot")
        .agg(F.max("fields").alias("fields"), F.count(F.lit(1)).alias("lines"))
        .filter((F.col("lines") == 2) & F.array_contains("fields", "status")
                & F.array_contains("fields", "company"))
        .groupBy("file").agg(F.min_by("fields", "slot").alias("fields"))
    )
    joined = with_header(data, header, "left")

    def cell(i):
        return F.get("cells", F.lit(i))

    def layout(columns):
        return F.array(F.lit(None).cast("string"), *map(F.lit, columns))

    score_cell = F.coalesce(cell(4).rlike(r"^\*{0,2}\d+(?:\.\d+)?/5\*{0,2}$"), F.lit(False))
    by_shape = F.when(is_iso_date(cell(1)) & score_cell, layout(fixed.CANONICAL_COLUMNS)).when(
        parse_int(cell(1)).isNotNull() & is_iso_date(cell(2)), layout(fixed.LEGACY_COLUMNS)
    )
    wanted = list(dict.fromkeys(fixed.HEADER_FIELDS.values()))
    place = {f: i for i, f in enumerate(wanted)}

    # All wanted cells of a row as one array, so the columns are looked up once.
    def pick(fields: Column) -> Column:
        return F.transform(
            F.array(*map(F.lit, wanted)),
            lambda f: F.coalesce(
                F.get("cells", (F.array_position(fields, f) - 1).cast("int")), F.lit("")
            ),
        )

    def dated(values: Column) -> Column:
        return F.when(is_iso_date(values[place["date"]]), values)

    record = bind(F.coalesce("fields", by_shape), lambda fields: F.when(
        fields.isNotNull(), bind(pick(fields), dated)
    ))
    rows = joined.select("file", "line_no", F.explode(F.array_compact(F.array(record))).alias("v"))
    at = {f: F.col("v")[i] for f, i in place.items()}
    score = first_filled(at["fit"], at["score"])
    zero = F.lit(0).cast("bigint")
    number = F.coalesce(F.nullif(parse_int(at["num"]), zero), F.nullif(report_num(at["report"]), zero))
    return rows.select(
        "file", F.col("line_no").alias("pos"), number.alias("num"),
        F.try_to_date(F.trim(at["date"])).alias("date"), at["company"].alias("company"),
        at["role"].alias("role"), parse_score(score).alias("fit"),
        parse_score(at["odds"]).alias("odds"), parse_score(at["priority"]).alias("priority"),
        parse_score(score).alias("score"), score.alias("score_raw"),
        *[at[f].alias(f) for f in ("status", "output", "report", "location", "notes", "url")],
    )


def read_tracker_all(live: DataFrame, archive: DataFrame) -> DataFrame:
    """Rows of both tracker halves with ``archived`` and the file they come from."""
    return read_tracker(live).withColumn("archived", F.lit(False)).unionByName(
        read_tracker(archive).withColumn("archived", F.lit(True))
    )


# --- incoming evaluations ------------------------------------------------------
def read_additions(files: DataFrame):
    """``(additions, rejects)`` out of ``(file, content)``, one evaluation per file.

    A pipe row, the 13-column form and the 8/9-column legacy form are told apart by
    their shape; in the legacy form status and score may be swapped.
    """
    content = F.trim(F.regexp_replace("content", r"^\s+|\s+$", ""))
    piped = content.startswith("|")
    pipe_cells = F.filter(split_row(content), lambda c: c != "")
    tab_cells = F.transform(F.split(content, "\t"), lambda c: F.trim(c))
    df = files.withColumns({
        "_piped": piped, "_p": F.when(piped, pipe_cells).otherwise(tab_cells), "_empty": content == "",
    })

    def cell(i):
        return F.get("_p", F.lit(i))

    def or_dash(i):
        return F.coalesce(F.nullif(cell(i), F.lit("")), F.lit("-"))

    def is_score(c):
        return F.coalesce(c.rlike(r"^\d+\.?\d*/5$") | (c == "N/A"), F.lit(False))

    def is_status(c):
        return F.coalesce(
            F.lower(c).rlike("^(?:" + "|".join(fixed.LEGACY_STATUS_STARTS) + ")"), F.lit(False)
        )

    full = F.col("_piped") | (
        (F.size("_p") >= 13) & is_score(cell(4)) & is_score(cell(5)) & is_score(cell(6))
    )
    swapped = is_score(cell(4)) & is_status(cell(5)) & ~(is_status(cell(4)) & ~is_score(cell(4)))
    old_status = F.when(swapped, cell(5)).otherwise(cell(4))
    old_score = F.when(swapped, cell(4)).otherwise(cell(5))
    number = F.nullif(parse_int(cell(0)), F.lit(0).cast("bigint"))
    parsed = df.withColumns({
        "num": number,
        "reason": F.when(F.col("_empty"), F.lit("empty"))
        .when(F.size("_p") < 8, F.concat(F.size("_p").cast("string"), F.lit(" fields")))
        .when(number.isNull(), F.lit("invalid entry number")),
    })
    digits = F.regexp_replace("file", r"\D", "").try_cast("bigint")
    good = parsed.filter("reason IS NULL").select(
        "file", F.coalesce(digits, F.lit(0).cast("bigint")).alias("file_no"), "num",
        F.try_to_date(cell(1)).alias("date"), cell(2).alias("company"), cell(3).alias("role"),
        F.when(full, cell(4)).otherwise(old_score).alias("fit"),
        F.when(full, cell(5)).otherwise(F.lit("-")).alias("odds"),
        F.when(full, cell(6)).otherwise(old_score).alias("priority"),
        write_status(F.when(full, cell(7)).otherwise(old_status)).alias("status"),
        F.when(full, or_dash(8)).otherwise(or_dash(6)).alias("output"),
        report_link_for_write(F.when(full, cell(9)).otherwise(cell(7))).alias("report"),
        F.when(full, or_dash(10)).otherwise(F.lit("-")).alias("location"),
        F.coalesce(F.when(full, cell(11)).otherwise(cell(8)), F.lit("")).alias("notes"),
        F.when(full, or_dash(12)).otherwise(F.lit("-")).alias("url"),
    )
    bad = parsed.filter("reason IS NOT NULL").select(
        "file", F.coalesce(digits, F.lit(0).cast("bigint")).alias("file_no"), "reason"
    )
    return good, bad


# --- batch notes ---------------------------------------------------------------
def read_batch_items(items: DataFrame) -> DataFrame:
    """Batch input with the real URL, company and role its notes carry.

    Notes read ``Role @ Company | Match% | URL``; the URL after the last bar wins
    over the item's own.
    """
    notes = F.coalesce("notes", F.lit(""))
    last = F.trim(F.call_function("substring_index", notes, F.lit("| "), F.lit(-1)))
    in_notes = F.when(F.contains(notes, F.lit("| ")) & last.startswith("http"), last)
    own = F.when(F.col("url").startswith("http"), F.col("url"))
    head = F.call_function("substring_index", notes, F.lit(" | "), F.lit(1))
    has_at = F.contains(head, F.lit(" @ "))
    company = F.call_function("substring_index", head, F.lit(" @ "), F.lit(-1))
    role = F.left(head, F.length(head) - F.length(company) - F.lit(3))
    return items.withColumns({
        "job_url": F.coalesce(in_notes, own),
        "company": F.when(has_at, F.trim(company)),
        "role": F.when(has_at, F.trim(role)),
    })
