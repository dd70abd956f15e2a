"""Small text tables: scan history, outcomes, follow-ups, exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oppflow.functions.text import blank_to_null, parse_int, split_row
from oppflow.sources.lines import read_lines, with_header


def _header_mapped(lines: DataFrame, fields: dict[str, list[str]], comment: str | None) -> DataFrame:
    """Tab-separated lines with columns found by header name, whatever their order."""
    text = lines.filter(F.trim("line") != "")
    if comment:
        text = text.filter(~F.col("line").startswith(comment))
    cells = text.withColumn("cells", F.transform(F.split("line", "\t"), lambda c: F.trim(c)))
    labels = [a for names in fields.values() for a in names]
    header = (
        cells.groupBy("file").agg(F.min("line_no").alias("line_no"))
        .join(cells, ["file", "line_no"])
        .select("file", F.col("line_no").alias("_first"),
                F.transform("cells", lambda c: F.lower(c)).alias("header"))
        .filter(F.arrays_overlap("header", F.array(*map(F.lit, labels))))
    )
    rows = with_header(cells, header).filter("line_no > _first")

    def at(names):
        places = [F.nullif(F.array_position("header", F.lit(n)), F.lit(0).cast("bigint")) for n in names]
        place = F.coalesce(*places)
        return blank_to_null(F.get("cells", (place - 1).cast("int")))

    return rows.select("file", F.col("line_no").alias("pos"),
                       *[at(names).alias(f) for f, names in fields.items()])


def parse_history(lines: DataFrame) -> DataFrame:
    df = _header_mapped(lines, {
        "url": ["url"], "first_seen": ["first_seen"], "source": ["source", "portal"],
        "title": ["title"], "company": ["company"], "status": ["status"],
    }, None)
    return df.filter("url IS NOT NULL").withColumn("first_seen", F.try_to_date("first_seen"))


def parse_outcomes(lines: DataFrame) -> DataFrame:
    df = _header_mapped(lines, {
        f: [f] for f in ("report", "company", "date", "first_contact", "stages_passed",
                         "furthest_stage", "outcome", "reason")
    }, "#")
    return df.filter("company IS NOT NULL").withColumns({
        "report": F.nullif(parse_int("report"), F.lit(0).cast("bigint")),
        "date": F.try_to_date("date"),
        "stages_passed": F.coalesce(parse_int("stages_passed"), F.lit(0).cast("bigint")),
    })


def _pipe_rows(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("line").startswith("|")).select(
        "file", F.col("line_no").alias("pos"), split_row("line").alias("c")
    )


def parse_followups(lines: DataFrame) -> DataFrame:
    rows = _pipe_rows(lines).filter(F.size("c") >= 8)
    names = ["company", "role", "channel", "contact", "notes"]
    return rows.withColumn("num", parse_int(F.col("c")[1])).filter("num IS NOT NULL").select(
        "file", "pos", "num", parse_int(F.col("c")[2]).alias("app_num"),
        F.try_to_date(F.col("c")[3]).alias("date"),
        *[F.coalesce(F.get("c", F.lit(i + 4)), F.lit("")).alias(n) for i, n in enumerate(names)],
    )


def parse_exclusions(lines: DataFrame) -> DataFrame:
    rows = _pipe_rows(lines).filter(F.size("c") >= 5).select(
        "file", "pos", F.col("c")[1].alias("date"), F.col("c")[2].alias("company"),
        F.col("c")[3].alias("role"), F.col("c")[4].alias("reason"),
    )
    return rows.filter(
        (F.col("company") != "") & (F.lower("company") != "company") & ~F.col("company").rlike("^-+$")
    ).withColumn("date", F.try_to_date("date"))


def read_history(spark: SparkSession, path) -> DataFrame:
    return parse_history(read_lines(spark, path))


def read_outcomes(spark: SparkSession, path) -> DataFrame:
    return parse_outcomes(read_lines(spark, path))


def read_followups(spark: SparkSession, path) -> DataFrame:
    return parse_followups(read_lines(spark, path))


def read_exclusions(spark: SparkSession, path) -> DataFrame:
    return parse_exclusions(read_lines(spark, path))
