"""Screening the inbox: verdicts, one row per opening, draining, review order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.functions.classify import detect_lanes, is_agency, literal_map, title_flags
from oppflow.functions.text import as_col, opening_key, truncate
from oppflow.operators.ranks import desc, top_per_key, with_rank
from oppflow.operators.seen import (
    exclusion_match, mark_company, posting_history, tracked_by_url,
)

VERDICTS = ["promising", "maybe", "unknown", "skip"]
# --- fixed values: how a stored status reads in a sentence ---------------------
STATUS_WORDS = {
    "❌": "rejected", "🚫": "discarded", "⏭️": "marked SKIP", "👻": "no reply",
    "🎯": "interviewing", "💰": "offer", "✅": "applied", "📬": "responded",
}
SHORTLIST_ROWS = 25


def describe_status(status) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(STATUS_WORDS), as_col(status)), F.lit("evaluated")
    )


def _symbol(status: Column) -> Column:
    return F.coalesce(F.nullif(status, F.lit("")), F.lit("·"))


def _day(date: Column) -> Column:
    return date.cast("string")


def history_cells(n: int = 2) -> Column:
    """Display cells for ``posting_history``: own role, others, how many more."""
    same = F.when(
        F.col("same_role").isNotNull(),
        F.concat(_symbol(F.col("same_role.status")), F.lit(" same role, "),
                 describe_status("same_role.status"), F.lit(" "), _day(F.col("same_role.date"))),
    )
    others = F.transform(
        F.slice("others", 1, n),
        lambda e: F.concat(_symbol(e["status"]), F.lit(" "), describe_status(e["status"]),
                           F.lit(" "), _day(e["date"]), F.lit(": "), truncate(e["role"], 34)),
    )
    more = F.when(
        F.col("others_total") > n,
        F.concat(F.lit("+"), (F.col("others_total") - n).cast("string"), F.lit(" more")),
    )
    return F.array_compact(F.concat(F.array(same), others, F.array(more)))


def tier_rank(tier) -> Column:
    ranks = literal_map({t: i for i, t in enumerate(fixed.TIER_ORDER)})
    return F.coalesce(F.try_element_at(ranks, as_col(tier)), F.lit(9))


def verdict_rank(verdict) -> Column:
    return F.element_at(literal_map({v: i for i, v in enumerate(VERDICTS)}), as_col(verdict))


def triage_verdict(
    inbox: DataFrame, tracker: DataFrame, exclusions: DataFrame, curated: DataFrame
) -> DataFrame:
    """Inbox rows with ``lanes, history, verdict, why, known``.

    The verdict is a reading order, not a decision: the first rule that holds
    decides, and thin evidence ends in maybe or unknown rather than in skip.
    """
    df = posting_history(inbox, tracker)
    df = tracked_by_url(df, tracker)
    df = exclusion_match(df, exclusions)
    df = mark_company(df, curated, "curated")
    df = df.withColumns({
        "lanes": detect_lanes("title"), **title_flags("title"), "agency": is_agency("company"),
        "history": history_cells(),
    })
    lane_count = F.size("lanes")
    primary = F.size(F.array_intersect("lanes", F.array(*map(F.lit, fixed.PRIMARY_LANES))))
    good_place = F.coalesce(F.col("tier").isin("S", "A"), F.lit(False))
    tier_c = F.coalesce(F.col("tier") == "C", F.lit(False))
    named_senior = F.col("senior") & ~F.col("agency")
    strong = (primary > 0) & named_senior & good_place
    very_strong = (primary >= 2) & named_senior
    trusted = F.col("curated") & named_senior & good_place

    def since(kind, entry):
        return F.concat(F.lit(kind), describe_status(entry["status"]), F.lit(" on "),
                        _day(entry["date"]))

    def cells(*values):
        return F.array_compact(F.array(*values))

    no_domain = F.coalesce("title_generic", F.lit(False)) & ~F.col("curated")
    generic_why = cells(
        F.lit(fixed.TRIAGE_REASONS["no_domain"]),
        F.when(tier_c, F.lit(fixed.TRIAGE_REASONS["tier_c"])),
        F.when(F.col("agency"), F.lit(fixed.TRIAGE_REASONS["agency"])),
        F.when(F.col("known"), F.lit(fixed.TRIAGE_REASONS["known"])),
    )
    general_why = cells(
        F.when(lane_count > 0, F.concat(F.array_join(F.slice("lanes", 1, 2), " + "), F.lit(fixed.TRIAGE_REASONS["lane"])))
        .when(F.col("technical"), F.lit(fixed.TRIAGE_REASONS["technical"])),
        F.when(F.col("curated"), F.lit(fixed.TRIAGE_REASONS["curated"])),
        F.when(~F.col("senior"), F.lit(fixed.TRIAGE_REASONS["below_senior"])),
        F.when(F.col("agency"), F.lit(fixed.TRIAGE_REASONS["hidden_employer"])),
        F.when(tier_c, F.lit(fixed.TRIAGE_REASONS["tier_c"])),
        F.when(F.col("rejected_elsewhere"), F.lit(fixed.TRIAGE_REASONS["rejected"])),
    )
    excluded, by_url, same = F.col("excluded"), F.col("by_url"), F.col("same_role")
    rules = [
        (excluded.isNotNull(), "skip", cells(F.concat(F.lit(fixed.TRIAGE_REASONS["excluded"]), excluded["reason"]))),
        (by_url.isNotNull(), "skip", cells(since(fixed.TRIAGE_REASONS["tracked"], by_url))),
        (same.isNotNull(), "skip", cells(since(fixed.TRIAGE_REASONS["same_role"], same))),
        (F.col("junior"), "skip", cells(F.lit(fixed.TRIAGE_REASONS["junior"]))),
        (F.col("german"), "skip", cells(F.lit(fixed.TRIAGE_REASONS["german"]))),
        (no_domain, "unknown", generic_why),
        ((lane_count == 0) & ~F.col("technical") & ~F.col("curated"), "skip",
         cells(F.lit(fixed.TRIAGE_REASONS["no_signal"]))),
        (strong | very_strong | trusted, "promising", general_why),
    ]
    chain = None
    for test, verdict, why in rules:
        value = F.struct(F.lit(verdict).alias("verdict"), why.alias("why"))
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    chain = chain.otherwise(F.struct(F.lit("maybe").alias("verdict"), general_why.alias("why")))
    shown = (
        F.when(excluded.isNotNull(), F.concat(
            F.array(F.concat(F.lit("⛔ excluded "), _day(excluded["date"]))), F.col("history")))
        .when(by_url.isNotNull(), F.concat(
            F.array(F.concat(_symbol(by_url["status"]), F.lit(" tracked "), _day(by_url["date"]),
                             F.lit(": "), truncate(by_url["role"], 40))),
            F.slice("history", 1, 2)))
        .otherwise(F.col("history"))
    )
    matched = excluded.isNotNull() | by_url.isNotNull() | same.isNotNull()
    return df.withColumn("_j", chain).select(
        *inbox.columns, "lanes", shown.alias("history"), "_j.verdict", "_j.why",
        (matched | F.col("known")).alias("known"),
    )


def drainable(verdict="verdict", known="known") -> Column:
    """A row no human will read: dropped, or uninformative at an unknown company."""
    return (as_col(verdict) == "skip") | ((as_col(verdict) == "unknown") & ~as_col(known))


def drainable_groups(rows: DataFrame) -> DataFrame:
    """Rows whose whole opening can go; one kept location keeps them all."""
    keyed = rows.withColumn("_opening", opening_key("company", "title"))
    gone = (
        keyed.groupBy("_opening").agg(F.min(drainable().cast("int")).alias("_all"))
        .filter("_all = 1").select("_opening")
    )
    return keyed.join(gone, "_opening", "left_semi").drop("_opening")


def drain_except(inbox: DataFrame, drained: DataFrame, date, key: str = "pos"):
    """``(inbox left, history lines)``: drained rows move to the history for good."""
    left = inbox.join(drained.select(key), key, "left_anti")
    lines = drained.select(
        "url", F.lit(date).cast("date").alias("first_seen"), F.lit("triage-drain").alias("source"),
        "title", "company", F.lit("drained").alias("status"),
    )
    return left, lines


def collapse_openings(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """One row per opening, the best-tier one, with up to three other locations.

    An opening advertised in thousands of places stays spread out: only the first
    rows of each (opening, location) and then of each opening are looked at.
    """
    place = F.coalesce(F.trim("location"), F.lit(""))
    keyed = rows.withColumns({
        "_opening": opening_key("company", "title"), "_place": place, "_tier": tier_rank("tier"),
    })
    order = ["_tier", pos]
    slim = keyed.select("_opening", "_place", "_tier", pos)
    per_place = top_per_key(slim, ["_opening", "_place"], order, 2).drop("_rn")
    # The best row, a second row of its place, two blanks and two rows for each of
    # the next two places come before a third further place at the latest.
    leading = top_per_key(per_place, ["_opening"], order, 9).drop("_rn")
    entry = F.struct("_tier", pos, "_place")
    ordered = F.sort_array(F.collect_list(entry))
    summary = leading.groupBy("_opening").agg(ordered.alias("_list")).join(
        keyed.groupBy("_opening").agg(F.count(F.lit(1)).alias("_rows")), "_opening"
    )
    further = F.filter(
        F.array_distinct(F.transform(F.slice("_list", 2, 8), lambda e: e["_place"])),
        lambda p: p != "",
    )
    note = F.when(
        F.col("_rows") > 1,
        F.concat(F.lit("also posted in "), F.coalesce(
            F.nullif(F.array_join(F.slice(further, 1, 3), "; "), F.lit("")),
            F.concat((F.col("_rows") - 1).cast("string"), F.lit(" other location(s)")),
        )),
    )
    summary = summary.select(
        F.col("_list")[0][pos].alias(pos), note.alias("also_posted"),
        F.col("_rows").alias("postings"),
    )
    return rows.join(summary, pos)


def order_triage(rows: DataFrame) -> DataFrame:
    """Review order as a column.  Companies compare by code point, ties by position."""
    return with_rank(
        rows,
        [verdict_rank("verdict"), tier_rank("tier"), desc("posted"), "company", "pos"],
        "review_rank",
    )


def shortlist(rows: DataFrame, n: int = SHORTLIST_ROWS) -> DataFrame:
    """The n freshest promising rows, the part of the table meant to be read."""
    order = [F.col("posted").desc_nulls_last(), F.col("company"), F.col("pos")]
    return rows.filter("verdict = 'promising'").orderBy(*order).limit(n)


def verdict_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("rows"))


def review_table(rows: DataFrame) -> DataFrame:
    """The ten display columns of the review table."""
    def shown(col, n):
        return F.trim(F.replace(truncate(F.coalesce(col, F.lit("")), n), F.lit("|"), F.lit("\\|")))

    def dash(col):
        return F.coalesce(F.nullif(col, F.lit("")), F.lit("—"))

    return rows.select(
        F.col("verdict"),
        shown(F.col("company"), 32).alias("company"),
        shown(F.col("title"), 70).alias("role"),
        dash(F.array_join(F.slice("lanes", 1, 2), ", ")).alias("lane"),
        F.coalesce("tier", F.lit("?")).alias("tier"),
        dash(F.replace(F.array_join("history", "<br>"), F.lit("|"), F.lit("\\|"))).alias("history"),
        shown(F.array_join("why", "; "), 150).alias("why"),
        shown(F.col("location"), 44).alias("location"),
        F.coalesce(F.col("posted").cast("string"), F.lit("")).alias("posted"),
        F.col("url"),
    )
