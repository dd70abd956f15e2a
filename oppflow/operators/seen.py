"""Lookups between postings and everything already known about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppflow.functions.text import (
    first_filled, linkedin_job_id, normalize_role, role_key, url_key,
)
from oppflow.operators.ranks import first_per_key, top_per_key
from oppflow.session import durable


def seen_keys(*frames: DataFrame) -> DataFrame:
    """Distinct ``(kind, key)`` of every URL, job id and company+role in the frames.

    Frames need ``url``, ``company`` and ``title``; any of them may be NULL.
    """
    parts = []
    for df in frames:
        # Keys are plain columns, stacked, so that no row goes through arrays and their lambdas.
        url = F.when(F.col("url") != "", F.col("url"))
        job = F.when(F.col("url") != "", F.concat(F.lit("li:"), linkedin_job_id("url")))
        role = F.when((F.col("company") != "") & (F.col("title") != ""), role_key("company", "title"))
        kinds = F.stack(F.lit(3), F.lit("url"), url, F.lit("url"), job, F.lit("role"), role)
        parts.append(df.select(kinds.alias("kind", "key")).filter("key IS NOT NULL"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.distinct()


def new_postings(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """Postings none of whose keys is seen.

    Equality anti joins rather than one with OR, which no hash or sort-merge
    join could run.  The seen keys are written once, as each join would work them out anew.
    """
    seen = durable(seen)
    urls = seen.filter("kind = 'url'").select(F.col("key").alias("_u"))
    roles = seen.filter("kind = 'role'").select(F.col("key").alias("_r"))
    keyed = postings.withColumns({
        "_url": F.col("url"),
        "_job": url_key("url"),
        "_role": role_key("company", "title"),
    })
    return (
        keyed.join(urls, F.col("_url") == F.col("_u"), "left_anti")
        .join(urls, F.col("_job") == F.col("_u"), "left_anti")
        .join(roles, F.col("_role") == F.col("_r"), "left_anti")
        .drop("_url", "_job", "_role")
    )


def first_seen_lookup(postings: DataFrame, history: DataFrame) -> DataFrame:
    """Postings with the ``first_seen`` of the last history line for their URL or job."""
    last = first_per_key(
        history.select(url_key("url").alias("_k"), F.col("first_seen"), F.col("pos")),
        ["_k"], [F.col("pos").desc()],
    ).drop("pos")
    return postings.withColumn("_key", url_key("url")).join(
        last, F.col("_key") == F.col("_k"), "left"
    ).drop("_key", "_k")


def since_filter(postings: DataFrame, history: DataFrame, since) -> DataFrame:
    """Postings first seen on or after a date; a posting without history is dropped."""
    return first_seen_lookup(postings, history).filter(F.col("first_seen") >= F.lit(since))


def tracked_by_url(postings: DataFrame, tracker: DataFrame) -> DataFrame:
    """Postings with the last tracker row that has their URL or job id."""
    last = first_per_key(
        tracker.filter(first_filled("url") != "").select(
            url_key("url", strip_slash=True).alias("_k"), F.col("pos"),
            F.struct("status", "date", "role").alias("by_url"),
        ),
        ["_k"], [F.col("pos").desc()],
    ).drop("pos")
    return postings.withColumn("_key", url_key("url", strip_slash=True)).join(
        last, F.col("_key") == F.col("_k"), "left"
    ).drop("_key", "_k")


def exclusion_match(postings: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Postings with the exclusion for their role, else the one for their company.

    Of several lines with one key the last counts.
    """
    keyed = exclusions.select(
        F.lower("company").alias("_c"),
        F.when(F.col("role") == "*", F.lit("*")).otherwise(normalize_role("role")).alias("_r"),
        F.struct("date", "reason").alias("_x"), "pos",
    )
    last = first_per_key(keyed, ["_c", "_r"], [F.col("pos").desc()]).drop("pos")
    whole = last.filter("_r = '*'").select(F.col("_c").alias("_wc"), F.col("_x").alias("_wx"))
    company = F.lower(F.trim("company"))
    p = postings.withColumns({"_co": company, "_ro": normalize_role("title")})
    return (
        p.join(last, (F.col("_co") == F.col("_c")) & (F.col("_ro") == F.col("_r")), "left")
        .join(whole, F.col("_co") == F.col("_wc"), "left")
        .withColumn("excluded", F.coalesce("_x", "_wx"))
        .drop("_co", "_ro", "_c", "_r", "_x", "_wc", "_wx")
    )


def mark_company(postings: DataFrame, names: DataFrame, mark: str) -> DataFrame:
    """Postings with a flag: is their company one of ``names.company``?"""
    known = names.select(F.lower(F.trim("company")).alias("_k")).distinct().withColumn(
        "_m", F.lit(True)
    )
    return postings.withColumn("_key", F.lower(F.trim("company"))).join(
        known, F.col("_key") == F.col("_k"), "left"
    ).withColumn(mark, F.coalesce("_m", F.lit(False))).drop("_key", "_k", "_m")


def engaged_intersection(postings: DataFrame, tracker: DataFrame) -> DataFrame:
    """Postings at companies the tracker already knows."""
    known = tracker.select(F.lower(F.trim("company")).alias("_k")).distinct()
    return postings.join(known, F.lower(F.trim("company")) == F.col("_k"), "left_semi")


def keep_generic_if_engaged(
    postings: DataFrame, tracker: DataFrame, keep_generic: bool = False
) -> DataFrame:
    """Drop titles that name no domain, except at companies already engaged with."""
    if keep_generic:
        return postings
    marked = mark_company(postings, tracker, "_engaged")
    return marked.filter("NOT title_generic OR _engaged").drop("_engaged")


def posting_history(postings: DataFrame, tracker: DataFrame, listed: int = 2) -> DataFrame:
    """Postings with what the tracker says about their company.

    ``same_role`` is the first row with the same normalised title; ``others`` the
    first ``listed`` remaining rows and ``others_total`` how many remain.  The
    company's rows are never gathered: its first ``listed + 1`` rows and a count
    are enough, whichever of them the posting's own role takes away.
    """
    entry = F.struct("pos", "status", "date", "role")
    rows = tracker.select(
        F.lower(F.trim("company")).alias("_c"), normalize_role("role").alias("_n"),
        "pos", "status", entry.alias("entry"),
    )
    same = first_per_key(rows, ["_c", "_n"], ["pos"]).select(
        F.col("_c").alias("_sc"), F.col("_n").alias("_sn"), F.col("entry").alias("same_role")
    )
    leading = top_per_key(rows, ["_c"], ["pos"], listed + 1).groupBy("_c").agg(
        F.sort_array(F.collect_list("entry")).alias("_leading")
    )
    totals = rows.groupBy("_c").agg(
        F.count(F.lit(1)).alias("_total"),
        F.count(F.when(F.col("status") == "❌", 1)).alias("_rejected"),
    )
    per_company = totals.join(leading, "_c")
    keyed = postings.withColumns(
        {"_co": F.lower(F.trim("company")), "_no": normalize_role("title")}
    )
    joined = keyed.join(per_company, F.col("_co") == F.col("_c"), "left").join(
        same, (F.col("_co") == F.col("_sc")) & (F.col("_no") == F.col("_sn")), "left"
    )
    has_same = F.col("same_role").isNotNull().cast("bigint")
    empty = F.array().cast("array<struct<pos:bigint,status:string,date:date,role:string>>")
    others = F.filter(
        F.coalesce("_leading", empty),
        lambda e: ~F.coalesce(e["pos"] == F.col("same_role.pos"), F.lit(False)),
    )
    same_rejected = F.coalesce((F.col("same_role.status") == "❌").cast("bigint"), F.lit(0))
    return joined.withColumns({
        "others": F.slice(others, 1, listed),
        "others_total": F.coalesce(F.col("_total"), F.lit(0)) - has_same,
        "rejected_elsewhere": F.coalesce(F.col("_rejected"), F.lit(0)) - same_rejected > 0,
        "known": F.col("_total").isNotNull(),
    }).drop("_co", "_no", "_c", "_sc", "_sn", "_total", "_rejected", "_leading")
