"""A board scan: filter, tier, deduplicate, and account for every posting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppflow.functions.classify import classify_title, resolve_tier
from oppflow.functions.text import linkedin_job_id, role_key
from oppflow.operators.dedup import first_wins
from oppflow.operators.seen import new_postings


def dedup_within_scan(postings: DataFrame, pos: str = "pos") -> DataFrame:
    """First-wins over URL, job id and company+role inside one scan."""
    keyed = postings.withColumns({
        "_k_url": F.col("url"), "_k_job": linkedin_job_id("url"),
        "_k_role": role_key("company", "title"),
    })
    return first_wins(keyed, ["_k_url", "_k_job", "_k_role"], pos).drop("_k_url", "_k_job", "_k_role")


def scan_stages(postings: DataFrame, seen: DataFrame, title_filter: dict, tiers=None) -> DataFrame:
    """Every posting with the ``stage`` it ended in and its ``tier``.

    The cheap tests come first; only what passes them is compared with the keys
    already seen and with the rest of the scan.
    """
    judged = postings.withColumns({
        "_class": classify_title("title", **title_filter), "_t": resolve_tier("location", tiers),
    })
    judged = judged.withColumns({"tier": F.col("_t.tier"), "_keep": F.col("_t.keep")}).drop("_t")
    passed = judged.filter("_class = 'pass' AND _keep")
    accepted = dedup_within_scan(new_postings(passed, seen)).select("pos", F.lit(True).alias("_new"))
    stage = (
        F.when(F.col("_class") != "pass", F.lit("filtered by title"))
        .when(~F.col("_keep"), F.lit("out of tier"))
        .when(F.col("_new").isNotNull(), F.lit("new"))
        .otherwise(F.lit("duplicate"))
    )
    return judged.join(accepted, "pos", "left").withColumn("stage", stage).drop(
        "_class", "_keep", "_new"
    )


def scan_summary(staged: DataFrame) -> DataFrame:
    return staged.groupBy("stage").agg(F.count(F.lit(1)).alias("rows"))


def new_by_tier(staged: DataFrame) -> DataFrame:
    return staged.filter("stage = 'new'").groupBy(
        F.coalesce("tier", F.lit("?")).alias("tier")
    ).agg(F.count(F.lit(1)).alias("rows"))


def empty_boards(targets: DataFrame, postings: DataFrame) -> DataFrame:
    """Boards that answered without a single posting; a moved board looks the same."""
    return targets.join(
        postings.select(F.col("company").alias("name")).distinct(), "name", "left_anti"
    )


def search_matrix(queries: DataFrame, locations: list[str], remote: list[str], cap: int):
    """Searches in request order, on-site before remote, up to the request cap.

    The places are configuration, so each query carries them as an array.
    """
    places = [(0, i, p) for i, p in enumerate(locations)] + [(1, i, p) for i, p in enumerate(remote)]
    entries = F.array(*[
        F.struct(F.lit(r).alias("remote"), F.lit(i).alias("place_no"), F.lit(p).alias("location"))
        for r, i, p in places
    ])
    pairs = queries.select("query_no", "query", F.explode(entries).alias("s"))
    return pairs.select(
        "query_no", "query", "s.place_no", "s.location", (F.col("s.remote") == 1).alias("remote")
    ).orderBy("remote", "query_no", "place_no").limit(cap)


def reposts(history: DataFrame, days: int = 90, n: int = 2) -> DataFrame:
    """Roles posted under n or more URLs within a window of days.

    Lines are first summed per role and day, so the sliding window runs over days
    and never over the lines of a much-reposted role.
    """
    from pyspark.sql import Window

    per_url = history.groupBy(
        F.lower(F.trim("company")).alias("company"), F.lower(F.trim("title")).alias("title"), "url"
    ).agg(F.min("first_seen").alias("day"))
    per_day = per_url.filter("day IS NOT NULL").groupBy("company", "title", "day").agg(
        F.count(F.lit(1)).alias("urls")
    )
    window = (
        Window.partitionBy("company", "title").orderBy(F.unix_date("day"))
        .rangeBetween(-(days - 1), 0)
    )
    counted = per_day.withColumn("in_window", F.sum("urls").over(window))
    return (
        counted.groupBy("company", "title").agg(
            F.sum("urls").alias("urls"), F.max("in_window").alias("most_in_window"),
            F.min(F.when(F.col("in_window") >= n, F.col("day"))).alias("reposted_on"),
        ).filter(F.col("most_in_window") >= n)
    )
