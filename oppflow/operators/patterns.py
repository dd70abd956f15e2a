"""What separates the applications that led somewhere from those that did not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.functions.classify import (
    classify_blocker, classify_company_size, classify_outcome, classify_remote,
    extract_tech_terms, normalize_status,
)
from oppflow.functions.stats import fixed_places, percent
from oppflow.functions.text import first_filled
from oppflow.operators.funnel import count_if, literal_rows
from oppflow.session import durable

ALL = "*"
FAILED = ["negative", "no_response", "self_filtered"]


def enrich(apps: DataFrame, reports: DataFrame, key: str = "num") -> DataFrame:
    """Tracker rows with their report's facts and the classes derived from them."""
    joined = apps.join(reports, key, "left")
    return joined.withColumns({
        "status_id": normalize_status("status"),
    }).withColumns({
        "outcome": classify_outcome("status_id"),
        "archetype": F.coalesce(F.nullif("archetype", F.lit("")), F.lit("Unknown")),
        "remote_bucket": classify_remote(first_filled("remote", "location", "notes")),
        "company_size": classify_company_size("team_size"),
    })


def analysis_guard(enriched: DataFrame, threshold: int = 5) -> DataFrame:
    """Whether enough rows are past evaluation to analyse anything."""
    current = count_if(F.col("status_id") != "evaluated")
    return enriched.agg(
        F.count(F.lit(1)).alias("total"), current.alias("current"),
        F.lit(threshold).cast("bigint").alias("threshold"),
        F.when(F.count(F.lit(1)) == 0, F.lit("no applications"))
        .when(current < threshold, F.lit("not enough data"))
        .otherwise(F.lit("ok")).alias("state"),
    )


def analysis_metadata(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.count(F.lit(1)).alias("total"), F.min("date").alias("date_from"),
        F.max("date").alias("date_to"),
        *[count_if(F.col("outcome") == o).alias(o) for o in fixed.OUTCOMES],
    )


def score_by_outcome(enriched: DataFrame) -> DataFrame:
    """avg, min, max and count per outcome and score; a score of 0 means unscored."""
    scores = ["fit", "odds", "priority"]
    long = enriched.select("outcome", F.explode(F.array(*[
        F.struct(F.lit(s).alias("score"), F.col(s).alias("value")) for s in scores
    ])).alias("x")).select("outcome", "x.score", "x.value").filter("value > 0")
    stats = long.groupBy("outcome", "score").agg(
        F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count(F.lit(1)).alias("n"),
    )
    every = literal_rows(
        enriched, [(o, s) for o in fixed.OUTCOMES for s in scores], "outcome string, score string"
    )
    zero = F.lit(0.0)
    return every.join(stats, ["outcome", "score"], "left").select(
        "outcome", "score", fixed_places(F.coalesce("avg", zero), 2).alias("avg"),
        F.coalesce("min", zero).alias("min"), F.coalesce("max", zero).alias("max"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def breakdown_by(enriched: DataFrame, dim: str) -> DataFrame:
    """Totals, outcome counts and conversion per value of a dimension."""
    counts = [count_if(F.col("outcome") == o).alias(o) for o in fixed.OUTCOMES]
    return enriched.groupBy(F.col(dim).alias("value")).agg(
        F.count(F.lit(1)).alias("total"), *counts
    ).withColumn("conversion", percent("positive", "total"))


def gaps_of(enriched: DataFrame) -> DataFrame:
    return enriched.select("outcome", F.explode("gaps").alias("gap"))


def blocker_analysis(enriched: DataFrame) -> DataFrame:
    """Typed gaps with their share of all applications."""
    kinds = F.transform(
        F.coalesce("gaps", F.array().cast("array<struct<description:string,severity:string,mitigation:string>>")),
        lambda g: classify_blocker(g["description"], g["severity"]),
    )
    # Every application adds one marker, so the total comes out of the same pass.
    counts = (
        enriched.select(F.explode(F.concat(F.array_compact(kinds), F.array(F.lit(ALL)))).alias("blocker"))
        .groupBy("blocker").agg(F.count(F.lit(1)).alias("frequency"))
    )
    total = F.max(F.when(F.col("blocker") == ALL, F.col("frequency"))).over(Window.partitionBy())
    return counts.withColumn("percentage", percent("frequency", total)).filter(
        F.col("blocker") != ALL
    )


def score_threshold(enriched: DataFrame) -> DataFrame:
    """Lowest score that led to progress, cut to one decimal; 3.5 without any."""
    scores = F.when((F.col("outcome") == "positive") & (F.col("fit") > 0), F.col("fit"))
    low, high = F.min(scores), F.max(scores)
    return enriched.agg(
        F.coalesce(F.floor(low * 10).cast("double") / 10, F.lit(3.5)).alias("recommended"),
        F.coalesce(low, F.lit(0.0)).alias("lowest"), F.coalesce(high, F.lit(0.0)).alias("highest"),
    )


def tech_gaps(enriched: DataFrame, top: int = 15) -> DataFrame:
    """Technologies named in the gaps of applications that failed."""
    return (
        gaps_of(enriched.filter(F.col("outcome").isin(FAILED)))
        .select(F.explode(extract_tech_terms("gap.description")).alias("skill"))
        .groupBy("skill").agg(F.count(F.lit(1)).alias("frequency"))
        .orderBy(F.col("frequency").desc(), "skill").limit(top)
    )


def best_segment(breakdown: DataFrame) -> DataFrame:
    """Highest conversion among values seen at least twice."""
    order = [F.col("conversion").desc(), F.col("total").desc(), F.col("value")]
    return breakdown.filter("total >= 2").orderBy(*order).limit(1)


def worst_segment(breakdown: DataFrame) -> DataFrame:
    """Largest value seen at least twice that never converted."""
    return breakdown.filter("total >= 2 AND conversion = 0").orderBy(
        F.col("total").desc(), F.col("value")
    ).limit(1)


def recommendations(enriched: DataFrame) -> DataFrame:
    """Rule-based advice, one row per rule whose threshold is reached."""
    blockers = blocker_analysis(enriched)
    skills = tech_gaps(enriched, 3).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct((-F.col("frequency")).alias("o"), "skill"))),
                lambda e: e["skill"],
            ), ", ",
        ).alias("skills")
    )

    def row(df, rule, subject, figure, impact):
        return df.select(
            F.lit(rule).alias("rule"), subject.alias("subject"),
            figure.cast("double").alias("figure"), F.lit(impact).alias("impact"),
        )

    geo = row(blockers.filter("blocker = 'geo-restriction' AND percentage >= 20"),
              "tighten location filters", F.col("blocker"), F.col("percentage"), "high")
    mismatch = blockers.filter("blocker = 'stack-mismatch' AND percentage >= 15").select(
        F.lit(None).cast("string").alias("skills"), "percentage"
    ).unionByName(skills.select("skills", F.lit(None).cast("bigint").alias("percentage")))
    both = mismatch.agg(F.max("skills").alias("skills"), F.max("percentage").alias("percentage"))
    stack = row(both.filter("percentage IS NOT NULL"),
                "filter out roles requiring", F.col("skills"), F.col("percentage"), "high")
    gate = row(score_threshold(enriched).filter("lowest > 3.0"),
               "set minimum score", F.lit("fit"), F.col("recommended"), "medium")
    best = row(best_segment(breakdown_by(enriched, "archetype")).filter("conversion > 0"),
               "double down on archetype", F.col("value"), F.col("conversion"), "medium")
    worst = row(worst_segment(breakdown_by(enriched, "remote_bucket")),
                "avoid remote policy", F.col("value"), F.col("total"), "medium")
    return geo.unionByName(stack).unionByName(gate).unionByName(best).unionByName(worst)


def analysis_document(enriched: DataFrame) -> DataFrame:
    """The analysis as ``(section, document)`` rows for a JSON sink.  Every section is
    an aggregate of fixed size, so gathering its rows is safe."""
    from oppflow.operators.funnel import status_funnel

    enriched = durable(enriched)  # read by every section
    sections = {
        "metadata": analysis_metadata(enriched),
        "funnel": status_funnel(enriched.select("status")),
        "scores": score_by_outcome(enriched),
        "blockers": blocker_analysis(enriched),
        "remote": breakdown_by(enriched, "remote_bucket"),
        "company_size": breakdown_by(enriched, "company_size"),
        "threshold": score_threshold(enriched),
        "tech_gaps": tech_gaps(enriched),
    }
    rows = [
        df.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias("document"))
        .select(F.lit(name).alias("section"), "document")
        for name, df in sections.items()
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
