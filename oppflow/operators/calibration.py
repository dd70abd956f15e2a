"""Score calibration: does a score predict that a company makes contact?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.functions.classify import normalize_status, score_band
from oppflow.functions.stats import fixed_places, pearson, rate, wilson
from oppflow.functions.text import days_between, effective_applied_date
from oppflow.operators.funnel import count_if, literal_rows
from oppflow.session import durable

SCORES = ["priority", "fit", "odds"]


def last_outcomes(outcomes: DataFrame) -> DataFrame:
    """One outcome per company and date, the last line written.

    Report numbers are shared between companies in practice and are no key.
    """
    line = F.struct("pos", "report", "stages_passed", "furthest_stage")
    return outcomes.groupBy("company", "date").agg(F.max(line).alias("outcome"))


def outcome_join(apps: DataFrame, outcomes: DataFrame) -> DataFrame:
    return apps.join(last_outcomes(outcomes), ["company", "date"], "left")


def cohort(apps: DataFrame, outcomes: DataFrame, as_of) -> DataFrame:
    """Every application that was sent, with its age and whether contact followed."""
    sent = apps.withColumn("status_id", normalize_status("status")).filter(
        F.col("status_id").isin(fixed.SENT_STATUSES)
    ).withColumn("sent_on", effective_applied_date("notes", "date"))
    joined = outcome_join(sent, outcomes)
    return joined.select(
        "num", "company", "role", "date", "sent_on", "status_id", *SCORES,
        days_between("sent_on", F.lit(as_of).cast("date")).alias("age"),
        F.col("outcome").isNotNull().cast("bigint").alias("contact"),
        F.coalesce("outcome.stages_passed", F.lit(0)).cast("bigint").alias("stages_passed"),
        F.col("outcome.furthest_stage").alias("furthest_stage"),
        F.col("outcome.report").alias("outcome_report"),
    )


def min_age(df: DataFrame, days: int) -> DataFrame:
    return df.filter(F.col("age") >= days)


def orphan_outcomes(sent: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcome lines that match no application that was sent."""
    return outcomes.join(sent.filter("contact = 1"), ["company", "date"], "left_anti")


def report_mismatch(sent: DataFrame) -> DataFrame:
    """Contacts whose outcome line names another report than the tracker."""
    return sent.filter("contact = 1 AND outcome_report <> num").select(
        "company", "date", "outcome_report", F.col("num").alias("tracker_report")
    )


def base_rate(sent: DataFrame) -> DataFrame:
    n, k = F.count(F.lit(1)), F.sum("contact")
    low, high = wilson(k, n)
    return sent.agg(
        n.alias("n"), F.coalesce(k, F.lit(0)).alias("k"), fixed_places(rate(k, n), 6).alias("rate"),
        fixed_places(low, 6).alias("lo"), fixed_places(high, 6).alias("hi"),
    )


def score_correlation(sent: DataFrame, scores: list[str] | None = None) -> DataFrame:
    """Pearson r of each score with contact, all in one pass."""
    scores = scores or SCORES
    one = sent.agg(*[pearson(s, "contact").alias(s) for s in scores])
    rows = F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("r")) for s in scores])
    return one.select(F.explode(rows).alias("x")).select(
        "x.score", fixed_places("x.r", 6).alias("r")
    )


def _rated(df: DataFrame, k: str = "k", n: str = "n") -> DataFrame:
    low, high = wilson(k, n)
    return df.withColumns({
        "rate": fixed_places(rate(k, n), 6), "lo": fixed_places(low, 6), "hi": fixed_places(high, 6),
    })


def banded_rates(sent: DataFrame, scores: list[str] | None = None) -> DataFrame:
    """Contact rate per score and band; bands nobody falls into stay, with n = 0."""
    scores = scores or SCORES
    long = sent.select("contact", F.explode(F.array(*[
        F.struct(F.lit(s).alias("score"), score_band(s).alias("band")) for s in scores
    ])).alias("x")).select("contact", "x.score", "x.band")
    counts = long.filter("band IS NOT NULL").groupBy("score", "band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("contact").alias("k")
    )
    every = literal_rows(
        sent, [(s, b[0]) for s in scores for b in fixed.SCORE_BANDS], "score string, band string"
    )
    zero = F.lit(0).cast("bigint")
    filled = every.join(counts, ["score", "band"], "left").withColumns(
        {"n": F.coalesce("n", zero), "k": F.coalesce("k", zero)}
    )
    return _rated(filled)


def gate_options(sent: DataFrame, cuts: list[float] | None = None) -> DataFrame:
    """Contact rate above and below each candidate cut of the priority score."""
    cuts = cuts or fixed.GATE_CUTS
    aggs = []
    for i, cut in enumerate(cuts):
        for side, test in (("above", F.col("priority") >= cut), ("below", F.col("priority") < cut)):
            aggs.append(count_if(test).alias(f"n_{i}_{side}"))
            aggs.append(count_if(test & (F.col("contact") == 1)).alias(f"k_{i}_{side}"))
    rows = F.array(*[
        F.struct(F.lit(float(cut)).alias("cut"), F.lit(side).alias("side"),
                 F.col(f"n_{i}_{side}").alias("n"), F.col(f"k_{i}_{side}").alias("k"))
        for i, cut in enumerate(cuts) for side in ("above", "below")
    ])
    return _rated(sent.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*"))


def furthest_stage_histogram(sent: DataFrame) -> DataFrame:
    return sent.filter("contact = 1").groupBy(
        F.coalesce(F.nullif("furthest_stage", F.lit("")), F.lit("unknown")).alias("stage")
    ).agg(F.count(F.lit(1)).alias("rows"))


def median_stages(sent: DataFrame) -> DataFrame:
    """Exact median of the stages passed, 0 without any contact."""
    return sent.filter("contact = 1").agg(
        F.coalesce(F.percentile("stages_passed", 0.5), F.lit(0.0)).alias("median_stages")
    )


def calibration_document(sent: DataFrame, outcomes: DataFrame, days: int = 0) -> DataFrame:
    """The calibration as ``(section, document)`` rows for a JSON sink.

    The figures cover applications of at least ``days`` days; the two checks cover all.  Every
    section is an aggregate of fixed size, so gathering its rows is safe; of the lines that
    match nothing only the number is kept, ``orphan_outcomes`` and ``report_mismatch`` list them.
    """
    sent = durable(sent)  # read by every section
    scoped = min_age(sent, days) if days else sent
    count = F.count(F.lit(1)).alias("rows")
    sections = {
        "base_rate": base_rate(scoped), "correlation": score_correlation(scoped),
        "bands": banded_rates(scoped), "gates": gate_options(scoped),
        "furthest_stage": furthest_stage_histogram(scoped), "stages": median_stages(scoped),
        "orphans": orphan_outcomes(sent, outcomes).agg(count), "mismatches": report_mismatch(sent).agg(count),
    }
    rows = [
        df.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias("document"))
        .select(F.lit(name).alias("section"), "document")
        for name, df in sections.items()
    ]
    return reduce(DataFrame.unionByName, rows)
