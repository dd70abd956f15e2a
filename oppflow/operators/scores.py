"""The documented scores of an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.functions.classify import weighted
from oppflow.operators.ranks import desc, with_rank


def composite_scores(df: DataFrame) -> DataFrame:
    """Fit, Odds, Opportunity and Priority from their components.

    Missed hard requirements cap Fit; every gap lowers Odds, down to a floor.
    """
    fit = weighted({k: k for k in fixed.FIT_WEIGHTS}, fixed.FIT_WEIGHTS)
    cap = None
    for missed, limit in fixed.FIT_CAPS:
        test = F.col("missed_requirements") >= missed
        value = F.least(fit, F.lit(limit))
        cap = F.when(test, value) if cap is None else cap.when(test, value)
    df = df.withColumn("fit", cap.otherwise(fit))
    penalty = weighted({k: F.col(k).cast("double") for k in fixed.ODDS_PENALTIES}, fixed.ODDS_PENALTIES)
    df = df.withColumns({
        "odds": F.greatest(F.col("fit") - penalty, F.lit(fixed.ODDS_FLOOR)),
        "opportunity": weighted({k: k for k in fixed.OPPORTUNITY_WEIGHTS}, fixed.OPPORTUNITY_WEIGHTS),
    })
    return df.withColumn(
        "priority", weighted({k: k for k in fixed.PRIORITY_WEIGHTS}, fixed.PRIORITY_WEIGHTS)
    )


def offer_total(weights: dict | None = None):
    weights = weights or fixed.OFFER_WEIGHTS
    return weighted({k: k for k in weights}, weights)


def compare_offers(df: DataFrame, weights: dict | None = None, key: str = "offer_id") -> DataFrame:
    """Weighted total over the dimensions and its rank; equal totals share a rank."""
    total = F.floor(offer_total(weights) * 1e6 + 0.5).cast("double") / 1e6
    ranked = with_rank(df.withColumn("total", total), [desc("total"), key], "_place")
    # The rank of a total is the place of its first row.
    first = ranked.groupBy("total").agg(F.min("_place").alias("rank"))
    return ranked.join(first, "total").drop("_place")
