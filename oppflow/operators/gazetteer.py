"""Places of any number, kept as a table: which of them a text names, and the tier that follows.

``functions.classify.resolve_tier`` builds one pattern from its lists, which suits some hundred names.
Here the names are rows.  Every run of words of a text that is as long as some name meets the names by
equality, so the work grows with the texts and not with texts times names.

* Texts are looked up once each, however many rows hold them.
* Names are broadcast only if Spark finds them small; otherwise both sides are shuffled by phrase, and a
  phrase that most texts hold is a skewed key of a join with one row on the other side, which adaptive
  execution splits.
* The word counts of names are read first: one row per count that occurs, never more than the words of
  the longest name.

``places`` has the columns ``name``, ``country``, ``tier`` and, if wanted, ``preference`` (smaller first,
0 without the column); others are ignored.  Defined cases: a name without a letter or digit, a null name
and a tier that ``tiers`` does not hold (null too) are no places; of equal names the one of the best tier
counts, then preference, then country.  A null text is an empty one and names nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oppflow.functions import fixed
from oppflow.functions.classify import literal_map, place_rules
from oppflow.functions.regex import literal, words
from oppflow.functions.text import normalize_location

PLACE = "struct<tier:string,score:double,country:string,reason:string,keep:boolean>"


def default_places(spark: SparkSession, tiers: dict | None = None, cities: dict | None = None) -> DataFrame:
    """The built-in countries and cities as such a table, to be extended by ``unionByName``."""
    rules = place_rules(tiers, cities)
    rows = [
        (name, rules["country_of"][number], fixed.TIER_ORDER[number // 10000], number % 10000)
        for name, number in sorted(rules["places"].items())
    ]
    return spark.createDataFrame(rows, "name string, country string, tier string, preference int")


def word_list(text: Column) -> Column:
    """Words of a text without accents and capitals: letters, digits and ``_`` of any script."""
    return F.filter(F.split(normalize_location(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def _ranked_names(places: DataFrame, tiers: dict) -> DataFrame:
    """One row per phrase with its best place: ``_phrase, _n, _best``."""
    order = [t for t in fixed.TIER_ORDER if t in tiers]
    found = F.array_position(F.array(*map(F.lit, order)).cast("array<string>"), F.col("tier"))
    preference = F.col("preference") if "preference" in places.columns else F.lit(0)
    ranked = places.select(
        word_list(F.col("name")).alias("_w"),
        F.struct(found.cast("int").alias("rank"), preference.cast("long").alias("preference"),
                 F.col("country"), F.col("tier"), F.col("name")).alias("_best"),
    ).filter((F.size("_w") > 0) & (F.col("_best.rank") > 0))
    return ranked.groupBy(F.array_join("_w", " ").alias("_phrase"), F.size("_w").alias("_n")).agg(
        F.min("_best").alias("_best")
    )


def places_in(texts: DataFrame, text: str, places: DataFrame, tiers: dict | None = None,
              nested: bool = False) -> DataFrame:
    """One row per distinct text and place named in it: ``text, start, n_words, name, country, tier, best``.

    ``start`` counts words from 0.  A name inside a longer one (York in New York) is left out unless
    ``nested`` is set.  ``best`` orders the places of a text: smallest first.
    """
    names = _ranked_names(places, tiers or fixed.DEFAULT_TIERS)
    counts = [r["_n"] for r in names.select("_n").distinct().collect()]
    each = texts.select(F.col(f"`{text}`").alias("_text")).filter("_text IS NOT NULL").distinct()
    spans = each.select("_text", word_list(F.col("_text")).alias("_w")).select(
        "_text", "_w", F.explode(F.array(*map(F.lit, sorted(counts))).cast("array<int>")).alias("_n")
    ).filter(F.size("_w") >= F.col("_n")).select(
        "_text", "_n", F.posexplode(F.transform(
            F.sequence(F.lit(1), F.size("_w") - F.col("_n") + 1), lambda at: F.array_join(F.slice("_w", at, F.col("_n")), " ")
        )).alias("_start", "_phrase")
    )
    found = spans.join(names, ["_phrase", "_n"])
    if not nested:
        before = Window.partitionBy("_text").orderBy("_start", F.desc("_n")).rowsBetween(Window.unboundedPreceding, -1)
        end = F.col("_start") + F.col("_n")
        found = found.withColumn("_reach", F.max(end).over(before)).filter(
            F.col("_reach").isNull() | (F.col("_reach") < end)
        )
    return found.select(
        F.col("_text").alias(text), F.col("_start").alias("start"), F.col("_n").alias("n_words"),
        "_best.name", "_best.country", "_best.tier", F.col("_best").alias("best"),
    )


def resolve_tiers(df: DataFrame, location: str, places: DataFrame, tiers: dict | None = None,
                  outside: list | None = None, nested: bool = False, name: str = "place") -> DataFrame:
    """``df`` with ``(tier, score, country, reason, keep)`` of its locations, judged by their best place.

    The rules after the places (regions, remote words, places outside) are those of
    ``classify.resolve_tier``; with ``default_places`` and ``nested`` the results are the same.
    """
    tiers = tiers or fixed.DEFAULT_TIERS
    best = places_in(df, location, places, tiers, nested).groupBy(F.col(f"`{location}`").alias("_text")).agg(
        F.min("best").alias("_best")
    )
    joined = df.join(best, F.col(f"`{location}`") == F.col("_text"), "left")
    return joined.withColumn(name, _judged(F.col(f"`{location}`"), tiers, outside).cast(PLACE)).drop("_text", "_best")


def _judged(location: Column, tiers: dict, outside: list | None) -> Column:
    norm = normalize_location(location)

    def says(terms) -> Column:
        return norm.rlike(words([literal(t) for t in terms]))

    def flagged(flag):
        return next((t for t in fixed.TIER_ORDER if t in tiers and tiers[t].get(flag)), None)

    beyond = says(fixed.OUTSIDE_PLACES if outside is None else outside)
    eu, anywhere = flagged("eu"), flagged("global_remote")
    reason = (
        F.when(norm == "", "no-location").when(F.col("_best").isNotNull(), "country")
        .when(says(fixed.EU_REGION_WORDS) & F.lit(eu is not None), "eu-region")
        .when(says(fixed.GLOBAL_REMOTE_WORDS) & ~beyond & F.lit(anywhere is not None), "global-remote")
        .when(beyond, "outside-scope").when(says(fixed.REMOTE_WORDS), "unqualified-remote")
        .otherwise("unrecognized")
    )
    tier = (
        F.when(reason == "country", F.col("_best.tier")).when(reason == "eu-region", F.lit(eu))
        .when(reason == "global-remote", F.lit(anywhere))
    )
    scores = {t: float(v["score"]) for t, v in tiers.items() if v.get("score") is not None}
    return F.struct(
        tier.alias("tier"), F.try_element_at(literal_map(scores), tier).alias("score"),
        F.when(reason == "country", F.col("_best.country")).alias("country"), reason.alias("reason"),
        (~reason.isin("outside-scope", "unrecognized")).alias("keep"),
    )
