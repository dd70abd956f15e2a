"""Places kept as a table: the same as the built-in lists, longest names, and many names at once."""

import random

import pytest
from pyspark.sql import functions as F

from oppflow.functions import classify as C
from oppflow.functions import fixed
from oppflow.operators import gazetteer as G
from oppflow.plans.views import LOCATIONS, SMALL_PLACES

EXTRA = [
    None, "", " ", "Mexico City", "Northern Ireland / Ireland", "EU Remote (Berlin)", "work from anywhere, USA",
    "Wien;Zürich", "Global - India", "Remote Europe", "hybrid", "St. Gallen, Switzerland", "Frankfurt am Main", "nowhere",
]
SCHEMA = "name string, country string, tier string, preference int, extra string"


def test_equals_the_built_in_lists(spark):
    rng = random.Random(3)
    known = LOCATIONS + SMALL_PLACES + EXTRA
    mixed = [f"{rng.choice(known)} {rng.choice('|/,-')} {rng.choice(known)}" for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(known + mixed)], "i int, location string")
    wanted = {r.i: r.t for r in df.select("i", C.resolve_tier("location").alias("t")).collect()}
    got = G.resolve_tiers(df, "location", G.default_places(spark), nested=True).collect()
    assert len(got) == len(wanted)
    assert {r.i: tuple(r.place) for r in got} == {i: tuple(t) for i, t in wanted.items()}


def test_longest_name_counts(spark):
    places = spark.createDataFrame([
        ("York", "united kingdom", "A", 1, "x"), ("New York", "united states", "C", 1, "x"), ("東京", "japan", "C", 2, "x"),
        ("york", "elsewhere", "B", 0, "x"), ("...", "nowhere", "S", 0, "x"), (None, "nowhere", "S", 0, "x"),
        ("Odd", "nowhere", "Z", 0, "x"), ("Odd", "nowhere", None, 0, "x"),
    ], SCHEMA)
    df = spark.createDataFrame([
        (1, "New York"), (2, "York, UK"), (3, "New York or York"), (4, "支社 東京"), (5, "Odd ..."), (6, None), (7, "YORK"),
    ], "i int, location string")
    flat = {r.i: (r.place.tier, r.place.country, r.place.reason)
            for r in G.resolve_tiers(df, "location", places).collect()}
    assert flat == {
        1: ("C", "united states", "country"), 2: ("A", "united kingdom", "country"), 3: ("A", "united kingdom", "country"),
        4: ("C", "japan", "country"), 5: (None, None, "unrecognized"), 6: (None, None, "no-location"),
        7: ("A", "united kingdom", "country"),
    }
    inside = {r.i: r.place.country for r in G.resolve_tiers(df, "location", places, nested=True).collect()}
    assert inside[1] == "united kingdom"
    named = G.places_in(df, "location", places).filter("location = 'New York or York'").collect()
    assert sorted((r.start, r.n_words, r.name) for r in named) == [(0, 2, "New York"), (3, 1, "York")]


@pytest.mark.parametrize("rows", [0, 20])
def test_empty_tables(spark, rows):
    places = spark.createDataFrame([], SCHEMA)
    df = spark.createDataFrame([(i, "Berlin, EU") for i in range(rows)], "i int, location string")
    got = G.resolve_tiers(df, "location", places).collect()
    assert [r.place.reason for r in got] == ["eu-region"] * rows
    assert G.resolve_tiers(df.limit(0), "location", G.default_places(spark)).collect() == []


def test_clashing_columns_and_a_hot_text(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("rank"), F.lit("t").alias("tier"), F.lit("c").alias("country"), F.lit("n").alias("name"),
        F.when(F.col("id") % 3 > 0, "Berlin, Germany").otherwise(F.concat(F.lit("Town "), F.col("id"))).alias("location"),
    )
    got = G.resolve_tiers(df, "location", G.default_places(spark)).groupBy("tier", "place.reason").count().collect()
    assert sorted((r["tier"], r["reason"], r["count"]) for r in got) == [("t", "country", 13333), ("t", "unrecognized", 6667)]


def test_a_million_names(spark):
    places = spark.range(1_000_000).select(
        F.concat(F.lit("Place "), F.col("id"), F.when(F.col("id") % 2 == 0, " North").otherwise("")).alias("name"),
        F.concat(F.lit("land "), F.col("id") % 97).alias("country"),
        F.element_at(F.array(*map(F.lit, fixed.TIER_ORDER)), (F.col("id") % 4 + 1).cast("int")).alias("tier"),
    )
    df = spark.range(5_000).select(
        F.col("id"), F.concat(F.lit("Office, place "), F.col("id") * 211, F.lit(" north")).alias("location")
    )
    rows = G.resolve_tiers(df, "location", places).collect()
    assert len(rows) == 5_000
    for r in rows:
        n = r.id * 211
        known = n < 1_000_000
        assert r.place.reason == ("country" if known else "unrecognized")
        assert (r.place.country, r.place.tier) == ((f"land {n % 97}", fixed.TIER_ORDER[n % 4]) if known else (None, None))
