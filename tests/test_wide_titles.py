"""A company with very many long titles that share a word."""

from pyspark.sql import functions as F

from oppflow.operators import matching


def test_twenty_thousand_titles_with_a_word_in_common(spark):
    words = ", ' ', ".join(f"'w{k}x', id" for k in range(11))
    targets = spark.range(20_000).select(
        F.lit("hot").alias("block"), F.expr(f"concat('platform ', {words})").alias("role"), F.col("id").alias("pos"))
    queries = targets.selectExpr("block", "CASE pos % 3 WHEN 0 THEN role WHEN 1 THEN concat('platform w3x', pos) ELSE concat(role, ' more') END AS role", "pos AS want")
    found = matching.first_same_role(queries, targets, "block", "role", ["pos"])
    got = queries.withColumn("full", matching.title_signature(F.col("role"))).join(found, ["block", "full"])
    assert got.filter("pos = want").count() == got.count() == 20_000


def test_bags_that_repeat_a_word_meet_by_what_they_share(spark):
    rows = [(i, ["hot", f"a{i}", f"b{i}", f"b{i}"]) for i in range(3000)] + [(5000, ["b7", "zzz"]), (5001, ["a8", "hot"])]
    sigs = spark.createDataFrame([("c", p, sorted(b)) for p, b in rows], "company string, pos long, bag array<string>")
    keys = matching.overlap_witnesses(sigs, ["company"])
    pairs = keys.alias("x").join(keys.alias("y"), "key").filter("x.pos < y.pos AND (x.small OR y.small)").select("x.pos", "y.pos").distinct()
    assert sorted(map(tuple, pairs.collect())) == [(7, 5000), (8, 5001)]
