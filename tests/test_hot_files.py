"""One long file, one hot group, one exploded table: no task and no driver gets all of it."""

import re

import pytest
from pyspark.sql import functions as F

from oppflow.operators import enrich, matching, quality
from oppflow.operators.ranks import with_rank
from oppflow.session import BROADCAST, configure
from oppflow.sources import lines, tables

N = 200_000


def _join_tasks(spark, df):
    """Rows of the largest partition, without any rule that splits or merges partitions at run time."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return max(r[1] for r in df.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        configure(spark)


@pytest.fixture
def shuffled(spark):
    before = spark.conf.get(BROADCAST)
    spark.conf.set(BROADCAST, "-1")
    yield spark
    spark.conf.set(BROADCAST, before)


def _text(spark, header, line):
    head = spark.createDataFrame([("f", k + 1, h) for k, h in enumerate(header)], "file string, line_no bigint, line string")
    return head.unionByName(spark.range(len(header) + 1, N + 1).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), F.expr(line).alias("line")))


def test_lines_of_one_file_meet_its_header_in_several_tasks(shuffled):
    tracker = _text(shuffled, ["| # | Date | Company | Role | Score | Status |", "|---|---|---|---|---|---|"],
                    "concat('| ', id, ' | 2024-01-02 | c | r | 4/5 | Applied |')")
    history = _text(shuffled, ["url\tfirst_seen\ttitle\tcompany"], "concat('https://x/', id, '\t2024-01-02\tt\tc')")
    outcomes = _text(shuffled, ["company\tdate"], "'c\t2024-01-02'")
    rows = _text(shuffled, ["| Date | Company |"], "'| 2024-01-02 | c | x |'")
    for df, n in ((lines.read_tracker(tracker), N - 2), (tables.parse_history(history), N - 1),
                  (tables.parse_outcomes(outcomes), N - 1), (quality.row_format(rows), N - 1)):
        assert df.count() == n
        assert _join_tasks(shuffled, df) < 0.8 * N


def test_lines_without_number_or_header(spark):
    rows = spark.createDataFrame([("f", None, 1), ("f", 70_000, 2), ("g", 1, 3), (None, 1, 4)], "file string, line_no bigint, k long")
    header = spark.createDataFrame([("f", "a"), ("f", "b"), (None, "c")], "file string, h string")
    for how in ("inner", "left"):
        want = rows.join(header, "file", how).select("k", "h").collect()
        assert sorted(map(str, lines.with_header(rows, header, how).select("k", "h").collect())) == sorted(map(str, want))


def test_ranks_of_a_hot_group_stay_dealt_out(shuffled):
    df = shuffled.range(N).select((F.col("id") * 7 % N).alias("v"), F.expr("CASE WHEN id % 50 = 0 THEN CASE WHEN id % 100 = 0 THEN 'a' END ELSE 'hot' END").alias("g"))
    ranked = with_rank(df, ["v"], "rank", ["g"])
    assert _join_tasks(shuffled, ranked) < 0.8 * N
    per = ranked.groupBy("g").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count("*").alias("n"), F.count_distinct("rank").alias("d")).collect()
    assert sorted((str(r.g), r.lo, r.hi, r.n, r.d) for r in per) == [
        ("None", 1, N // 100, N // 100, N // 100), ("a", 1, N // 100, N // 100, N // 100), ("hot", 1, N * 49 // 50, N * 49 // 50, N * 49 // 50)]
    assert ranked.alias("x").join(ranked.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.rank") + 1 == F.col("y.rank"))).filter("x.v >= y.v").count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_tables_are_not_broadcast(spark):
    apps = spark.createDataFrame([("acme", "alpha beta beta"), ("acme", "gamma delta"), ("acme", None)], "company string, role string")
    cands = spark.createDataFrame([("acme", "gamma", 1), ("acme", "beta alpha", 2), ("acme", "delta gammas", 3)], "company string, title string, pos long")
    found = enrich.best_role_match(apps, cands)
    assert sorted((r.role or "", r.best_pos) for r in found.collect()) == [("", 1), ("alpha beta beta", 2), ("gamma delta", 3)]
    same = matching.first_same_role(apps.select(F.col("company").alias("block"), "role"), cands.select(F.col("company").alias("block"), "title", "pos").withColumnRenamed("title", "role"), "block", "role", ["pos"])
    for df in (found, same):
        assert "SortMergeJoin [block" in _plan(df)
        assert not re.search(r"BroadcastHashJoin \[block#\d+, (?:part|word|title_word)#", _plan(df))


def test_a_guessed_size_broadcasts_little(spark):
    assert spark.conf.get(BROADCAST) == "1m"
    other = spark.newSession()
    other.conf.set(BROADCAST, "256k")
    assert configure(other).conf.get(BROADCAST) == "256k"
