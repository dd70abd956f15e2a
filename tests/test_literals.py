"""Many literals at once: the same as testing each on each line, and no line-by-literal product."""

import random

from pyspark.sql import functions as F

from oppflow.operators import literals as L


def brute(docs, wanted):
    return sorted(
        (i, n, p) for i, text in docs if text is not None for n, line in enumerate(text.split("\n"), 1)
        for p in {w for w in wanted if w} if p in line
    )


def rows_of(df):
    return sorted((r.doc_id, r.line_no, r.pattern) for r in df.collect())


def test_equals_each_on_each(spark):
    rng = random.Random(5)
    letters = "aab bc.\n$(é漢😀"
    docs = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 200)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "aab" * 3000), (3, docs[3][1]), (203, "\n\n")]
    wanted = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    wanted += [None, "", "aab", "aab", "aabaab\n", "never here at all", "😀", "a" * 50]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id int, text string, source string, line_no int")
    given = spark.createDataFrame([(w, "x") for w in wanted], "pattern string, line string")
    assert rows_of(L.scan_many(df.drop("line_no"), given)) == brute(docs, wanted)
    assert rows_of(L.scan_many(df, given, gram=3)) == brute(docs, wanted)


def test_allowed_and_empty(spark):
    df = spark.createDataFrame([(1, "abcdefgh", "src1"), (2, "abcdefgh", None)], "doc_id int, text string, source string")
    given = spark.createDataFrame([("cdefgh",)], "pattern string")
    assert rows_of(L.scan_many(df, given, allow=["src1"])) == [(2, 1, "cdefgh")]
    assert rows_of(L.scan_many(df, given.limit(0))) == []
    assert rows_of(L.scan_many(df.limit(0), given)) == []


def test_ten_thousand_literals_meet_few_lines(spark):
    df = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"),
        F.concat(F.lit("the user name is user"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("@mail")).alias("text"),
    )
    given = spark.range(10_000).select(F.concat(F.lit("user"), F.lpad((F.col("id") * 2).cast("string"), 6, "0")).alias("pattern"))
    found = L.scan_many(df, given)
    assert rows_of(found) == [(i, 1, f"user{i:06d}") for i in range(0, 4000, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan


def test_a_piece_of_a_line_never_carries_the_line(spark):
    """A line used to be shuffled with every piece of it: 40,000 characters as often as they have pieces."""
    import re

    line = " ".join(f"w{i}" for i in range(8000))
    df = spark.createDataFrame([(1, line, "s"), (1, line, "s"), (1, "w1 w2", "s"), (None, "x😀abc w7 w8", "s")], "doc_id int, text string, source string")
    wanted = [line[i:i + 5 + i % 30] for i in range(0, len(line) - 40, 97)] + ["?abc", "\ufffdabc", "😀abc", " w5 w6 w7 w8 w9 w10 w11 w12"]
    found = L.scan_many(df, spark.createDataFrame([(w,) for w in wanted], "pattern string"))
    docs = [(1, line), (1, line), (1, "w1 w2"), (None, "x😀abc w7 w8")]
    assert sorted(map(str, rows_of_any(found))) == sorted(map(str, brute_any(docs, wanted)))
    short = L.scan_many(df, spark.createDataFrame([(w,) for w in wanted if len(w) <= L.GRAM], "pattern string"))
    plan = short._jdf.queryExecution().executedPlan().toString().split("\n")
    exploded = [n for n in plan if "Generate explode" in n and re.search(r"\[_piece#\d+\]$", n)]
    assert exploded and all(re.search(r", \[doc_id#\d+L?, line_no#\d+L?\], false, ", n) for n in exploded)


def rows_of_any(df):
    return [(r.doc_id, r.line_no, r.pattern) for r in df.collect()]


def brute_any(docs, wanted):
    return [(i, 1, p) for i, text in docs for p in set(wanted) if p in text]
