"""The SQL functions give what the column functions give, for every function and odd values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from oppflow.functions import classify as C
from oppflow.functions import sql_functions as S

TEXTS = [
    None, "", " ", "**4.5**/5", "[12](../reports/012-x.md)", "a \\| b | c|", "posted 2026-03-01, applied on 2026-03-09",
    "https://de.linkedin.com/jobs/view/x-1234567?trk=1", "https://x.example.com/a//", "1767225600000", "2026-01-05T10:00:00Z",
    "Sr. PM (m/w/d), Platform & API - Germany", "Senior Product Manager, Platform", "Acme Technologies GmbH", "München, Germany",
    "Remote - EMEA", "Łódź", "It's &amp; &#39;q&#39; &lt;b&gt; \\d 'x'", "contact: Jane Roe at jane@example.com", "✅", "Rejected 2026-01-01",
    "aplicado", "Randstad", "remote, global", "series A startup, 50 people", "x" * 80, "a=(b) and(c) or(d) 'in(e)'",
]


@pytest.fixture(scope="module")
def rows(spark):
    S.register_functions(spark)
    pairs = [(i, t, TEXTS[(i * 7 + 3) % len(TEXTS)], dt.date(2026, 1, 1) + dt.timedelta(i)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(pairs, "i int, a string, b string, d date").cache()


def test_every_function_equals_its_column(rows):
    wanted, got = [], []
    for name, (build, types, _) in S.FUNCTIONS.items():
        args = ["d" if t == "date" else "ab"[i] for i, t in enumerate(types)]
        wanted.append(build(*[F.col(x) for x in args]).alias(name))
        got.append(F.expr(f"{S.PREFIX}{name}({', '.join(args)})").alias(name))
    left = rows.orderBy("i").select(*wanted).collect()
    right = rows.orderBy("i").select(*got).collect()
    for name in S.FUNCTIONS:
        assert [r[name] for r in left] == [r[name] for r in right], name


def test_bodies_stay_built_in(spark, rows):
    rows.createOrReplaceTempView("sql_function_rows")
    plan = spark.sql(
        "SELECT i FROM sql_function_rows WHERE opp_normalize_role(a) = opp_normalize_role(b)"
    )._jdf.queryExecution().executedPlan().toString()
    assert "opp_normalize_role" not in plan and "Python" not in plan


def test_own_lists_under_own_name(spark, rows):
    own = {"own_lanes": (lambda a: C.detect_lanes(a, [("Odd 'lane'", ["platform"])]), ["string"], "array<string>")}
    assert S.register_functions(spark, "", own) == ["own_lanes"]
    got = {r.i: r.v for r in rows.selectExpr("i", "own_lanes(a) AS v").collect()}
    assert got[TEXTS.index("Senior Product Manager, Platform")] == ["Odd 'lane'"]
