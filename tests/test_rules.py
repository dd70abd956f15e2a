"""Literal cases of the classification rules and scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from oppflow.functions import classify as C
from oppflow.functions import stats as S
from oppflow.functions import text as T


def column(spark, values, schema, *exprs):
    df = spark.createDataFrame(values, schema)
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_status_cells(spark):
    cases = {
        "": "evaluated", "  ": "evaluated", "✅": "applied", "📬": "responded", "🎯": "interview",
        "💰": "offer", "❌": "rejected", "🚫": "discarded", "👻": "ignored", "⏭️": "skip", "⏭": "skip",
        "Applied": "applied", "aplicado 2026-03-12": "applied", "**Rejected**": "rejected",
        "monitor": "skip", "ghosted": "ignored", "foo": "foo", "GEO BLOCKER": "skip", "Hold": "evaluated",
    }
    rows = column(spark, [(c,) for c in cases], "c string", "c", C.normalize_status("c"))
    assert dict(rows) == cases


def test_written_and_repaired_status(spark):
    rows = column(
        spark, [(c,) for c in ("pending", "-", "DUP of 3", "nonsense", "entrevista", "❌")], "c string",
        "c", C.write_status("c"), C.repaired_status("c")["cell"], C.repaired_status("c")["note"],
    )
    assert {r[0]: r[1:] for r in rows} == {
        "pending": ("", None, None), "-": ("", "", None), "DUP of 3": ("🚫", "🚫", "DUP of 3"),
        "nonsense": ("", None, None), "entrevista": ("🎯", "🎯", None), "❌": ("❌", "❌", None),
    }


@pytest.mark.parametrize("text,tier,country,reason,keep", [
    ("München, Germany", "S", "germany", "country", True),
    ("Paris | Berlin", "S", "germany", "country", True),
    ("London, UK", "A", "united kingdom", "country", True),
    ("Tel Aviv", "B", "israel", "country", True),
    ("Oslo", "B", "norway", "country", True),
    ("Brussels", "C", "belgium", "country", True),
    ("Remote - EMEA", "S", None, "eu-region", True),
    ("Worldwide", "S", None, "global-remote", True),
    ("Remote - United States", None, None, "outside-scope", False),
    ("Global, US", None, None, "outside-scope", False),
    ("Remote", None, None, "unqualified-remote", True),
    ("", None, None, "no-location", True),
    ("Atlantis", None, None, "unrecognized", False),
    ("Łódź", None, None, "unrecognized", False),
    ("Northern Ireland", "S", "ireland", "country", True),
    ("Cluj-Napoca", "A", "romania", "country", True),
    ("Ra'anana", "B", "israel", "country", True),
    ("Mexico City", None, None, "outside-scope", False),
    ("Austin", None, None, "outside-scope", False),
])
def test_location_tiers(spark, text, tier, country, reason, keep):
    row = column(spark, [(text,)], "l string", C.resolve_tier("l"))[0][0]
    assert (row.tier, row.country, row.reason, row.keep) == (tier, country, reason, keep)


def test_tiers_and_cities_are_parameters(spark):
    tiers = {"S": {"score": 5.0, "countries": ["norway"]}, "A": {"score": 4.0, "eu": True}}
    tier = C.resolve_tier("l", tiers, {"norway": ["bodo"]})
    rows = column(spark, [("Bodø",), ("Bodo",), ("Oslo",), ("Spain",), ("Serbia",)], "l string", "l", tier["tier"])
    assert dict(rows) == {"Bodø": None, "Bodo": "S", "Oslo": None, "Spain": "A", "Serbia": None}


SAME = [
    ("Senior PM, AI", "Senior Product Manager - AI"),
    ("Senior Product Manager - AI", "Senior AI Product Manager"),
    ("AI Senior Product Manager", "AI Senior Product Manager"),
    ("Senior Product Manager", "Product Manager, Senior"),
    ("Senior Product Manager (YouTrack)", "Product Manager, YouTrack"),
]
DISTINCT = [
    ("Product Manager - Infrastructure Monitoring", "AI Senior Product Manager"),
    ("Product Manager - Infrastructure Monitoring", "Product Manager - Cybersecurity & AI"),
    ("Senior Product Manager, AI Agents (Config & Personalization)", "Senior Product Manager, AI Agents Testing"),
    ("Senior Product Owner AI Platform", "Senior Product Owner Data Platform"),
    ("AI Product Manager (m/f/d)", "(Senior) PO Agentic AI B2B"),
]


@pytest.mark.parametrize("a,b,same", [(*p, True) for p in SAME] + [(*p, False) for p in DISTINCT])
def test_role_match(spark, a, b, same):
    if (a, b) == SAME[3]:
        assert not column(spark, [(a, b)], "a string, b string", T.role_tokens("a"))[0][0]
    got = column(spark, [(a, b), (b, a)], "a string, b string", T.role_fuzzy_match("a", "b"))
    assert got == [(same,), (same,)]


def test_liveness(spark):
    long = "x " * 200
    cases = [
        (200, "u", "The job you are looking for is no longer open.", [], "expired"),
        (200, "u", "663 JOBS FOUND " + long, ["Apply for this Job"], "active"),
        (404, "u", long, ["Apply"], "expired"), (200, "u?error=true", long, ["Apply"], "expired"),
        (200, "u", "x" * 200, [], "expired"), (200, "u", "x" * 400, [], "uncertain"),
        (200, "u", "663 jobs found " + long, ["Reapplying"], "expired"),
        (200, "u", long + " OFFRE EXPIRÉE", [], "expired"), (None, None, None, None, "expired"),
    ]
    rows = column(
        spark, cases, "s int, u string, b string, c array<string>, want string",
        C.classify_liveness("s", "u", "b", "c")["result"], "want",
    )
    assert all(got == want for got, want in rows), rows


def test_report_classes(spark):
    sizes = {"": "unknown", "12 people": "startup", "50-400": "scaleup", "1,200": "enterprise",
             "a, small team": "enterprise", "small elite": "startup", "global": "enterprise", "x": "unknown"}
    assert dict(column(spark, [(s,) for s in sizes], "s string", "s", C.classify_company_size("s"))) == sizes
    remote = {"US-only": "geo-restricted", "Hybrid remote": "hybrid/onsite", "work from anywhere": "global remote",
              "Remote": "regional remote", "Argentina remote only": "geo-restricted", "": "unknown"}
    assert dict(column(spark, [(s,) for s in remote], "s string", "s", C.classify_remote("s"))) == remote
    gaps = [("Python", "hard", "stack-mismatch"), ("Python", "nice to have", None), ("visa and python", "hard", "geo-restriction"),
            ("Director", "high", "seniority-mismatch"), ("relocat", "high", "onsite-requirement"), ("French", "high", "other")]
    assert all(r[0] == r[1] for r in column(spark, gaps, "d string, s string, w string", C.classify_blocker("d", "s"), "w"))
    tech = column(spark, [("C++, C# and .NET; react native, node.js, Go",)], "t string", C.extract_tech_terms("t"))[0][0]
    assert tech == ["React", "Node.js", "Go"]


def test_statistics(spark):
    rows = column(spark, [(0, 0), (0, 10), (1, 10), (10, 10)], "k int, n int", *[F.round(c, 4) for c in S.wilson("k", "n")])
    assert rows == [(0.0, 0.0), (0.0, 0.2775), (0.0179, 0.4042), (0.7225, 1.0)]
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 5.0)], "x double, y double")
    assert df.agg(S.pearson("x", "y")).first()[0] == 0.0
    assert df.limit(1).agg(S.pearson("x", "y")).first()[0] == 0.0
    assert df.limit(0).agg(S.pearson("x", "y")).first()[0] == 0.0
    assert df.agg(S.percent(F.lit(1), F.lit(0))).first()[0] == 0


def test_cadence(spark):
    cases = [
        ("applied", 6, None, 0, "waiting"), ("applied", 7, None, 0, "overdue"), ("applied", 3, 1, 2, "cold"),
        ("applied", 30, 7, 1, "overdue"), ("applied", 30, 6, 1, "waiting"), ("responded", 0, None, 0, "urgent"),
        ("responded", 2, None, 0, "waiting"), ("responded", 3, None, 0, "overdue"),
        ("interview", 1, None, 0, "overdue"), ("interview", 0, None, 0, "waiting"),
    ]
    rows = column(spark, cases, "s string, d int, l int, n int, w string", C.follow_up_urgency("s", "d", "l", "n"), "w")
    assert all(a == b for a, b in rows), rows
    day = dt.date(2026, 1, 1)
    rows = column(
        spark, [("applied", day, None, 0), ("applied", day, day, 1), ("applied", day, day, 2),
                ("responded", day, None, 0), ("interview", day, day, 1), ("offer", day, None, 0)],
        "s string, a date, l date, n int", C.next_follow_up_date("s", "a", "l", "n"),
    )
    assert [r[0] and (r[0] - day).days for r in rows] == [7, 7, None, 3, 1, None]


def test_text_functions(spark):
    def one(expr, **cols):
        return column(spark, [tuple(cols.values())], ", ".join(f"{k} string" for k in cols), expr)[0][0]

    assert one(T.decode_entities("a"), a="&amp;lt; &#39;a&#x1F600;b &#8212;&nbsp; x&foo;") == "&lt; 'a😀b — x&foo;"
    assert one(T.ats_normalize("a"), a='<p title="—">a—b…</p><style>—</style> “c” <x —') == \
        '<p title="—">a-b...</p><style>—</style> "c" <x —'
    assert one(T.company_base("a"), a=" Acme Technologies Inc.") == "acme"
    assert one(T.company_key("a"), a="n8n.io") == one(T.company_key("a"), a="N8N io") == "n8nio"
    assert one(T.normalize_role("a"), a="Sr. PM (m/w/d), TPM") == "senior product manager technical product manager"
    assert one(T.group_title("a"), a="Lead PM (Remote) – US") == "lead pm"
    assert one(T.report_path("a", F.lit("data")), a="[12](../reports/12-a.md)") == "reports/12-a.md"
    assert one(T.report_path("a", F.lit("data")), a="none") is None
    assert one(T.parse_score("a"), a="**4.1/5**") == 4.1 and one(T.parse_score("a"), a="DUP") == 0.0
    assert one(T.parse_score_loose("a"), a=".5") == 0.5 and one(T.parse_score_loose("a"), a="N/A") == 0.0
    assert one(T.truncate("a", 5), a="abcdef") == "abcd…" and one(T.truncate("a", 6), a="abcdef") == "abcdef"
    assert one(T.split_row("a"), a="| a \\| b | c |") == ["", "a | b", "c", ""]
    contacts = one(T.extract_contacts("a"), a="contact: Jane Doe at jane@x.io; bob@y.com")
    # The first name before an address counts, even if another address comes between.
    assert [(c.email, c.name) for c in contacts] == [("jane@x.io", "Jane Doe"), ("bob@y.com", "Jane Doe")]
    assert one(T.extract_contacts("a"), a="write bob@y.com")[0].name is None
    url = "https://de.linkedin.com/jobs/view/pm-at-x-1234567?trk=1"
    assert one(T.dedup_keys("a"), a=url) == [url, "li:1234567"]
    assert one(T.url_key("a", True), a="https://x.io/a//") == "https://x.io/a"
    assert one(T.harvested_urls("a"), a="see https://x.io/a, (https://y.io/b).") == ["https://x.io/a", "https://y.io/b"]
    assert str(one(T.to_posted_date("a"), a="1700000000000")) == "2023-11-14"
    assert str(one(T.to_posted_date("a"), a="2024-01-31T23:30:00-05:00")) == "2024-02-01"
    assert one(T.to_posted_date("a"), a="soon") is None
    assert str(one(T.effective_applied_date("a", F.lit("2026-01-01").cast("date")),
                   a="Applied 2026-02-01, applied on 2026-03-01")) == "2026-03-01"
    assert one(T.iso_week(F.col("a").cast("date")), a="2027-01-01") == "2026-W53"


def test_titles(spark):
    rows = column(spark, [("Senior PM, Platforms & AI",), ("Praktikant",), ("Cook",)], "t string", C.detect_lanes("t"))
    assert [r[0] for r in rows] == [["Platform", "AI"], [], []]
    flt = dict(role_gate=["manager"], negative=["junior"], positive=["ai"])
    rows = column(spark, [("AI Engineer",), ("Junior AI Manager",), ("AI Manager",), ("Manager",), (None,)],
                  "t string", C.classify_title("t", **flt))
    assert [r[0] for r in rows] == ["reject", "reject", "pass", "generic", "reject"]
    assert column(spark, [("anything",)], "t string", C.classify_title("t")) == [("pass",)]
    rows = column(spark, [("Findr",), ("Acme Talent",), ("Talented",), ("Best Jobs",), ("Jobs Ltd",)], "c string", C.is_agency("c"))
    assert [r[0] for r in rows] == [True, True, False, True, False]


def test_no_length_is_special(spark):
    """Words, entities and terms of any length, and the cities that were once left out."""
    from oppflow.functions import classify as C
    from oppflow.functions import text as T
    from oppflow.operators.enrich import best_role_match

    long = "x" * 70
    apps = spark.createDataFrame([("Acme", f"{long} beta")], "company string, role string")
    titles = spark.createDataFrame([("Acme", "other", 1), ("Acme", f"{long}, lead", 2)], "company string, title string, pos long")
    assert [r.best_pos for r in best_role_match(apps, titles).collect()] == [2]
    entity = "&#" + "0" * 45 + "65;"
    row = spark.createDataFrame([(entity + "&#x" + "0" * 50 + "42;",)], "t string").select(T.decode_entities("t").alias("d")).first()
    assert row.d == "AB"
    cities = [("Jena", "S"), ("St. Gallen", "A"), ("Winterthur", "A"), ("Turku", "B"), ("Naples", "B"), ("Mechelen", "C")]
    places = spark.createDataFrame([(c,) for c, _ in cities], "location string").select(
        "location", C.resolve_tier("location").alias("t")).collect()
    assert [(r.location, r.t.reason, r.t.keep) for r in places] == [(c, "country", True) for c, _ in cities]


def test_views_keep_every_row(spark, sf_dir):
    from oppflow.plans.views import spark_view, table

    for view, name in (("outcome", "orders"), ("followup", "lineitem"), ("history", "lineitem"),
                       ("exclusion", "customer"), ("addition", "orders"), ("posting", "orders"), ("app", "orders")):
        assert spark_view(spark, sf_dir, view).count() == table(spark, sf_dir, name).count(), view


def test_lint_by_kind(spark):
    from oppflow.operators.corpus import lint_documents

    text = "Senior Product Manager, AI — x\n## Experience\n### Acme | PM\nnone"
    rows = [(1, text, "cv.md"), (2, text, "Cover Letter x.md"), (3, text, "cv.HTML"), (4, text, None)]
    found = lint_documents(spark.createDataFrame(rows, "doc_id long, text string, name string"), name="name").collect()
    labels = {i: sorted(r.label for r in found if r.doc_id == i) for i in range(1, 5)}
    every = ["DASH_IN_MD", "MISSING_PRODUCT_SUBTITLE", "TITLE_WITH_PRODUCT"]
    assert labels == {1: every, 2: every[:2], 3: every[2:], 4: every}


def test_lint_forms_find_what_the_rules_find(spark):
    """Forms that are faster to search for have the first finding of the rule itself, and texts they cannot be in are passed over."""
    import random
    import re

    from oppflow.functions import fixed
    from oppflow.operators import corpus
    from oppflow.plans.q_rules import LINT, LINT_FORMS

    pieces = ["the", "The The", " ", " ", "\n", "ab", "Z", "_", "é", "12", "2021", "1,234", "12.345+", "systems", "repos", "@", ".", "ab.de", "robust",
              "Best practices", "robustness", "Strong match for", "strongly", "--", " driving", "–", "—", "Jan 2020", "Present", "`", "Sr", "### A | b", "\n## Experience\n", "11:", "#"]
    rng = random.Random(7)
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(3000)] + [None]
    found = corpus.lint_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rules=LINT, forms=LINT_FORMS).collect()
    got = {(r.doc_id, r.label): r.sample for r in found if r.label != "MISSING_PRODUCT_SUBTITLE"}

    def plain(text):
        ranges = re.sub(rf"({corpus.DAY})\s*[–—]\s*({corpus.DAY}|Present|present)", r"\1-\2", text, flags=re.A)
        return re.sub(r"`[^`\n]*`", "``", ranges)

    want = {(i, label): m.group()[:80] for i, t in enumerate(texts[:-1]) for label, p in LINT if (m := re.search(p, t, re.A))}
    want |= {(i, "DASH_IN_MD"): d[:80] for i, t in enumerate(texts[:-1]) if re.search("[–—]", d := plain(t))}
    assert got == want and {label for _, label in got} >= {"REPEATED_THE", "ADDRESS", "LONG_NUMBER", "INTERNAL_NUMBERS", "CLICHE_VERBS", "DASH_IN_MD"}
    for label, pattern in LINT:  # no place costs a look back before it has a character that a finding begins with
        form = corpus.ascii_bounds((corpus.FORMS | LINT_FORMS).get(pattern, (None, pattern))[1])
        assert label == "ADDRESS" or not form.removeprefix("(?i)").startswith("(?<"), label
    assert dict(fixed.LINT_RULES).items() <= dict(LINT).items()


def test_roles_are_folded_in_four_patterns(spark):
    from oppflow.functions.text import normalize_role

    rows = [("Sr. PM (m/w/d)/TPM pm_x PO-jr.",), ("PM pm PM",), ("m (m/w) / w",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(normalize_role("t")).collect()]
    assert got == ["senior product manager technical product manager pm x product owner junior",
                   "product manager product manager product manager", "", ""]
    assert str(normalize_role("t")).count("regexp_replace") <= 4
