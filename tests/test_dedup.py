"""Order-dependent operators against a sequential model, on random and skewed rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.operators import dedup, enrich, matching, merge, queues, ranks, seen, triage


def sequential_first_wins(rows):
    taken, out = set(), []
    for pos, *keys in sorted(rows):
        named = [(i, k) for i, k in enumerate(keys) if k is not None]
        if not any(k in taken for k in named):
            taken.update(named)
            out.append(pos)
    return out


@pytest.mark.parametrize("rows", [
    [(1, "u1", "r1"), (2, "u1", "r2"), (3, "u3", "r2")],
    [(1, "u1", "r1"), (2, "u2", "r1"), (3, "u2", "r3")],
    [(i, f"u{i}", f"r{(i + 1) // 2}") for i in range(1, 15)],
])
def test_first_wins_examples(spark, rows):
    df = spark.createDataFrame(rows, "pos long, u string, r string")
    assert sorted(r.pos for r in dedup.first_wins(df, ["u", "r"]).collect()) == sequential_first_wins(rows)


def test_first_wins_random_and_hot(spark):
    rng = random.Random(7)
    rows = [(i, "hot" if rng.random() < 0.4 else f"u{rng.randrange(300)}",
             None if rng.random() < 0.1 else f"r{rng.randrange(200)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "pos long, u string, r string")
    assert sorted(r.pos for r in dedup.first_wins(df, ["u", "r"]).collect()) == sequential_first_wins(rows)


def bag_of(role):
    words = role.lower().replace("(", " ").replace(")", " ").split()
    return [w for w in words if len(w) > 2 and w not in fixed.DEDUP_STOPWORDS]


def overlaps(a, b):
    x, y = bag_of(a), bag_of(b)
    if not x or not y:
        return False
    shared = sum(w in y for w in x)
    return shared >= 2 and shared / min(len(x), len(y)) >= 0.6


def sequential_clusters(rows):
    """rows: (pos, company, role); returns {pos: seed}"""
    seeds, out = {}, {}
    for pos, company, role in sorted(rows):
        for seed, seed_role in seeds.get(company, []):
            if overlaps(seed_role, role):
                out[pos] = seed
                break
        else:
            seeds.setdefault(company, []).append((pos, role))
            out[pos] = pos
    return out


WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "lambda", "zeta", "senior", "eta"]


@pytest.mark.parametrize("seed,longest", [(1, 5), (2, 9), (3, 14)])
def test_clusters_match_sequential_model(spark, seed, longest):
    rng = random.Random(seed)
    extra = [f"word{i}" for i in range(8)] if longest > 9 else []
    rows = [
        (i, "hot" if rng.random() < 0.5 else f"c{rng.randrange(4)}",
         " ".join(rng.choices(WORDS + extra, k=rng.randint(1, longest)))) for i in range(400)
    ]
    df = spark.createDataFrame(rows, "pos long, company string, role string").withColumn("file", F.lit("live"))
    got = {r.pos: r.seed for r in dedup.cluster_of(df).collect()}
    assert got == sequential_clusters(rows)


def test_dedup_keeps_best_score_and_most_advanced_status(spark):
    rows = [(1, "Acme", "Platform Catalog Owner", "3.0", "applied", "f"), (2, "Acme", "Owner Platform Catalog", "4.0", "evaluated", "f"),
            (3, "Acme", "Catalog Platform", "4.0", "offer", "f"), (4, "Acme", "Storage", "1.0", "", "f"),
            (5, "Acme", "Platform Catalog", "4.5", "", "g")]
    df = spark.createDataFrame(rows, "pos long, company string, role string, score string, status string, file string")
    kept, removed = dedup.dedup_clusters(df)
    assert {(r.pos, r.status, r.cluster_size) for r in kept.collect()} == {(2, "offer", 3), (4, "", 1), (5, "", 1)}
    assert {(r.pos, r.kept_pos) for r in removed.collect()} == {(1, 2), (3, 2)}


def test_shared_word_thresholds():
    for n in range(2, 9):
        need = matching.shared_words_needed(n)
        assert need >= 2 and need / n >= 0.6 and (need == 2 or (need - 1) / n < 0.6)


def fuzzy(a, b):
    def tokens(s):
        words = "".join(c if c.isalnum() else " " for c in s.lower()).split()
        return {w for w in words if len(w) >= 2 and not w.isdigit() and w not in fixed.ROLE_STOPWORDS}, sorted(words)

    (x, sx), (y, sy) = tokens(a), tokens(b)
    if not x or not y:
        return bool(sx) and sx == sy
    return x == y or ((x < y or y < x) and min(len(x), len(y)) >= 2)


def test_first_same_role_matches_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = WORDS + ["product", "manager", "ai"] + [f"w{i}" for i in range(6)]
    titles = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 16 if i % 20 == 0 else 5))) for i in range(160)]
    q = spark.createDataFrame([("b", t) for t in titles[:80]], "block string, role string")
    t = spark.createDataFrame([("b", x, i) for i, x in enumerate(titles[80:])], "block string, role string, pos long")
    found = matching.first_same_role(q, t, "block", "role", ["pos"])
    got = {r.role: r.pos for r in q.withColumn("full", matching.title_signature(F.col("role"))).join(
        found, ["block", "full"], "left").collect()}
    for a in titles[:80]:
        want = next((i for i, b in enumerate(titles[80:]) if fuzzy(a, b)), None)
        assert got[a] == want, (a, got[a], want)


def test_best_role_match_against_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = ["data", "database", "base", "plat", "platform", "form", "cloud", "clouds", "of", "ml"] + [f"w{i}x" for i in range(8)]
    roles = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 14 if i % 10 == 0 else 4))) for i in range(40)]
    titles = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 14 if i % 10 == 0 else 4))) for i in range(60)]
    apps = spark.createDataFrame([("Acme Inc.", r) for r in roles] + [("Nobody", "data")], "company string, role string")
    cands = spark.createDataFrame([("acme", t, i) for i, t in enumerate(titles)], "company string, title string, pos long")
    got = {r.role: r.best_pos for r in enrich.best_role_match(apps, cands).filter("block = 'acme'").collect()}
    for role in roles:
        scores = [sum(len(w) > 2 and w in t for w in role.split()) for t in titles]
        assert got[role] == scores.index(max(scores)), role


LIVE = "pos long, date date, company string, role string, fit double, odds double, priority double, status string, output string, report string, location string, notes string, url string"


def test_merge_rules(spark):
    day = dt.date(2026, 8, 1)

    def row(pos, company, role, priority, report=""):
        return (pos, day, company, role, 3.0, 3.0, priority, "✅", "-", report, "Wien", "old", "u")

    live = spark.createDataFrame([row(1, "Northwind", "AI Senior Product Manager", 4.1, "[318](r)"), row(2, "Other", "PM, Search", 2.0, "[319](r)")], LIVE)
    archive = spark.createDataFrame([row(9, "Closed", "PM, Ads", 2.0)], LIVE)
    adds = [(400, "Northwind", "Senior PM - AI", 3.4, ""), (402, "Northwind", "Senior PM, AI", 4.6, ""), (403, "Northwind", "PM AI", 4.8, ""),
            (404, "Closed", "Ads PM", 4.9, ""), (405, "New", "PM, Maps", 3.0, ""), (406, "New", "PM, Maps", 3.0, ""),
            (407, "Third", "PM, Search", 3.0, "[319](r)"), (408, "northwind", "Something Else", 4.2, "[318](x)")]
    additions = spark.createDataFrame(
        [(n, dt.date(2026, 8, 25), c, r, 4.0, 4.0, p, "", "-", rep, "Linz", "why", "-") for n, c, r, p, rep in adds],
        LIVE.replace("pos long", "file_no long"))
    merged, actions = merge.merge_additions(live, archive, additions)
    got = {r.file_no: (r.action, r.reason) for r in actions.collect()}
    assert got == {400: ("held", "score not higher"), 402: ("updated", "score higher"), 403: ("held", "row already updated"),
                   404: ("held", "archived"), 405: ("inserted", "new role"), 406: ("inserted", "new role"), 407: ("inserted", "new role"),
                   408: ("held", "row already updated")}
    rows = {r.pos: r for r in merged.collect() if r.pos}
    assert rows[1].notes == "Re-eval 2026-08-25 (4.1→4.6). why" and rows[1].date == day and rows[1].location == "Wien"
    assert rows[2].notes == "old" and merged.count() == 5


def test_rank_is_exact_for_hot_keys(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("pos"), F.lit(1).alias("same"))
    got = ranks.with_rank(df, ["same", ranks.desc("pos")], "r", ["k"]).collect()
    for k in (0, 1):
        mine = sorted((r.r, r.pos) for r in got if r.k == k)
        assert [r for r, _ in mine] == list(range(1, len(mine) + 1))
        assert [p for _, p in mine] == sorted((p for _, p in mine), reverse=True)


def tracker(spark, rows):
    schema = "pos long, status string, priority double, odds double, date date, notes string"
    return spark.createDataFrame([(i, s, p, o, dt.date.fromisoformat(d), n) for i, (s, p, o, d, n) in enumerate(rows)], schema)


def order_of(df):
    return [r.pos for r in queues.sort_tracker(df, None).orderBy("queue_rank").collect()]


def test_tracker_order(spark):
    d = "2026-01-01"
    assert order_of(tracker(spark, [(s, 3.0, 3.0, d, "") for s in ("👻", "❌", "⏭️", "✅", "🎯", "")])) == [5, 4, 3, 2, 1, 0]
    assert order_of(tracker(spark, [("", 2.0, 1.0, "2026-03-01", ""), ("", 4.5, 1.0, "2026-01-01", ""), ("", 3.0, 1.0, "2026-06-01", "")])) == [1, 2, 0]
    assert order_of(tracker(spark, [("✅", 5.0, 1.0, "2026-01-01", ""), ("✅", 1.0, 1.0, "2026-06-01", ""), ("✅", 3.0, 1.0, "2026-03-01", "")])) == [1, 2, 0]
    assert order_of(tracker(spark, [("✅", 1.0, 1.0, "2026-05-01", ""), ("✅", 1.0, 1.0, "2026-01-01", "Applied 2026-06-01")])) == [1, 0]
    lanes = [("", 4.9, 1.0, d, "Posted 2026-06-01"), ("", 3.9, 1.0, d, "Posted 2026-08-09"), ("", 4.5, 1.0, d, ""), ("", 4.1, 1.0, d, "posted on 2026-08-08")]
    assert order_of(tracker(spark, lanes)) == [3, 0, 2, 1]
    assert order_of(tracker(spark, [("", 3.0, 1.0, d, "")] * 3)) == [0, 1, 2]
    assert order_of(tracker(spark, [("typo", 1.0, 1.0, d, ""), ("🎯", 5.0, 1.0, d, "")])) == [0, 1]


def test_collapse_lists_three_other_places(spark):
    rows = [(0, "Acme", "PM (Remote)", "Rome", "B"), (1, "acme ", "PM - UK", "Wien", "S"), (2, "Acme", "PM", "Wien", "A"), (3, "Acme", "PM", "", "A"),
            (4, "Acme", "PM", "Graz", "A"), (5, "Acme", "PM", "Linz", None), (6, "Acme", "PM", "Oslo", None), (7, "Beta", "PM", "", None), (8, "Beta", "PM", "", None)]
    df = spark.createDataFrame(rows, "pos long, company string, title string, location string, tier string")
    got = {r.pos: (r.also_posted, r.postings) for r in triage.collapse_openings(df).collect()}
    assert got == {1: ("also posted in Wien; Graz; Rome", 7), 7: ("also posted in 1 other location(s)", 2)}


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "pos long, url string, company string, title string, location string")
    assert dedup.first_wins(empty, ["url", "title"]).count() == 0
    assert seen.new_postings(empty, seen.seen_keys(empty)).count() == 0
    assert order_of(tracker(spark, [])) == []
    apps = spark.createDataFrame([], "pos long, file string, company string, role string, score string, status string")
    assert dedup.dedup_clusters(apps)[0].count() == 0


def test_seen_keys_are_worked_out_once(spark):
    """The joins of new postings read the keys; none of them makes the keys again.  A posting without URL is known by its role only."""
    columns = "pos long, url string, company string, title string"
    job = "https://de.linkedin.com/jobs/view/x-1234567?trk=1"
    known = [(1, "u1", "Acme", "PM"), (2, job, None, "PM"), (3, "", "Beta", ""), (4, None, " Gamma ", "Owner"), (5, "u1", "Acme", "PM")]
    keys = seen.seen_keys(spark.createDataFrame(known[:3], columns), spark.createDataFrame(known[3:], columns))
    assert sorted(map(tuple, keys.collect())) == [
        ("role", "acme::pm"), ("role", "gamma::owner"), ("url", job), ("url", "li:1234567"), ("url", "u1")]
    rows = [(1, "u1", "X", "Y"), (2, "https://www.linkedin.com/jobs/view/1234567", "X", "Y"), (3, "u3", "ACME", "pm "), (4, "u4", "X", "Y"),
            (5, "", "X", "Y"), (6, "u6", None, "PM"), (7, None, "X", "Y"), (8, None, "gamma", "owner")]
    fresh = seen.new_postings(spark.createDataFrame(rows, columns), keys)
    assert sorted(r.pos for r in fresh.collect()) == [4, 5, 6, 7]
    assert "Generate" not in fresh._jdf.queryExecution().optimizedPlan().toString()


def test_a_long_chain_needs_few_tables(spark, monkeypatch):
    """A thousand rows of which each excludes the next."""
    from oppflow.operators import dedup, linked

    written = []
    for module in (dedup, linked):
        real = module.durable
        monkeypatch.setattr(module, "durable", lambda df, real=real: written.append(1) or real(df))
    rows = [(i, f"k{i + d}", True) for i in range(1000) for d in (0, 1)]
    members = spark.createDataFrame(rows, "pos long, key string, small boolean")
    assert sorted(r.pos for r in dedup.greedy_first(members).collect()) == list(range(0, 1000, 2))
    assert len(written) < 40


def test_groups_too_large_for_a_task_stay_with_the_rounds(spark, monkeypatch):
    from oppflow.operators import dedup

    monkeypatch.setattr(dedup, "ROUNDS_BEFORE_GROUPS", 1)
    monkeypatch.setattr(dedup, "SETTLED_MEMBERS", 6)
    rows = [(i, f"a{i + d}", i % 3 > 0) for i in range(12) for d in (0, 1)]
    rows += [(100 + i, f"b{i + d}", True) for i in range(3) for d in (0, 1)]
    members = spark.createDataFrame(rows, "pos long, key string, small boolean")
    taken, held = [], []
    for pos in sorted({p for p, _, _ in rows}):
        mine = [(k, s) for p, k, s in rows if p == pos]
        if not any(k == h and (s or t) for k, s in mine for h, t in held):
            taken.append(pos)
            held += mine
    assert sorted(r.pos for r in dedup.greedy_first(members).collect()) == taken
