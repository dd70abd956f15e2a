"""Rows that exclude one another in long chains, against the rule run row after row."""

import random

import pytest

from oppflow.operators import dedup

SCHEMA = "pos long, key string, small boolean"


def sequential(rows):
    by_pos = {}
    for pos, key, small in rows:
        by_pos.setdefault(pos, []).append((key, small))
    taken, held, held_small = [], set(), set()
    for pos in sorted(by_pos):
        if not any(k in held_small or (s and k in held) for k, s in by_pos[pos]):
            taken.append(pos)
            held.update(k for k, _ in by_pos[pos])
            held_small.update(k for k, s in by_pos[pos] if s)
    return taken


def taken(spark, rows):
    return sorted(r.pos for r in dedup.greedy_first(spark.createDataFrame(rows, SCHEMA)).collect())


def test_a_chain_of_200_000_rows(spark, monkeypatch):
    written, real = [], dedup.durable
    monkeypatch.setattr(dedup, "durable", lambda df: written.append(df) or real(df))
    members = spark.range(200_000).selectExpr("id AS pos", "explode(array(id, id + 1)) AS n").selectExpr(
        "pos", "concat('k', n) AS key", "true AS small")
    odd = dedup.greedy_first(members).selectExpr("count(*) AS n", "max(pos % 2) AS odd", "count(DISTINCT pos) AS d").first()
    assert (odd.n, odd.odd, odd.d) == (100_000, 0, 100_000)
    assert len(written) <= 60
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in written]
    assert not any("Python" in p or "Pandas" in p for p in plans)


@pytest.mark.parametrize("reach", [2, 3, 4])
def test_chains_in_which_a_row_excludes_several(spark, monkeypatch, reach):
    monkeypatch.setattr(dedup, "ROUNDS_BEFORE_GROUPS", 0)
    rows = [(i, f"k{i + d}", True) for i in range(60) for d in range(reach)]
    assert taken(spark, rows) == sequential(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_rows_with_a_hot_key(spark, monkeypatch, seed):
    monkeypatch.setattr(dedup, "ROUNDS_BEFORE_GROUPS", seed)
    rng = random.Random(seed)
    rows = []
    for pos in rng.sample(range(-500, 5000), 400):
        keys = {f"k{rng.randrange(250)}" for _ in range(rng.randint(1, 3))} | ({"hot"} if rng.random() < 0.33 else set())
        rows += [(pos, key, rng.random() < (0.05 if key == "hot" else 0.6)) for key in keys]
    rows += rng.sample(rows, 40)  # the same row twice under a key
    assert taken(spark, rows) == sequential(rows)
