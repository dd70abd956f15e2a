"""Mixing: targets against a sequential model, words near their targets, reruns agree."""

import random
import re
from collections import Counter
from fractions import Fraction

import pyarrow as pa
import pytest

from oppflow.llm.mixing import _round_cells, mix_sources, pivot
from oppflow.llm.queries import QUERIES


def slow_targets(sizes, weights=(1, 2, 3), most=3):
    """Targets of sources by size: whoever is above the limit is set to it, the rest shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = Fraction(sum(sizes.values())), set(names), {}
    while True:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not above or not left:
            return {**target, **{s: float(left * weight[s] / total) for s in open_}}
        for s in above:
            target[s] = float(most * sizes[s])
        left -= sum(most * sizes[s] for s in above)
        open_ -= set(above)


def check(rows, got, most=3):
    """``rows`` of (id, source, size) and what the operator makes of them; returns the words taken by source."""
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=str) == sorted(rows, key=str)
    sizes, largest = Counter(), {}
    for _, source, size in rows:
        sizes[source] += size
        largest[source] = max(largest.get(source, 0), size)
    targets, taken = slow_targets({s: sizes[s] for s in largest}, most=most), Counter()
    for r in got:
        assert r.taken == r.size * r.copies and 0 <= r.copies <= most
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source], rel=1e-12)
        taken[r.source] += r.taken
    for source in largest:
        assert abs(taken[source] - targets[source]) <= largest[source] / 2 + 1e-6
    return taken, targets


def documents(spark, rows):
    made = [(i, source, " ".join(["w"] * size) or None, "x") for i, source, size in rows]
    return spark.createDataFrame(made, "doc_id long, source string, text string, size string")


@pytest.mark.parametrize("seed", range(3))
def test_random_sources(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "B", "ä", "z", "\U0001f600", "ﬁ"]
    rows = []
    for i in range(3000):
        source = "a" if i % 3 == 0 else rng.choice(names)
        rows.append((i, source, rng.choice([0, 1, 2, 5, 40, rng.randrange(200)])))
    docs = documents(spark, rows)
    got = mix_sources(docs, cell_rows=16).collect()
    taken, targets = check(rows, got)
    assert sum(abs(taken[s] - targets[s]) for s in targets) < 0.01 * sum(targets.values())
    # The same whatever the partitions; another seed takes others.
    again = mix_sources(docs.repartition(7), cell_rows=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(map(str, got)) != sorted(map(str, mix_sources(docs, cell_rows=16, seed=1).collect()))


def test_every_document_keeps_its_mean():
    """Over many hashes a document takes one more copy as often as its fraction says, and words stay."""
    rng, size, times = random.Random(6), [3 + i % 7 for i in range(40)], 1500
    took = Counter()
    for _ in range(times):
        batch = pa.RecordBatch.from_pydict({
            "id": list(range(40)), "source_no": [0] * 40, "cell": [0] * 20 + [1] * 20, "size": size,
            "hash": [rng.randrange(-2**63, 2**63) for _ in size], "extra": [0] * 40, "open": [0.3] * 20 + [0.8] * 20,
        })
        rows = [r for out in _round_cells(iter([batch.slice(0, 7), batch.slice(7)])) for r in out.to_pylist()]
        assert len(rows) == 40 and sum(r["open"] > 0 for r in rows) <= 2
        for cell, fraction in ((0, 0.3), (1, 0.8)):
            words = sum(r["size"] * (r["extra"] + r["open"]) for r in rows if r["cell"] == cell)
            assert words == pytest.approx(fraction * sum(size[20 * cell:20 * cell + 20]))
        took.update({r["id"]: r["extra"] + r["open"] for r in rows})
    assert all(abs(took[i] / times - (0.3 if i < 20 else 0.8)) < 0.06 for i in range(40))


def test_limits_and_small_sources(spark):
    # Source c weighs 3 but has little: it stops at three times its words, the rest goes to a and b.
    rows = [(i, "a", 10) for i in range(50)] + [(100 + i, "b", 10) for i in range(50)] + [(200, "c", 7)]
    taken, targets = check(rows, mix_sources(documents(spark, rows)).collect())
    assert taken["c"] == 21 and targets["c"] == 21.0
    only = [(1, None, 5)]
    assert [r.taken for r in mix_sources(documents(spark, only)).collect()] == [5]


def test_defined_cases(spark):
    empty = [(1, "a", 0), (2, None, 0), (None, "a", 0)]
    assert {(r.taken, r.target) for r in mix_sources(documents(spark, empty)).collect()} == {(0, 0.0)}
    assert mix_sources(documents(spark, [])).count() == 0
    rows = [(7, "a", 3)] * 9000 + [(8, "b", 5)] * 500 + [(None, "b", 4)] * 3 + [(9, None, 11)]
    check(rows, mix_sources(documents(spark, rows)).collect())


def test_pivot_moves_words_only():
    rng = random.Random(2)
    for _ in range(1000):
        v, w = rng.randrange(1, 50), rng.randrange(1, 50)
        p, q = rng.uniform(0.01, 0.99), rng.uniform(0.01, 0.99)
        a, b = pivot((v, p), (w, q), rng.random())
        assert v * a + w * b == pytest.approx(v * p + w * q) and min(a, b, 1 - a, 1 - b) < 1e-12
    gives, takes = min(3 * 0.3, 5 * 0.4), min(5 * 0.6, 3 * 0.7)
    means = [pivot((3, 0.3), (5, 0.6), (i + 0.5) / 10000) for i in range(10000)]
    assert sum(a for a, _ in means) / 10000 == pytest.approx(0.3, abs=1e-3) and gives > 0 < takes


def test_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in table]
    check(rows, QUERIES["op13_mixing"](spark, sf_dir).collect())
