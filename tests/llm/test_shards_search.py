"""Sharding and top-k search against brute force."""

import math
import random
import zlib

import numpy as np
import pytest

from oppflow.llm import top_k as search
from oppflow.llm.sharding import bounds, ring_points, ring_shards, walk
from oppflow.llm.top_k import top_k
from pyspark.sql import functions as F


def documents(spark, n):
    rows = [(i * 7, None if i % 11 == 0 else "é" * (i % 13), "x", 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, _arc int")


@pytest.mark.parametrize("n,shards,cell", [(1000, 8, 100_000), (1003, 7, 1), (5, 8, 10), (1, 3, 10), (0, 8, 10)])
def test_rows_law(spark, n, shards, cell):
    rows = ring_shards(documents(spark, n), shards=shards, cell_rows=cell).collect()
    assert sorted(r.doc_id for r in rows) == [i * 7 for i in range(n)]
    slots = {}
    for r in rows:
        text = documents_text(r.doc_id // 7)
        assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        slots.setdefault(r.shard, []).append(r.slot)
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def documents_text(i):
    return "" if i % 11 == 0 else "é" * (i % 13)


def test_walk_equals_row_by_row():
    """Each row in its turn goes clockwise to the first point of a shard with room."""
    rng = random.Random(1)
    for _ in range(200):
        shards = rng.randint(1, 5)
        owners = [rng.randrange(shards) for _ in range(rng.randint(shards, 12))]
        owners[:shards] = range(shards)
        sizes = [rng.randint(0, 9) for _ in owners]
        room = bounds(sum(sizes), shards, rng.choice([0, 0.3]))
        segments, placed = walk(owners, sizes, room), [0] * shards
        for arc, size in enumerate(sizes):
            firsts = [f for f, _, _ in segments[arc]]
            assert firsts == sorted(firsts) and (not size or firsts[0] == 0)
            for (first, shard, slot), end in zip(segments[arc], [*firsts[1:], size]):
                placed[shard] += end - first
        assert sum(placed) == sum(sizes) and all(p <= r for p, r in zip(placed, room))


def test_limited_movement(spark):
    """With slack, most rows stay when a shard is added, and none leaves the home its place names without need."""
    df = documents(spark, 3000)
    homes = lambda n: {r.doc_id: r.shard for r in ring_shards(df, shards=n, slack=0.5).collect()}
    before, after = homes(8), homes(9)
    moved = sum(before[i] != after[i] for i in before)
    assert moved < 0.3 * len(before)
    eight = dict(ring_points(spark, 8, 64))
    assert {p: s for p, s in ring_points(spark, 9, 64) if s < 8} == eight


def test_hot_text_and_repeated_ids(spark):
    df = spark.createDataFrame([(i // 2, "hot") for i in range(400)] + [(None, None)], "doc_id long, text string")
    counts = [r["count"] for r in ring_shards(df, shards=4).groupBy("shard").count().collect()]
    assert sorted(counts) == [100, 100, 100, 101]


def vectors(seed, n, dim, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if clusters:
        x = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] * 3 + x * 0.05
    return [(int(i), [float(np.float32(v)) for v in row]) for i, row in enumerate(x / np.linalg.norm(x, axis=1)[:, None])]


def brute_force(rows, k):
    good = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, qv in good:
        if q % 50 == 0:
            scores = sorted(
                (-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q and len(v) == len(qv)
            )[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("rows", [
    vectors(1, 400, 8), vectors(2, 600, 3, clusters=5),
    [(i, [1.0, 0.0]) for i in range(120)] + [(50, [1.0, 0.0])],
    [(0, [0.5]), (1, None), (2, []), (3, [float("nan")]), (4, [float("inf")]), (5, [None]), (6, [0.25]), (None, [1.0])],
    [(0, [0.5, 0.5]), (50, [1.0]), (100, [2.0]), (7, [-0.5])],
    [],
])
def test_top_k(spark, monkeypatch, rows):
    monkeypatch.setattr(search, "LEAF", 8)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, id int")
    got = top_k(df, F.col("id") % 50 == 0, candidate_block=130, query_block=3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_force(rows, 5)


@pytest.mark.parametrize("size", [3e4, 1e6, 3e5, 1e14, 1e30, 1e200])
def test_top_k_of_large_components(spark, monkeypatch, size):
    """Scores beyond the exact range of doubles, and beyond 64 bits."""
    monkeypatch.setattr(search, "LEAF", 8)
    rows = [(i, [size * c for c in v]) for i, v in vectors(5, 260, 6, clusters=4)]
    rows += [(1000 + i, [0.25 * i, 0.0, 1.0, -1.0, 0.0, 0.5]) for i in range(40)]  # small ones beside them
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, id int")
    got = top_k(df, F.col("id") % 50 == 0, candidate_block=70, query_block=3).collect()
    fits = lambda s: -(1 << 63) <= s < 1 << 63
    want = [(q, r, i, s if fits(s) else None, 0 if fits(s) else 1 if s > 0 else -1) for q, r, i, s in brute_force(rows, 5)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score, r.over) for r in got) == want


def test_search_prunes(monkeypatch):
    """On clustered vectors most pairs of leaves are never multiplied, and the answers are the same."""
    monkeypatch.setattr(search, "LEAF", 8)
    rows = vectors(3, 4000, 3, clusters=40)
    x = np.floor(256 * np.array([v for _, v in rows]))
    ids = np.arange(len(rows))
    tree, some = search.Tree.build(ids, x), search.Tree.build(ids[::50], x[::50])
    made = []
    real = np.rint
    monkeypatch.setattr(search.np, "rint", lambda a: made.append(a.size) or real(a))
    got = search.search(some, tree, 5)
    assert sum(made) < 0.5 * len(rows) * len(rows) / 50
    scores = {q: sorted((s for p, _, s in got if p == q), reverse=True) for q in ids[::50]}
    for q in ids[::50]:
        every = np.sort(np.delete(x @ x[q], q))[::-1][:5]
        assert scores[q] == every.astype(int).tolist()


def test_few_pairs_of_blocks_are_left(spark, monkeypatch):
    """On clustered vectors fewer than a tenth of the pairs of blocks get their trees, and all answers are right."""
    rows = [(i, [20 * c for c in v]) for i, v in vectors(9, 6000, 6, clusters=30)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, id int")
    grid, left = [], []
    real = search.open_pairs

    def watched(queries, chunks, firsts):
        grid.append(queries.count() * sum(len(r.blocks) // 8 for r in chunks.collect()))
        pairs = real(queries, chunks, firsts)
        left.append(pairs.count())
        return pairs

    monkeypatch.setattr(search, "open_pairs", watched)
    monkeypatch.setattr(search, "CHUNK_BLOCKS", 7)
    got = top_k(df, F.col("id") % 50 == 0, candidate_block=100, query_block=4).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_force(rows, 5)
    assert grid[0] > 900 and left[0] < grid[0] / 10, (grid, left)


def test_tree_covers():
    rows = vectors(4, 3000, 5, clusters=7)
    x = np.array([v for _, v in rows]) * 256
    tree = search.Tree.build(np.arange(len(rows)), x)
    assert sorted(tree.ids.tolist()) == list(range(len(rows)))
    for low, high, center, radius, first, count in tree.nodes:
        apart = np.linalg.norm(tree.vectors[int(low):int(high)] - tree.vectors[int(center)], axis=1)
        assert apart.max() <= radius + 1e-9
        if count:
            below = tree.nodes[int(first):int(first + count)]
            assert below[0][0] == low and below[-1][1] == high and (below[1:, 0] == below[:-1, 1]).all()
