"""Exact and near deduplication against brute force on small, awkward tables."""

import hashlib
import random
from collections import Counter

import pytest

from oppflow.llm import near_dedup
from oppflow.llm.exact_dedup import drop_exact_copies, exact_copies
from oppflow.llm.near_dedup import drop_near_copies, near_copies

#: Columns whose names clash with the operators' own.
SCHEMA = "doc_id long, text string, kept string, _id string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", None) for i, t in rows], SCHEMA)


AWKWARD = [
    (1, "same"), (5, "same"), (3, "same"), (2, ""), (7, None), (8, "Same"), (9, "same "), (10, "émas"),
    (11, "x" * 70 + "a"), (12, "x" * 70 + "b"), (13, "x" * 70 + "b"), (14, "word " * 30_000), (15, "word " * 30_000),
    (16, None), (17, "repeated"), (17, "repeated"),
]


@pytest.mark.parametrize("bits", [26, 10, 6])
def test_exact_against_brute_force(spark, bits):
    got = sorted(
        (r.doc_id, r.keep_id, r.group_size, r.kept, r.full_hash)
        for r in exact_copies(frame(spark, AWKWARD), map_bits=bits, hash_all=True).collect()
    )
    want = []
    for i, t in AWKWARD:
        group = [j for j, u in AWKWARD if (u or "") == (t or "")]
        want.append((i, max(group), len(group), i == max(group), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("bits", [26, 7])
def test_full_hash_is_null_for_whom_a_shorter_key_decides(spark, bits):
    """Whatever the size of the map: also where every bit of it is set."""
    rows = AWKWARD + [(100 + k, f"text number {k}") for k in range(900)] + [(2000 + k, f"twice {k % 90}") for k in range(180)]
    pairs = Counter((len((t or "").encode()), (t or "")[:64]) for _, t in rows)
    got = exact_copies(frame(spark, rows), map_bits=bits).collect()
    shown = Counter((r.doc_id, r.full_hash) for r in got)
    want = Counter(
        (i, hashlib.sha256((t or "").encode()).hexdigest() if pairs[len((t or "").encode()), (t or "")[:64]] > 1 else None)
        for i, t in rows
    )
    assert shown == want


def test_exact_null_ids_and_empty_table(spark):
    got = {r.text for r in drop_exact_copies(frame(spark, [(None, "a"), (1, "a"), (None, "b")])).collect()}
    assert got == {"a", "b"}
    assert drop_exact_copies(frame(spark, [])).collect() == []
    kept = drop_exact_copies(frame(spark, AWKWARD))
    assert kept.columns == ["doc_id", "text", "kept", "_id", "component"]
    assert sorted(r.doc_id for r in kept.collect()) == [5, 8, 9, 10, 11, 13, 15, 16, 17, 17]


def test_only_rows_of_the_dropped_text_go(spark):
    # One id with two texts: the row whose text has a larger copy goes, the other stays.
    rows = [(4, "copied"), (4, "own"), (6, "copied")]
    assert sorted((r.doc_id, r.text) for r in drop_exact_copies(frame(spark, rows)).collect()) == [(4, "own"), (6, "copied")]


def brute_force(rows, words, threshold):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).split()
        sets[i] = {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def near_rows(seed, groups=25, chain=40):
    """Groups of copies with edits, a long chain in which only neighbours are similar, and junk."""
    rng, texts = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([1, 2, 3, 8, 40, 120]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            texts.append("\t".join(copy).upper())
    moving = [word() + str(k) for k in range(60 + 3 * chain)]
    texts += [" ".join(moving[3 * k: 3 * k + 60]) for k in range(chain)]
    texts += ["", None, " \n ", "one", "ONE", "é É", "word " * 5000, "word " * 5001]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed,block,ids", [(1, 10**6, 10**6), (2, 150, 10**6), (3, 400, 0)])
def test_near_against_brute_force(spark, seed, block, ids):
    rows = near_rows(seed)
    got = near_copies(frame(spark, rows), words=2, block=block, broadcast_ids=ids)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == brute_force(rows, 2, 80)


def test_near_links_that_no_star_has(spark):
    """A crowd around the threshold: many are similar to few others only, in shared buckets."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(3, 6)):
            copy[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = near_copies(frame(spark, rows), words=2, block=2000)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == brute_force(rows, 2, 80)


def test_near_edges(spark):
    assert near_copies(frame(spark, [])).collect() == []
    rows = [(1, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")]
    got = near_copies(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [
        (0, None, True), (1, 1, True), (3, 1, False), (3, 1, False)]
    kept = drop_near_copies(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "kept", "_id", "component"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1]


def test_estimate_is_close():
    a = near_dedup.shingles(" ".join(f"w{k}" for k in range(3000)), 1)
    b = near_dedup.shingles(" ".join(f"w{k}" for k in range(300, 3300)), 1)
    equal = (near_dedup.sketch(a) == near_dedup.sketch(b)).sum()
    assert abs(near_dedup.estimate(equal) - 2700 / 3300) < 0.15
    assert near_dedup.estimate((near_dedup.sketch(a) == near_dedup.sketch(a)).sum()) == 1
