"""Runs of repeated words: the operator against a slow reading of their definition."""

import hashlib
import random
import re
import time
import zlib

import pytest

from oppflow.llm.queries import QUERIES, with_periods
from oppflow.llm.word_runs import collapse, find_runs, word_runs


def slow_runs(words, least=12):
    """Every period, every stretch, smallest period by trial."""
    out = set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i:
                s, e = i, j + q
                finer = any(all(words[k] == words[k + r] for k in range(s, e - r)) for r in range(1, q))
                if e - s >= max(least, 2 * q) and not finer:
                    out.add((s, e - s, q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_periodic(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def random_words(rng):
    n, k = rng.choice([0, 1, 5, 12, 30, 60, 90]), rng.choice([1, 2, 3, 8, 50])
    words = [str(rng.randrange(k)).encode() for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 9)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if rng.random() < 0.5:
            words += words[:rng.randrange(n)]
    return words


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_their_definition(seed):
    rng = random.Random(seed)
    for _ in range(100):
        texts = [random_words(rng) for _ in range(rng.randint(0, 5))]
        least = rng.choice([12, 12, 4, 5, 7])
        assert find_runs(texts, least) == [slow_runs(words, least) for words in texts]


def test_literal_runs():
    abc = b"a b c".split()
    assert find_runs([abc * 4]) == [[(0, 12, 3)]]
    assert find_runs([abc * 3 + [b"a", b"b"]]) == [[]]  # eleven words
    assert find_runs([[b"x"] + abc * 4 + [b"a", b"y"]]) == [[(1, 13, 3)]]
    # Two runs that overlap, and one inside another's period.
    assert find_runs([[b"a"] * 14 + [b"b"] * 13]) == [[(0, 14, 1), (14, 13, 1)]]
    inner = [b"a"] * 12 + [b"b"]
    assert find_runs([inner * 2]) == [[(0, 12, 1), (0, 26, 13), (13, 12, 1)]]


def test_long_and_monotonous_texts_take_little_time():
    start = time.time()
    assert find_runs([[b"a"] * 100_000]) == [[(0, 100_000, 1)]]
    assert find_runs([[b"b"] + [b"a"] * 50_000 + [b"b"]]) == [[(1, 50_000, 1)]]
    assert find_runs([[w for i in range(10_000) for w in (b"x%d" % i, *b"1 2 3 4 5 6".split())]]) == [[]]
    passage = b"one two three four five six seven eight".split()
    assert find_runs([[w for i in range(5_000) for w in (*passage, b"y%d" % i, b"z%d" % i)]]) == [[]]
    assert time.time() - start < 30


def test_collapse_keeps_the_first_period():
    words = b"x a b a b a b a b a b a b y".split()
    assert collapse(words, find_runs([words])[0]) == b"x a b y"
    assert collapse([], []) == b""


def test_defined_cases_and_extra_columns(spark):
    text = "p " + "q r " * 8 + "s"
    rows = [(1, text, "a", 7), (1, text, "a", 7), (None, "  x\x1cy z", None, 8), (2, None, "b", 9), (3, "", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, `_text` int")
    got = word_runs(docs, keep=["doc_id", "runs", "_text"]).toPandas().values.tolist()
    run = [{"start": 1, "length": 16, "period": 2}]
    assert sorted([[d if d == d else None, a, b, n, [r.asDict() if hasattr(r, "asDict") else dict(r) for r in rs], c]
                   for d, a, b, n, rs, c in got], key=lambda r: (r[0] is None, r[0])) == [
        [1, "a", 7, 18, run, "p q r s"], [1, "a", 7, 18, run, "p q r s"], [2, "b", 9, 0, [], ""], [3, "b", 9, 0, [], ""],
        [None, None, 8, 3, [], "  x\x1cy z"],  # neither sign parts words
    ]
    assert word_runs(docs.limit(0)).count() == 0


def test_results_do_not_depend_on_the_batch(spark):
    rng = random.Random(3)
    rows = [(i, b" ".join(random_words(rng)).decode()) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(str, word_runs(docs).collect()))
    assert one == sorted(map(str, word_runs(docs.repartition(5), batch_words=1).collect()))


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = {}
    for row in docs.collect():
        words = slow_periodic(row.doc_id, re.findall(r"[^\x20\x09-\x0D]+", row.text or ""))
        runs = slow_runs(words) if len(words) < 1500 else find_runs([[w.encode() for w in words]])[0]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        every = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        expected[row.doc_id] = (
            len(runs), best[0], best[1], best[2], best[1] and 1000 * best[1] // best[2],
            hashlib.sha256(every.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
        )
    got = {row[0]: tuple(row[1:]) for row in QUERIES["op11_word_runs"](spark, sf_dir).collect()}
    assert got == expected
    assert sum(r[0] > 0 for r in got.values()) > 5


def test_periodic_texts(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 17)) if i % 19 else None) for i in range(300)] + [(None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in with_periods(docs).collect()}
    for doc_id, text in rows:
        if doc_id is not None and text is not None:
            assert got[doc_id].split() == slow_periodic(doc_id, text.split())
    assert got[None] == "a b"
