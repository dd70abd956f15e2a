"""Runs of repeated words inside texts: maximal pairs of a bottom-up LCP-interval tree.

Words are stretches of characters other than space, tab, line feed, vertical tab, form feed and carriage
return.  A run is a stretch of words with smallest period ``q`` (words ``q`` apart are the same), at least
``max(least, 2 * q)`` long, that no neighbouring word extends with that period.

Two equal stretches of ``l`` words that begin at ``i`` and ``i + d`` and can be extended neither to the left
nor to the right are a maximal pair; they are a stretch of ``l + d`` words with period ``d``.  The pairs with
``d <= l`` and ``l + d >= least`` are therefore the runs, each named once for its period and once for every multiple
of it that fits twice; the smallest distance of a stretch is its period.  Nothing is extended or compared a second time.

Pairs come from the tree over the suffixes, bottom up.  A node stands for a repeated stretch and keeps
where it begins in lists by the word to the left.  When two children meet, the places of the
smaller one look for places of the other within the node's length and with another word to the left.  Only nodes of at
least ``least / 2`` words can hold such a pair, so the tree ends there; and a text in which no stretch of that
length comes again soon enough is not sorted at all.

Every text is worked on where it is read: there is no shuffle, and a text takes memory in
proportion to its words.  The texts of a batch are sorted together, at most ``BATCH_WORDS`` words at a
time (a longer text alone).  A hot source or id has no part in it.

Defined cases: null is the empty text, which has no runs and collapses to the empty text; repeated rows and
ids are rows of their own; an empty table gives an empty result; other columns are kept if
they are named in ``keep``, whatever their names are.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from oppflow.llm.batches import with_results

BATCH_WORDS = 200_000
#: Odd number that spreads the hashes of word stretches; equal stretches have equal hashes whatever it is.
SPREAD = 0x9E3779B97F4A7C15

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, a number of its own after each text, and where the texts begin.

    Equal words have equal numbers inside a text and different ones in different texts.
    """
    total = sum(map(len, texts)) + len(texts)
    out = np.empty(total, dtype=np.int64)
    begins = np.empty(len(texts) + 1, dtype=np.int64)
    at = used = 0
    for k, words in enumerate(texts):
        begins[k] = at
        index: dict[bytes, int] = {}
        out[at:at + len(words)] = [index.setdefault(w, len(index)) for w in words]
        out[at:at + len(words)] += used
        at += len(words) + 1
        used += len(index)
    begins[-1] = at
    ends = begins[1:] - 1
    out[ends] = used + np.arange(len(texts))
    return out, begins


def _may_have_runs(numbers: np.ndarray, begins: np.ndarray, half: int) -> np.ndarray:
    """Which texts have a stretch that comes again within twice its length, for lengths half, 2 half, 4 half, ...

    A pair at a node of ``l`` words, ``g <= l < 2 g``, is less than ``2 g`` apart and shares its first ``g`` words.
    """
    found = np.zeros(len(begins) - 1, dtype=bool)
    hashes = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(SPREAD)
    hashes ^= hashes >> np.uint64(29)
    grams = hashes.copy()
    for k in range(1, half):
        grams = grams[:-1] * np.uint64(SPREAD) + hashes[k:] if len(grams) > 1 else grams[:0]
    places, length, factor = np.arange(len(grams)), half, pow(SPREAD, half, 1 << 64)
    while len(places) > 1:
        order = np.argsort(grams[places], kind="stable")
        sorted_places = places[order]
        same = np.diff(grams[sorted_places].view(np.int64)) == 0
        near = same & (np.diff(sorted_places) < 2 * length)
        found[np.searchsorted(begins, sorted_places[1:][near], side="right") - 1] = True
        again = np.zeros(len(places), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        # Twice the length, at the places that came again.
        places = np.sort(sorted_places[again])
        places = places[places + length < len(grams)]
        longer = np.zeros(len(grams), dtype=np.uint64)
        longer[places] = grams[places] * np.uint64(factor) + grams[places + length]
        grams, length, factor = longer, 2 * length, factor * factor % (1 << 64)
    return found


def _suffixes(numbers: np.ndarray) -> np.ndarray:
    """The suffixes in order, by ranks of ever twice as many words."""
    ranks = numbers
    length, n = 1, len(numbers)
    while True:
        order = np.argsort(ranks, kind="stable")
        ordered = ranks[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(ordered) != 0)))
        if n == 0 or new[order[-1]] == n - 1:
            return order
        after = np.zeros(n, dtype=np.int64)
        after[:-length] = new[length:] + 1
        ranks = new * (n + 1) + after
        length *= 2


def _shared(numbers: list[int], order: np.ndarray) -> list[int]:
    """Words that each suffix shares with the one before it in order.  Every text ends in a number of its own,
    so no two suffixes share the end of the list."""
    n = len(numbers)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    before = np.empty(n, dtype=np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    out, place, before = [0] * n, place.tolist(), before.tolist()
    length = 0
    for i in range(n):
        j = before[i]
        if j < 0:
            length = 0
            continue
        while numbers[i + length] == numbers[j + length]:
            length += 1
        out[place[i]] = length
        if length:
            length -= 1
    return out


class _Places:
    """Where a repeated stretch begins, in ordered lists by the word to the left."""

    __slots__ = ("size", "by_left")

    def __init__(self, place: int, left: int):
        self.size, self.by_left = 1, {left: [place]}


class _Tree:
    """Joins the nodes of the tree and notes the maximal pairs whose distance is at most their length."""

    def __init__(self, numbers: list[int], least: int):
        self.left = [-1, *numbers[:-1]]
        self.owner: list[_Places | None] = [None] * len(numbers)
        self.least = least
        self.pairs: list[tuple[int, int, int]] = []

    def leaf(self, place: int) -> _Places:
        self.owner[place] = places = _Places(place, self.left[place])
        return places

    def join(self, a: _Places, b: _Places, length: int) -> _Places:
        if a.size < b.size:
            a, b = b, a
        by_left, owner, left = a.by_left, self.owner, self.left
        # Either look into the list of every other word to the left, or at every place within reach.
        lists = len(by_left) <= 2 * length
        for word, places in b.by_left.items():
            for i in places:
                if lists:
                    for other, them in by_left.items():
                        if other != word:
                            for j in them[bisect_left(them, i - length):bisect_right(them, i + length)]:
                                self.note(i, j, length)
                else:
                    for j in range(max(0, i - length), min(len(left), i + length + 1)):
                        if owner[j] is a and left[j] != word:
                            self.note(i, j, length)
        for word, places in b.by_left.items():
            for i in places:
                owner[i] = a
            mine = by_left.get(word)
            if mine is None:
                by_left[word] = places
            elif len(places) * 16 < len(mine):
                for i in places:
                    insort(mine, i)
            else:
                mine += places
                mine.sort()
        a.size += b.size
        return a

    def note(self, i: int, j: int, length: int) -> None:
        if i > j:
            i, j = j, i
        if j - i + length >= self.least:
            self.pairs.append((i, j - i + length, j - i))


def _maximal_pairs(numbers: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, length, distance) of the stretches that the maximal pairs cover."""
    order, half = _suffixes(numbers), (least + 1) // 2
    numbers = numbers.tolist()
    shared, order = _shared(numbers, order), order.tolist()
    tree = _Tree(numbers, least)
    open_nodes: list[tuple[int, _Places]] = []
    current = None
    for at in range(1, len(order) + 1):
        length = shared[at] if at < len(order) else 0
        if length < half:
            if current is not None:
                while open_nodes:
                    depth, places = open_nodes.pop()
                    current = tree.join(places, current, depth)
                current = None
            continue
        if current is None:
            current = tree.leaf(order[at - 1])
        while open_nodes and open_nodes[-1][0] > length:
            depth, places = open_nodes.pop()
            current = tree.join(places, current, depth)
        if open_nodes and open_nodes[-1][0] == length:
            open_nodes[-1] = (length, tree.join(open_nodes[-1][1], current, length))
        else:
            open_nodes.append((length, current))
        current = tree.leaf(order[at])
    return tree.pairs


def find_runs(texts: list[list[bytes]], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of every text, given as its words, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return out
    chosen = np.flatnonzero(_may_have_runs(*_numbered(texts), (least + 1) // 2))
    if len(chosen):
        numbers, begins = _numbered([texts[k] for k in chosen])
        smallest: dict[tuple[int, int], int] = {}
        for start, length, distance in _maximal_pairs(numbers, least):
            smallest[start, length] = min(distance, smallest.get((start, length), distance))
        for (start, length), period in sorted(smallest.items(), key=lambda r: (r[0][0], r[1])):
            k = int(np.searchsorted(begins, start, side="right")) - 1
            out[chosen[k]].append((start - int(begins[k]), length, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if runs:
        edges = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            edges[start + period] += 1
            edges[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
    return b" ".join(words)


def _groups(texts: list[list[bytes]], words: int) -> Iterator[list[list[bytes]]]:
    """The texts in order in groups of at most so many words, a longer text alone."""
    group, held = [], 0
    for text in texts:
        if group and held + len(text) > words:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def word_runs(
    df: DataFrame, keep: list[str] | None = None, text_col: str = "text", least: int = 12,
    batch_words: int = BATCH_WORDS,
) -> DataFrame:
    """The columns ``keep`` (``doc_id`` unless named), ``n_words``, ``runs`` (array of start, length and period, by start
    and period) and ``collapsed``, the words of the text without repetitions."""
    keep = ["doc_id"] if keep is None else keep

    def results(texts: list[str]) -> dict[str, pa.Array]:
        # bytes.split() parts at exactly the six characters that are no part of a word.
        words = [text.encode().split() for text in texts]
        runs = [r for group in _groups(words, batch_words) for r in find_runs(group, least)]
        collapsed = [collapse(w, r) for w, r in zip(words, runs)]
        return {
            "n_words": pa.array(list(map(len, words)), pa.int64()),
            "runs": pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], RUNS),
            "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
        }

    found = with_results(
        df, keep, text_col, results,
        "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string",
    )
    return found.toDF(*keep, "n_words", "runs", "collapsed")
