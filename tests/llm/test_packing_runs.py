"""The matching on the driver holds at most two runs of open sequences for every length."""

import random

import pytest

from oppflow.llm.packing import Plan


class Watched(Plan):
    most = 0

    def _round(self, length, count):
        super()._round(length, count)
        self.most = max(self.most, sum(map(len, self._gaps.values())) - 2 * len(self.runs))


@pytest.mark.parametrize("seed", range(12))
def test_runs_are_bounded(seed):
    rng = random.Random(seed)
    counts = {n: rng.randint(1, rng.choice([3, 10**6])) for n in rng.sample(range(1, 2049), rng.choice([50, 500, 2048]))}
    assert Watched(counts, 2048).most <= 0
