"""The store of seen keys: answers of a plain set, work that stays flat, batches that are run again."""

import random
from unittest.mock import patch

import pytest

from oppflow.streaming.key_store import BASE, KeyStore


def keys_of(spark, names, kind="url"):
    return spark.createDataFrame([(kind, n) for n in names], "kind string, key string")


def asked(store, spark, names, before):
    return sorted(r.key for r in store.among(keys_of(spark, names), before).collect())


def test_equals_a_set(spark, tmp_path):
    store, rng, held = KeyStore(spark, str(tmp_path), rows=16, fan_in=3), random.Random(1), {}
    store.append(BASE, keys_of(spark, [f"k{i}" for i in range(100)]))
    held[BASE] = {f"k{i}" for i in range(100)}
    for batch in range(11):
        store.merge(batch)
        names = [f"k{rng.randrange(400)}" for _ in range(rng.choice([0, 3, 40]))]
        known = set().union(*(v for b, v in held.items() if b < batch))
        assert asked(store, spark, names + ["k1", "none"], batch) == sorted(known & {*names, "k1", "none"})
        held[batch] = set(names) - known
        store.append(batch, keys_of(spark, sorted(held[batch])))
    # Another kind is another key; merged runs are gone, and every batch is covered once.
    assert store.among(keys_of(spark, ["k1"], "role"), 99).count() == 0
    runs = store.runs(11)
    assert [b for r in runs for b in range(r.first, r.last + 1)] == list(range(BASE, 11)) and len(runs) < 8
    assert sum(r.rows for r in runs) == sum(map(len, held.values()))


class CutOff:
    """A store that fails when the marker is written."""

    def __init__(self, store):
        self.store = store

    def __getattr__(self, name):
        return getattr(self.store, name)

    def create(self, *_):
        raise RuntimeError("lost")


def test_a_batch_that_is_run_again(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path), rows=16, fan_in=2)
    for batch in range(4):
        store.append(batch, keys_of(spark, [f"b{batch}", f"c{batch}"]))
    # Batch 3 runs again, with less: it does not see its own keys, and replaces them.
    store.merge(3)
    assert asked(store, spark, ["b2", "b3", "c3"], 3) == ["b2"]
    store.append(3, keys_of(spark, ["b3"]))
    store.merge(4)
    assert asked(store, spark, ["b0", "b3", "c3", "c2"], 4) == ["b0", "b3", "c2"]
    # What was cut off before its marker does not count, and is written anew.
    cut = KeyStore(spark, str(tmp_path), rows=16, fan_in=2)
    cut._store = CutOff(cut._store)
    with pytest.raises(RuntimeError):
        cut.append(4, keys_of(spark, ["b4"]))
    assert asked(store, spark, ["b4"], 5) == []
    store.append(4, keys_of(spark, ["b4"]))
    assert asked(store, spark, ["b4"], 5) == ["b4"]


def test_work_stays_flat_over_fifty_batches(spark, tmp_path):
    """Rows of the store that a question reads, batch after batch, while the store grows fiftyfold."""
    store, read = KeyStore(spark, str(tmp_path), rows=32, fan_in=8), []
    real = KeyStore._touched

    def counted(self, name, schema, runs, placed):
        table = real(self, name, schema, runs, placed)
        read[-1] += table.count()
        return table

    with patch.object(KeyStore, "_touched", counted):
        for batch in range(50):
            store.merge(batch)
            read.append(0)
            again = [f"k{batch // 2}-{i}" for i in range(2)] if batch else []
            fresh = [f"k{batch}-{i}" for i in range(40)]
            assert asked(store, spark, fresh[:4] + again, batch) == sorted(again)
            store.append(batch, keys_of(spark, fresh))
    assert len(store.runs(50)) <= 15
    total = sum(r.rows for r in store.runs(50))
    assert total == 2000 and max(read[40:]) < 0.5 * total
    # The number of runs grows with the logarithm, so what is read does, and not with the store.
    assert sum(read[40:]) < 3 * sum(read[6:16])
