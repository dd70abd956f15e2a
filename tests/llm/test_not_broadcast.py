"""Tables that Spark takes for smaller than they are reach no join by broadcast, and so not the driver."""

import re

import corpus_pipeline
from oppflow.llm import components, near_dedup, tables
from tests.llm.test_dedup import brute_force, frame, near_rows


def recorded(monkeypatch, module, plans):
    """Keeps the first plan of everything that ``module`` writes, by name."""
    def written(df, name, *args, keep=module.written, **kwargs):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, name, *args, **kwargs)

    monkeypatch.setattr(module, "written", written)


def test_bands_blocks_and_links_are_shuffled(spark, monkeypatch):
    """All bands went through the driver where the files of a class a row were below the threshold."""
    plans, rows = [], near_rows(5, groups=12)
    recorded(monkeypatch, near_dedup, plans)
    recorded(monkeypatch, components, plans)
    found = near_dedup.near_copies(frame(spark, rows), words=2, block=150)
    plans.append(("result", found._jdf.queryExecution().executedPlan().toString()))
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect()) == brute_force(rows, 2, 80)
    by_name = dict(plans)
    assert "SortMergeJoin [key" in by_name["likely"] and "SortMergeJoin [key" in by_name["active"]
    for name, plan in plans:
        assert not re.search(r"BroadcastHashJoin \[key#", plan), name
    # Links, pairs, blocks and components meet what belongs to them by a shuffle.
    for name in ("stars", "star_links", "block_links", "result"):
        assert "SortMergeJoin" in by_name[name], name


def test_the_stage_of_the_pipeline_shuffles_its_bands(spark, monkeypatch):
    plans, rows = [], near_rows(6, groups=5, chain=10)
    recorded(monkeypatch, near_dedup, plans)
    kept = corpus_pipeline.without_near_copies(spark, frame(spark, rows), "")
    assert "SortMergeJoin [key" in dict(plans)["likely"]
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _, stays in brute_force(rows, 5, 80) if stays}


def test_many_rows_that_go_are_shuffled(spark):
    rows = frame(spark, [(i, f"text {i % 3}") for i in range(30)])
    gone = rows.where("doc_id < 20").selectExpr("doc_id AS _id", "xxhash64(text) AS _hash")
    for most, kind in ((5, "SortMergeJoin"), (20, "BroadcastHashJoin")):
        left = tables.without(rows, gone, "doc_id", "text", broadcast_keys=most)
        assert kind in left._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in left.collect()) == list(range(20, 30))
