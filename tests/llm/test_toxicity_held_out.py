"""op3's held-out rows against their labels, and a toxic text at the end of a very long one."""

from oppflow.llm import toxicity
from oppflow.llm.queries import QUERIES
from tests.llm.test_text import ordinary

SF = "/root/testdata/sf0.1"


def test_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op3_toxicity"](spark, SF).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    found, there = sum(r.predicted for r in rows), sum(r.toxic for r in rows)
    assert there > 100 and hits >= 0.95 * found and hits >= 0.5 * there


def test_toxic_end_of_a_long_text():
    bad = " worthless and pathetic with disgusting things"
    sizes = [20, 60, 200, 900]  # of both kinds, so that the length says nothing
    model = toxicity.fit([(ordinary(k, sizes[k % 4]) + bad * (k % 8 < 4), int(k % 8 < 4)) for k in range(160)])
    long = ordinary(1, 60_000)
    clean, toxic = toxicity.features([long, long + bad], model.ordinary, model.specific)
    assert toxic[0] > clean[0] and (toxic[2:-1] > clean[2:-1]).all()
    alone, without, within = toxicity.scores([ordinary(2) + bad, long, long + bad], model)
    assert alone >= 0.7 and within >= 0.7 > without
