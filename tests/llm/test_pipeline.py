"""The pipeline's stages on a small table with one case of everything, and the registered queries."""

import random

import pytest

import corpus_pipeline
from oppflow.llm.queries import ORACLES, QUERIES
from tests.llm.test_dedup import brute_force
from tests.llm.test_text import DE, EN, FR, shuffled


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with their copies, near copies, toxic ones and texts without letters."""
    rng = random.Random(4)
    texts = [shuffled({"en": EN, "de": DE, "fr": FR}[lang], k, 60) + f" unique{k}" for k in range(60) for lang in ["en", "de", "fr"][k % 3:][:1]]
    langs = [["en", "de", "fr"][k % 3] for k in range(60)]
    rows = [(k, t, lang, "s", len(t)) for k, (t, lang) in enumerate(zip(texts, langs))]
    for k in range(60, 90):  # toxic
        words = shuffled(EN, k, 60).split()
        for _ in range(4):
            words.insert(rng.randrange(len(words)), rng.choice(["worthless", "pathetic", "disgusting"]))
        rows.append((k, " ".join(words), "en", "s", 0))
    toxic = set(range(60, 90))
    rows += [(100 + k, texts[k], langs[k], "s", 0) for k in range(10)] + [(110, texts[0], "en", "s", 0)]
    rows += [(120 + k, texts[20 + k] + " more", langs[20 + k], "s", 0) for k in range(10)]
    rows += [(140, None, "en", "s", 0), (141, "", None, None, 0), (142, "12 34 !!", "en", "s", 0)]
    base = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, *_ in rows if i < 90], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base, rows, toxic


def test_stages(spark, small):
    base, rows, toxic = small
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if "doc_id" in docs.columns else {}
        out = stage(spark, docs, base)
        path = f"{base}/{name}-out"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = (before, {r.doc_id for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == columns
    before, after = kept["toxicity"]
    assert len(before) == len(rows) and after == set(before) - toxic
    before, after = kept["language"]
    assert set(before) - after == {140, 141, 142}
    before, after = kept["exact_dedup"]
    assert after == {max(i for i, t in before.items() if t == u) for u in before.values()}
    before, after = kept["near_dedup"]
    assert after == {i for i, _, _, stays in brute_force(list(before.items()), 5, 80) if stays}
    assert not after & set(range(120, 130))
    before, after = kept["packing"]
    assert set(before) == after
    ran = corpus_pipeline.run(spark, base).toPandas()
    assert set(ran.doc_id) == after
    assert (ran.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_empty_documents(spark, small, tmp_path):
    base, _, _ = small
    spark.read.parquet(f"{base}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{base}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_native_plans(spark, sf_dir):
    """Exact deduplication and sharding run no Python on the executors."""
    for name in ("op1_exact_dedup", "op10_ring_sharding"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExistingRDD")), name


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) == {"op1_exact_dedup", "op6_top_k", "op7_near_dedup"}
