"""The language stage rejects letters that are in no language, and keeps clean documents."""

import random
import re

import corpus_pipeline
from oppflow.llm import language
from oppflow.llm.samples import remainder


def junk(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 9))) for _ in range(n))


JUNK = [junk(1), junk(2, 5), "Съешь ещё этих мягких французских булок, да выпей чаю", "qzx", "0x7 -- wqjxvk 99", junk(3, 20_000), "", "12 -- 34", None]


def test_letters_in_no_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit_on_rows(docs, hold_out=(5, 0))
    rows = spark.createDataFrame([(k, t, None) for k, t in enumerate(JUNK)], docs.schema)
    found = {r.doc_id: r for r in language.languages(rows, model).collect()}
    assert not any(r.in_language for r in found.values())
    # The prediction itself is unknown only without a letter.
    assert {k for k, r in found.items() if r.lang_pred == "und"} == {k for k, t in enumerate(JUNK) if not re.search("[^\\W\\d_]", t or "")}
    assert language.drop_unknown(rows, model).collect() == []
    held_out = docs.where(remainder("doc_id", 5) == 0)
    kept = language.drop_unknown(held_out, model).count()
    assert kept == held_out.count() > 20
    some = held_out.where("length(text) > 200").first().text[:200]
    assert language.inferred([some + " " + junk(4, 5), junk(4, 5)], model)[1].tolist() == [True, False]


def test_every_letter_gets_a_learned_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit_on_rows(docs, hold_out=(5, 0))
    texts = ["Hi", "ok", "WXQZ zzkq", "x7 qq", "日本語の文章", "ß", "12 %", "", "é"]
    found = language.predictions(texts, model)
    assert [p == "und" for p in found["lang_pred"]] == [False] * 6 + [True, True, False]
    assert set(found["lang_pred"]) - {"und"} <= set(model.languages)
    scores = found["score"].to_pylist()
    assert all((0 < s <= 1) == (p != "und") for s, p in zip(scores, found["lang_pred"]))
    # Of languages that fit alike the first name is taken.
    even = language.fit([("abc", "b"), ("abc", "a"), ("abc", "c")])
    assert language.predictions(["abc abc"], even)["lang_pred"] == ["a"]


def test_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.limit(len(JUNK)).collect()
    bad = spark.createDataFrame([{**r.asDict(), "doc_id": -1 - k, "text": t, "lang": None} for k, (r, t) in enumerate(zip(rows, JUNK))], docs.schema)
    kept = corpus_pipeline.in_a_language(spark, docs.unionByName(bad), sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect())


def test_without_a_model(spark):
    rows = spark.createDataFrame([(k, t, None) for k, t in enumerate(JUNK)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language.drop_unknown(rows, None).collect()) == [0, 1, 2, 3, 4, 5]
