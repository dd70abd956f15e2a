"""The registered queries of this folder, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer_path

from oppflow.llm import language, toxicity
from oppflow.llm.bpe import bpe_encode
from oppflow.llm.exact_dedup import exact_copies
from oppflow.llm.html_text import extract_text
from oppflow.llm.mixing import mix_sources
from oppflow.llm.near_dedup import near_copies
from oppflow.llm.packing import pack_documents
from oppflow.llm.samples import remainder
from oppflow.llm.sharding import ring_shards
from oppflow.llm.tables import few_files, table
from oppflow.llm.token_files import token_file_round_trip
from oppflow.llm.top_k import top_k
from oppflow.llm.whitening import whiten
from oppflow.llm.word_runs import word_runs

WORD_BPE = tokenizer_path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, shuffled: bool = False):
    """Register ``fn(spark, sf_dir)``; a narrow result that comes out of a shuffle gets a few partitions for every core."""

    def add(fn):
        QUERIES[name] = (lambda spark, sf_dir: few_files(fn(spark, sf_dir))) if shuffled else fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""", shuffled=True)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_copies(docs, hash_all=True).withColumnRenamed("full_hash", "text_sha256").drop("text_hash")


@query("op10_ring_sharding", shuffled=True)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring_shards(table(spark, sf_dir, "documents"), shards=8, slack=0.0)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), WORD_BPE, keep_ids=False)


@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_file_round_trip(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), WORD_BPE, end_id=0, capacity=2048)


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_on_labels(docs, table(spark, sf_dir, "labels"), hold_out=(3, 1))
    return toxicity.toxicity_scores(docs, model).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query("op2_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.languages(docs, language.fit_on_rows(docs, hold_out=(5, 0)))
    return found.withColumn("held_out", remainder("doc_id", 5) == 0)


@query("op7_near_dedup", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM words
), classes AS (
  SELECT s, min(doc_id) AS id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), items AS (SELECT id, n, unnest(s) AS item FROM classes),
links AS (
  SELECT a.id AS u, b.id AS v FROM items a JOIN items b ON a.item = b.item AND a.id < b.id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT id AS u, id AS v FROM classes UNION SELECT r.u, w.v FROM reach r JOIN ways w ON r.v = w.u),
named AS (SELECT u AS id, min(v) AS component FROM reach GROUP BY u)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(n.component, d.doc_id) AS component_id,
       d.doc_id = coalesce(n.component, d.doc_id) AS kept
FROM sets d LEFT JOIN classes c ON c.s = d.s LEFT JOIN named n ON n.id = c.id
""", shuffled=True)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"), words=2, threshold=80).drop("text_hash")


@query("op6_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""", shuffled=True)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256).drop("over")


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of documents, the text of some made periodic: with ``h = crc32(doc_id)``, ``g = h div 10`` and ``n`` words,
    if ``h`` ends in 0 every word ``i >= a`` becomes word ``a + (i - a) % p``, ``a = g % n``, ``p = 1 + (n - a) div (3 + g % 8)``."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    split = docs.select("doc_id", "text", words.alias("w")).withColumns({
        "n": F.size("w"), "g": F.floor(h / 10), "many": F.coalesce(F.size("w"), F.lit(0)) > 0,
    })
    split = split.withColumn("a", F.when(F.col("many"), F.col("g") % F.col("n")).cast("int")).withColumn(
        "p", F.when(F.col("many"), F.expr("1 + (n - a) div (3 + g % 8)")).cast("int")
    )
    periodic = F.expr(
        "array_join(concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), "
        "cast((n - a + p - 1) div p AS int))), 1, n - a)), ' ')"
    )
    return split.select("doc_id", F.when(F.col("many"), periodic).otherwise(F.col("text")).alias("text"))


@query("op11_word_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs(with_periods(table(spark, sf_dir, "documents")))
    # Greatest length first, then smallest start, then smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("finer"),
    )))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    every = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.before")).alias("start"),
        F.col("_best.length").alias("length"), (-F.col("_best.finer")).alias("period"),
        F.expr("1000 * _best.length div -_best.finer").alias("exponent_milli"),
        F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


@query("op13_mixing", shuffled=True)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
