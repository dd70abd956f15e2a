"""Continuous intake: every poll adds only postings nobody has seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oppflow.operators.scan import dedup_within_scan
from oppflow.operators.seen import new_postings, seen_keys
from oppflow.session import durable, scratch_path
from oppflow.streaming.jobs import batch_table, run_batches
from oppflow.streaming.key_store import BASE, ROWS, KeyStore


def in_flight(postings: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop repeats that are still under way; the state is bounded by the watermark.

    Rows older than the watermark are dropped too, seen before or not: not for postings that may arrive late.
    """
    return postings.withWatermark("ts", delay).dropDuplicatesWithinWatermark(
        ["url", "company", "title"]
    )


def stream_intake(
    postings: DataFrame, known: DataFrame, path: str | None = None, checkpoint: str | None = None,
    bucket_rows: int = ROWS,
) -> DataFrame:
    """Process all available postings and return the accepted ones.

    There is no watermark, so a posting counts however late it arrives.  What was ever accepted, and
    what repeats within a batch, is decided by a store of keys (``key_store``): those of ``known`` are written once, each
    batch appends the keys of what it accepted, and a batch that is run again replaces its own part.  A batch asks the
    store about its own keys, so its work follows its size and not all that came before.
    With ``path`` and ``checkpoint`` of the caller's the next call carries on.
    """
    spark: SparkSession = postings.sparkSession
    path = path or scratch_path(spark, "intake")
    columns = [c for c in postings.columns if c != "ts"]
    store = KeyStore(spark, f"{path}/seen", bucket_rows)
    if not store.runs(BASE + 1):
        store.append(BASE, seen_keys(known))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = durable(batch.select(*columns))
        store.merge(batch_id)
        fresh = dedup_within_scan(new_postings(rows, store.among(seen_keys(rows), batch_id)))
        accepted = f"{path}/accepted/batch_id={batch_id}"
        fresh.write.mode("overwrite").parquet(accepted)
        written = spark.read.schema(batch.select(*columns).schema).parquet(accepted)
        store.append(batch_id, seen_keys(written))

    run_batches(postings, "append", write, checkpoint)
    return batch_table(spark, f"{path}/accepted", postings.select(*columns).schema).drop("batch_id")


def event_postings(events: DataFrame) -> DataFrame:
    """An event stream read as a stream of postings."""
    who = F.col("user_id").cast("string")
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("pos"),
        F.concat(F.lit("https://jobs.example.com/"), who, F.lit("/"), F.col("event_type")).alias("url"),
        F.concat(F.lit("Company "), who).alias("company"), F.col("event_type").alias("title"),
    )
