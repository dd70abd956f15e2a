"""Bounded samples of labelled rows for fitting, and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oppflow.llm.tables import written


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    text = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def sample_per_label(
    df: DataFrame, label: DataFrame, per_label: int, max_chars: int, id_col: str, text_col: str,
) -> list[tuple[str, object]]:
    """(text, label) of at most ``per_label`` rows of each label, in the order of a hash of the id.

    ``label`` has the columns ``_id, _label``.  Texts longer than ``max_chars`` are passed over, so at most
    ``labels * per_label * max_chars`` characters reach the driver.  Of rows that repeat an id only those with the
    smallest text hash count, once.
    """
    hashed = F.shiftrightunsigned(F.xxhash64("_id"), 1)
    texts = df.where(F.length(F.col(f"`{text_col}`")) <= max_chars).select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")
    )
    # One row per id and label that has a text: only these are counted and chosen from.
    able = texts.groupBy("_id").agg(F.min(F.xxhash64("_text")).alias("_hash")).join(label.distinct(), "_id")
    # The rows with the smallest hashes are wanted, so a bound on the hash that leaves a few times as many
    # keeps them, and no task ranks a whole label.
    counts = able.groupBy("_label").agg(F.count("*").alias("_n"))
    near = able.join(counts, "_label").where(hashed / F.lit(float(2**63)) <= 4 * per_label / F.col("_n"))
    order = Window.partitionBy("_label").orderBy(hashed, "_id")
    chosen = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_label)
    # Written first, so that Spark knows how small it is before it thinks of moving texts.
    chosen = written(chosen.select("_id", "_hash", "_label"), "chosen", narrow=True)
    # Equal rows of a chosen id are one: the aggregate leaves as many rows as were chosen, before anything is collected.
    rows = texts.withColumn("_hash", F.xxhash64("_text")).join(chosen, ["_id", "_hash"]).groupBy("_id", "_label").agg(
        F.min("_text").alias("_text")
    )
    return [(r["_text"], r["_label"]) for r in sorted(rows.collect(), key=lambda r: (str(r["_label"]), str(r["_id"])))]
