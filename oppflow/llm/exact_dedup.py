"""Exact deduplication by progressive refinement: length, then a prefix hash, then the full hash.

Only DataFrame functions.  Text never moves between tasks.  The first pass counts (length, prefix hash) pairs, and
from those counts lengths; lengths that one row has leave first, then pairs that one row has.  The second pass works
out the full SHA-256 of the texts still in question and groups by it.

The pairs in question reach the second pass as a map of ``2 ** MAP_BITS`` bits, sent to every task: a row whose bit is
not set has no copy and its text is not read further.  The map has the same size however many pairs there are.  A row
whose bit another pair has set is hashed too, and found to be alone by the exact pair afterwards, so results,
nulls among them, never depend on the map; only the number of texts hashed in vain does, and slowly (pairs divided by
bits).

Hot groups: every grouping is a count or a maximum that Spark combines within each task before it
shuffles, so a text that fills a third of the table reaches the shuffle as one row per task.  The
join that brings a group's result back to its rows is between narrow rows and is left to the
skew handling of adaptive execution.

Defined cases: a null text is an empty text; ties cannot occur between different ids, and rows that
repeat the id that stays all stay; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oppflow.llm.tables import whole_text, without, written

#: Characters that the second step hashes.
PREFIX_CHARS = 64
#: Size of the map of undecided pairs: at most a million words of 64 bits, of 16 bytes with their number.
MAP_BITS = 26


def _keyed(df: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    text = whole_text(text_col)
    return df.select(
        F.col(f"`{id_col}`").alias("_id"),
        text.alias("_text"),
        F.octet_length(text).alias("_length"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_prefix"),
    )


def undecided_keys(keyed: DataFrame) -> DataFrame:
    """(length, prefix hash) pairs that more than one row has, from one pass over the table.

    Lengths that a single row has leave before prefixes are compared.
    """
    by_prefix = keyed.groupBy("_length", "_prefix").agg(F.count("*").alias("_n"))
    by_length = by_prefix.groupBy("_length").agg(F.sum("_n").alias("_rows")).where("_rows > 1")
    return by_prefix.where("_n > 1").join(by_length, "_length", "left_semi").select("_length", "_prefix")


def _place(map_bits: int) -> Column:
    """Where a (length, prefix hash) pair stands in the map."""
    return F.pmod(F.xxhash64("_length", "_prefix"), F.lit(1 << map_bits))


def _map(keys: DataFrame, map_bits: int) -> DataFrame:
    """``_word, _bits``: the words of the map that have a bit set."""
    bits = keys.select(_place(map_bits).alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word"))
    return bits.agg(F.expr("bit_or(shiftleft(1L, CAST(_place & 63 AS int)))").alias("_bits"))


def exact_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS,
    map_bits: int = MAP_BITS, hash_all: bool = False,
) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, full_hash, text_hash``.

    Of equal texts the row with the largest id stays.  ``full_hash`` is null where a shorter key
    already showed that no other row has this text, unless ``hash_all`` asks for every digest.
    """
    keyed = _keyed(df, id_col, text_col, prefix_chars)
    # At most 2 ** (map_bits - 6) rows of two numbers.
    words = written(_map(undecided_keys(keyed), map_bits), "undecided", narrow=True)
    keyed = keyed.withColumn("_place", _place(map_bits)).withColumn("_word", F.shiftright("_place", 6))
    keyed = keyed.join(F.broadcast(words), "_word", "left")
    maybe = F.coalesce(F.expr("getbit(_bits, CAST(_place & 63 AS int))") == 1, F.lit(False))
    full = F.sha2(F.col("_text"), 256)
    rows = keyed.select(
        "_id", maybe.alias("_maybe"), (full if hash_all else F.when(maybe, full)).alias("_full"),
        "_length", "_prefix", F.xxhash64("_text").alias("_hash"),
    )
    # A row that is alone by a shorter key joins under that key, so such rows spread over all tasks.
    alone = F.concat_ws(":", "_length", "_prefix")
    rows = rows.withColumn("_key", F.when(F.col("_maybe"), F.col("_full")).otherwise(alone))
    groups = (
        rows.where("_maybe").groupBy("_key")
        .agg(F.max("_id").alias("_keep"), F.count("*").alias("_size"), F.first("_length").alias("_l"), F.first("_prefix").alias("_p"))
    )
    # Rows of a pair, over its texts: one row only, if another pair had set its bit.
    pairs = groups.groupBy("_l", "_p").agg(F.sum("_size").alias("_mates"))
    groups = groups.join(pairs, ["_l", "_p"]).drop("_l", "_p")
    keep = F.coalesce(F.col("_keep"), F.col("_id"))
    shown = F.col("_full") if hash_all else F.when(F.col("_mates") > 1, F.col("_full"))
    return rows.join(groups, "_key", "left").select(
        F.col("_id").alias(id_col), keep.alias("keep_id"),
        F.coalesce(F.col("_size"), F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"), shown.alias("full_hash"),
        F.col("_hash").alias("text_hash"),
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.  Rows without an id stay."""
    dropped = exact_copies(df, id_col, text_col).where("NOT kept")
    return without(df, dropped.select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")), id_col, text_col)
