"""Connected groups of rows that share keys, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppflow.session import durable


def _towards_least(links: DataFrame) -> DataFrame:
    """Every link hung on the smaller of its ends' least neighbours, then stars made of what hangs there."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    outer = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = outer.filter("u <> v").distinct()
    inner = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(inner, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(inner.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def groups_of(members: DataFrame) -> DataFrame:
    """``(pos, group)`` for rows ``(pos, key)``: rows joined by any chain of shared keys, named by the smallest.

    The number of rounds grows with the logarithm of the longest chain.
    """
    first = members.groupBy("key").agg(F.min("pos").alias("v"))
    links = members.join(first, "key").select(F.col("pos").alias("u"), "v").filter("u <> v").distinct()
    state = None
    while True:
        links = durable(_towards_least(links))
        now = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if (now.n, now.s) == state:
            break
        state = (now.n, now.s)
    stars = links.select(F.col("u").alias("pos"), F.col("v").alias("group"))
    return members.select("pos").distinct().join(stars, "pos", "left").select(
        "pos", F.coalesce("group", "pos").alias("group")
    )
