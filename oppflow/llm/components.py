"""Connected components of a table of links, by alternating large and small stars.

Every round keeps one written table of links; a component ends as a star around its smallest id, after
a number of rounds that grows with the logarithm of its size.  Minima are combined within tasks before they
are shuffled, so a node with very many links reaches the shuffle of a minimum as one row per task; the
join that brings it back to its links is between narrow rows and is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppflow.llm.tables import SHUFFLED, written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").hint(SHUFFLED).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v").distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    around = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return around.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every node that has a link, from links ``u, v``; a component is its smallest id."""
    now = links.select("u", "v").where("u <> v")
    while True:
        now = written(_small_star(_large_star(now)), "stars", narrow=True)
        # Done when every node hangs on one other that hangs on none.
        hung = now.groupBy("u").agg(F.count("*").alias("n"))
        if hung.where("n > 1").isEmpty() and now.join(hung.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    centers = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.unionByName(centers)
