"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Only DataFrame functions on rows.  Every shard has ``nodes`` points on a ring; a row's id is hashed
to a place on it and belongs to the next point clockwise.  No shard takes more than its load bound:
rows that a full shard cannot take go on clockwise to the next point of a shard with room.  With
``slack = 0`` the bounds are exact shares, so row counts differ by one at most; with more slack fewer
rows leave the shard their place names, and fewer move when a shard is added.

How the bound is kept without a row-by-row walk: rows within an arc (the stretch before a point) have
a rank.  Only arc sizes decide how many rows an arc leaves at each shard it comes to, and there are
``shards * nodes`` arcs whatever the table's size, so that walk is done once on the arc sizes, and each
row looks up its rank in its arc's short list of segments.  An arc holds that share of the rows, so
ranks are taken within cells of an arc, ``cell_rows`` rows each on average, and cell counts are added up.

Defined cases: a null id hashes like the text ``null``; rows that repeat an id are told apart by the
hash of their text and then stay interchangeable; an empty table gives an empty result; texts are
measured in UTF-8 bytes, null as none.  Other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NODES = 64
CELL_ROWS = 100_000
#: Places on the ring: the first 15 hex digits of a hash.
_RING_DIGITS = 15
#: The ring is cut into so many equal sectors (as a power of two) to look points up.
_SECTOR_BITS = 12


def _place(key: Column) -> Column:
    """A place on the ring, 60 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, _RING_DIGITS), 16, 10).cast("long")


def ring_points(spark, shards: int, nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node in ring order; a shard's points never depend on the others."""
    points = spark.range(shards).select(
        F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("node")
    ).select(_place(F.concat_ws("#", F.lit("node"), F.col("shard"), F.col("node"))).alias("place"), "shard")
    return sorted((r.place, r.shard) for r in points.collect())  # shards * nodes rows


def _table(spark, rows: list[dict], fields: str) -> DataFrame:
    """A table of parameter size from literals, without Python tasks."""
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")
    return spark.range(1).select(F.inline(parsed))


def _sectors(points: list[tuple[int, int]]) -> list[dict]:
    """Per sector of the ring the number of points before it and the points inside it."""
    width, sectors = 4 * _RING_DIGITS - _SECTOR_BITS, []
    inside: dict[int, list[int]] = {}
    for place, _ in points:
        inside.setdefault(place >> width, []).append(place)
    base = 0
    for sector in range(1 << _SECTOR_BITS):
        own = inside.get(sector, [])
        sectors.append({"_sector": sector, "_base": base, "_points": own})
        base += len(own)
    return sectors


def bounds(rows: int, shards: int, slack: float) -> list[int]:
    """The most rows each shard takes.  Without slack the shares are exact."""
    share, left = divmod(rows, shards)
    exact = [share + (s < left) for s in range(shards)]
    return [max(e, int(rows / shards * (1 + slack))) for e in exact]


def walk(owners: list[int], sizes: list[int], room: list[int]) -> list[list[tuple[int, int, int]]]:
    """Where each arc's rows go: (first rank, shard, first slot) segments per arc.

    In every round each arc offers what it still has to the point it has come to; points are served
    in ring order.  What does not fit goes on clockwise past full shards.  A round with rows left over
    has filled a shard, so there are at most as many rounds as shards.
    """
    n, room, used = len(owners), list(room), [0] * len(room)
    left, at = list(sizes), list(range(n))
    segments: list[list[tuple[int, int, int]]] = [[] for _ in owners]
    while any(left):
        for arc in range(n):
            while left[arc] and not room[owners[at[arc]]]:
                at[arc] = (at[arc] + 1) % n
        for arc in sorted((a for a in range(n) if left[a]), key=lambda a: (at[a], a)):
            shard = owners[at[arc]]
            taken = min(left[arc], room[shard])
            if taken:
                segments[arc].append((sizes[arc] - left[arc], shard, used[shard]))
                room[shard] -= taken
                used[shard] += taken
                left[arc] -= taken
    return segments


def ring_shards(
    df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
    nodes: int = NODES, slack: float = 0.0, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row per input row: ``id_col, size, text_crc32, shard, slot``; slots are gapless per shard."""
    spark = df.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(
        F.col(f"`{id_col}`").alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        _place(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))).alias("_place"),
    )
    points = ring_points(spark, shards, nodes)
    total = df.count()
    cells = max(1, -(-total // (cell_rows * len(points))))
    rows = (
        rows.withColumn("_sector", F.shiftright("_place", 4 * _RING_DIGITS - _SECTOR_BITS))
        .join(F.broadcast(_table(spark, _sectors(points), "_sector:bigint,_base:int,_points:array<bigint>")), "_sector")
        .withColumn("_arc", (
            F.col("_base") + F.size(F.filter("_points", lambda p: p < F.col("_place")))
        ) % len(points))
        .withColumn("_cell", F.pmod("_place", F.lit(cells)).cast("int"))
        .drop("_sector", "_base", "_points")
    )
    counted = rows.groupBy("_arc", "_cell").agg(F.count("*").alias("_n"))
    arcs = {r["_arc"]: r["n"] for r in counted.groupBy("_arc").agg(F.sum("_n").alias("n")).collect()}
    sizes = [arcs.get(a, 0) for a in range(len(points))]
    segments = walk([s for _, s in points], sizes, bounds(sum(sizes), shards, slack))
    lists = _table(spark, [
        {"_arc": a, "_segments": [{"first": f, "shard": s, "slot": k} for f, s, k in segs]}
        for a, segs in enumerate(segments) if segs
    ], "_arc:int,_segments:array<struct<first:bigint,shard:int,slot:bigint>>")
    before = Window.partitionBy("_arc").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cell_starts = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_arc", "_cell").orderBy("_place", "_id", "text_crc32", "size")
    ranked = rows.withColumn("_in", F.row_number().over(inside) - 1).join(cell_starts, ["_arc", "_cell"])
    rank = F.col("_before") + F.col("_in")
    segment = F.element_at(F.filter("_segments", lambda s: s["first"] <= F.col("_rank")), -1)
    return (
        ranked.withColumn("_rank", rank).join(F.broadcast(lists), "_arc")
        .withColumn("_segment", segment)
        .select(
            F.col("_id").alias(id_col), "size", "text_crc32",
            F.col("_segment.shard").alias("shard"),
            (F.col("_segment.slot") + F.col("_rank") - F.col("_segment.first")).alias("slot"),
        )
    )
