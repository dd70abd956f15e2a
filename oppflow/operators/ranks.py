"""Exact ranks and first rows without putting a whole table or group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oppflow.session import durable

_PARTITION_SHIFT = 33  # monotonically_increasing_id keeps the partition above this bit


def desc(value):
    """A descending sort key for ``with_rank``; NULL comes last."""
    return ("desc", value)


def with_rank(df: DataFrame, order: list, name: str = "rank", within: list[str] | None = None):
    """Add the 1-based position of every row in a total order.

    The rows are range-sorted over all executors and written once, so the ids are
    frozen; a row's rank is then its place in its partition plus the size of the
    partitions before it.  A hot sort key is spread over several partitions.  With
    ``within`` the count restarts for every group, again without a window over it: a group's
    first place is kept with every partition that holds some of it, and rows meet it by both,
    so that a group of any size is dealt out as the sort has dealt it.
    """
    within = within or []
    ids = f"_{name}_id"
    # Keys become columns first: a sort works out an expression at every comparison.
    values = [k[1] if isinstance(k, tuple) else k for k in order]
    keyed = df.withColumns({
        f"_{name}_{i}": F.col(v) if isinstance(v, str) else v for i, v in enumerate(values)
    })
    keys = [
        F.col(f"_{name}_{i}").desc_nulls_last() if isinstance(k, tuple) else F.col(f"_{name}_{i}").asc()
        for i, k in enumerate(order)
    ]
    frozen = durable(
        keyed.orderBy(*within, *keys).select(*df.columns, F.monotonically_increasing_id().alias(ids))
    )
    part = F.shiftright(F.col(ids), _PARTITION_SHIFT)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort, so its size is bounded by their number.
    starts = (
        frozen.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    place = F.col("_start") + F.col(ids).bitwiseAND(F.lit((1 << _PARTITION_SHIFT) - 1)) + 1
    placed = (
        frozen.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, place.cast("bigint"))
        .drop("_start", ids)
    )
    if not within:
        return placed.drop("_part")
    # A row per partition and group that it holds rows of.
    held = placed.groupBy("_part", *within).agg(F.min(name).alias("_first"))
    first = held.groupBy(*within).agg((F.min("_first") - 1).alias("_offset"))

    def same(a: str, b: str) -> list:
        return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in within]

    offsets = held.alias("h").join(first.alias("o"), same("h", "o")).select("h._part", *[f"h.{k}" for k in within], "o._offset")
    joined = placed.alias("r").join(offsets.alias("f"), [F.col("r._part") == F.col("f._part"), *same("r", "f")])
    kept = [F.col(f"r.{c}") for c in placed.columns if c not in (name, "_part")]
    return joined.select(*kept, (F.col(f"r.{name}") - F.col("f._offset")).alias(name))


def top_per_key(df: DataFrame, keys: list, order: list, k: int = 1, name: str = "_rn"):
    """The first k rows of every key.  Spark cuts each task's share to k rows per
    key before the shuffle, so a hot key never travels whole."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def first_per_key(df: DataFrame, keys: list, order: list) -> DataFrame:
    return top_per_key(df, keys, order, 1).drop("_rn")
