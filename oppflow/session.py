"""Session settings the operators rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# UTC and ANSI are part of the results' meaning; the rest is tuning that AQE
# refines at run time.  Nothing here depends on the size of the data.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Before a run Spark knows a table only by its compressed files, a hundredth of its rows at times, and takes an
# exploded array for a single row.  So little is broadcast by that guess; sizes measured at run time decide the rest.
# A session that has a threshold of its own keeps it.
BROADCAST, BROADCAST_DEFAULT = "spark.sql.autoBroadcastJoinThreshold", "10485760b"
GUESSED, MEASURED = "1m", ("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")

# Before every explode this rule adds a filter "array not empty" that works the array
# out once more.  Here the arrays are parsed payloads, split texts and word subsets,
# and hardly ever empty, so the filter costs more than the rows it would drop.
EXCLUDED_RULE = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created.

    They stay set: UTC and ANSI decide what the results mean, so whoever hands over a
    session hands over these settings of it.  Call this where the session is made.
    """
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if spark.conf.get(BROADCAST, BROADCAST_DEFAULT) == BROADCAST_DEFAULT:
        spark.conf.set(BROADCAST, GUESSED)
        if spark.conf.get(MEASURED[0], None) is None:
            spark.conf.set(*MEASURED)
    excluded = spark.conf.get("spark.sql.optimizer.excludedRules", None) or ""
    if EXCLUDED_RULE not in excluded:
        rules = ",".join(r for r in (excluded, EXCLUDED_RULE) if r)
        spark.conf.set("spark.sql.optimizer.excludedRules", rules)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where that is unset it is a folder of the warehouse, which the driver and the
    executors share too; never a machine-local one, which would lose the data together
    with the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    return configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


# What this process has written for itself, by session.
_WRITTEN: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Delete the tables that ``durable`` and the streams wrote under the shared folder.

    To be called when no frame made from them is needed any more.  Returns how many
    there were.  Folders that a caller named are never deleted.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared folder and reading it back.

    The rows are worked out once, survive lost executors, and values a re-run could
    assign differently, such as row ids, are frozen.  Unlike a checkpoint, which works
    everything out a second time to save it, a written table is also read by column.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a written table; ``release`` deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path
