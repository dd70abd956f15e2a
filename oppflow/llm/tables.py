"""Reading inputs and cutting lineage for the operators of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oppflow.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder, spread over the cores if it comes in fewer splits than those.

    Only the split count decides; values and rows are the same either way.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share; ``oppflow.release`` deletes it."""
    return scratch_path(spark, name)


#: Files per core that a narrow table has at most, or that share of the shuffle partitions if that is more.
#: Every file costs the store and the executors a few calls (on a local file system a forked process), so tables
#: of a few numbers a row that come out of a shuffle are written with fewer.
FILES_PER_CORE = 2
PARTITIONS_PER_FILE = 8


def few_files(df: DataFrame, per_core: int = FILES_PER_CORE) -> DataFrame:
    """``df`` in fewer partitions, without a shuffle; their number grows with the cluster and with the
    number of shuffle partitions that the session asks for.

    Only for rows of a few numbers that come out of a shuffle: what is worked out after the shuffle is worked out in
    as many tasks, so never for texts, ids or sets, nor for what Python makes of a scan.
    """
    spark = df.sparkSession
    asked = int(spark.conf.get("spark.sql.shuffle.partitions")) * per_core // (FILES_PER_CORE * PARTITIONS_PER_FILE)
    return df.coalesce(max(1, per_core * spark.sparkContext.defaultParallelism, asked))


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: worked out once, safe from lost executors.

    ``narrow`` says that it is a table as ``few_files`` asks for.
    """
    path = scratch(df.sparkSession, name)
    (few_files(df, per_core=1) if narrow else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Hint for a join with a table that Spark takes for smaller than it is: exploded, which it counts as one row an
#: array, or known by compressed files of a few numbers a row.  Such a table is never broadcast.
SHUFFLED = "merge"

#: Keys that are sent to every task to pick rows; beyond it rows are moved to the keys.
BROADCAST_KEYS = 1_000_000


def without(df: DataFrame, gone: DataFrame, id_col: str, text_col: str, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``df`` without the rows named in ``gone`` by ``_id`` and ``_hash``, the hash of the text.

    Texts only move if there are more than ``broadcast_keys`` rows to leave out.
    """
    gone = written(gone.select("_id", "_hash").distinct(), "gone", narrow=True)
    few = gone.count() <= broadcast_keys
    text = F.coalesce(df[f"`{text_col}`"].cast("string"), F.lit(""))
    same = (df[f"`{id_col}`"] == gone["_id"]) & (F.xxhash64(text) == gone["_hash"])
    return df.join(F.broadcast(gone) if few else gone.hint(SHUFFLED), same, "left_anti")


def whole_text(column: str):
    """The text column as a string, null counted as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
