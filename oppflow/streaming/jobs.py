"""Running a streaming query over everything that has arrived, then stopping."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from oppflow.session import scratch_path


@contextmanager
def settings_for(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings that hold while a query is started and run, and are put back after."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def run_batches(
    stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], checkpoint: str | None = None,
    settings: dict[str, str] | None = None,
) -> None:
    """Hand all available input to ``write`` in micro-batches.

    With a ``checkpoint`` of the caller's, a later run goes on where this one stopped:
    it reads only what has arrived since and its batches are numbered on.
    """
    spark: SparkSession = stream.sparkSession
    with settings_for(spark, settings or {}):
        query = (
            stream.writeStream.outputMode(mode).foreachBatch(write)
            .option("checkpointLocation", checkpoint or scratch_path(spark, "offsets"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()


def batch_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The batches written below a path, with their ``batch_id``; no rows if there are none."""
    schema = StructType(schema.fields).add("batch_id", "long")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def run_to_table(
    stream: DataFrame, mode: str, path: str | None = None, checkpoint: str | None = None,
    settings: dict[str, str] | None = None,
) -> DataFrame:
    """Process all available input into a Parquet table under the shared folder.

    Every micro-batch writes its own folder and replaces it when it is run again,
    so a retry after a lost executor changes nothing.  ``path`` and ``checkpoint``
    belong together: give both, and the same ones again, to carry on.
    """
    spark: SparkSession = stream.sparkSession
    path = path or scratch_path(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run_batches(stream, mode, write, checkpoint, settings)
    return batch_table(spark, path, stream.schema)
