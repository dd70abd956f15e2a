"""Writers.  Appends are partitioned tables with files per run; a repeated run adds nothing."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def history_rows(postings: DataFrame, scan_date, status: str = "added") -> DataFrame:
    return postings.select(
        "url", F.lit(scan_date).cast("date").alias("first_seen"), "source", "title", "company",
        F.lit(status).alias("status"),
    )


def _marker(spark: SparkSession, history_path: str, run_id: str = ""):
    """The file that says a run is complete, or the folder of all such files, and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{history_path.rstrip('/')}.committed/{run_id}".rstrip("/"))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def append_postings(
    postings: DataFrame, inbox_path: str, history_path: str, scan_date, run_id: str | None = None
) -> bool:
    """Add accepted postings to the inbox and to the scan history of one day, to both or to neither.

    Each run has files of its own in both tables, and one marker beside the history says that it is
    complete; ``committed_rows`` reads complete runs only.  A retry names the ``run_id`` of the run it repeats:
    what an unfinished attempt left is replaced, and a run that is complete stays as it is (False is
    returned).  Without a name every call is a run of its own.  The history is made from the rows the inbox
    was given, so both hold the same postings even if ``postings`` would come out differently a second time.
    """
    spark, run_id = postings.sparkSession, run_id or uuid.uuid4().hex
    if not RUN_NAME.fullmatch(run_id):
        raise ValueError(f"not a name for a run: {run_id!r}")
    marker, files = _marker(spark, history_path, run_id)
    if files.exists(marker):
        return False
    inbox, history = (f"{path.rstrip('/')}/run_id=run-{run_id}" for path in (inbox_path, history_path))
    day = F.lit(scan_date).cast("date")
    dated = postings.withColumn("scan_date", day)
    dated.write.mode("overwrite").partitionBy("scan_date").parquet(inbox)
    listed = spark.read.schema(dated.schema).parquet(inbox)
    history_rows(listed, scan_date).withColumn("scan_date", day).write.mode("overwrite").partitionBy(
        "scan_date"
    ).parquet(history)
    files.create(marker, True).close()
    return True


def committed_rows(spark: SparkSession, path: str, history_path: str) -> DataFrame:
    """The rows of an inbox or history that complete runs appended; other runs' folders are not read.

    The driver lists one name per run.
    """
    folder, files = _marker(spark, history_path)
    runs = [f"run-{status.getPath().getName()}" for status in files.listStatus(folder)] if files.exists(folder) else []
    return spark.read.parquet(path).filter(F.col("run_id").isin(runs)).drop("run_id")


def write_review(table: DataFrame, path: str) -> None:
    """The triage table as CSV part files, in review order if it carries one."""
    table.write.mode("overwrite").option("header", True).csv(path)


def write_document(document: DataFrame, path: str) -> None:
    """A nested result as JSON lines."""
    document.write.mode("overwrite").json(path)
