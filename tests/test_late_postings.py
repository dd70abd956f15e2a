"""A posting that arrives in a later run, dated long before the newest, is still taken."""

from oppflow.streaming import intake
from tests.test_streams import POSTING, arrive


def test_late_posting_in_a_second_run(spark, tmp_path):
    folder, path, offsets = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/offsets"
    known = spark.createDataFrame([], "url string, company string, title string")

    def poll():
        stream = spark.readStream.schema(POSTING).parquet(folder)
        return sorted(r.url for r in intake.stream_intake(stream, known, path, offsets).collect())

    arrive(spark, folder, 20, [(1, "https://a/1", "Acme", "Dev")])
    assert poll() == ["https://a/1"]
    arrive(spark, folder, 2, [(2, "https://a/2", "Late", "Ops"), (3, "https://a/2", "Late", "Ops"), (4, "https://a/1", "Acme", "Dev")])
    assert poll() == ["https://a/1", "https://a/2"]
    assert poll() == ["https://a/1", "https://a/2"]
