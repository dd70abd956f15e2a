"""A growing set of keys on a shared store, asked at a cost that follows the question and not the set.

Keys come in runs, one per micro-batch.  A run is written twice: the keys, and marks, one bit per key (a Bloom filter
of one hash) in words of 64.  Both lie in buckets of the key's hash, of about ``rows`` keys each: a run of
``2 ** k`` times as many has ``2 ** k`` buckets.  Which of some keys are in the set is found in two steps: their marks
are looked up, in the buckets they fall into; those with a mark are compared with the keys of their bucket.  So a question
reads at most one bucket for each of its keys and each run, and of new keys hardly any.

Runs are merged as they come: ``fan_in`` neighbours that cover equally many batches become one, so their number grows
with the logarithm of the number of batches, and a key is written again as often.

A run counts once its marker stands, which is written last; a run that another one covers counts no more.  A batch that
is run again replaces its own run, and only earlier batches are merged or asked, so it finds what it found before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oppflow.session import durable

KEYS = "kind string, key string, run string, k int, bucket int"
MARKS = "word int, bits long, run string, k int, bucket int"
ROWS = 1 << 16
FAN_IN = 8
#: Bits of marks per key that a bucket is laid out for; so many keys share the mark of another, as a share of one.
BITS_PER_KEY = 16
#: The batch number of what was known before the first batch.
BASE = -1


@dataclass(frozen=True, order=True)
class Run:
    first: int  # batches from first to last
    last: int
    k: int
    rows: int

    @property
    def name(self) -> str:
        return f"{self.first}_{self.last}_{self.k}_{self.rows}"

    @property
    def span(self) -> int:
        return self.last - self.first + 1


class KeyStore:
    """Keys ``(kind, key)`` below a path of the shared store; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, rows: int = ROWS, fan_in: int = FAN_IN):
        self.spark, self.path, self.rows, self.fan_in = spark, path.rstrip("/"), rows, fan_in
        self.words = max(1, rows * BITS_PER_KEY // 64)
        self._folder = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._folder(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- runs ----------------------------------------------------------------
    def _marked(self) -> list[Run]:
        markers = self._folder(f"{self.path}/runs")
        if not self._store.exists(markers):
            return []
        names = [status.getPath().getName() for status in self._store.listStatus(markers)]
        return sorted(Run(*map(int, name.split("_"))) for name in names)

    def runs(self, before: int) -> list[Run]:
        """The runs of batches before this one, none covered by another, in order."""
        found = [r for r in self._marked() if r.last < before]
        return [
            r for r in found
            if not any(o != r and o.first <= r.first and r.last <= o.last and (o.span > r.span or o > r) for o in found)
        ]

    def _delete(self, run: Run) -> None:
        """The marker first, so that a half deleted run does not count."""
        for path in (f"runs/{run.name}", f"keys/run={run.name}", f"marks/run={run.name}"):
            self._store.delete(self._folder(f"{self.path}/{path}"), True)

    # --- where a key stands --------------------------------------------------
    def _bucket(self, k) -> Column:
        return F.expr(f"CAST(pmod(_hash, shiftleft(1L, {k})) AS int)")

    def _placed(self, keys: DataFrame) -> DataFrame:
        hashed = keys.select("kind", "key").withColumn("_hash", F.xxhash64("kind", "key"))
        # Buckets take the low bits of the hash, bits of a word the high ones, words those between.
        return hashed.withColumns({
            "word": F.pmod(F.shiftright("_hash", 24), F.lit(self.words)).cast("int"),
            "bit": F.shiftrightunsigned("_hash", 58).cast("int"),
        })

    # --- writing -------------------------------------------------------------
    def _write(self, first: int, last: int, keys: DataFrame) -> Run:
        for old in self._marked():
            if (old.first, old.last) == (first, last):
                self._delete(old)
        placed = durable(self._placed(keys))
        rows = placed.count()
        run = Run(first, last, max(0, (-(-rows // self.rows) - 1).bit_length()), rows)
        if rows:
            dealt = placed.withColumn("bucket", self._bucket(run.k)).withColumn("k", F.lit(run.k))
            marks = dealt.groupBy("k", "bucket", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
            for name, table in (("keys", dealt.select("kind", "key", "k", "bucket")), ("marks", marks)):
                table.repartition("bucket").write.mode("overwrite").partitionBy("k", "bucket").parquet(
                    f"{self.path}/{name}/run={run.name}"
                )
        self._store.create(self._folder(f"{self.path}/runs/{run.name}"), True).close()
        return run

    def append(self, batch_id: int, keys: DataFrame) -> Run:
        """The keys of a batch, in place of those that it may have written before."""
        return self._write(batch_id, batch_id, keys)

    def merge(self, before: int) -> None:
        """Merge neighbours that cover equally many batches, all before this one."""
        while True:
            runs = [r for r in self.runs(before) if r.first > BASE]
            at = next((
                i for i in range(len(runs) - self.fan_in + 1)
                if len({r.span for r in runs[i:i + self.fan_in]}) == 1
            ), None)
            if at is None:
                break
            together = runs[at:at + self.fan_in]
            self._write(together[0].first, together[-1].last, self._read("keys", KEYS, together).select("kind", "key"))
        live = set(self.runs(before))
        for run in self._marked():
            if run.last < before and run not in live:
                self._delete(run)

    # --- asking --------------------------------------------------------------
    def _read(self, name: str, schema: str, runs: list[Run]) -> DataFrame:
        folders = [f"{self.path}/{name}/run={r.name}" for r in runs if r.rows]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*folders)

    def _touched(self, name: str, schema: str, runs: list[Run], placed: DataFrame) -> DataFrame:
        """The buckets of a table that some keys (with their ``k`` and ``bucket``) fall into; no others are read.

        A row per bucket is collected: no more than there are folders.
        """
        found = placed.groupBy("k").agg(F.collect_set("bucket").alias("buckets")).collect()
        wanted = F.lit(False)
        for row in found:
            wanted = wanted | ((F.col("k") == row.k) & F.col("bucket").isin(row.buckets))
        return self._read(name, schema, runs).where(wanted)

    def among(self, keys: DataFrame, before: int) -> DataFrame:
        """Those of the keys ``(kind, key)`` that batches before this one have appended."""
        runs = self.runs(before)
        sizes = sorted({r.k for r in runs if r.rows})
        none = keys.select("kind", "key").limit(0)
        if not sizes:
            return none
        k = F.explode(F.array(*map(F.lit, sizes))).alias("k")
        placed = durable(self._placed(keys.distinct()).select("*", k).withColumn("bucket", self._bucket("k")))
        marks = self._touched("marks", MARKS, runs, placed).select("k", "bucket", "word", "bits")
        marked = placed.join(marks, ["k", "bucket", "word"]).where(F.expr("getbit(bits, bit)") == 1)
        maybe = durable(marked.select("kind", "key", "k", "bucket").distinct())
        if maybe.isEmpty():
            return none
        kept = self._touched("keys", KEYS, runs, maybe).select("kind", "key", "k", "bucket")
        return maybe.join(kept, ["k", "bucket", "kind", "key"], "left_semi").select("kind", "key").distinct()
