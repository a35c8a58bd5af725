"""Run records as a stream: each micro-batch is upserted into a table of buckets.

A key's hash names its bucket. A batch rewrites only the buckets that it has keys of, each into a new folder; a manifest, one
small file a batch, then says which folder of each bucket is the table's. It is written last and in one piece: a batch that
fails before leaves folders that nothing names, and runs again into folders of the same name; one that had its manifest is
done and isn't run again. Folders and manifests that no recent manifest needs are deleted.

Of the rows of a key, the one with the highest order columns stays, whichever batch it came in; of equal ones the later
batch's. So late rows don't replace newer ones, and the table is the same however the stream is cut into batches. Keys may be
null. The largest bucket's rows are a shuffle's partitions, split where they are large; nothing is collected but the numbers
of the touched buckets.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lectio.functions.files import Files

BUCKETS, KEPT = 64, 2


class BucketTable:
    """A keyed table in the folder `path`. keys: what a row is found by; order: which of a key's rows is the last."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.order, self.n = spark, path, keys, order, buckets
        self.files = Files(spark)

    def manifest(self, number: int | None = None) -> dict | None:
        """The manifest of a batch, or the newest one."""
        names = [n for n in self.files.names(f"{self.path}/manifest") if n.endswith(".json")]
        if number is not None:
            names = [n for n in names if n == f"{number:020d}.json"]
        return json.loads(self.files.read(f"{self.path}/manifest/{names[-1]}")) if names else None

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None where nothing has been written."""
        now = self.manifest()
        if now is None:
            return None
        schema = StructType.fromJson(json.loads(now["schema"]))
        folders = [f"{self.path}/{f}" for b, f in now["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Puts a batch in, once: a number that the table has, or that is before its newest, changes nothing."""
        now = self.manifest()
        if now is not None and now["number"] >= number:
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).alias("lectio_bucket")
        batch = batch.persist()
        try:
            touched = [r[0] for r in batch.select(bucket).distinct().collect()]
            old = self.read(touched)
            rows = batch.withColumn("lectio_number", F.lit(number))
            if old is not None:
                rows = old.withColumn("lectio_number", F.lit(-1)).unionByName(rows, allowMissingColumns=True)
            columns = [c for c in rows.columns if c != "lectio_number"]
            last = F.max_by(F.struct(*(F.col(c) for c in columns)), F.struct(*self.order, "lectio_number"))
            new = rows.groupBy(*self.keys).agg(last.alias("r")).select("r.*")
            folder = f"data/n={number}"
            new.withColumn("lectio_bucket", bucket).hint("rebalance", F.col("lectio_bucket")).write.mode("overwrite").partitionBy("lectio_bucket").parquet(f"{self.path}/{folder}")
        finally:
            batch.unpersist()
        of = (now or {"buckets": {}})["buckets"] | {str(b): f"{folder}/lectio_bucket={b}" for b in touched}
        found = {"number": number, "buckets": of, "schema": json.dumps(new.schema.jsonValue())}
        self.files.write_once(f"{self.path}/manifest/{number:020d}.json", json.dumps(found))
        self.vacuum()

    def vacuum(self, keep: int = KEPT) -> list[str]:
        """Deletes what the last `keep` manifests don't name, manifests too, and returns it. Readers of the table as it was up to
        so many batches ago aren't disturbed."""
        names = [n for n in self.files.names(f"{self.path}/manifest") if n.endswith(".json")]
        needed = {f for n in names[-keep:] for f in json.loads(self.files.read(f"{self.path}/manifest/{n}"))["buckets"].values()}
        gone = [f"manifest/{n}" for n in names[:-keep]]
        newest = int(names[-1][:-5]) if names else -1
        for n in self.files.names(f"{self.path}/data"):
            if int(n.removeprefix("n=")) <= newest:
                has = {f"data/{n}/{b}" for b in self.files.names(f"{self.path}/data/{n}") if b.startswith("lectio_bucket=")}
                gone += [f"data/{n}"] if not has & needed else sorted(has - needed)
        for g in gone:
            self.files.delete(f"{self.path}/{g}")
        return gone


def upsert_into(path: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch."""
    return lambda batch, number: BucketTable(batch.sparkSession, path, keys, order, buckets).upsert(batch, number)


def start(records: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> StreamingQuery:
    """Upserts what the stream has into the table, then ends; the checkpoint keeps its place for the next start."""
    return records.writeStream.foreachBatch(upsert_into(path, keys, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
