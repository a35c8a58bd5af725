"""Tables in the folder that all executors share, which cut the lineage of what is used several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lectio.functions.deploy import deployed


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only where the cluster names none and driver and executors are one process
    (tests), a folder of our own."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lectio-checkpoint-"))
        found = context.getCheckpointDir()
    return found


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back.

    A lost executor then costs the reread of a file, and what was decided once (partition numbers, offsets within a
    partition) cannot change when a stage runs again. The table stays until cleanup().
    """
    spark = deployed(df.sparkSession)
    path = f"{shared_dir(spark)}/lectio-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    _paths(spark).append(path)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for what isn't a table of its own; it goes with cleanup()."""
    path = f"{shared_dir(deployed(spark))}/lectio-{name}-{uuid.uuid4().hex}"
    _paths(spark).append(path)
    return path


def _paths(spark: SparkSession) -> list[str]:
    context = spark.sparkContext
    if not hasattr(context, "_lectio_tables"):
        context._lectio_tables = []
    return context._lectio_tables


def mark(spark: SparkSession) -> int:
    """A place in the order of written tables, for since()."""
    return len(_paths(spark))


def since(spark: SparkSession, place: int) -> list[str]:
    return _paths(spark)[place:]


def dropped(spark: SparkSession, paths: list[str]) -> int:
    """Deletes these written tables. How many were there."""
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    gone = set(paths)
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        n += bool(path.getFileSystem(conf).delete(path, True))
    _paths(spark)[:] = [p for p in _paths(spark) if p not in gone]
    return n


def cleanup(spark: SparkSession) -> int:
    """Deletes the tables that written() has made in this context, once the results that read them are saved. How many."""
    return dropped(spark, list(_paths(spark)))
