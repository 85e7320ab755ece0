"""Spark session defaults and staged tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that suit wide text rows; a cluster overrides them with spark-submit.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", name: str = "pagetide", **conf) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir of the session.

    A local session (tests, a laptop) without that setting gets a fresh local folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pagetide-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Cuts the lineage and survives lost executors. Unlike an RDD checkpoint the copy stays columnar, so a later
    reader that needs only narrow columns never touches the page text again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*staged: DataFrame) -> None:
    """Remove staged tables that no later step reads: each step that did has been written itself.

    Shuffle files of the jobs before go with the driver's plans, once its collector has run.
    """
    for table in staged:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if staged:
        gc.collect()
        staged[0].sparkSession._jvm.System.gc()


def keep_partitioned(df: DataFrame) -> DataFrame:
    """Checkpoint of a frame that was repartitioned by keys; later joins on these keys need no shuffle of it.

    The plan must be final for Spark to remember the partitioning, so it is not re-planned at run time.
    """
    spark = df.sparkSession
    shared_dir(spark)
    setting = "spark.sql.adaptive.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(setting, before)
