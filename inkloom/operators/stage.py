"""Tables in the folder that driver and executors share: where a plan is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only in local mode, where one machine does all."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="inkloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the application's part of the shared folder, which goes when the driver ends."""
    base = f"{shared_dir(spark)}/inkloom/{spark.sparkContext.applicationId}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    return f"{base}/{tag}-{uuid.uuid4().hex}"


def settle(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here."""
    path = shared_path(spark, tag)
    # Denser than the default: what is written between stages shares the disk with the exchanges.
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
