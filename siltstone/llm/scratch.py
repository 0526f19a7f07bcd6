"""Tables written between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FALLBACK = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master without that setting, a folder of this application."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{LOCAL_FALLBACK}/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siltstone/{name}-{uuid.uuid4().hex}"


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame once and read it back: cuts the lineage and survives lost executors."""
    spark = frame.sparkSession
    path = fresh_path(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(frame.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the shuffle files of finished steps go. Spark deletes them once the driver's collector finds that nothing
    refers to them any more, which by itself may be half an hour later, with all of them on the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard_all(spark: SparkSession) -> None:
    """Delete everything that operators have staged under the shared folder of this session."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/siltstone")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
