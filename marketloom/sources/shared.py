"""Folders that the driver and all executors share, and what is written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it names none, a local master gets one of its own; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """df with its row numbers from 1 in the order of the keys (null first), which may be of any type that Spark can order.

    Rows are dealt to ranges of the keys by Spark's own sample of them, as many ranges as a shuffle has partitions, and
    numbered inside their range; only the ranges' sizes are summed in order. Rows that agree in all keys are numbered in any
    order and stay in one range: where many may, give a further key that tells them apart. An empty table gives none.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = saved(df.repartitionByRange(parts, *[F.col(k).asc_nulls_first() for k in keys]).withColumn("_range", F.spark_partition_id()))
    sizes = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*[F.col(k).asc_nulls_first() for k in keys]))
    return kept.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_own", "_before")
