"""Request files in parts with a manifest, and a run that goes on where an earlier one stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import pending
from .shared import numbered, saved


def _manifest(spark: SparkSession, path: str, key_type: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(f"key {key_type}, part long").parquet(f"{path}/manifest")
    return spark.createDataFrame([], f"key {key_type}, part long")


def request_lines(df: DataFrame, key: str, prompt: str, model: str) -> DataFrame:
    """key, request: one JSON line for each row."""
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))).alias("messages"))
    line = F.struct(F.col(key).cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))
    return df.select(F.col(key).alias("key"), F.to_json(line).alias("request"))


def write_requests(df: DataFrame, cache: DataFrame, path: str, key: str, prompt: str, result: str, model: str, chunk: int = 1000) -> DataFrame:
    """The parts that this run has written: part, n_requests.

    Rows that have neither a result in the cache nor a request in an earlier part become text files in folders part=k of
    path/requests, `chunk` requests to a part in key order; keys must differ. The manifest (key, part) is appended when the
    parts are whole. A run that died before that leaves parts which the next run overwrites, as it numbers its own from the
    manifest's last part on; a run with nothing left to ask writes nothing. So runs can be repeated at any point.
    """
    spark = df.sparkSession
    done = _manifest(spark, path, df.schema[key].dataType.simpleString())
    todo = request_lines(pending(df, cache, key, result), key, prompt, model).join(done.select("key"), "key", "left_anti")
    first = (done.agg(F.max("part")).first()[0] or 0) + 1
    parts = saved(numbered(todo, "key").select("key", (F.floor((F.col("n") - 1) / chunk) + first).alias("part"), "request"))
    counts = saved(parts.groupBy("part").agg(F.count(F.lit(1)).alias("n_requests")))
    if counts.limit(1).count():
        # Lines of a part lie in one file in key order: parts of `chunk` lines are dealt out whole.
        lines = parts.repartition("part").sortWithinPartitions("part", "key").select("part", "request")
        lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").text(f"{path}/requests")
        parts.select("key", "part").write.mode("append").parquet(f"{path}/manifest")
    return counts


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """part, request of all lines written."""
    return spark.read.option("basePath", f"{path}/requests").schema("value string, part long").text(f"{path}/requests").select("part", F.col("value").alias("request"))
