"""Running a stream to its end: files that arrive one after another in, a table out."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.shared import new_folder, remove

NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A wave has a file for so many rows.
FILE_ROWS = 50_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks_state(spark: SparkSession, empty_batches: bool = True):
    """State in RocksDB, which operators with state of their own need and which keeps state out of the heap."""
    wanted = {PROVIDER: ROCKS, NO_DATA: str(empty_batches).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


#: The column that deals a wave's rows to its files.
PART = "_part"


def arrive(df: DataFrame, path: str, wave: str, waves: range, files: int = 1) -> None:
    """Adds the rows of each wave to a folder as so many files, wave after wave, as producers would that close their files
    for each wave. A wave and its files are what a micro-batch of `follow` reads. Each file begins with a row without values
    and with a null PART, so that every wave has all its files, however few its rows; `follow` leaves these rows out."""
    spark = df.sparkSession
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files)).cast("int")
    kept = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.drop(wave).schema.fields]
    starts = spark.range(files, numPartitions=1).select(*kept, F.lit(None).cast("int").alias(PART), F.col("id").cast("int").alias("_file"))
    for w in waves:
        own = df.where(F.col(wave) == w).drop(wave).withColumn(PART, part).withColumn("_file", F.col(PART))
        own.unionByName(starts).repartitionById(files, F.col("_file")).drop("_file").write.mode("append").parquet(path)


def follow(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    """A stream of what `arrive` writes in the order of its arrival, a wave's files to a micro-batch."""
    stored = StructType([*schema.fields, StructField(PART, IntegerType())])
    return spark.readStream.schema(stored).option("maxFilesPerTrigger", files).parquet(path).where(F.col(PART).isNotNull()).drop(PART)


def drained(stream: DataFrame, out: str, checkpoint: str, empty_batches: bool = True) -> DataFrame:
    """The table at out after all that has arrived is appended to it; run again with the same folders, it goes on where it
    stopped, and adds nothing twice. empty_batches: a last batch without rows moves on what waits for the watermark; state
    that lives for a time would ask for such batches for ever, so streams with it do without."""
    spark = stream.sparkSession
    with rocks_state(spark, empty_batches):
        stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def snapshots(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """The whole result after each micro-batch, with the batch's number as `batch`; a batch that is run again replaces its own."""
    spark = stream.sparkSession

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    with rocks_state(spark):
        stream.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def run_waves(df: DataFrame, wave: str, waves: range, make: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, str, str], DataFrame] = drained) -> DataFrame:
    """What a stream made by `make` leaves when df's rows arrive wave by wave. Its files lie in the shared folder; those of
    the input and of the state go when the stream has ended, the result stays. df is made once and lies there by waves, from
    which each wave's files come: one for each FILE_ROWS rows of the largest wave, at most as many as a shuffle has partitions."""
    spark = df.sparkSession
    at = new_folder(spark, "stream")
    df.where(F.col(wave).isNotNull()).write.partitionBy(wave).parquet(f"{at}/waves")
    rows = spark.read.schema(df.schema).parquet(f"{at}/waves").select(df.columns)
    most = rows.groupBy(wave).count().agg(F.max("count")).first()[0] or 0
    files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // FILE_ROWS)))
    try:
        arrive(rows, f"{at}/in", wave, waves, files)
        return sink(make(follow(spark, f"{at}/in", rows.drop(wave).schema, files)), f"{at}/out", f"{at}/state")
    finally:
        remove(spark, f"{at}/waves")
        remove(spark, f"{at}/in")
        remove(spark, f"{at}/state")
