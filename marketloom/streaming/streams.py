"""Structured Streaming forms of the running operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_COUNT = 16


def stream_table(spark, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def hash_take(stream: DataFrame, key: str, share: float) -> tuple[DataFrame, DataFrame]:
    """(validation, training) parts of a stream by key digest; the same rows in any batch order. A null key is its own value."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(42)))
    b = F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") % 10000 < int(share * 10000)
    return stream.where(b), stream.where(~b)


def running_moments(stream: DataFrame, x: str) -> DataFrame:
    return stream.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"))


def streaming_bars(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of a tick stream; a bar is final once the watermark has passed it."""
    at = F.struct("ts", "event_id")
    d = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("ticker", F.window("ts", width).alias("w"))
    return d.agg(F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"), F.count(F.lit(1)).alias("n_ticks")).select("ticker", F.col("w.start").alias("bar"), "open", "high", "low", "close", "n_ticks")


def news_on_calendar(news: DataFrame, calendar: DataFrame, late: str = "1 day") -> DataFrame:
    """A news stream without repeats, joined with the static table day -> event_date of each ticker."""
    d = news.withWatermark("timestamp_utc", late).dropDuplicatesWithinWatermark(["ticker", "timestamp_utc", "headline"])
    return d.withColumn("day", F.to_date("timestamp_utc")).join(calendar, ["ticker", "day"])


def buffered_advantage(batch: DataFrame, held: DataFrame, size: int = 32, least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(key, id, advantage) of a batch, and the buffers after it: z-scores within each key's last `size` rewards, the
    batch's own included, or within the whole batch for keys that hold fewer than `least`.

    batch: key, id, reward; held: key, held (array), one row a key. For foreachBatch, with held as a table between batches.
    """
    new = batch.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "reward"))).alias("x"))
    both = new.join(held.withColumnRenamed("held", "old"), "key", "full")
    own = F.concat(F.coalesce("old", F.array().cast("array<double>")), F.coalesce(F.transform("x", lambda e: e["reward"]), F.array().cast("array<double>")))
    kept = both.select("key", own.alias("a")).select("key", F.slice("a", F.greatest(F.size("a") - size + 1, F.lit(1)), size).alias("held"))
    values = kept.select("key", F.size("held").alias("n"), F.explode("held").alias("v")).groupBy("key", "n").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    whole = batch.agg(F.avg("reward").alias("bm"), F.stddev_pop("reward").alias("bs"))  # one row
    d = batch.join(values, "key").join(F.broadcast(whole), F.lit(True))
    few = F.col("n") < least
    z = (F.col("reward") - F.when(few, F.col("bm")).otherwise(F.col("m"))) / (F.when(few, F.col("bs")).otherwise(F.col("s")) + 1e-6)
    return d.select("key", "id", z.alias("advantage")), kept


def adaptive_coefficient(batches: DataFrame, start: float = 0.05, target: float = 6.0, horizon: int = 10000) -> DataFrame:
    """The coefficient after each batch: an ordered fold of (batch_id, kl, n); one row a batch."""
    s = F.array_sort(F.collect_list(F.struct("batch_id", "kl", "n")))
    step = lambda v, x: v * (1 + F.least(F.greatest(x["kl"] / target - 1, F.lit(-0.2)), F.lit(0.2)) * x["n"] / horizon)
    return batches.agg(F.aggregate(s, F.lit(start), step).alias("coefficient"))
