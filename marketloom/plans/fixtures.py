"""Adapters from the provided tables to the engine's input schemas: plain column arithmetic, no randomness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per brand. One shuffle on (ticker, date); part is small against lineitem and Spark chooses the join."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    d = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date"), px.alias("px"), at.alias("at"), "l_quantity")
    return d.groupBy("ticker", "date").agg(
        F.min_by("px", "at").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "at").alias("close"),
        F.max_by("px", "at").alias("adj_close"), F.sum("l_quantity").cast("long").alias("volume"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news items of the brands, spread over the bars' dates."""
    brands = read(spark, sf_dir, "part").select("p_brand").distinct()
    ranked = brands.select(F.col("p_brand").alias("ticker"), (F.regexp_extract("p_brand", r"(\d+)$", 1).try_cast("int") % 25).alias("k"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", F.pmod("doc_id", F.lit(25)).cast("int").alias("k"))
    ts = F.timestamp_seconds(F.unix_seconds(F.lit("1995-01-02 00:00:00").cast("timestamp")) + F.pmod(F.col("doc_id") * 7919, F.lit(2499)) * 86400 + F.pmod(F.col("doc_id") * 104729, F.lit(86400)))
    return docs.join(ranked, "k").select(
        F.concat(F.lit("n"), "doc_id").alias("news_id"), "ticker", ts.alias("timestamp_utc"), F.substring("text", 1, 80).alias("headline"), F.col("text").alias("body"), "source"
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 4).alias("sample_id"), (F.col("vec_id") % 4).alias("candidate_id"), F.col("embedding")[0].cast("double").alias("reward"))


LABELS = ("Strong Down", "Mild Down", "Neutral", "Mild Up", "Strong Up")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax of five components as class probabilities; the true class from the label."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 5), lambda x: F.exp(x.cast("double"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    e = e.withColumn("p", F.transform("e", lambda x: x / total))
    names = F.array(*map(F.lit, LABELS))
    return e.select(
        F.col("vec_id").alias("sample_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("vec_id") % 250).cast("int")).alias("window_end_date"), "p",
        F.element_at(names, (F.col("label") % 5 + 1).cast("int")).alias("true_label"), F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("pred_label"),
        ((F.pmod(F.col("vec_id") * 37, F.lit(101)) - 50) / 1000.0).alias("stock_return"),
    )


def logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy and reference log-probabilities of chosen and rejected answers."""
    v = lambda i: (-F.abs(F.col("embedding")[i].cast("double")) * 10).alias(("c", "r", "c0", "r0")[i - 5])
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair_id"), *map(v, range(5, 9)))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, messages in turn order."""
    c = read(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return c.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.concat(F.lit("U"), "user_id").alias("ticker"), "ts", "event_id", F.col("value").alias("px"))
