"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import numbered

#: Words in file names that give away a file's role.
ROLES = (("news", ("news", "headline", "article")), ("price", ("price", "ohlcv", "stock", "history")), ("metadata", ("meta", "readme", "info")))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """With a schema, so that no pass infers one; broken lines give nulls."""
    d = spark.read.schema(schema).json(path)
    return d.limit(limit) if limit is not None else d


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=sep, header=header)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, sep=sep, header=True)


def scan_dated_dirs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """JSON lines in <root>/<ticker>/<date>..., a file or a folder of files for each date, with ticker and date from the path."""
    d = spark.read.schema(schema).json(f"{root}/*/*").withColumn("_f", F.col("_metadata.file_path"))
    part = lambda i: F.regexp_extract("_f", r"([^/]+)/(\d{4}-\d{2}-\d{2})[^/]*(?:/[^/]+)?$", i)
    return d.withColumns({"ticker": part(1), "date": F.try_to_date(part(2))}).drop("_f")


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Path, suffix, size and guessed role of every file; contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    role = F.lit("unknown")
    for r, words in reversed(ROLES):
        role = F.when(name.rlike("|".join(words)), r).otherwise(role)
    return d.select("path", F.regexp_extract(name, r"(\.[^.]+)$", 1).alias("suffix"), F.round(F.col("length") / 1048576, 6).alias("size_mb"), role.alias("role"))


def head_preview(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.orderBy(key).limit(n)


def batch_requests(df: DataFrame, key: str, prompt: str, model: str, chunk: int = 1000) -> DataFrame:
    """Request lines with the part they belong to, `chunk` a part in key order."""
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))).alias("messages"))
    line = F.to_json(F.struct(F.col(key).cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))
    return numbered(df, key).select(F.col(key), F.floor((F.col("n") - 1) / chunk).alias("part"), line.alias("request"))


def pending(df: DataFrame, cache: DataFrame, key: str, result: str) -> DataFrame:
    """Rows without a cached result; an empty result counts as none."""
    return df.join(cache.where(F.coalesce(F.col(result), F.lit("")) != "").select(key), key, "left_anti")


def merge_cache(cache: DataFrame, new: DataFrame, key: str, result: str) -> DataFrame:
    done = cache.where(F.coalesce(F.col(result), F.lit("")) != "")
    return done.unionByName(new.join(done.select(key), key, "left_anti"))


def load_word_vectors(spark: SparkSession, path: str, vocab: DataFrame) -> DataFrame:
    """word, vector of the vocabulary's words from lines "word f1 ... fn"; spellings of unknown become UNK."""
    parts = F.split("value", " ")
    d = spark.read.text(path).select(F.element_at(parts, 1).alias("word"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x.try_cast("double")).alias("vector"))
    word: Column = F.when(F.lower("word").isin("<unk>", "unk"), "UNK").otherwise(F.col("word"))
    return d.withColumn("word", word).join(vocab.select("word").distinct(), "word", "left_semi")
