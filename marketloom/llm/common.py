"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. Where the session names none, a local master gets one of its own; on a cluster
    that is an error, as executors could not read a folder of the driver."""
    if spark.sparkContext.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not at and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder, with its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with so many rows may be hot.
HOT = 100


def join_spread(d: DataFrame, t: DataFrame, key: str, n: str, rows: int) -> DataFrame:
    """d joined with t, which has one row for each key and, in column n, how many of d's `rows` rows have it.

    Keys with more than HOT rows, and more than an eighth of a partition's share of all, are so few (8 for each partition
    at most) that their rows of t are broadcast, and their rows of d stay where they are. All others meet by shuffle.
    """
    bound = max(HOT, rows // (8 * shuffle_partitions(d.sparkSession)))
    hot = t.where(F.col(n) > bound)
    if hot.limit(1).count() == 0:
        return d.join(t, key)
    marked = d.join(F.broadcast(hot), key, "left")
    rest = marked.where(F.col(n).isNull()).select(*d.columns).join(t.where(F.col(n) <= bound), key)
    return marked.where(F.col(n).isNotNull()).unionByName(rest)


def longs_as_text(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """df with its 64-bit columns among names as text, and which these are. Pandas turns such a column into doubles where it
    holds a null, and they lose what is beyond 2^53."""
    big = [f.name for f in df.schema.fields if f.name in names and isinstance(f.dataType, LongType)]
    return df.withColumns({c: F.col(f"`{c}`").cast("string") for c in big}), big


def longs_again(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`").cast("long") for c in names})


def vocab(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
