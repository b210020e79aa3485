"""Cleaning and normalisation of news and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Column names that stand for each role.
NEWS_NAMES = {"ticker": ("ticker", "symbol", "stock_symbol", "stock"), "timestamp_utc": ("timestamp_utc", "date", "datetime", "published", "time"), "headline": ("headline", "title", "article_title"), "body": ("body", "article", "text", "content"), "source": ("source", "publisher"), "url": ("url", "link"), "author": ("author",)}
PRICE_NAMES = {"ticker": ("ticker", "symbol"), "date": ("date", "day"), "open": ("open",), "high": ("high",), "low": ("low",), "close": ("close",), "adj_close": ("adj_close", "adj close", "adjclose"), "volume": ("volume", "vol")}


def rename_roles(df: DataFrame, names: dict[str, tuple[str, ...]]) -> tuple[DataFrame, list[str]]:
    """Columns by role, and a warning for each role without a column (null then)."""
    have = {c.lower().strip(): c for c in df.columns}
    cols, warnings = [], []
    for role, aliases in names.items():
        found = next((have[a] for a in aliases if a in have), None)
        cols.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(role))
        if not found:
            warnings.append(f"no column for {role}")
    return df.select(*cols), warnings


def normalize_news(df: DataFrame) -> tuple[DataFrame, list[str]]:
    d, w = rename_roles(df, NEWS_NAMES)
    return d.withColumns({"body": F.coalesce("body", "headline"), "timestamp_utc": F.try_to_timestamp(F.col("timestamp_utc").cast("string"))}), w


def normalize_prices(df: DataFrame) -> tuple[DataFrame, list[str]]:
    d, w = rename_roles(df, PRICE_NAMES)
    return d.withColumn("adj_close", F.coalesce(F.col("adj_close").cast("double"), F.col("close").cast("double"))), w


def clean_text(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def strip_html(x: Column) -> Column:
    return clean_text(F.regexp_replace(F.regexp_replace(x, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " "))


def clean_news(df: DataFrame, key: str = "news_id") -> DataFrame:
    """Drops rows without ticker or time and repeats of (ticker, time, headline), the least key staying; strips markup."""
    d = df.where((F.trim("ticker") != "") & F.col("timestamp_utc").isNotNull())
    w = Window.partitionBy("ticker", "timestamp_utc", "headline").orderBy(key)
    d = d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("_clean", strip_html(F.col("headline")))
    return d.withColumns({"headline_raw": F.when(F.col("_clean") != F.col("headline"), F.col("headline")), "headline": F.col("_clean"), "body": strip_html(F.col("body"))}).drop("_clean")


def clean_prices(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.try_to_date(F.col("date").cast("string"))).where("close > 0 AND volume >= 0 AND date IS NOT NULL")


def select_universe(news: DataFrame, prices: DataFrame, n: int, fallback: tuple[str, ...] = ()) -> DataFrame:
    """The n tickers with most news of those that have prices too; where there are none, the fallback's tickers that have prices."""
    priced = prices.select("ticker").distinct()
    both = news.join(priced, "ticker", "left_semi").groupBy("ticker").agg(F.count(F.lit(1)).alias("n_news"))
    if fallback:
        none = both.agg((F.count(F.lit(1)) == 0).alias("_none"))  # one row
        spare = priced.where(F.col("ticker").isin(*fallback)).join(F.broadcast(none), F.col("_none")).select("ticker", F.lit(0).cast("long").alias("n_news"))
        both = both.unionByName(spare)
    return both.orderBy(F.desc("n_news"), "ticker").limit(n)


def select_years(df: DataFrame, date: str, first: int, last: int, span: int = 3) -> DataFrame:
    """The rows of the years first to last; where there are none, those of the latest `span` years without a gap."""
    years = df.select(F.year(date).alias("_y")).where("_y IS NOT NULL").distinct()  # a row a year
    run = years.withColumn("_n", F.count(F.lit(1)).over(Window.orderBy("_y").rangeBetween(1 - span, 0)))
    bounds = run.agg(F.count_if(F.col("_y").between(first, last)).alias("_in"), F.max(F.when(F.col("_n") == span, F.col("_y"))).alias("_end"))
    low, high = F.when(F.col("_in") > 0, first).otherwise(F.col("_end") - span + 1), F.when(F.col("_in") > 0, last).otherwise(F.col("_end"))
    return df.join(F.broadcast(bounds.select(low.alias("_low"), high.alias("_high"))), F.year(date).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def length_filter(df: DataFrame, col: str, least: int = 0, most: int | None = None) -> DataFrame:
    n = F.length(col)
    return df.where((n >= least) & (F.lit(True) if most is None else n <= most))


def truncate_text(x: Column, most: int) -> Column:
    return F.substring(x, 1, most)


def extract_answer(x: Column, sep: str = "#### ") -> Column:
    return F.try_element_at(F.split(x, sep), F.lit(2))


def fill_groups(df: DataFrame, strings: tuple[str, ...] = (), numbers: tuple[str, ...] = (), thirds: tuple[str, ...] = ()) -> DataFrame:
    return df.fillna({c: "" for c in strings} | {c: 0.0 for c in numbers} | {c: 0.33 for c in thirds})


def answer_rows(df: DataFrame, text: str, key: str, sep: str = "#### ") -> DataFrame:
    """key, answer of all rows but the one of least key, which is the heading."""
    first = df.agg(F.min(key).alias("_first"))  # one row
    d = df.join(F.broadcast(first), F.col(key) > F.col("_first"))
    return d.select(key, extract_answer(F.col(text), "\\Q" + sep + "\\E").alias("answer"))
