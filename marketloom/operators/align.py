"""Alignment of news with trading days, labels and chronological splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Phrases that give away a later price.
LEAKAGE_PHRASES = ("shares surged", "shares plunged", "stock rises after", "stock falls after", "trading higher after", "trading lower after")
CLASS_BOUNDS = (-0.03, -0.0075, 0.0075, 0.03)


def by_ticker() -> WindowSpec:
    """The order of every ticker's rows: one shuffle and one sort serve all functions over it."""
    return Window.partitionBy("ticker").orderBy("date")


def next_trading_day(news: DataFrame, calendar: DataFrame, same_day_before: int | None = None) -> DataFrame:
    """event_date: the first trading day after the news day, or that day itself if it trades and the hour is before
    same_day_before. Calendar and news are merged in one ordered window by ticker, so there is no range join;
    news after the last trading day has no event_date and is dropped.
    """
    day = F.to_date("timestamp_utc")
    early = F.lit(False) if same_day_before is None else F.hour("timestamp_utc") < same_day_before
    d = news.withColumn("_day", F.when(early, F.date_sub(day, 1)).otherwise(day))
    # Only distinct (ticker, day) go through the window, so neither texts nor a ticker's many items of a day are sorted.
    days = d.select("ticker", F.col("_day").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("date").alias("trade")).distinct()
    c = calendar.select("ticker", F.col("date").alias("at"), F.lit(0).alias("kind"), F.col("date").alias("trade"))
    w = Window.partitionBy("ticker").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    table = days.unionByName(c).withColumn("event_date", F.last("trade", ignorenulls=True).over(w)).where("kind = 1 AND event_date IS NOT NULL")
    return d.join(table.select("ticker", F.col("at").alias("_day"), "event_date"), ["ticker", "_day"]).select(*news.columns, "event_date")


def prior_window(bars: DataFrame, n: int = 60) -> DataFrame:
    """window_start_date and window_end_date of each bar that has n bars before it."""
    d = bars.select("ticker", "date", F.lag("date", n).over(by_ticker()).alias("window_start_date"), F.lag("date", 1).over(by_ticker()).alias("window_end_date"))
    return d.where("window_start_date IS NOT NULL")


def future_returns(bars: DataFrame, h: int = 1, market_ticker: str = "SPY") -> DataFrame:
    """Return over h bars, the market's (its own ticker if present, else the mean over tickers) and the difference."""
    d = bars.select("ticker", "date", (F.try_divide(F.lead("adj_close", h).over(by_ticker()), F.col("adj_close")) - 1).alias("stock_return"))
    m = d.groupBy("date").agg(F.coalesce(F.max(F.when(F.col("ticker") == market_ticker, F.col("stock_return"))), F.avg("stock_return")).alias("market_return"))
    return d.join(m, "date").withColumn("abnormal_return", F.col("stock_return") - F.col("market_return"))


def label5(x: Column) -> Column:
    a, b, c, d = CLASS_BOUNDS
    return F.when(x <= a, "Strong Down").when(x <= b, "Mild Down").when(x < c, "Neutral").when(x < d, "Mild Up").when(x.isNotNull(), "Strong Up")


def movement_class(x: Column, k: int = 2, low: float = -0.004, high: float = 0.005) -> Column:
    """2 classes: 0 up to 1e-7, else 1. 3 classes: 0 below low, 2 from high on, else 1."""
    if k == 2:
        return F.when(x <= 1e-7, 0).otherwise(1)
    return F.when(x < low, 0).when(x < high, 1).otherwise(2)


def drop_flat(df: DataFrame, x: str, low: float = -0.005, high: float = 0.0055) -> DataFrame:
    return df.where(~((F.col(x) >= low) & (F.col(x) < high)))


def leakage_flags(df: DataFrame) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "headline", "body"))
    hit = F.lit(False)
    for p in LEAKAGE_PHRASES:
        hit = hit | text.contains(p)
    return df.withColumns({"leakage_phrase_flag": hit, "post_market_uncertain_flag": F.hour("timestamp_utc") >= 20})


def date_split(df: DataFrame, train: float = 0.7, val: float = 0.15, date: str = "date") -> DataFrame:
    """Chronological split by distinct dates. The date table is small and only it is ranked."""
    days = df.select(date).distinct()
    w = Window.orderBy(date)
    days = days.select(date, (F.row_number().over(w) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    s = F.when(F.col("k") < F.floor(F.col("n") * train), "train").when(F.col("k") < F.floor(F.col("n") * (train + val)), "val").otherwise("test")
    return df.join(days.select(date, s.alias("split")), date)


def ticker_split(df: DataFrame, share: float = 0.8) -> DataFrame:
    """The first round(n * share) rows of each ticker, half to even, are train."""
    every = Window.partitionBy("ticker")
    return df.withColumn("split", F.when(F.row_number().over(by_ticker()) <= F.bround(F.count(F.lit(1)).over(every) * F.lit(share)), "train").otherwise("test"))


def hash_split(df: DataFrame, key: str, test_share: float, seed: int = 42) -> DataFrame:
    """Reproducible split by the key's digest; the same rows whatever the partitioning."""
    bucket = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))), 1, 7), 16, 10).cast("long") % 10000
    return df.withColumn("split", F.when(bucket < int(test_share * 10000), "test").otherwise("train"))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.withColumn("_o", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)))).orderBy("_o", key).limit(n).drop("_o")


def latest_fraction(df: DataFrame, share: float, date: str, key: str, before: float | None = None) -> DataFrame:
    """The last floor(n * share) rows by (date, key), or all but the first floor(n * before), which can be one more.
    Only the rows of the date at the cut are ranked."""
    by_day = df.groupBy(date).count()
    w = Window.orderBy(F.desc(date))
    days = by_day.withColumns({"_after": F.sum("count").over(w) - F.col("count"), "_all": F.sum("count").over(Window.partitionBy())})
    days = days.withColumn("_left", (F.floor(F.col("_all") * share) if before is None else F.col("_all") - F.floor(F.col("_all") * before)) - F.col("_after")).where("_left > 0").select(date, "_left", F.col("count").alias("_count"))
    d = df.join(days, date)
    inside = d.where("_count <= _left").drop("_left", "_count")
    cut = d.where("_count > _left").withColumn("_r", F.row_number().over(Window.partitionBy(date).orderBy(F.desc(key)))).where("_r <= _left").drop("_left", "_count", "_r")
    return inside.unionByName(cut)


def lookback(targets: DataFrame, messages: DataFrame, days: int) -> DataFrame:
    """Texts of the `days` calendar days before each target date, in order; an equi-join on exploded offsets."""
    t = targets.select("ticker", "date", F.explode(F.sequence(F.date_sub("date", days), F.date_sub("date", 1))).alias("day"))
    j = t.join(messages, ["ticker", "day"])
    return j.groupBy("ticker", "date").agg(F.array_sort(F.collect_list(F.struct("day", "id", "text"))).alias("m")).select("ticker", "date", F.transform("m", lambda x: x["text"]).alias("texts"))


def price_lookback(bars: DataFrame, days: int = 5, price: str = "adj_close", keep: tuple[str, ...] = ()) -> DataFrame:
    """Prices of the days-1 calendar days before each date in order, and the last one before these (before_price).

    Dates without a price in either are left out. Range frames over one order serve both, so there is no self-join.
    """
    w = Window.partitionBy("ticker").orderBy(F.unix_date("date"))
    d = bars.withColumns({"prices": F.collect_list(price).over(w.rangeBetween(1 - days, -1)), "before_price": F.last(price, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, -days))})
    return d.where((F.size("prices") > 0) & F.col("before_price").isNotNull()).select("ticker", "date", "prices", "before_price", *keep)


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    c = df.groupBy(label).count()
    return c.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))


def majority_class(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).count().orderBy(F.desc("count"), label).limit(1)


def overlap_count(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys of a are in b; 0 for a clean split."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("n_overlap"))


def feature_join(samples: DataFrame, features: DataFrame, drop: tuple[str, ...] = ("date", "open", "high", "low", "close", "adj_close", "volume", "raw_file")) -> DataFrame:
    """Each sample with the features of its ticker on its window's last day, so that none is later; raw prices go."""
    f = features.withColumnRenamed("date", "window_end_date")
    return samples.join(f, ["ticker", "window_end_date"]).drop(*[c for c in drop if c in features.columns])


def point_in_time_violations(df: DataFrame, known: str = "window_end_date", event: str = "event_date") -> DataFrame:
    """One row: how many rows know a day that is not before their event."""
    return df.agg(F.count_if(F.col(known) >= F.col(event)).alias("n_late"))


def align_to_trading_days(samples: DataFrame, messages: DataFrame, most: int) -> DataFrame:
    """sample_id, date, n_msgs, msgs: messages of a sample's window on the first of its trading days that is later.

    samples: sample_id, ticker, dates (array, ordered); messages: ticker, day, id, text. Messages on or after the last
    date or before the first day of the lookback (samples' column first_day) take no part; samples with a trading day
    without messages are left out; a day keeps its first `most`.
    """
    s = samples.select("sample_id", "ticker", "dates", F.explode(F.sequence(F.col("first_day"), F.date_sub(F.element_at("dates", -1), 1))).alias("day"))
    j = s.join(messages, ["ticker", "day"])
    at = F.array_min(F.filter("dates", lambda t: t > F.col("day")))
    d = j.select("sample_id", F.size("dates").alias("n_days"), at.alias("date"), "day", "id", "text")
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy("sample_id", "n_days", "date").orderBy("day", "id"))).where(F.col("_k") <= most)  # no more than these are collected
    g = d.groupBy("sample_id", "n_days", "date").agg(F.array_sort(F.collect_list(F.struct("day", "id", "text"))).alias("m"))
    g = g.withColumn("_have", F.count(F.lit(1)).over(Window.partitionBy("sample_id"))).where("_have = n_days")
    return g.select("sample_id", "date", F.least(F.size("m"), F.lit(most)).alias("n_msgs"), F.transform(F.slice("m", 1, most), lambda x: x["text"]).alias("msgs"))


def zip_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of two tables side by side by an explicit row key; b's columns that a has too are left out."""
    return a.join(b.select(key, *[c for c in b.columns if c not in a.columns]), key)


def sentiment_label(change: Column) -> Column:
    return F.when(change > 0, "Positive").otherwise("Negative")


def phase_filter(df: DataFrame, phases: dict[str, tuple[str, str]], date: str = "date") -> DataFrame:
    """phase of each row by half-open date ranges; rows in none are left out."""
    phase = F.lit(None).cast("string")
    for name, (start, end) in phases.items():
        phase = F.when((F.col(date) >= F.lit(start).cast("date")) & (F.col(date) < F.lit(end).cast("date")), name).otherwise(phase)
    return df.withColumn("phase", phase).where("phase IS NOT NULL")


def movement_series(bars: DataFrame, phases: dict[str, tuple[str, str]], days: int = 5) -> DataFrame:
    """phase, ticker, date, movement of all rows that have a price lookback and are not flat."""
    w = by_ticker()
    m = bars.withColumn("movement", F.try_divide("adj_close", F.lag("adj_close").over(w)) - 1).select("ticker", "date", "movement")
    d = price_lookback(bars, days).select("ticker", "date").join(m, ["ticker", "date"])
    return phase_filter(drop_flat(d.where("movement IS NOT NULL"), "movement"), phases).select("phase", "ticker", "date", "movement")
