"""Queries that run streams to their end over rows that arrive in waves, some late and some twice, with SQL for what must be left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indicators
from ..sources.shared import saved
from ..streaming import buffers, runs, streams
from . import fixtures as X
from .queries import IND, NEWS, query, r

#: Ticks arrive by periods of six days; every 17th a period late, every 101st three: too late for a delay of seven days.
TICKS = """ticks AS (SELECT 'U' || user_id ticker, event_id, ts, "value" px, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 6 + CASE WHEN event_id % 101 = 0 THEN 3 WHEN event_id % 17 = 0 THEN 1 ELSE 0 END wave FROM events)"""
#: When a wave is read, rows are late by the watermark that the waves up to two before it have set.
LATE = "limits AS (SELECT wave, (SELECT max(ts) FROM {0} e WHERE e.wave <= w.wave - 2) - INTERVAL '{1}' lim FROM (SELECT DISTINCT wave FROM {0}) w)"


def _waves(df: DataFrame) -> range:
    ends = df.agg(F.min("wave"), F.max("wave")).first()
    return range(ends[0], ends[1] + 1) if ends[0] is not None else range(0)


def _ticks(s: SparkSession, d: str) -> DataFrame:
    behind = F.when(F.col("event_id") % 101 == 0, 3).when(F.col("event_id") % 17 == 0, 1).otherwise(0)
    period = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 6).cast("int")
    return X.intraday(s, d).withColumn("wave", period + behind)


@query(f"""WITH {TICKS}, {LATE.format("ticks", "7 days")}, kept AS (SELECT ticker, date_trunc('hour', ts) bar, ts, event_id, px FROM ticks JOIN limits USING (wave) WHERE lim IS NULL OR date_trunc('hour', ts) + INTERVAL '1 hour' > lim),
 last AS (SELECT max(ts) - INTERVAL '7 days' wm FROM ticks) SELECT ticker, bar, round(first(px ORDER BY ts, event_id), 4) AS "open", max(px) high, min(px) low, round(last(px ORDER BY ts, event_id), 4) AS "close", count(*) n_ticks
 FROM kept, last WHERE bar + INTERVAL '1 hour' <= wm GROUP BY ticker, bar""")
def stream_bars(s: SparkSession, d: str) -> DataFrame:
    """Hourly bars that are final once the watermark has passed them; ticks that come too late are left out."""
    t = _ticks(s, d)
    out = runs.run_waves(t, "wave", _waves(t), lambda x: streams.streaming_bars(x, late="7 days"))
    return out.withColumns({"bar": F.col("bar").cast("timestamp_ntz"), "open": r("open"), "close": r("close")})


@query(f"""WITH {TICKS} SELECT CAST(dense_rank() OVER (ORDER BY w.wave) - 1 AS INT) batch, count(px) n, round(avg(px), 6) mean, round(var_pop(px), 6) var FROM (SELECT DISTINCT wave FROM ticks) w JOIN ticks t ON t.wave <= w.wave GROUP BY w.wave""")
def stream_moments(s: SparkSession, d: str) -> DataFrame:
    """Count, mean and variance of all that has arrived, after each wave."""
    t = _ticks(s, d)
    out = runs.run_waves(t, "wave", _waves(t), lambda x: streams.running_moments(x, "px"), runs.snapshots)
    return out.select(F.col("batch").cast("int").alias("batch"), "n", r("mean", 6).alias("mean"), r("var", 6).alias("var"))


def _arrivals(s: SparkSession, d: str) -> DataFrame:
    """News by periods of 300 days; every 37th item comes three periods late, every tenth once more a period later."""
    n = X.news(s, d).select("news_id", "ticker", "timestamp_utc", "headline")
    i = F.substring("news_id", 2, 20).cast("long")
    wave = F.floor(F.datediff(F.to_date("timestamp_utc"), F.lit("1995-01-02").cast("date")) / 300).cast("int") + F.when(i % 37 == 0, 3).otherwise(0)
    again = F.when(i % 10 == 3, F.array(wave, wave + 1)).otherwise(F.array(wave))
    return n.withColumn("wave", F.explode(again))


def _calendar(bars: DataFrame) -> DataFrame:
    """ticker, day -> event_date, window_end_date and the tokens of that last day before the event."""
    f = indicators.features(bars).select("ticker", "date", "technical_event_tokens")
    w = indicators.by_ticker()
    d = f.select("ticker", "date", F.lag("date").over(w).alias("before"), F.lag("technical_event_tokens").over(w).alias("tokens"))
    days = F.sequence(F.coalesce("before", F.lit("1995-01-01").cast("date")), F.date_sub("date", 1))
    return d.where(F.coalesce("before", F.lit("1995-01-01").cast("date")) < F.col("date")).select("ticker", F.explode(days).alias("day"), F.col("date").alias("event_date"), F.col("before").alias("window_end_date"), "tokens")


@query(f"""WITH {IND}, {NEWS}, arrived AS (SELECT news_id, ticker, timestamp_utc ts, unnest(CASE WHEN i % 10 = 3 THEN [v, v + 1] ELSE [v] END) wave FROM (SELECT *, CAST(substr(news_id, 2) AS BIGINT) i, date_diff('day', DATE '1995-01-02', CAST(timestamp_utc AS DATE)) // 300 + CASE WHEN CAST(substr(news_id, 2) AS BIGINT) % 37 = 0 THEN 3 ELSE 0 END v FROM news)),
 {LATE.format("arrived", "400 days")}, kept AS (SELECT DISTINCT news_id, ticker, ts FROM arrived JOIN limits USING (wave) WHERE lim IS NULL OR ts > lim),
 i AS (SELECT *, count(*) OVER w n14, avg(g) OVER w ag, avg(f) OVER w af FROM b1 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING)), rsi AS (SELECT ticker, date, CASE WHEN n14 = 14 THEN CASE WHEN af > 0 THEN 100 - 100 / (1 + ag / af) WHEN ag > 0 THEN 100 END END v FROM i),
 ev AS (SELECT k.news_id, k.ticker, min(b.date) event_date FROM kept k JOIN bars b ON b.ticker = k.ticker AND b.date > CAST(ts AS DATE) GROUP BY ALL), en AS (SELECT ev.*, max(b.date) window_end_date FROM ev LEFT JOIN bars b ON b.ticker = ev.ticker AND b.date < ev.event_date GROUP BY ALL)
 SELECT news_id, en.ticker, event_date, window_end_date, CASE WHEN v >= 70 THEN 'RSI_OVERBOUGHT' WHEN v <= 30 THEN 'RSI_OVERSOLD' END rsi_token FROM en LEFT JOIN rsi ON rsi.ticker = en.ticker AND rsi.date = en.window_end_date""")
def stream_news(s: SparkSession, d: str) -> DataFrame:
    """News that arrives on a stream, without repeats, with the event's day and what the tokens said on the day before it."""
    a = _arrivals(s, d)
    calendar = saved(_calendar(X.bars(s, d)))  # each micro-batch joins it
    out = runs.run_waves(a, "wave", _waves(a), lambda x: streams.news_on_calendar(x, calendar, "400 days").select("news_id", "ticker", "event_date", "window_end_date", "tokens"))
    return out.select("news_id", "ticker", "event_date", "window_end_date", F.nullif(F.regexp_extract(F.get(F.filter("tokens", lambda x: x.startswith("[RSI")), F.lit(0)), r"\[(\w+)", 1), F.lit("")).alias("rsi_token"))


REWARDS = "rw AS (SELECT vec_id % 6 batch_id, (vec_id // 6) % 11 AS \"key\", vec_id id, CAST(embedding[1] AS DOUBLE) reward FROM embeddings)"


def _rewards(s: SparkSession, d: str) -> DataFrame:
    return X.read(s, d, "embeddings").select((F.col("vec_id") % 6).alias("batch_id"), (F.floor(F.col("vec_id") / 6) % 11).alias("key"), F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("reward"))


HELD = f"""{REWARDS}, fr AS (SELECT *, count(*) OVER f n, avg(reward) OVER f m, stddev_pop(reward) OVER f sd, row_number() OVER (PARTITION BY "key", batch_id ORDER BY id DESC) k FROM rw WINDOW f AS (PARTITION BY "key" ORDER BY batch_id, id ROWS 31 PRECEDING)),
 hd AS (SELECT "key", batch_id, n, m, sd FROM fr WHERE k = 1)"""


@query(f"""WITH {HELD} SELECT "key", batch_id, n, round(m, 6) mean, round(sd, 6) std FROM hd""")
def buffer_windows(s: SparkSession, d: str) -> DataFrame:
    """Each key's buffer after each batch, from the whole table."""
    return buffers.buffers(_rewards(s, d)).select("key", "batch_id", "n", r("mean", 6).alias("mean"), r("std", 6).alias("std"))


@query(f"""WITH {HELD}, wh AS (SELECT batch_id, avg(reward) bm, stddev_pop(reward) bs FROM rw GROUP BY batch_id)
 SELECT batch_id, "key", id, round((reward - CASE WHEN n < 16 THEN bm ELSE m END) / (CASE WHEN n < 16 THEN bs ELSE sd END + 1e-6), 6) advantage FROM rw JOIN hd USING ("key", batch_id) JOIN wh USING (batch_id)""")
def stream_advantages(s: SparkSession, d: str) -> DataFrame:
    """Batches of rewards on a stream, the keys' buffers in its state store."""
    x = _rewards(s, d)
    held = runs.run_waves(x.withColumn("wave", F.col("batch_id").cast("int")), "wave", range(6), buffers.buffer_stream)
    return buffers.advantages(x, held).withColumn("advantage", r("advantage", 6))


@query("""SELECT event_id, CASE WHEN CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':42'), 1, 7) AS BIGINT) % 10000 < 1500 THEN 'valid' ELSE 'train' END part FROM events""")
def stream_split(s: SparkSession, d: str) -> DataFrame:
    """A stream in two parts by the digest of the key."""
    t = _ticks(s, d)

    def both(x: DataFrame) -> DataFrame:
        valid, train = streams.hash_take(x, "event_id", 0.15)
        return valid.withColumn("part", F.lit("valid")).unionByName(train.withColumn("part", F.lit("train"))).select("event_id", "part")

    return runs.run_waves(t, "wave", _waves(t), both)
