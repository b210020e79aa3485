"""Queries of the operators that cut histories into blocks; their SQL has no blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, blocks, indicators
from . import fixtures as X
from .queries import BARS, IND, _sql, query, r

#: Blocks of so many days: the given prices reach over seven years.
DAYS = 512


@query(f"""WITH {IND}, i AS (SELECT *, count(*) OVER v n14, avg(g) OVER v ag, avg(f) OVER v af, avg(tr) OVER v atr, count(ret_1d) OVER w nr, stddev_samp(ret_1d) OVER w sr, count(*) OVER w n20, avg(adj_close) OVER w m20, stddev_samp(adj_close) OVER w sd,
 avg(CAST(volume AS DOUBLE)) OVER w vm, stddev_samp(CAST(volume AS DOUBLE)) OVER w vs, count(*) OVER x n60, avg(adj_close) OVER x m60 FROM b1
 WINDOW v AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING), w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING), x AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING))
 SELECT ticker, date, round(ret_20d, 4) ret_20d, round(CASE WHEN nr = 20 THEN sr * sqrt(252) END, 4) volatility_20d, round(CASE WHEN n14 = 14 THEN CASE WHEN af > 0 THEN 100 - 100 / (1 + ag / af) WHEN ag > 0 THEN 100 END END, 4) rsi_14, round(CASE WHEN n14 = 14 THEN atr END, 4) atr_14,
 round(CASE WHEN n20 = 20 THEN m20 END, 4) sma_20, round(CASE WHEN n60 = 60 THEN adj_close / m60 - 1 END, 4) price_vs_sma60, round(CASE WHEN n20 = 20 THEN (adj_close - m20 + 2 * sd) / (4 * sd) END, 4) bb_position, round(CASE WHEN n20 = 20 THEN (volume - vm) / (vs + 1e-9) END, 4) volume_zscore_20, round("open" / pc - 1, 4) gap_pct_last_day FROM i""")
def indicators_in_blocks(s: SparkSession, d: str) -> DataFrame:
    c = ["ret_20d", "volatility_20d", "rsi_14", "atr_14", "sma_20", "price_vs_sma60", "bb_position", "volume_zscore_20", "gap_pct_last_day"]
    return blocks.with_halo(X.bars(s, d), indicators.indicators, 64, DAYS).select("ticker", "date", *[r(x).alias(x) for x in c])


@query(_sql["macd"])
def macd_in_blocks(s: SparkSession, d: str) -> DataFrame:
    m = blocks.macd(X.bars(s, d).select("ticker", "date", "adj_close"))
    return m.select("ticker", "date", *[r(x).alias(x) for x in ("macd", "macd_signal", "macd_hist")])


@query(_sql["price_lookback"])
def price_lookback_in_blocks(s: SparkSession, d: str) -> DataFrame:
    def look(x: DataFrame) -> DataFrame:
        return align.price_lookback(x, keep=("_core",))

    x = blocks.with_halo(X.bars(s, d).select("ticker", "date", "adj_close"), look, 8, DAYS, needs="adj_close")
    return x.select("ticker", "date", F.size("prices").cast("long").alias("n_prices"), r(T.total(F.col("prices")), 8).alias("total"), r("before_price", 8).alias("before_price"))


@query(_sql["event_alignment"])
def event_alignment_in_blocks(s: SparkSession, d: str) -> DataFrame:
    return blocks.next_trading_day(X.news(s, d), X.bars(s, d).select("ticker", "date")).select("news_id", "ticker", "event_date")


@query(f"""WITH {BARS}, x AS (SELECT ticker, date, lag(date, 60) OVER w window_start_date, lag(date, 1) OVER w window_end_date, adj_close / lag(adj_close) OVER w - 1 ret FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))
 SELECT ticker, date, window_start_date, window_end_date, round(ret, 4) ret FROM x WHERE window_start_date IS NOT NULL""")
def prior_windows_in_blocks(s: SparkSession, d: str) -> DataFrame:
    def prior(x: DataFrame) -> DataFrame:
        w = align.by_ticker()
        return x.select("ticker", "date", "_core", F.lag("date", 60).over(w).alias("window_start_date"), F.lag("date", 1).over(w).alias("window_end_date"), indicators.ret("adj_close", 1).alias("ret")).where("window_start_date IS NOT NULL")

    return blocks.with_halo(X.bars(s, d), prior, 61, DAYS).withColumn("ret", r("ret"))
