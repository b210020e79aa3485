"""Registered queries over the provided tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import align, backtest, clean, indicators, metrics, models, preference
from ..sources import io
from ..sources.shared import saved
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

BARS = """px AS (SELECT p_brand ticker, CAST(l_shipdate AS DATE) date, l_extendedprice / l_quantity px, l_quantity q,
  row_number() OVER (PARTITION BY p_brand, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) k
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (SELECT ticker, date, arg_min(px, k) "open", max(px) high, min(px) low, arg_max(px, k) "close", arg_max(px, k) adj_close, CAST(sum(q) AS BIGINT) volume FROM px GROUP BY ALL)"""
IND = BARS + """, b0 AS (SELECT *, adj_close / lag(adj_close, 1) OVER w - 1 ret_1d, adj_close / lag(adj_close, 5) OVER w - 1 ret_5d, adj_close / lag(adj_close, 20) OVER w - 1 ret_20d,
  adj_close - lag(adj_close) OVER w d, lag("close") OVER w pc, row_number() OVER w n FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
b1 AS (SELECT *, coalesce(greatest(d, 0), 0) g, coalesce(greatest(-d, 0), 0) f, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END tr FROM b0)"""
MARKET = IND + """, m0 AS (SELECT date, avg(ret_1d) market_ret_1d FROM b0 GROUP BY date),
m1 AS (SELECT *, CASE WHEN count(market_ret_1d) OVER w20 = 20 THEN stddev_samp(market_ret_1d) OVER w20 * sqrt(252) END v20,
  CASE WHEN count(market_ret_1d) OVER w5 = 5 THEN exp(sum(ln(1 + market_ret_1d)) OVER w5) - 1 END market_ret_5d
  FROM m0 WINDOW w20 AS (ORDER BY date ROWS 19 PRECEDING), w5 AS (ORDER BY date ROWS 4 PRECEDING)),
m2 AS (SELECT *, list(v20) FILTER (v20 IS NOT NULL) OVER (ORDER BY date ROWS 251 PRECEDING) past FROM m1),
market AS (SELECT date, market_ret_1d, market_ret_5d, v20 market_vol_20d,
  CASE WHEN v20 IS NOT NULL AND len(past) >= 20 THEN (len(list_filter(past, lambda x: x < v20)) + (len(list_filter(past, lambda x: x = v20)) + 1) / 2) / len(past) END rk FROM m2)"""
NEWS = """brands AS (SELECT DISTINCT p_brand ticker, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) % 25 k FROM part),
news AS (SELECT 'n' || doc_id news_id, ticker, TIMESTAMP '1995-01-02' + to_seconds((doc_id * 7919) % 2499 * 86400 + (doc_id * 104729) % 86400) timestamp_utc, substr("text", 1, 80) headline, "text" body, source FROM documents JOIN brands ON doc_id % 25 = k)"""
CAND = "cand AS (SELECT vec_id // 4 sample_id, vec_id % 4 candidate_id, CAST(embedding[1] AS DOUBLE) reward FROM embeddings)"
PRED = """e0 AS (SELECT vec_id, label, list_transform(embedding[1:5], lambda x: exp(CAST(x AS DOUBLE))) e FROM embeddings),
e1 AS (SELECT vec_id, label, list_transform(e, lambda x: x / (e[1] + e[2] + e[3] + e[4] + e[5])) p FROM e0),
pred AS (SELECT vec_id sample_id, DATE '2020-01-01' + CAST(vec_id % 250 AS INT) window_end_date, p, (['Strong Down','Mild Down','Neutral','Mild Up','Strong Up'])[label % 5 + 1] true_label,
  (['Strong Down','Mild Down','Neutral','Mild Up','Strong Up'])[list_position(p, list_max(p))] pred_label, ((vec_id * 37) % 101 - 50) / 1000.0::DOUBLE stock_return, label % 5 + 1 k FROM e1)"""
LOGP = "logp AS (SELECT vec_id pair_id, -abs(CAST(embedding[6] AS DOUBLE)) * 10 c, -abs(CAST(embedding[7] AS DOUBLE)) * 10 r, -abs(CAST(embedding[8] AS DOUBLE)) * 10 c0, -abs(CAST(embedding[9] AS DOUBLE)) * 10 r0 FROM embeddings)"
BT = PRED + """, bt AS (SELECT *, CASE WHEN p[4] + p[5] > 0.42 THEN 'long' WHEN p[1] + p[2] > 0.42 THEN 'short' ELSE 'hold' END action FROM pred),
sr AS (SELECT *, CASE action WHEN 'long' THEN stock_return - 0.0005 WHEN 'short' THEN -stock_return - 0.0005 ELSE 0 END strategy_return FROM bt),
eq AS (SELECT *, exp(sum(ln(1 + strategy_return)) OVER (ORDER BY window_end_date, sample_id)) equity FROM sr),
cur AS (SELECT *, equity / max(equity) OVER (ORDER BY window_end_date, sample_id) - 1 drawdown FROM eq)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def r(c: str | Column, n: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


@query(f'WITH {BARS} SELECT ticker, date, round("open", 8) AS "open", round(high, 8) high, round(low, 8) low, round("close", 8) AS "close", volume FROM bars')
def bars_daily(s: SparkSession, d: str) -> DataFrame:
    return X.bars(s, d).select("ticker", "date", r("open", 8).alias("open"), r("high", 8).alias("high"), r("low", 8).alias("low"), r("close", 8).alias("close"), "volume")


@query(f"""WITH {IND} SELECT ticker, date, round(ret_1d, 4) ret_1d, round(ret_5d, 4) ret_5d, round(ret_20d, 4) ret_20d,
 round(CASE WHEN count(ret_1d) OVER w10 = 10 THEN stddev_samp(ret_1d) OVER w10 * sqrt(252) END, 4) volatility_10d, round(CASE WHEN count(ret_1d) OVER w20 = 20 THEN stddev_samp(ret_1d) OVER w20 * sqrt(252) END, 4) volatility_20d FROM b1
 WINDOW w10 AS (PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING), w20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)""")
def returns_volatility(s: SparkSession, d: str) -> DataFrame:
    c = ["ret_1d", "ret_5d", "ret_20d", "volatility_10d", "volatility_20d"]
    return indicators.indicators(X.bars(s, d)).select("ticker", "date", *[r(x).alias(x) for x in c])


@query(f"""WITH {IND}, i AS (SELECT *, count(*) OVER w n14, avg(g) OVER w ag, avg(f) OVER w af, avg(tr) OVER w atr FROM b1 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING))
 SELECT ticker, date, round(CASE WHEN n14 = 14 THEN CASE WHEN af > 0 THEN 100 - 100 / (1 + ag / af) WHEN ag > 0 THEN 100 END END, 4) rsi_14, round(CASE WHEN n14 = 14 THEN atr END, 4) atr_14, round("open" / pc - 1, 4) gap_pct_last_day FROM i""")
def rsi_atr_gap(s: SparkSession, d: str) -> DataFrame:
    return indicators.indicators(X.bars(s, d)).select("ticker", "date", r("rsi_14").alias("rsi_14"), r("atr_14").alias("atr_14"), r("gap_pct_last_day").alias("gap_pct_last_day"))


@query(f"""WITH {IND}, i AS (SELECT *, count(*) OVER w n20, avg(adj_close) OVER w m, stddev_samp(adj_close) OVER w sd, avg(CAST(volume AS DOUBLE)) OVER w vm, stddev_samp(CAST(volume AS DOUBLE)) OVER w vs, count(*) OVER v n60, avg(adj_close) OVER v m60 FROM b1
 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING), v AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING))
 SELECT ticker, date, round(CASE WHEN n20 = 20 THEN m END, 4) sma_20, round(CASE WHEN n20 = 20 THEN adj_close / m - 1 END, 4) price_vs_sma20, round(CASE WHEN n60 = 60 THEN adj_close / m60 - 1 END, 4) price_vs_sma60,
 round(CASE WHEN n20 = 20 THEN 4 * sd / m END, 4) bb_width, round(CASE WHEN n20 = 20 THEN (adj_close - m + 2 * sd) / (4 * sd) END, 4) bb_position, round(CASE WHEN n20 = 20 THEN (volume - vm) / (vs + 1e-9) END, 4) volume_zscore_20 FROM i""")
def averages_bollinger_volume(s: SparkSession, d: str) -> DataFrame:
    c = ["sma_20", "price_vs_sma20", "price_vs_sma60", "bb_width", "bb_position", "volume_zscore_20"]
    return indicators.indicators(X.bars(s, d)).select("ticker", "date", *[r(x).alias(x) for x in c])


@query(f"""WITH RECURSIVE {BARS}, s AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) n FROM bars),
 e AS (SELECT ticker, date, n, adj_close a, adj_close b, 0.0::DOUBLE sg FROM s WHERE n = 1
  UNION ALL SELECT s.ticker, s.date, s.n, a * (11 / 13.0::DOUBLE) + s.adj_close * (2 / 13.0::DOUBLE), b * (25 / 27.0::DOUBLE) + s.adj_close * (2 / 27.0::DOUBLE),
   sg * 0.8 + 0.2 * ((a * (11 / 13.0::DOUBLE) + s.adj_close * (2 / 13.0::DOUBLE)) - (b * (25 / 27.0::DOUBLE) + s.adj_close * (2 / 27.0::DOUBLE))) FROM e JOIN s ON s.ticker = e.ticker AND s.n = e.n + 1)
 SELECT ticker, date, round(a - b, 4) macd, round(sg, 4) macd_signal, round(a - b - sg, 4) macd_hist FROM e""")
def macd(s: SparkSession, d: str) -> DataFrame:
    return indicators.macd(X.bars(s, d).select("ticker", "date", "adj_close")).select("ticker", "date", r("macd").alias("macd"), r("macd_signal").alias("macd_signal"), r("macd_hist").alias("macd_hist"))


@query(f"""WITH {MARKET} SELECT date, round(market_ret_1d, 4) market_ret_1d, round(market_ret_5d, 4) market_ret_5d, round(market_vol_20d, 4) market_vol_20d, round(rk, 4) market_vol_20d_rank,
 CASE WHEN rk <= 0.33 THEN 'low_vol' WHEN rk >= 0.66 THEN 'high_vol' ELSE 'normal_vol' END regime_label FROM market""")
def market_regime(s: SparkSession, d: str) -> DataFrame:
    m = indicators.market(indicators.indicators(X.bars(s, d)).select("date", "ret_1d"))
    return m.select("date", *[r(x).alias(x) for x in ("market_ret_1d", "market_ret_5d", "market_vol_20d", "market_vol_20d_rank")], "regime_label")


@query(f"WITH {MARKET} SELECT ticker, date, round(ret_5d - market_ret_5d, 4) relative_strength_5d FROM b0 LEFT JOIN market USING (date)")
def relative_strength(s: SparkSession, d: str) -> DataFrame:
    i = indicators.indicators(X.bars(s, d)).select("ticker", "date", "ret_1d", "ret_5d", "ret_20d")
    return indicators.relative_strength(i, indicators.market(i.select("date", "ret_1d"))).select("ticker", "date", r("relative_strength_5d").alias("relative_strength_5d"))


def _token_names(s: SparkSession, d: str) -> DataFrame:
    return indicators.features(X.bars(s, d)).select("ticker", F.explode("technical_event_tokens").alias("token")).select("ticker", F.regexp_extract("token", r"\[(\w+)", 1).alias("token"))


@query()
def event_tokens(s: SparkSession, d: str) -> DataFrame:
    """How often each event token occurs per ticker."""
    return _token_names(s, d).groupBy("ticker", "token").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {IND}, i AS (SELECT *, count(*) OVER w n14, avg(g) OVER w ag, avg(f) OVER w af FROM b1 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING)), x AS (SELECT ticker, CASE WHEN af > 0 THEN 100 - 100 / (1 + ag / af) WHEN ag > 0 THEN 100 END v FROM i WHERE n14 = 14)
 SELECT ticker, CASE WHEN v >= 70 THEN 'RSI_OVERBOUGHT' ELSE 'RSI_OVERSOLD' END token, count(*) n FROM x WHERE v >= 70 OR v <= 30 GROUP BY ALL""")
def rsi_tokens(s: SparkSession, d: str) -> DataFrame:
    return _token_names(s, d).where(F.col("token").startswith("RSI")).groupBy("ticker", "token").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'U' || user_id ticker, date_trunc('hour', ts) bar, round(first(value ORDER BY ts, event_id), 4) AS "open", max(value) high, min(value) low, round(last(value ORDER BY ts, event_id), 4) AS "close", count(*) n_ticks FROM events GROUP BY ALL""")
def resample_hourly(s: SparkSession, d: str) -> DataFrame:
    return indicators.resample(X.intraday(s, d)).select("ticker", "bar", r("open").alias("open"), "high", "low", r("close").alias("close"), "n_ticks")


@query(f"""WITH {BARS}, x AS (SELECT ticker, date, list("close") OVER (PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING) c, lead("close") OVER (PARTITION BY ticker ORDER BY date) target FROM bars)
 SELECT ticker, date, round(list_sum(c) / 10, 6) mean_close, round(target, 8) target FROM x WHERE len(c) = 10 AND target IS NOT NULL""")
def sliding_sequences(s: SparkSession, d: str) -> DataFrame:
    q = indicators.sequences(X.bars(s, d), ["close"], 10)
    return q.select("ticker", "date", r(F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x["close"]) / 10, 6).alias("mean_close"), r("target", 8).alias("target"))


@query(f"""WITH {BARS}, {NEWS} SELECT news_id, news.ticker ticker, min(date) event_date FROM news JOIN bars ON bars.ticker = news.ticker AND bars.date > CAST(timestamp_utc AS DATE) GROUP BY ALL""")
def event_alignment(s: SparkSession, d: str) -> DataFrame:
    return align.next_trading_day(X.news(s, d), X.bars(s, d).select("ticker", "date")).select("news_id", "ticker", "event_date")


@query(f"""WITH {BARS}, x AS (SELECT ticker, date, lag(date, 60) OVER w window_start_date, lag(date, 1) OVER w window_end_date FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) SELECT * FROM x WHERE window_start_date IS NOT NULL""")
def prior_windows(s: SparkSession, d: str) -> DataFrame:
    return align.prior_window(X.bars(s, d))


@query(f"""WITH {BARS}, x AS (SELECT ticker, date, list(adj_close) OVER a p, last(adj_close) OVER b q FROM bars WINDOW a AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 4 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING), b AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 5 DAYS PRECEDING))
 SELECT ticker, date, len(p) n_prices, round(list_sum(p), 8) total, round(q, 8) before_price FROM x WHERE len(p) > 0 AND q IS NOT NULL""")
def price_lookback(s: SparkSession, d: str) -> DataFrame:
    x = align.price_lookback(X.bars(s, d).select("ticker", "date", "adj_close"))
    return x.select("ticker", "date", F.size("prices").cast("long").alias("n_prices"), r(T.total(F.col("prices")), 8).alias("total"), r("before_price", 8).alias("before_price"))


RET = f"""{BARS}, fr AS (SELECT ticker, date, lead(adj_close) OVER (PARTITION BY ticker ORDER BY date) / adj_close - 1 stock_return FROM bars),
 fm AS (SELECT *, avg(stock_return) OVER (PARTITION BY date) market_return FROM fr), lab AS (SELECT *, stock_return - market_return ab,
 CASE WHEN stock_return - market_return <= -0.03 THEN 'Strong Down' WHEN stock_return - market_return <= -0.0075 THEN 'Mild Down' WHEN stock_return - market_return < 0.0075 THEN 'Neutral' WHEN stock_return - market_return < 0.03 THEN 'Mild Up' WHEN stock_return IS NOT NULL THEN 'Strong Up' END label_5 FROM fm)"""


def _labelled(s: SparkSession, d: str, bars: DataFrame | None = None) -> DataFrame:
    return align.future_returns(X.bars(s, d) if bars is None else bars).withColumn("label_5", align.label5(F.col("abnormal_return")))


@query(f"WITH {RET} SELECT ticker, date, round(stock_return, 4) stock_return, round(market_return, 4) market_return, round(ab, 4) abnormal_return FROM lab")
def future_returns(s: SparkSession, d: str) -> DataFrame:
    return align.future_returns(X.bars(s, d)).select("ticker", "date", *[r(c).alias(c) for c in ("stock_return", "market_return", "abnormal_return")])


@query(f"""WITH {RET} SELECT label_5, count(*) AS "count", round(count(*) / sum(count(*)) OVER (), 6) AS "share" FROM lab WHERE label_5 IS NOT NULL GROUP BY label_5""")
def label_distribution(s: SparkSession, d: str) -> DataFrame:
    return align.label_distribution(_labelled(s, d).where("label_5 IS NOT NULL"), "label_5").withColumn("share", r("share", 6))


@query(f"WITH {RET} SELECT label_5, count(*) n FROM lab WHERE label_5 IS NOT NULL GROUP BY ALL ORDER BY n DESC, label_5 LIMIT 1")
def majority_class(s: SparkSession, d: str) -> DataFrame:
    return align.majority_class(_labelled(s, d).where("label_5 IS NOT NULL"), "label_5").withColumnRenamed("count", "n")


@query(f"""WITH {BARS}, dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 k, count(*) OVER () n FROM (SELECT DISTINCT date FROM bars)),
 sp AS (SELECT date, CASE WHEN k < floor(n * 0.7::DOUBLE) THEN 'train' WHEN k < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END split FROM dd) SELECT split, count(*) n, min(date) first_date, max(date) last_date FROM bars JOIN sp USING (date) GROUP BY split""")
def date_split(s: SparkSession, d: str) -> DataFrame:
    return align.date_split(X.bars(s, d)).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(f"""WITH {BARS}, x AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) k, round_even(count(*) OVER (PARTITION BY ticker) * 0.8::DOUBLE, 0) c FROM bars) SELECT ticker, CASE WHEN k <= c THEN 'train' ELSE 'test' END split, count(*) n FROM x GROUP BY ALL""")
def ticker_split(s: SparkSession, d: str) -> DataFrame:
    return align.ticker_split(X.bars(s, d)).groupBy("ticker", "split").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {BARS}, x AS (SELECT ticker, date, row_number() OVER (ORDER BY date DESC, ticker DESC) k, count(*) OVER () n FROM bars) SELECT ticker, date FROM x WHERE k <= floor(n * 0.15::DOUBLE)""")
def latest_fraction(s: SparkSession, d: str) -> DataFrame:
    return align.latest_fraction(X.bars(s, d).select("ticker", "date"), 0.15, "date", "ticker").select("ticker", "date")


@query(f"""WITH {NEWS} SELECT ticker, count(*) n_news FROM news WHERE ticker IN (SELECT p_brand FROM part JOIN lineitem ON p_partkey = l_partkey) GROUP BY ticker ORDER BY n_news DESC, ticker LIMIT 10""")
def ticker_universe(s: SparkSession, d: str) -> DataFrame:
    return clean.select_universe(X.news(s, d), X.bars(s, d), 10)


_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
@query(f"""WITH {NEWS}, x AS (SELECT *, row_number() OVER (PARTITION BY ticker, timestamp_utc, headline ORDER BY news_id) k FROM news) SELECT ticker, count(*) n, CAST(sum(length({_STRIP.format('body')})) AS BIGINT) body_chars, count(*) FILTER ({_STRIP.format('headline')} <> headline) n_changed FROM x WHERE k = 1 GROUP BY ticker""")
def clean_news(s: SparkSession, d: str) -> DataFrame:
    """Items kept of each ticker, the characters of their cleaned bodies, and how many headlines cleaning has changed."""
    return clean.clean_news(X.news(s, d)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("body_chars"), F.count("headline_raw").alias("n_changed"))


WHOLE = NEWS + """, whole AS (SELECT news_id, ticker, TIMESTAMP '1995-01-02' + to_seconds(coalesce(length(body), 0) % 2499 * 86400) timestamp_utc, body headline, body FROM news)"""


@query(f"""WITH {WHOLE}, x AS (SELECT *, row_number() OVER (PARTITION BY ticker, timestamp_utc, headline ORDER BY news_id) k FROM whole), y AS (SELECT *, {_STRIP.format('headline')} c FROM x WHERE k = 1) SELECT news_id, md5(c) headline_md5, md5({_STRIP.format('body')}) body_md5, md5(CASE WHEN c <> headline THEN headline END) headline_raw_md5 FROM y""")
def clean_news_texts(s: SparkSession, d: str) -> DataFrame:
    """The kept items with digests of their cleaned texts. The whole text is the headline and its length gives the day, so that copies are repeats."""
    day = F.coalesce(F.length("body"), F.lit(0)) % 2499
    at = F.timestamp_seconds(F.unix_seconds(F.lit("1995-01-02 00:00:00").cast("timestamp")) + day * 86400)
    x = clean.clean_news(X.news(s, d).withColumns({"headline": F.col("body"), "timestamp_utc": at}))
    return x.select("news_id", *[F.md5(c).alias(f"{c}_md5") for c in ("headline", "body", "headline_raw")])


_PHRASES = " OR ".join(f"contains(t, '{p}')" for p in align.LEAKAGE_PHRASES)


@query(f"""WITH {NEWS}, x AS (SELECT *, lower(concat_ws(' ', headline, body)) t FROM news) SELECT count(*) n, count(*) FILTER ({_PHRASES}) n_phrase, count(*) FILTER (extract(hour FROM timestamp_utc) >= 20) n_post_market FROM x""")
def leakage_flags(s: SparkSession, d: str) -> DataFrame:
    return align.leakage_flags(X.news(s, d)).agg(F.count(F.lit(1)).alias("n"), F.count_if("leakage_phrase_flag").alias("n_phrase"), F.count_if("post_market_uncertain_flag").alias("n_post_market"))


@query(f"""WITH {NEWS}, x AS (SELECT *, lower(concat_ws(' ', headline, body)) t FROM news) SELECT news_id, {_PHRASES} leakage_phrase_flag, extract(hour FROM timestamp_utc) >= 20 post_market_uncertain_flag FROM x""")
def leakage_flags_news(s: SparkSession, d: str) -> DataFrame:
    return align.leakage_flags(X.news(s, d)).select("news_id", "leakage_phrase_flag", "post_market_uncertain_flag")


@query(f"""WITH {CAND} SELECT a.sample_id, a.candidate_id chosen, b.candidate_id rejected, round(a.reward - b.reward, 6) margin FROM cand a JOIN cand b ON a.sample_id = b.sample_id AND a.reward - b.reward >= 0.1""")
def preference_pairs(s: SparkSession, d: str) -> DataFrame:
    return preference.preference_pairs(X.candidates(s, d)).withColumn("margin", r("margin", 6))


@query(f"""WITH {CAND}, x AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY reward DESC, candidate_id) k FROM cand) SELECT sample_id, candidate_id, round(greatest(0.01, reward + 0.1), 6) weight FROM x WHERE k <= 2""")
def weighted_sft(s: SparkSession, d: str) -> DataFrame:
    return preference.rwsft(X.candidates(s, d)).withColumn("weight", r("weight", 6))


@query(f"WITH {CAND} SELECT sample_id, arg_max(candidate_id, reward) candidate_id, round(max(reward), 6) reward FROM cand GROUP BY sample_id")
def best_of_n(s: SparkSession, d: str) -> DataFrame:
    return preference.best_of_n(X.candidates(s, d)).select("sample_id", "candidate_id", r("reward", 6).alias("reward"))


@query(f"""WITH {PRED}, g AS (SELECT a, b FROM (SELECT unnest(['Strong Down','Mild Down','Neutral','Mild Up','Strong Up']) a), (SELECT unnest(['Strong Down','Mild Down','Neutral','Mild Up','Strong Up']) b))
 SELECT a true_label, b pred_label, count(sample_id) n FROM g LEFT JOIN pred ON true_label = a AND pred_label = b GROUP BY ALL""")
def confusion_matrix(s: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(X.predictions(s, d), X.LABELS).withColumn("n", F.col("n").cast("long"))


@query(f"""WITH {PRED}, l AS (SELECT true_label l FROM pred UNION SELECT pred_label FROM pred), t AS (SELECT l, (SELECT count(*) FROM pred WHERE true_label = l) nt, (SELECT count(*) FROM pred WHERE pred_label = l) np, (SELECT count(*) FROM pred WHERE true_label = l AND pred_label = l) hit FROM l),
 a AS (SELECT sum(hit)::DOUBLE c, sum(nt)::DOUBLE s, avg(2.0::DOUBLE * hit / (nt + np)) f1, sum(nt * np)::DOUBLE tp, sum(nt * nt)::DOUBLE tt, sum(np * np)::DOUBLE pp FROM t) SELECT round(c / s, 6) accuracy, round(f1, 6) macro_f1, round((c * s - tp) / sqrt((s * s - pp) * (s * s - tt)), 6) mcc FROM a""")
def classification_metrics(s: SparkSession, d: str) -> DataFrame:
    m = metrics.classification_metrics(X.predictions(s, d))
    return m.select(*[r(c, 6).alias(c) for c in m.columns])


@query(f"""WITH {PRED}, q AS (SELECT k, list_transform(p, lambda x: (x + 1e-9) / (1 + 5e-9)) q FROM pred), z AS (SELECT -ln(q[k]) l, list_sum(list_transform(q, lambda x, i: pow(x - CASE WHEN i = k THEN 1 ELSE 0 END, 2))) b FROM q) SELECT round(avg(l), 6) nll, round(avg(b), 6) brier_sum, round(avg(b / 5), 6) brier_macro FROM z""")
def probability_scores(s: SparkSession, d: str) -> DataFrame:
    m = metrics.probability_scores(X.predictions(s, d), X.LABELS)
    return m.select(*[r(c, 6).alias(c) for c in m.columns])


@query(f"""WITH {PRED}, x AS (SELECT k, unnest(p) v, unnest([1,2,3,4,5]) j FROM pred), b AS (SELECT j, least(floor(v * 10), 9) bin, count(*) n, avg(v) cf, avg(CASE WHEN j = k THEN 1.0::DOUBLE ELSE 0 END) ac FROM x GROUP BY ALL), e AS (SELECT j, sum(n * abs(cf - ac)) / sum(n) e FROM b GROUP BY j) SELECT round(avg(e), 6) ece_macro FROM e""")
def calibration_error(s: SparkSession, d: str) -> DataFrame:
    return metrics.ece(X.predictions(s, d), X.LABELS).select(r("ece_macro", 6).alias("ece_macro"))


@query(f"""WITH {PRED} SELECT CAST(least(floor(list_max(p) * 10), 9) AS BIGINT) bin, count(*) n, round(avg(list_max(p)), 6) confidence, round(avg(CASE WHEN true_label = pred_label THEN 1.0::DOUBLE ELSE 0 END), 6) accuracy FROM pred GROUP BY ALL""")
def calibration_curve(s: SparkSession, d: str) -> DataFrame:
    c = metrics.calibration_curve(X.predictions(s, d), F.array_max("p"), F.col("true_label") == F.col("pred_label"))
    return c.select(F.col("bin").cast("long").alias("bin"), "n", r("confidence", 6).alias("confidence"), r("accuracy", 6).alias("accuracy"))


_Z = "((c - r) - (c0 - r0))"
_LS = "-(greatest(-({0}), 0) + ln(1 + exp(-abs({0}))))"
_LOSS_SQL = {
    "sigmoid": f"-({_LS.format(f'0.1 * {_Z}')})", "hinge": f"greatest(0, 1 - 0.1 * {_Z})", "ipo": f"pow({_Z} - 5, 2)", "sppo_hard": "pow(c - c0 - 5, 2) + pow(r - r0 + 5, 2)",
    "nca_pair": f"-({_LS.format('0.1 * (c - c0)')}) - 0.5 * ({_LS.format('-0.1 * (c - c0)')}) - 0.5 * ({_LS.format('-0.1 * (r - r0)')})",
    "apo_zero": "1 - 1 / (1 + exp(-0.1 * (c - c0))) + 1 / (1 + exp(-0.1 * (r - r0)))", "apo_down": f"1 / (1 + exp(-0.1 * (c - c0))) + 1 - 1 / (1 + exp(-0.1 * {_Z}))",
    "bco_pair": f"-({_LS.format('0.1 * (c - c0)')}) - ({_LS.format('-0.1 * (r - r0)')})", "discopop": f"-({_LS.format(f'0.1 * {_Z}')}) * (1 - 1 / (1 + exp(-2 * {_Z}))) + exp(-0.1 * {_Z}) * (1 / (1 + exp(-2 * {_Z})))",
}


@query(f"WITH {LOGP} " + " UNION ALL ".join(f"SELECT '{k}' kind, round(avg({v}), 6) mean_loss FROM logp" for k, v in _LOSS_SQL.items()))
def preference_losses(s: SparkSession, d: str) -> DataFrame:
    return metrics.mean_losses(X.logps(s, d), {k: metrics.pair_loss(k) for k in _LOSS_SQL}).withColumn("mean_loss", r("mean_loss", 6))


@query(f"""WITH {LOGP}, a AS (SELECT row_number() OVER (ORDER BY c - c0) n, c - c0 x FROM logp), b AS (SELECT row_number() OVER (ORDER BY r - r0) n, r - r0 y FROM logp) SELECT round(avg(-({_LS.format('0.1 * (x - y)')})), 6) mean_loss, count(*) n FROM a JOIN b USING (n)""")
def aot_loss(s: SparkSession, d: str) -> DataFrame:
    return metrics.preference_loss(X.logps(s, d), "aot_pair").agg(r(F.avg("loss"), 6).alias("mean_loss"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOGP} SELECT round(avg(0.1 * (c - c0)), 6) chosen_reward, round(avg(0.1 * (r - r0)), 6) rejected_reward, round(avg(CASE WHEN 0.1 * (c - c0) > 0.1 * (r - r0) THEN 1.0::DOUBLE ELSE 0 END), 6) accuracy, round(avg(0.1 * (c - c0) - 0.1 * (r - r0)), 6) margin FROM logp")
def preference_metrics(s: SparkSession, d: str) -> DataFrame:
    m = metrics.preference_metrics(X.logps(s, d))
    return m.select(*[r(c, 6).alias(c) for c in m.columns])


def _trades(s: SparkSession, d: str) -> DataFrame:
    p = X.predictions(s, d).withColumn("action", backtest.action(F.col("p")[3] + F.col("p")[4], F.col("p")[0] + F.col("p")[1], 0.42))
    return p.withColumn("strategy_return", backtest.strategy_return(F.col("action"), F.col("stock_return")))


@query(f"WITH {BT} SELECT sample_id, window_end_date, action, round(strategy_return, 6) strategy_return, round(equity, 6) equity, round(drawdown, 6) drawdown FROM cur")
def equity_curve(s: SparkSession, d: str) -> DataFrame:
    c = backtest.equity_curve(_trades(s, d))
    return c.select("sample_id", "window_end_date", "action", *[r(x, 6).alias(x) for x in ("strategy_return", "equity", "drawdown")])


@query(f"""WITH {BT} SELECT count(*) FILTER (action <> 'hold') trades, count(*) FILTER (action = 'long') longs, count(*) FILTER (action = 'short') shorts, round(exp(sum(ln(1 + strategy_return))) - 1, 6) total_return, round(avg(strategy_return) / stddev_samp(strategy_return) * sqrt(252), 6) sharpe,
 round(min(drawdown), 6) max_drawdown, round(count(*) FILTER (action <> 'hold' AND strategy_return > 0) / count(*) FILTER (action <> 'hold'), 6) win_rate FROM cur""")
def backtest_metrics(s: SparkSession, d: str) -> DataFrame:
    m = backtest.backtest_metrics(backtest.equity_curve(_trades(s, d)))
    return m.select("trades", "longs", "shorts", *[r(c, 6).alias(c) for c in ("total_return", "sharpe", "max_drawdown", "win_rate")])


@query(f"""WITH {PRED}, x AS (SELECT sample_id, unnest(['ORIGINAL','CF_NEWS_REMOVE','CF_TECH_NEUTRALIZE','CF_REGIME_FLIP']) cf_type, unnest([pred_label, true_label, 'Neutral', pred_label]) l, unnest([0, 0, 0, 0]) run FROM pred
  UNION ALL SELECT sample_id, 'CF_REGIME_FLIP', CASE WHEN sample_id % 3 = 0 THEN 'strong_down' ELSE 'MILD_UP' END, 1 FROM pred WHERE sample_id % 4 = 0 UNION ALL SELECT sample_id, 'ORIGINAL', 'neutral', -1 FROM pred),
 y AS (SELECT *, CASE WHEN lower(l) LIKE '%down%' THEN -1 WHEN lower(l) LIKE '%up%' THEN 1 ELSE 0 END dir FROM x QUALIFY row_number() OVER (PARTITION BY sample_id, cf_type ORDER BY run DESC) = 1) SELECT a.cf_type, round(avg(CASE WHEN a.dir <> b.dir THEN 1.0::DOUBLE ELSE 0 END), 6) flip_rate, count(*) n FROM y a JOIN y b ON a.sample_id = b.sample_id AND b.cf_type = 'ORIGINAL' AND a.cf_type <> 'ORIGINAL' GROUP BY ALL""")
def counterfactual_flips(s: SparkSession, d: str) -> DataFrame:
    kinds = [("ORIGINAL", F.col("pred_label")), ("CF_NEWS_REMOVE", F.col("true_label")), ("CF_TECH_NEUTRALIZE", F.lit("Neutral")), ("CF_REGIME_FLIP", F.col("pred_label"))]
    x = X.predictions(s, d).select("sample_id", F.explode(F.array(*[F.struct(F.lit(k).alias("cf_type"), v.alias("pred_label")) for k, v in kinds])).alias("x")).select("sample_id", "x.*")
    x = x.withColumn("run", F.lit(0))
    i = F.col("sample_id")
    again = X.predictions(s, d).where(i % 4 == 0).select("sample_id", F.lit("CF_REGIME_FLIP").alias("cf_type"), F.when(i % 3 == 0, "strong_down").otherwise("MILD_UP").alias("pred_label"), F.lit(1).alias("run"))
    earlier = X.predictions(s, d).select("sample_id", F.lit("ORIGINAL").alias("cf_type"), F.lit("neutral").alias("pred_label"), F.lit(-1).alias("run"))
    return backtest.flip_rate(x.unionByName(again).unionByName(earlier)).withColumn("flip_rate", r("flip_rate", 6))


@query("""WITH t AS (SELECT conv_id * 100 + turn k, unnest(list_concat(regexp_split_to_array(trim("text"), '\\s+'), ['<sep>'])) w, generate_subscripts(list_concat(regexp_split_to_array(trim("text"), '\\s+'), ['<sep>']), 1) i FROM conversations),
 o AS (SELECT w, row_number() OVER (ORDER BY k, i) - 1 pos FROM t), b AS (SELECT pos // 256 block, count(*) c, CAST(sum(length(w)) AS BIGINT) chars FROM o GROUP BY ALL) SELECT block, chars FROM b WHERE c = 256""")
def constant_length_blocks(s: SparkSession, d: str) -> DataFrame:
    c = X.read(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), F.split(F.trim("text"), r"\s+").alias("ids"))
    b = preference.pack_blocks(c, "k", "ids", "<sep>", 256)
    return b.select("block", F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query("""WITH m AS (SELECT conv_id, list({'role': "role", 'content': "text"} ORDER BY turn) m FROM conversations GROUP BY conv_id) SELECT conv_id, len(m) - 1 n_prompt, m[-1].role last_role, md5(m[-1].content) completion_md5 FROM m WHERE len(m) > 1""")
def prompt_completion(s: SparkSession, d: str) -> DataFrame:
    p = preference.to_prompt_completion(X.messages(s, d))
    return p.select("conv_id", F.size("prompt").cast("long").alias("n_prompt"), F.col("completion.role").alias("last_role"), F.md5("completion.content").alias("completion_md5"))


@query("""WITH m AS (SELECT conv_id, string_agg(upper(substr("role", 1, 1)) || substr("role", 2) || ': ' || "text", chr(10) ORDER BY turn) || chr(10) || 'Assistant:' p FROM conversations GROUP BY conv_id) SELECT conv_id, md5(p) prompt_md5, length(p) n_chars FROM m""")
def chat_rendering(s: SparkSession, d: str) -> DataFrame:
    m = X.messages(s, d).select("conv_id", T.render_chat(F.col("messages")).alias("p"))
    return m.select("conv_id", F.md5("p").alias("prompt_md5"), F.length("p").cast("long").alias("n_chars"))


@query("""WITH x AS (SELECT conv_id, turn, sum(len(regexp_split_to_array(trim("text"), '\\s+'))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) used FROM conversations) SELECT conv_id, turn FROM x WHERE used <= 60""")
def budget_prefix(s: SparkSession, d: str) -> DataFrame:
    return preference.fit_budget(X.read(s, d, "conversations"), "conv_id", "turn", "text", 60).select("conv_id", "turn")


@query("""WITH x AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 k FROM documents) SELECT CAST(k // 5 AS BIGINT) batch, count(*) n_items, md5('[' || string_agg('{"doc_id":' || doc_id || ',"size":' || coalesce(length("text"), 0) || '}', ',' ORDER BY k) || ']') prompt_md5 FROM x GROUP BY ALL""")
def prompt_batches(s: SparkSession, d: str) -> DataFrame:
    x = X.read(s, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    return preference.batch_prompts(x, "doc_id", ["doc_id", "size"]).select("batch", F.col("n_items").cast("long").alias("n_items"), F.md5("prompt").alias("prompt_md5"))


@query("""SELECT doc_id, len(regexp_split_to_array(trim("text"), '\\s+')) n_words, md5(trim(regexp_replace("text", '\\s+', ' ', 'g'))) clean_md5 FROM documents""")
def text_cleaning(s: SparkSession, d: str) -> DataFrame:
    return X.read(s, d, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"), F.md5(clean.clean_text(F.col("text"))).alias("clean_md5"))


@query("""WITH x AS (SELECT doc_id, "text", trim(regexp_replace("text", '\\s+', ' ', 'g')) c FROM documents) SELECT doc_id, CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END n_words, md5(c) clean_md5, coalesce(length("text") BETWEEN 200 AND 5000, false) usual_length FROM x""")
def text_cleaning_all(s: SparkSession, d: str) -> DataFrame:
    """Every document; the length filter of text_cleaning is a column."""
    x = X.read(s, d, "documents").select("doc_id", clean.clean_text(F.col("text")).alias("c"), F.coalesce(F.length("text").between(200, 5000), F.lit(False)).alias("usual_length"))
    return x.select("doc_id", F.when(F.col("c") == "", 0).otherwise(T.word_count(F.col("c"))).cast("long").alias("n_words"), F.md5("c").alias("clean_md5"), "usual_length")


@query("""SELECT CASE WHEN pmod < 2000 THEN 'test' ELSE 'train' END split, count(*) n FROM (SELECT CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 7) AS BIGINT) % 10000 pmod FROM documents) GROUP BY ALL""")
def hash_split(s: SparkSession, d: str) -> DataFrame:
    return align.hash_split(X.read(s, d, "documents").select("doc_id"), "doc_id", 0.2).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


TRIALS = """tr AS (SELECT user_id sample_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 trial, CAST(event_id AS VARCHAR) response, event_type = 'purchase' correct FROM events)"""


def _trials(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return X.read(s, d, "events").select(F.col("user_id").alias("sample_id"), (F.row_number().over(w) - 1).alias("trial"), F.col("event_id").cast("string").alias("response"), (F.col("event_type") == "purchase").alias("correct"))


@query(f"""WITH {TRIALS}, x AS (SELECT *, lag(response) OVER w rejected, lag(correct) OVER w was FROM tr WINDOW w AS (PARTITION BY sample_id ORDER BY trial)) SELECT sample_id, min(trial) trial, arg_min(response, trial) chosen, arg_min(rejected, trial) rejected FROM x WHERE correct AND NOT was GROUP BY sample_id""")
def retry_pairs(s: SparkSession, d: str) -> DataFrame:
    return preference.retry_pairs(_trials(s, d)).withColumn("trial", F.col("trial").cast("long"))


@query("""WITH t AS (SELECT avg(length("text")) FILTER (toxic = 1) a FROM documents JOIN labels USING (doc_id)) SELECT toxic, round(avg(length("text")), 4) mean, round(stddev_pop(length("text")), 4) std, median(length("text")) median FROM documents JOIN labels USING (doc_id) GROUP BY toxic""")
def toxicity_summary(s: SparkSession, d: str) -> DataFrame:
    x = X.read(s, d, "documents").join(X.read(s, d, "labels"), "doc_id").select("toxic", F.length("text").alias("n"))
    return metrics.score_summary(x, "toxic", "n").select("toxic", r("mean").alias("mean"), r("std").alias("std"), "median")


@query(f"""WITH {BARS}, g AS (SELECT count(*) >= 1000 a, count(DISTINCT ticker) >= 20 b, min("close") > 0 c, count(*) = count(DISTINCT ticker || ':' || date) d FROM bars) SELECT unnest(['rows','tickers','positive','unique']) AS "check", CASE WHEN unnest([a, b, c, d]) THEN 'PASS' ELSE 'FAIL' END status FROM g""")
def quality_gates(s: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    return backtest.quality_gates(X.bars(s, d), {"rows": n >= 1000, "tickers": F.countDistinct("ticker") >= 20, "positive": F.min("close") > 0, "unique": n == F.countDistinct("ticker", "date")})


JUDGE = PRED + """, jt AS (SELECT sample_id, CASE WHEN sample_id % 7 = 0 THEN 'no answer' ELSE 'x ```json {"strong_down": ' || printf('%.4f', p[1]) || ', "mild_down": ' || printf('%.4f', p[2]) || ', "neutral": ' || printf('%.4f', p[3]) || ', "mild_up": ' || printf('%.4f', p[4]) || ', "strong_up": ' || printf('%.4f', p[5]) || '}```' END t FROM pred)"""


@query()
def judge_distribution(s: SparkSession, d: str) -> DataFrame:
    """Model-written JSON, every seventh broken: extraction, parse and renormalisation."""
    p = X.predictions(s, d)
    body = F.concat(F.lit("x ```json {"), F.array_join(F.array(*[F.concat(F.lit(f'"{c}": '), T.fixed(F.col("p")[i], 4)) for i, c in enumerate(T.CLASSES)]), ", "), F.lit("}```"))
    t = p.select("sample_id", F.when(F.col("sample_id") % 7 == 0, "no answer").otherwise(body).alias("t"))
    q = t.select("sample_id", T.extract_json(F.col("t")).isNotNull().alias("parse_ok"), T.parse_distribution(F.col("t")).alias("q"))
    return q.select("sample_id", "parse_ok", r(F.col("q")[2], 3).alias("neutral"), T.argmax_label(F.col("q"), T.CLASSES).alias("label"))


@query()
def linear_baseline(s: SparkSession, d: str) -> DataFrame:
    """Logistic regression on the indicators, fitted on the early dates and scored on the late ones."""
    cols = ["ret_1d", "ret_5d", "price_vs_sma20", "bb_position", "volume_zscore_20"]
    bars = saved(X.bars(s, d))  # a row for each ticker and day; features, labels and each pass of the fit read it
    f = indicators.indicators(bars).select("ticker", "date", *cols).na.drop()
    j = align.date_split(f.join(_labelled(s, d, bars).where("label_5 IS NOT NULL").select("ticker", "date", "label_5"), ["ticker", "date"]))
    j = saved(models.standardize(j.where("split = 'train'"), j, cols))
    m = models.linear_baseline(j.where("split = 'train'"), cols, "label_5")
    return m.transform(j.where("split = 'test'")).select("ticker", "date", "label_5", F.col("prediction").cast("int").alias("prediction"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
