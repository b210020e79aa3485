"""Technical indicators as window expressions: one shuffle by ticker, one sort by date."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.text import fixed

YEAR = 252**0.5


def by_ticker() -> WindowSpec:
    """The order of every ticker's rows: one shuffle and one sort serve all functions over it."""
    return Window.partitionBy("ticker").orderBy("date")


def full(agg: Column, x: str, n: int) -> Column:
    """A rolling aggregate that is null until n values that are not null are in the window."""
    w = by_ticker().rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(w) == n, agg.over(w))


def ret(x: str, k: int) -> Column:
    return F.try_divide(F.col(x), F.lag(x, k).over(by_ticker())) - 1


def ewm(df: DataFrame, x: str, spans: dict[str, int]) -> DataFrame:
    """Exponentially weighted means without adjustment, each ticker's history in one task (a few thousand rows).

    Nulls carry the last mean on.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        return pdf.assign(**{name: pdf[x].ewm(span=n, adjust=False).mean() for name, n in spans.items()})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + "".join(f", {n} double" for n in spans)
    return df.groupBy("ticker").applyInPandas(run, schema)


def macd(df: DataFrame, x: str = "adj_close") -> DataFrame:
    """macd, macd_signal and macd_hist; both recursions run in one pass over each ticker."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        m = pdf[x].ewm(span=12, adjust=False).mean() - pdf[x].ewm(span=26, adjust=False).mean()
        s = m.ewm(span=9, adjust=False).mean()
        return pdf.assign(macd=m, macd_signal=s, macd_hist=m - s)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", macd double, macd_signal double, macd_hist double"
    return df.groupBy("ticker").applyInPandas(run, schema)


def indicators(bars: DataFrame) -> DataFrame:
    """Returns, volatility, RSI, moving averages, Bollinger, ATR, volume z-score, gap: all over the same window order."""
    d = bars.withColumns({f"ret_{k}d": ret("adj_close", k) for k in (1, 5, 20)} | {"_delta": F.col("adj_close") - F.lag("adj_close").over(by_ticker()), "_prev": F.lag("close").over(by_ticker()), "_n": F.row_number().over(by_ticker())})
    d = d.withColumns({
        "_gain": F.coalesce(F.greatest("_delta", F.lit(0.0)), F.lit(0.0)), "_fall": F.coalesce(F.greatest(-F.col("_delta"), F.lit(0.0)), F.lit(0.0)),
        "_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_prev")), F.abs(F.col("low") - F.col("_prev"))),
        "_vol": F.col("volume").cast("double"),
    })
    d = d.withColumns(
        {f"volatility_{n}d": full(F.stddev_samp("ret_1d"), "ret_1d", n) * YEAR for n in (10, 20)}
        | {f"sma_{n}": full(F.avg("adj_close"), "adj_close", n) for n in (5, 20, 60)}
        | {"_sd20": full(F.stddev_samp("adj_close"), "adj_close", 20), "_ag": full(F.avg("_gain"), "_gain", 14), "_al": full(F.avg("_fall"), "_fall", 14), "atr_14": full(F.avg("_range"), "_range", 14), "_vm": full(F.avg("_vol"), "_vol", 20), "_vs": full(F.stddev_samp("_vol"), "_vol", 20)}
    )
    rsi = F.when(F.col("_al") > 0, 100 - 100 / (1 + F.try_divide("_ag", "_al"))).when((F.col("_al") == 0) & (F.col("_ag") > 0), 100.0)
    return d.withColumns({
        "rsi_14": rsi, "price_vs_sma20": F.try_divide("adj_close", "sma_20") - 1, "price_vs_sma60": F.try_divide("adj_close", "sma_60") - 1,
        "bb_width": F.try_divide(4 * F.col("_sd20"), F.col("sma_20")), "bb_position": F.try_divide(F.col("adj_close") - F.col("sma_20") + 2 * F.col("_sd20"), 4 * F.col("_sd20")),
        "volume_zscore_20": (F.col("_vol") - F.col("_vm")) / (F.col("_vs") + 1e-9), "gap_pct_last_day": F.try_divide(F.col("open"), F.col("_prev")) - 1,
    }).drop("_delta", "_prev", "_gain", "_fall", "_range", "_vol", "_sd20", "_ag", "_al", "_vm", "_vs", "_n")


def market(returns: DataFrame) -> DataFrame:
    """Equal-weight market return by date with 5- and 20-day compounding, volatility, its 252-day rank and regime.

    Grouping leaves one row a date, so the window over all dates is small whatever the number of tickers.
    """
    m = returns.groupBy("date").agg(F.avg("ret_1d").alias("market_ret_1d"))
    w = Window.orderBy("date")
    span = lambda n: w.rowsBetween(1 - n, 0)

    def compound(n: int) -> Column:
        product = F.aggregate(F.collect_list("market_ret_1d").over(span(n)), F.lit(1.0), lambda a, r: a * (1 + r))
        return F.when(F.count("market_ret_1d").over(span(n)) == n, product - 1)

    m = m.withColumns({f"market_ret_{n}d": compound(n) for n in (5, 20)})
    m = m.withColumn("market_vol_20d", F.when(F.count("market_ret_1d").over(span(20)) == 20, F.stddev_samp("market_ret_1d").over(span(20)) * YEAR))
    m = m.withColumn("_past", F.collect_list("market_vol_20d").over(span(252)))
    below = F.size(F.filter("_past", lambda v: v < F.col("market_vol_20d")))
    equal = F.size(F.filter("_past", lambda v: v == F.col("market_vol_20d")))
    rank = F.when(F.col("market_vol_20d").isNotNull() & (F.size("_past") >= 20), (below + (equal + 1) / 2) / F.size("_past"))
    return m.withColumn("market_vol_20d_rank", rank).drop("_past").withColumn("regime_label", regime(F.col("market_vol_20d_rank")))


def regime(rank: Column) -> Column:
    return F.when(rank <= 0.33, "low_vol").when(rank >= 0.66, "high_vol").otherwise("normal_vol")


def relative_strength(stock: DataFrame, mkt: DataFrame) -> DataFrame:
    return stock.join(mkt, "date", "left").withColumns({f"relative_strength_{n}d": F.col(f"ret_{n}d") - F.col(f"market_ret_{n}d") for n in (5, 20)})


def resample(ticks: DataFrame, width: str = "1 hour", ts: str = "ts", px: str = "px", tie: str = "event_id") -> DataFrame:
    """Open, high, low, close and volume of coarser bars; a row for each bar that has ticks."""
    at = F.struct(ts, tie)
    d = ticks.groupBy("ticker", F.window(ts, width).alias("w")).agg(F.min_by(px, at).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, at).alias("close"), F.count(F.lit(1)).alias("n_ticks"))
    return d.select("ticker", F.col("w.start").alias("bar"), "open", "high", "low", "close", "n_ticks")


def forward_fill(df: DataFrame, cols: list[str], by: str = "ticker", order: str = "date") -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def sequences(df: DataFrame, cols: list[str], length: int, target: str = "close") -> DataFrame:
    """The last `length` rows as an array with the next row's target; only full windows that have a next row."""
    w = by_ticker().rowsBetween(1 - length, 0)
    d = df.withColumns({"sequence": F.collect_list(F.struct(*cols)).over(w), "target": F.lead(target).over(by_ticker())})
    return d.where((F.size("sequence") == length) & F.col("target").isNotNull()).select("ticker", "date", "sequence", "target")


def trend_class(x: str = "close") -> Column:
    """0 down, 1 flat, 2 up to the next row."""
    return (F.signum(F.lead(x).over(by_ticker()) - F.col(x)) + 1).cast("int")


def event_tokens() -> Column:
    """Readable tokens of seven rule groups in fixed order; null inputs give none."""
    c = F.col
    pct = lambda x: x * 100

    def token(name: str, key: str, digits: int, value: Column, tail: Column | str = "") -> Column:
        return F.concat(F.lit(f"[{name}: {key}="), fixed(value, digits), F.lit(tail) if isinstance(tail, str) else tail, F.lit("]"))

    strong = lambda cond: F.concat(F.lit(", strength="), F.when(cond, "high").otherwise("medium"))
    rules = [
        F.when(c("rsi_14") >= 70, token("RSI_OVERBOUGHT", "RSI14", 1, c("rsi_14"), strong(c("rsi_14") >= 80))).when(c("rsi_14") <= 30, token("RSI_OVERSOLD", "RSI14", 1, c("rsi_14"), strong(c("rsi_14") <= 20))),
        F.when(c("macd_hist") > 0, token("MACD_BULLISH", "hist", 2, c("macd_hist"))).when(c("macd_hist") < 0, token("MACD_BEARISH", "hist", 2, c("macd_hist"))),
        F.when(c("price_vs_sma20") > 0, token("PRICE_ABOVE_SMA20", "distance", 1, pct(c("price_vs_sma20")), "%")).when(c("price_vs_sma20") <= 0, token("PRICE_BELOW_SMA20", "distance", 1, pct(c("price_vs_sma20")), "%")),
        F.when(c("bb_position") >= 0.9, token("BOLLINGER_UPPER_PRESSURE", "position", 2, c("bb_position"))).when(c("bb_position") <= 0.1, token("BOLLINGER_LOWER_PRESSURE", "position", 2, c("bb_position"))),
        F.when(c("volume_zscore_20") >= 1.5, token("VOLUME_SPIKE", "zscore", 1, c("volume_zscore_20"))).when(c("volume_zscore_20") <= -1, token("VOLUME_DRY_UP", "zscore", 1, c("volume_zscore_20"))),
        F.when(c("relative_strength_5d") > 0.02, token("MARKET_OUTPERFORMANCE_5D", "value", 1, pct(c("relative_strength_5d")), "%")).when(c("relative_strength_5d") < -0.02, token("MARKET_UNDERPERFORMANCE_5D", "value", 1, pct(c("relative_strength_5d")), "%")),
        F.when(c("market_vol_20d_rank") >= 0.8, token("HIGH_VOLATILITY_REGIME", "vol20_pctile", 2, c("market_vol_20d_rank"))),
    ]
    return F.array_compact(F.array(*rules))


def features(bars: DataFrame) -> DataFrame:
    """All indicators, market context and event tokens of each bar."""
    stock = indicators(bars)
    mkt = market(stock.select("date", "ret_1d"))  # taken before the recursions, which run in Python once
    out = relative_strength(macd(stock), mkt)
    return out.withColumn("technical_event_tokens", event_tokens())


def token_report(df: DataFrame, tokens: str = "technical_event_tokens") -> DataFrame:
    """One row: rows, share without tokens, rows of each regime, and the tokens of the first row (by ticker and date) that has any."""
    has = F.size(tokens) > 0
    return df.agg(
        F.count(F.lit(1)).alias("token_rows"), F.avg((~has).cast("double")).alias("missing_rate"), *[F.count_if(F.col("regime_label") == x).alias(x) for x in ("low_vol", "normal_vol", "high_vol")],
        F.min_by(F.array_join(tokens, ", "), F.when(has, F.struct("ticker", "date"))).alias("example_tokens"),
    )


def trend_sign(x: str = "close", n: int = 20) -> Column:
    """1 above, -1 below, 0 at the moving average (to nine decimals) or before there is one."""
    return F.coalesce(F.signum(F.round(F.col(x) - full(F.avg(x), x, n), 9)), F.lit(0.0)).cast("int")


def timeframe_features(ticks: DataFrame, width: str = "1 hour", ts: str = "ts", px: str = "px", tie: str = "event_id", atr: int = 14, sma: int = 20) -> DataFrame:
    """Bars of one width, those without ticks filled from the bar before (no ticks), with average range and trend; nulls are 0.

    The first row's range is high - low: the reference's wrap to the last close is left out. Only bars with ticks are
    shuffled; each fills the gap up to the next one where it lies. A null ticker's bars have no values.
    """
    prices, step = ["open", "high", "low", "close"], F.expr(f"INTERVAL {width}")
    b = resample(ticks, width, ts, px, tie).withColumnRenamed("bar", "date")
    b = forward_fill(b.withColumns({c: F.when(F.col("ticker").isNotNull(), F.col(c)) for c in (*prices, "n_ticks")}), prices)
    last = F.coalesce(F.lead("date").over(by_ticker()) - step, F.col("date"))
    d = b.withColumn("_last", last).withColumn("_at", F.explode(F.sequence("date", "_last", step)))
    d = d.withColumn("n_ticks", F.when(F.col("_at") == F.col("date"), F.coalesce("n_ticks", F.lit(0))).otherwise(0).cast("long")).drop("_last", "date").withColumnRenamed("_at", "date")
    d = d.withColumn("_prev", F.lag("close").over(by_ticker()))
    d = d.withColumn("_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_prev")), F.abs(F.col("low") - F.col("_prev"))))
    d = d.withColumns({"atr": F.coalesce(full(F.avg("_range"), "_range", atr), F.lit(0.0)), "trend": trend_sign("close", sma)})
    return d.drop("_prev", "_range").withColumnRenamed("date", "bar").select("ticker", "bar", *prices, "n_ticks", "atr", "trend")
