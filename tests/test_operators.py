"""Operators on small tables, against hand-made rows or pandas written here."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions import text as T
from marketloom.operators import align, backtest, clean, indicators, metrics, preference
from marketloom.streaming import streams


def bars(spark, n=80):
    rng = np.random.default_rng(3)
    p = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    d = pd.DataFrame({"ticker": "A", "date": pd.date_range("2020-01-01", periods=n).date, "open": p * 0.99, "high": p * 1.02, "low": p * 0.97, "close": p, "adj_close": p, "volume": (rng.random(n) * 1000).astype(int)})
    return d, spark.createDataFrame(d)


def test_indicators_match_pandas(spark):
    p, df = bars(spark)
    got = indicators.macd(indicators.indicators(df)).orderBy("date").toPandas()
    x = p["adj_close"]
    delta = x.diff().fillna(0)
    rs = delta.clip(lower=0).rolling(14).mean() / (-delta.clip(upper=0)).rolling(14).mean()
    np.testing.assert_allclose(got["rsi_14"], 100 - 100 / (1 + rs), rtol=1e-9)
    np.testing.assert_allclose(got["sma_20"], x.rolling(20).mean(), rtol=1e-9)
    m = x.ewm(span=12, adjust=False).mean() - x.ewm(span=26, adjust=False).mean()
    np.testing.assert_allclose(got["macd_hist"], m - m.ewm(span=9, adjust=False).mean(), atol=1e-9)
    np.testing.assert_allclose(got["volatility_20d"], x.pct_change().rolling(20).std() * 252**0.5, rtol=1e-9)


def test_one_exchange_for_all_window_functions(spark):
    _, df = bars(spark)
    plan = indicators.indicators(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ticker") == 1


def test_event_alignment_is_strictly_later(spark):
    cal = spark.sql("SELECT 'A' ticker, explode(array(date'2020-01-02', date'2020-01-06')) date")
    news = spark.sql("SELECT 'A' ticker, explode(array(timestamp'2020-01-02 10:00', timestamp'2020-01-04 10:00', timestamp'2020-01-06 09:00')) timestamp_utc")
    got = {str(r[0])[:10]: str(r[1]) for r in align.next_trading_day(news, cal).select("timestamp_utc", "event_date").collect()}
    assert got == {"2020-01-02": "2020-01-06", "2020-01-04": "2020-01-06"}
    same = align.next_trading_day(news, cal, same_day_before=12).count()
    assert same == 3


def test_label_bounds(spark):
    got = spark.createDataFrame([(x,) for x in (-0.03, -0.0075, -0.0074, 0.0075, 0.03)], "x double").select(align.label5(F.col("x"))).toPandas().iloc[:, 0].tolist()
    assert got == ["Strong Down", "Mild Down", "Neutral", "Mild Up", "Strong Up"]


def test_rationale_chain(spark):
    good = '{"news_rationale":["n"],"technical_rationale":["t"],"conflict_resolution":"c","risk_note":"r","action":"long","forecast_distribution":{"strong_down":0.0,"mild_down":0.1,"neutral":0.2,"mild_up":0.4,"strong_up":0.3}}'
    bad = good.replace('"neutral":0.2', '"neutral":0.9')
    df = spark.createDataFrame([(f"text ```json\n{good}\n```",), (f"so {bad} end",), ("nothing",)], "t string")
    d = df.select(T.extract_json(F.col("t")).alias("j")).select("j", F.from_json("j", T.RATIONALE).alias("r"))
    got = d.select(T.validation_error(F.col("r")), F.when(F.col("r").isNotNull(), T.repaired_probs(F.col("r")))).collect()
    assert [g[0] for g in got] == [None, "probability_sum", "parse"]
    assert got[1][1] == [0.0, 0.0, 0.0, 0.4, 0.6]


def test_preference_shapes(spark):
    df = spark.createDataFrame([("The sky is blue.", "The sky is green.")], "chosen string, rejected string")
    r = preference.extract_prompt(df).first()
    assert (r["prompt"], r["chosen"], r["rejected"]) == ("The sky is", " blue.", " green.")
    u = preference.unpair(df.withColumn("prompt", F.lit("p"))).collect()
    assert [(x["completion"], x["label"]) for x in u] == [("The sky is blue.", True), ("The sky is green.", False)]


def test_token_arrays(spark):
    a = F.array(*map(F.lit, (5, 6, 7, 8, 9)))
    one = spark.range(1)
    assert one.select(preference.mask_by_template(a, [6, 7])).first()[0] == [-100, -100, -100, 8, 9]
    assert one.select(preference.pad(a, 7, 0, "left")).first()[0] == [0, 0, 5, 6, 7, 8, 9]
    assert one.select(preference.truncate_after(a, 7, 0)).first()[0] == [5, 6, 7, 0, 0]


def test_gae_matches_recursion(spark):
    r, v = [0.1, -0.2, 1.0], [0.5, 0.4, 0.3]
    want, last = [], 0.0
    for t in (2, 1, 0):
        last = r[t] + (v[t + 1] if t < 2 else 0.0) - v[t] + 0.95 * last
        want.insert(0, last)
    got = spark.range(1).select(metrics.gae(F.array(*map(F.lit, r)), F.array(*map(F.lit, v)))).first()[0]
    np.testing.assert_allclose(got, want)


def test_losses_are_finite_for_all_kinds(spark):
    df = spark.createDataFrame([(i, -1.0 - i, -2.0 + i, -1.5, -2.5) for i in range(4)], "pair_id long, c double, r double, c0 double, r0 double")
    for kind in metrics.LOSSES:
        v = [x["loss"] for x in metrics.preference_loss(df, kind).collect()]
        assert len(v) == 4 and np.isfinite(v).all(), kind


def test_equity_curve(spark):
    df = spark.createDataFrame([(i, pd.Timestamp(2020, 1, 1 + i // 2).date(), x) for i, x in enumerate((0.1, -0.2, 0.05, 0.3))], "sample_id long, window_end_date date, strategy_return double")
    got = backtest.equity_curve(df).orderBy("sample_id").toPandas()
    eq = np.cumprod([1.1, 0.8, 1.05, 1.3])
    np.testing.assert_allclose(got["equity"], eq)
    np.testing.assert_allclose(got["drawdown"], eq / np.maximum.accumulate(eq) - 1, atol=1e-12)


def test_counterfactuals_fill_the_template(spark):
    df = spark.createDataFrame([(1, "News", ["[HIGH_VOLATILITY_REGIME: x]"])], "sample_id long, headline string, technical_event_tokens array<string>")
    got = {r["cf_type"]: r["prompt"] for r in backtest.counterfactuals(df, "{headline}|{technical_event_tokens}").collect()}
    assert len(set(got.values())) == 4 and "LOW_VOLATILITY" in got["CF_REGIME_FLIP"]


def test_control_reward_rejects_unknown_tasks(spark):
    with pytest.raises(Exception, match="unknown task"):
        spark.range(1).select(preference.control_reward(F.lit("x"), F.lit(1.0))).collect()


def test_clean_news_keeps_the_least_key(spark):
    df = spark.sql("SELECT * FROM VALUES ('b','A',timestamp'2020-01-01','<b>x</b>','y'),('a','A',timestamp'2020-01-01','<b>x</b>','y'),('c','',timestamp'2020-01-01','z','y') t(news_id,ticker,timestamp_utc,headline,body)")
    got = clean.clean_news(df).collect()
    assert [(r["news_id"], r["headline"], r["headline_raw"]) for r in got] == [("a", "x", "<b>x</b>")]


def test_price_lookback_takes_calendar_days_and_one_row_more(spark):
    df = spark.sql("SELECT 'A' ticker, date_add(date'2020-01-01', d) date, d * 1.0D adj_close FROM VALUES (0), (1), (4), (5), (20) t(d)")
    got = {r["before_price"]: r["prices"] for r in align.price_lookback(df).collect()}
    assert got == {0.0: [1.0, 4.0]}


def test_budget_and_batches(spark):
    df = spark.createDataFrame([(1, 0, "a b"), (1, 1, None), (1, 2, "c d"), (1, 3, "e"), (2, 0, "a b c d")], "k int, turn int, t string")
    assert [tuple(r) for r in preference.fit_budget(df, "k", "turn", "t", 3).select("k", "turn").orderBy("k", "turn").collect()] == [(1, 0), (1, 1)]
    got = preference.batch_prompts(spark.range(7), "id", ["id"]).orderBy("batch").collect()
    assert [r["n_items"] for r in got] == [5, 2] and got[1]["prompt"] == '[{"id":5},{"id":6}]'
    assert preference.batch_prompts(spark.range(0), "id", ["id"]).count() == 0


def test_valid_items_of_a_batch(spark):
    df = spark.createDataFrame([('```json\n[{"a":1,"b":2},{"a":1}]\n```',), ("[]",), ("no list",), (None,)], "t string")
    assert [r[0] for r in df.select(T.valid_items(F.col("t"), ("a", "b"))).collect()] == [1, 0, 0, 0]


def test_streaming_bars_equal_batch(spark, tmp_path):
    d = spark.range(200).select(F.lit("A").alias("ticker"), F.timestamp_seconds(F.col("id") * 100).alias("ts"), F.col("id").alias("event_id"), (F.col("id") % 7).cast("double").alias("px"))
    d.write.parquet(str(tmp_path / "in"))
    s = streams.streaming_bars(streams.stream_table(spark, str(tmp_path / "in"), d.schema))
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(s.schema).parquet(str(tmp_path / "out"))
    want = indicators.resample(d)
    assert got.exceptAll(want).count() == 0 and got.count() >= want.count() - 3


def test_features_run_python_once_and_events_are_not_sorted_whole(spark):
    _, df = bars(spark)
    plan = indicators.features(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1


def test_buffered_advantages_against_a_plain_reading(spark):
    rng = np.random.default_rng(2)
    rows = [(b, int(rng.integers(0, 4)) if b else 0, i, float(rng.normal())) for b in range(4) for i in range(b * 20, b * 20 + 20)]
    held, buffers = spark.createDataFrame([], "key long, held array<double>"), {}
    for b in range(4):
        own = [r for r in rows if r[0] == b]
        out, held = streams.buffered_advantage(spark.createDataFrame([r[1:] for r in own], "key long, id long, reward double"), held, 8, 5)
        got = {r["id"]: r["advantage"] for r in out.collect()}
        for k in {r[1] for r in own}:
            buffers[k] = (buffers.get(k, []) + [r[3] for r in own if r[1] == k])[-8:]
        for _, k, i, x in own:
            base = np.array(buffers[k] if len(buffers[k]) >= 5 else [r[3] for r in own])
            assert got[i] == pytest.approx((x - base.mean()) / (base.std() + 1e-6))


def test_sources_round_trip(spark, tmp_path):
    from marketloom.sources import io

    d = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    io.write_table(d, str(tmp_path / "p"))
    io.write_jsonl(d, str(tmp_path / "j"))
    io.write_csv(d, str(tmp_path / "c"), sep="\t")
    want = sorted(map(tuple, d.collect()))
    for back in (io.read_table(spark, str(tmp_path / "p")), io.read_jsonl(spark, str(tmp_path / "j"), "id int, t string"), io.read_csv(spark, str(tmp_path / "c"), "id int, t string", sep="\t")):
        assert sorted(map(tuple, back.collect())) == want
    (tmp_path / "t" / "AAPL").mkdir(parents=True)
    (tmp_path / "t" / "AAPL" / "2020-01-02").write_text('{"text": "x"}\n')
    got = io.scan_dated_dirs(spark, str(tmp_path / "t"), "text string").first()
    assert (got["ticker"], str(got["date"]), got["text"]) == ("AAPL", "2020-01-02", "x")
    cache = spark.createDataFrame([(1, "done"), (2, "")], "id int, result string")
    assert [r["id"] for r in io.pending(d, cache, "id", "result").collect()] == [2]
    (tmp_path / "w.txt").write_text("<unk> 1 2\ncat 3 4\ndog 5 6\n")
    v = io.load_word_vectors(spark, str(tmp_path / "w.txt"), spark.createDataFrame([("UNK",), ("cat",)], "word string"))
    assert sorted((r["word"], r["vector"]) for r in v.collect()) == [("UNK", [1.0, 2.0]), ("cat", [3.0, 4.0])]
    m = io.file_manifest(spark, str(tmp_path / "t")).first()
    assert m["role"] == "unknown" and m["size_mb"] > 0


def test_masks_of_several_turns(spark):
    one = spark.createDataFrame([([9, 3, 5, 1, 2, 7, 3, 6, 1, 2, 8, 3, 4],), ([1, 2, 7],), ([3, 4],), ([1, 2, 7, 3, 5, 1, 2, 8],)], "a array<int>")
    got = [x[0] for x in one.select(preference.mask_turns(F.col("a"), [3], [1, 2])).collect()]
    no = -100
    assert got == [[no, no, no, no, no, 7, no, no, no, no, 8, no, no], [no] * 3, [no] * 2, [no, no, 7, no, no, no, no, 8]]


def test_prompt_of_strings_and_turns(spark):
    d = spark.createDataFrame([("ask me yes", "ask me no"), ("same", "same"), ("ab", "xy"), ("", "")], "chosen string, rejected string")
    got = [tuple(x) for x in preference.extract_prompt(d).select("prompt", "chosen", "rejected").collect()]
    assert got == [("ask me", " yes", " no"), ("sam", "e", "e"), ("", "ab", "xy"), ("", "", "")]
    turns = spark.createDataFrame([(["q", "a"], ["q", "b"])], "chosen array<string>, rejected array<string>")
    assert tuple(preference.extract_prompt(turns).select("prompt", "chosen", "rejected").first()) == (["q"], ["a"], ["b"])


def test_odd_votes_are_an_error(spark):
    d = spark.createDataFrame([([1, 2],)], "v array<int>")
    with pytest.raises(Exception, match="invalid votes"):
        d.select(preference.all_true(F.col("v"))).collect()
    assert spark.createDataFrame([([1, 1],), ([1, 0],), ([0, -1],)], "v array<int>").select(preference.all_true(F.col("v"))).toPandas().iloc[:, 0].tolist() == [1, 0, -1]


def test_years_with_a_gap(spark):
    d = spark.sql("SELECT explode(array(date'2001-01-01', date'2002-01-01', date'2003-01-01', date'2005-01-01', date'2006-01-01')) date")
    years = lambda *a: sorted(str(x[0])[:4] for x in clean.select_years(d, "date", *a).collect())
    assert years(2018, 2023) == ["2001", "2002", "2003"] and years(2005, 2023) == ["2005", "2006"]
    assert clean.select_years(d.where("false"), "date", 2018, 2023).count() == 0


def test_tokens_round_as_printf_does(spark):
    d = spark.createDataFrame([(0.815, 0.125, 0.15), (0.825, -0.125, -0.25), (0.875, 1234.375, None)], "market_vol_20d_rank double, macd_hist double, volume_zscore_20 double")
    d = d.withColumns({c: F.lit(None).cast("double") for c in ("rsi_14", "price_vs_sma20", "bb_position", "relative_strength_5d")})
    got = [(r["market_vol_20d_rank"], r["macd_hist"], r["t"]) for r in d.withColumn("t", indicators.event_tokens()).collect()]
    for rank, hist, tokens in got:
        assert tokens == [f"[MACD_{'BULLISH' if hist > 0 else 'BEARISH'}: hist={hist:.2f}]", f"[HIGH_VOLATILITY_REGIME: vol20_pctile={rank:.2f}]"]
    d = spark.createDataFrame([(79.95,), (2.5,), (0.05,), (-0.05,)], "x double").select("x", T.fixed(F.col("x"), 1).alias("t"))
    assert [r["t"] for r in d.collect()] == [f"{r['x']:.1f}" for r in d.collect()]


def test_annual_return_of_a_long_fall(spark):
    """The product of all returns is far below what 1 can carry beside it."""
    d = spark.range(20000).select((F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 250).cast("int"))).alias("window_end_date"), F.col("id").alias("sample_id"), F.lit("long").alias("action"), F.lit(-0.01).alias("strategy_return"))
    m = backtest.backtest_metrics(d.withColumn("drawdown", F.lit(0.0))).first()
    assert m["annual_return"] == pytest.approx(0.99**252 - 1) and m["total_return"] == pytest.approx(-1)
    ruin = d.limit(7).withColumns({"drawdown": F.lit(0.0), "strategy_return": F.when(F.col("sample_id") == 3, -1.0).otherwise(0.1)})
    assert backtest.backtest_metrics(ruin).first()["annual_return"] == -1
