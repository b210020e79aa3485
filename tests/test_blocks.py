"""Blocks of histories, streams with state, numbered texts, request files, trajectories and fused baselines."""

import glob
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions import text as T
from marketloom.operators import align, backtest, blocks, indicators, metrics, models, preference, trajectory
from marketloom.plans import fixtures, queries
from marketloom.sources import requests, shared
from marketloom.streaming import buffers, runs, streams


def history(spark, n=700, holes=0.4, nulls=0.0):
    """Two keys with gaps of all lengths, and one with a single row."""
    rng = np.random.default_rng(7)
    parts = []
    for k, size in (("A", n), ("B", n // 3), ("C", 1)):
        days = pd.date_range("2010-01-01", periods=4 * size)[np.sort(rng.choice(4 * size, size, replace=False))]
        days = days.where(np.arange(size) < size * (1 - holes), days + pd.Timedelta(days=900))
        p = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, size)))
        parts.append(pd.DataFrame({"ticker": k, "date": days.date, "open": p * 0.99, "high": p * 1.02, "low": p * 0.97, "close": p, "adj_close": np.where(rng.random(size) < nulls, np.nan, p), "volume": rng.integers(1, 1000, size)}))
    d = pd.concat(parts)
    return d, spark.createDataFrame(d).withColumn("adj_close", F.nanvl("adj_close", F.lit(None).cast("double")))


def rows(df, cols):
    p = df.select("ticker", "date", *cols).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    return p


def test_halos_give_what_whole_histories_give(spark):
    _, df = history(spark)
    cols = ["ret_20d", "volatility_20d", "rsi_14", "atr_14", "price_vs_sma60", "bb_position", "volume_zscore_20"]
    want = rows(indicators.indicators(df), cols)
    for days, fine in ((64, 16), (128, 128), (1024, 64)):
        pd.testing.assert_frame_equal(rows(blocks.with_halo(df, indicators.indicators, 64, days, fine), cols), want, rtol=1e-9, atol=1e-12)
    with pytest.raises(ValueError, match="multiple"):
        blocks.with_halo(df, indicators.indicators, 64, 100, 64)


def test_a_hot_key_becomes_many_groups(spark):
    _, df = history(spark)
    seen = []

    def spy(x):
        seen.append(x)
        return x.withColumn("n", F.count(F.lit(1)).over(indicators.by_ticker().rowsBetween(-3, 0)))

    out = blocks.with_halo(df, spy, 4, 128, 32)
    assert out.count() == df.count()
    sizes = seen[0].where("ticker.key = 'A'").groupBy("ticker").count().toPandas()["count"]
    assert len(sizes) > 15 and sizes.max() < 200


def test_means_by_blocks_equal_the_recursion(spark):
    p, df = history(spark)
    got = rows(blocks.macd(df, days=32), ["macd", "macd_signal", "macd_hist"])
    want = rows(indicators.macd(df.select("ticker", "date", "adj_close")), ["macd", "macd_signal", "macd_hist"])
    pd.testing.assert_frame_equal(got, want, rtol=1e-9, atol=1e-9)
    plan = blocks.macd(df)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "Python" not in plan


def test_means_pass_over_nulls(spark):
    p, df = history(spark, 300, nulls=0.3)
    got = rows(blocks.ema(df, {"m": ("adj_close", 5), "fast": ("adj_close", 2)}, days=16), ["m", "fast"])
    for k, part in p.groupby("ticker"):
        part = part.sort_values("date")
        for name, span in (("m", 5), ("fast", 2)):
            np.testing.assert_allclose(got[got.ticker == k][name].to_numpy(float), part["adj_close"].ewm(span=span, adjust=False, ignore_na=True).mean(), rtol=1e-9)
    with pytest.raises(ValueError, match="spans"):
        blocks.ema(df, {"m": ("adj_close", 1)})


def test_alignment_by_blocks_is_the_same(spark):
    _, df = history(spark)
    cal = df.select("ticker", "date")
    news = spark.range(4000).select(F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit("Z")), (F.col("id") % 4 + 1).cast("int")).alias("ticker"), F.timestamp_seconds(F.lit(1262304000) + F.col("id") * 53 * 3600).alias("timestamp_utc"), "id")
    for early in (None, 16):
        for days in (8, 128):
            got = {tuple(r) for r in blocks.next_trading_day(news, cal, early, days).select("id", "event_date").collect()}
            assert got == {tuple(r) for r in align.next_trading_day(news, cal, early).select("id", "event_date").collect()} and got


REWARDS = [(b, k, 100 * b + 10 * k + i, float((b * 7 + k * 3 + i * i) % 11)) for b in range(6) for k in range(4) for i in range(1 + (b + k) % 6)]


def reference_advantages(rewards, size, least):
    """As a plain tracker does it, batch by batch."""
    held, out = {}, {}
    for b in sorted({r[0] for r in rewards}):
        batch = [r for r in rewards if r[0] == b]
        all_rewards = [r[3] for r in batch]
        for k in sorted({r[1] for r in batch}):
            own = [r for r in batch if r[1] == k]
            held[k] = (held.get(k, []) + [r[3] for r in sorted(own, key=lambda r: r[2])])[-size:]
            x = all_rewards if len(held[k]) < least else held[k]
            out |= {(b, k, r[2]): (r[3] - np.mean(x)) / (np.std(x) + 1e-6) for r in own}
    return out


def as_frame(spark, rewards):
    return spark.createDataFrame(rewards, "batch_id long, key long, id long, reward double")


def test_buffers_of_a_stream_equal_windows_and_survive_a_restart(spark, tmp_path):
    df = as_frame(spark, REWARDS).withColumn("wave", F.col("batch_id").cast("int"))
    at = str(tmp_path)
    schema = df.drop("wave").schema
    run = lambda: runs.drained(buffers.buffer_stream(runs.follow(spark, f"{at}/in", schema), 7), f"{at}/out", f"{at}/state")
    runs.arrive(df, f"{at}/in", "wave", range(3))
    first = run().count()
    assert first == len({(r[0], r[1]) for r in REWARDS if r[0] < 3})
    runs.arrive(df, f"{at}/in", "wave", range(3, 6))  # a new query on the same checkpoint takes up the buffers
    held = run()
    assert run().count() == held.count()  # nothing new, nothing twice
    order = ["key", "batch_id"]
    want = buffers.buffers(df, 7).toPandas().sort_values(order).reset_index(drop=True)
    got = held.toPandas().sort_values(order).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, rtol=1e-9, atol=1e-12)
    z = {(r["batch_id"], r["key"], r["id"]): r["advantage"] for r in buffers.advantages(df, held, 4).collect()}
    plain = reference_advantages(REWARDS, 7, 4)
    assert z.keys() == plain.keys() and all(abs(z[k] - plain[k]) < 1e-9 for k in z)


def test_idle_keys_are_forgotten(spark, tmp_path):
    df = as_frame(spark, [(0, 1, 1, 1.0), (0, 1, 2, 3.0), (1, 1, 3, 5.0)]).withColumn("wave", F.col("batch_id").cast("int"))
    at, schema = str(tmp_path), df.drop("wave").schema
    run = lambda: runs.drained(buffers.buffer_stream(runs.follow(spark, f"{at}/in", schema), 7, 1), f"{at}/out", f"{at}/state", False)
    runs.arrive(df, f"{at}/in", "wave", range(1))
    run()
    runs.arrive(df, f"{at}/in", "wave", range(1, 2))
    got = {r["batch_id"]: r["n"] for r in run().collect()}
    assert got == {0: 2, 1: 1}  # a millisecond to live: the second batch finds nothing held


def test_stream_parts_do_not_overlap(spark):
    valid, train = streams.hash_take(spark.range(1000), "id", 0.2)
    a, b = {r[0] for r in valid.collect()}, {r[0] for r in train.collect()}
    assert not a & b and len(a | b) == 1000 and 150 < len(a) < 250


def test_numbers_of_any_key(spark):
    words = ["é", "b", "B", "", "𝄞", "zz", None, *[f"w{i % 37}" for i in range(300)]]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, i long")
    got = [(r["w"], r["i"]) for r in shared.numbered(df, "w", "i").orderBy("n").collect()]
    key = lambda x: (x[0] is not None, (x[0] or "").encode(), x[1])
    assert got == sorted(((w, i) for i, w in enumerate(words)), key=key)
    assert [r["n"] for r in shared.numbered(df, "w", "i").select("n").orderBy("n").collect()] == list(range(1, len(words) + 1))
    assert shared.numbered(df.limit(0), "w").count() == 0
    vocab = {r["word"]: r["id"] for r in preference.vocabulary(df.select(F.col("w").alias("word"))).collect()}
    assert vocab == {w: i + 1 for i, w in enumerate(sorted({w for w in words if w is not None}, key=str.encode))}


def test_requests_go_on_where_they_stopped(spark, tmp_path):
    at = str(tmp_path / "r")
    df = spark.createDataFrame([(i, f"p{i}") for i in range(25)], "k long, prompt string")
    cache = spark.createDataFrame([(3, "done"), (4, "")], "k long, result string")
    write = lambda x, c: {r["part"]: r["n_requests"] for r in requests.write_requests(x, c, at, "k", "prompt", "result", "m", 10).collect()}
    assert write(df.where("k < 12"), cache) == {1: 10, 2: 1}
    assert write(df.where("k < 12"), cache) == {}
    # A run that died after its files and before its manifest: the part is written again, not twice.
    spark.createDataFrame([("junk", 3)], "value string, part long").write.partitionBy("part").mode("append").text(f"{at}/requests")
    assert write(df, cache) == {3: 10, 4: 3}
    lines = requests.read_requests(spark, at).collect()
    ids = [int(json.loads(r["request"])["custom_id"]) for r in lines]
    assert sorted(ids) == [i for i in range(25) if i != 3] and {r["part"] for r in lines} == {1, 2, 3, 4}


def test_trajectory_chunks(spark):
    unit = (trajectory.Group("allies", "{x}", 2, 2, 0, ((1,),)),)
    steps = [("g", 0, t, [1.0, 0.5, 0.0, 9.0, 7.0] if t % 2 == 0 else None, t % 3 if t % 2 else None) for t in range(16)] + [("g", 1, t, [0.0] * 5 if t % 2 == 0 else None, 1 if t % 2 else None) for t in range(7)]
    df = spark.createDataFrame(steps, "trajectory string, agent int, t int, state array<double>, action int")
    got = {(r["agent"], r["chunk"]): r for r in trajectory.trajectory_chunks(df, unit, ("a", "b", "c"), own=0, fmt="%.1f").collect()}
    assert set(got) == {(0, 0), (0, 1)}  # the last whole chunk counts, one without its answer does not
    state = "{State:{visible allies: {x} {id 0: 0.5}; own_health: 7.0}; "
    assert got[0, 0]["text"] == state + "Action: b; } " + state + "Action: a; } " + state + "Action: c; } " + state
    assert got[0, 0]["answer"] == 1 and all(r["negative"] != r["answer"] and 0 <= r["negative"] < 3 for r in got.values())
    seen = {r[0] for r in spark.range(300).select(trajectory.other_action(F.lit(1), F.col("id").cast("string"), 4)).collect()}
    assert seen == {0, 2, 3}


def test_option_means_cut_ragged_spans(spark):
    df = spark.sql("SELECT array(-1D, -2D, -4D, -9D, -3D, -9D, -1D, -5D, -7D, -9D) f, array(4, 2, 4) sizes, array(2, 1, 0) lengths, 1 truth")
    df = df.withColumn("o", trajectory.cut_spans(F.col("f"), F.col("sizes"))).withColumn("m", trajectory.span_means(F.col("o"), F.col("lengths")))
    r = df.first()
    assert r["o"] == [[-1, -2, -4, -9], [-3, -9], [-1, -5, -7, -9]] and r["m"] == [-3.0, -3.0, None]
    assert not preference.split_by_argmax(df, "m", "truth").first()["positive"]  # of equals, the first


def test_chat_templates(spark):
    m = spark.sql("""SELECT from_json('[{"role":"user","content":"hi"},{"role":"tool"},{"role":"assistant","content":"yes"}]', 'array<struct<role:string,content:string>>') m""")
    chat = T.chat_template(F.col("m"), T.CHATML, T.CHATML_END)
    assert m.select(chat).first()[0] == "<|im_start|>user\nhi<|im_end|>\ntool\n<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    prompt = T.chat_template(F.slice("m", 1, 2), T.CHATML, T.CHATML_END)
    assert m.select(T.completion_of(chat, prompt)).first()[0] == "<|im_start|>assistant\nyes<|im_end|>\n"
    assert m.select(T.completion_of(prompt, chat)).first()[0] is None


def test_flip_rate_counts_the_last_row_and_any_spelling(spark):
    data = [(1, "ORIGINAL", "mild_up", 0), (1, "X", "Strong Down", 0), (1, "X", "STRONG_UP", 1), (2, "ORIGINAL", "neutral", 0), (2, "X", "downward", 0), (3, "X", "up", 0), (4, "ORIGINAL", None, 0), (4, "X", "flat", 0)]
    got = backtest.flip_rate(spark.createDataFrame(data, "sample_id long, cf_type string, pred_label string, run long")).collect()
    assert [tuple(r) for r in got] == [("X", 1 / 3, 3)]


def test_bins_have_their_lower_edge(spark):
    got = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.3, 0.30000000000000004, 0.7, 0.9999, 1.0)], "p double").select(metrics.bin_of(F.col("p"), 10)).collect()
    edges = [i * 0.1 for i in range(1, 10)]
    assert [r[0] for r in got] == [sum(x >= e for e in edges) for x in (0.0, 0.1, 0.3, 0.30000000000000004, 0.7, 0.9999, 1.0)]


def test_baselines_on_a_fixture_that_can_be_told_apart(spark):
    rng = np.random.default_rng(1)
    y = rng.choice(["down", "flat", "up"], 400, p=[0.3, 0.3, 0.4])
    x = pd.DataFrame({"key": range(400), "label": y, "a": (y == "up") + rng.normal(0, 0.05, 400)})
    z = pd.DataFrame({"key": range(400), "b": (y == "flat") + rng.normal(0, 0.05, 400), "regime": rng.choice(["low_vol", "high_vol"], 400)})
    both = models.fused([spark.createDataFrame(x), spark.createDataFrame(z)], ["key"], "regime")
    assert {"regime_low_vol", "regime_normal_vol", "regime_high_vol"} <= set(both.columns) and both.count() == 400
    train, test = both.where("key < 300"), both.where("key >= 300")
    majority = test.where("label = 'up'").count() / 100
    scores = None
    for name, fit, cols in (("one", models.tree_baseline, ["a"]), ("fused", models.tree_baseline, ["a", "b"]), ("linear", models.linear_baseline, ["a", "b"])):
        s = models.scored(fit(train, cols, "label"), test, "label", ["key"]).withColumn("model", F.lit(name))
        scores = s if scores is None else scores.unionByName(s)
    p = scores.toPandas()
    assert np.allclose(p["p"].map(sum), 1) and all(len(v) == 3 for v in p["p"])
    report = {r["model"]: r for r in models.model_report(scores, ["down", "flat", "up"]).collect()}
    assert report["fused"]["accuracy"] > 0.97 > report["one"]["accuracy"] > majority and report["linear"]["accuracy"] > 0.9
    for name, q in p.groupby("model"):
        hit = (q["true_label"] == q["pred_label"]).to_numpy()
        classes = sorted(set(q["true_label"]) | set(q["pred_label"]))
        f1 = [2 * (hit & (q["true_label"] == c)).sum() / ((q["true_label"] == c).sum() + (q["pred_label"] == c).sum()) for c in classes]
        brier = np.mean([sum((v - (c == t)) ** 2 for v, c in zip(pp, ["down", "flat", "up"], strict=True)) for pp, t in zip(q["p"], q["true_label"], strict=True)])
        assert np.allclose([report[name][k] for k in ("accuracy", "macro_f1", "brier")], [hit.mean(), np.mean(f1), brier])


def test_window_order_is_not_a_single_partition(spark):
    _, df = history(spark)
    plan = blocks.next_trading_day(spark.sql("SELECT 'A' ticker, timestamp'2012-01-01 00:00:00' timestamp_utc"), df.select("ticker", "date"))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_the_linear_baseline_reads_the_trades_once(spark, monkeypatch):
    """Bars are made once, whatever passes the fit takes."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    d, read = "/root/testdata/sf0.001", fixtures.read
    trades = read(spark, d, "lineitem")
    monkeypatch.setattr(fixtures, "read", lambda s, at, name: read(s, at, name).withColumn("l_extendedprice", counted("l_extendedprice")) if name == "lineitem" else read(s, at, name))
    assert queries.queries()["linear_baseline"](spark, d).count() > 0
    assert seen.value == trades.count()


def test_gaps_are_filled_without_a_join(spark):
    """Bars without ticks are made where the bar before them lies: two shuffles of bars with ticks, none of the filled ones."""
    t = spark.createDataFrame([("a", "2024-01-01 00:10:00", 1, 5.0), ("a", "2024-01-01 00:20:00", 2, 5.0), ("a", "2024-01-01 03:00:00", 3, None), ("a", "2024-01-02 05:00:00", 4, 7.0), ("b", "2024-01-01 00:00:00", 5, 1.0), (None, "2024-01-01 00:00:00", 6, 2.0)], "ticker string, ts string, event_id long, px double")
    d = indicators.timeframe_features(t.withColumn("ts", F.col("ts").cast("timestamp")))
    plan = d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2
    got = {(r["ticker"], str(r["bar"])): r for r in d.collect()}
    assert len(got) == 32
    hour = lambda h: got["a", str(pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h))]
    assert [hour(h)["n_ticks"] for h in (0, 1, 3, 28, 29)] == [2, 0, 1, 0, 1] and [hour(h)["open"] for h in (0, 3, 28, 29)] == [5.0, 5.0, 5.0, 7.0]
    assert [hour(h)["trend"] for h in (18, 28, 29)] == [0, 0, 1] and [hour(h)["atr"] for h in (12, 13, 29)] == [0.0, 0.0, 2.0 / 14]
    assert got[None, "2024-01-01 00:00:00"]["close"] is None and got[None, "2024-01-01 00:00:00"]["n_ticks"] == 0


def test_a_wave_has_many_files_and_one_batch(spark, monkeypatch):
    """No task holds a wave: its files are many, also of a wave with fewer rows than files and of one without any."""
    monkeypatch.setattr(runs, "FILE_ROWS", 100)
    d = spark.range(1000).select("id", F.when(F.col("id") < 1, 0).when(F.col("id") < 990, 2).otherwise(3).alias("wave"))
    seen = []

    def sink(stream, out, checkpoint):
        folder = checkpoint.replace("/state", "/in").removeprefix("file:")
        seen.append(len(glob.glob(f"{folder}/*.parquet")))
        return runs.snapshots(stream.agg(F.count("id").alias("n"), F.sum("id").alias("s")), out, checkpoint)

    got = {(r["batch"], r["n"], r["s"]) for r in runs.run_waves(d, "wave", range(4), lambda x: x, sink).collect()}
    assert seen == [4 * 4] and got == {(0, 1, 0), (1, 1, 0), (2, 990, 990 * 989 // 2), (3, 1000, 1000 * 999 // 2)}
