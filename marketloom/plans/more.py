"""Further registered queries: every branch of the operators that the market queries do not reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, backtest, clean, indicators, metrics, preference
from ..streaming import streams
from . import fixtures as X
from .queries import BARS, BT, IND, JUDGE, LOGP, MARKET, PRED, RET, TRIALS, _labelled, _sql, _trades, _trials, query, r

CONV = """cv AS (SELECT conv_id, turn, "role" role, coalesce("text", '') body, string_split(coalesce("text", ''), ' ') w FROM conversations)"""


def _turns(s: SparkSession, d: str) -> DataFrame:
    c = X.read(s, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("body"))
    return c.withColumn("w", F.split("body", " "))


# ---- event tokens: the whole texts, from all seven rule groups

EMA = """s AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) n FROM bars),
 e AS (SELECT ticker, date, n, adj_close a, adj_close b, 0.0::DOUBLE sg FROM s WHERE n = 1
  UNION ALL SELECT s.ticker, s.date, s.n, a * (11 / 13.0::DOUBLE) + s.adj_close * (2 / 13.0::DOUBLE), b * (25 / 27.0::DOUBLE) + s.adj_close * (2 / 27.0::DOUBLE),
   sg * 0.8 + 0.2 * ((a * (11 / 13.0::DOUBLE) + s.adj_close * (2 / 13.0::DOUBLE)) - (b * (25 / 27.0::DOUBLE) + s.adj_close * (2 / 27.0::DOUBLE))) FROM e JOIN s ON s.ticker = e.ticker AND s.n = e.n + 1)"""
TOKENS = f"""{MARKET}, {EMA}, ti AS (SELECT *, count(*) OVER w14 n14, avg(g) OVER w14 ag, avg(f) OVER w14 af, count(*) OVER w20 n20, avg(adj_close) OVER w20 m, stddev_samp(adj_close) OVER w20 sd,
  avg(CAST(volume AS DOUBLE)) OVER w20 vm, stddev_samp(CAST(volume AS DOUBLE)) OVER w20 vs FROM b1 WINDOW w14 AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING), w20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)),
 tv AS (SELECT ticker, date, CASE WHEN n14 = 14 THEN CASE WHEN af > 0 THEN 100 - 100 / (1 + ag / af) WHEN ag > 0 THEN 100 END END rsi, a - b - sg hist, CASE WHEN n20 = 20 THEN adj_close / m - 1 END dist,
  CASE WHEN n20 = 20 AND sd > 0 THEN (adj_close - m + 2 * sd) / (4 * sd) END pos, CASE WHEN n20 = 20 THEN (volume - vm) / (vs + 1e-9) END vz, ret_5d - market_ret_5d rel, rk FROM ti JOIN e USING (ticker, date) LEFT JOIN market USING (date)),
 tok AS (SELECT ticker, date, list_filter([
  CASE WHEN rsi >= 70 THEN printf('[RSI_OVERBOUGHT: RSI14=%.1f, strength=%s]', rsi, CASE WHEN rsi >= 80 THEN 'high' ELSE 'medium' END) WHEN rsi <= 30 THEN printf('[RSI_OVERSOLD: RSI14=%.1f, strength=%s]', rsi, CASE WHEN rsi <= 20 THEN 'high' ELSE 'medium' END) END,
  CASE WHEN hist > 0 THEN printf('[MACD_BULLISH: hist=%.2f]', hist) WHEN hist < 0 THEN printf('[MACD_BEARISH: hist=%.2f]', hist) END,
  CASE WHEN dist > 0 THEN printf('[PRICE_ABOVE_SMA20: distance=%.1f%%]', dist * 100) WHEN dist <= 0 THEN printf('[PRICE_BELOW_SMA20: distance=%.1f%%]', dist * 100) END,
  CASE WHEN pos >= 0.9 THEN printf('[BOLLINGER_UPPER_PRESSURE: position=%.2f]', pos) WHEN pos <= 0.1 THEN printf('[BOLLINGER_LOWER_PRESSURE: position=%.2f]', pos) END,
  CASE WHEN vz >= 1.5 THEN printf('[VOLUME_SPIKE: zscore=%.1f]', vz) WHEN vz <= -1 THEN printf('[VOLUME_DRY_UP: zscore=%.1f]', vz) END,
  CASE WHEN rel > 0.02 THEN printf('[MARKET_OUTPERFORMANCE_5D: value=%.1f%%]', rel * 100) WHEN rel < -0.02 THEN printf('[MARKET_UNDERPERFORMANCE_5D: value=%.1f%%]', rel * 100) END,
  CASE WHEN rk >= 0.8 THEN printf('[HIGH_VOLATILITY_REGIME: vol20_pctile=%.2f]', rk) END], lambda x: x IS NOT NULL) tokens, CASE WHEN rk <= 0.33 THEN 'low_vol' WHEN rk >= 0.66 THEN 'high_vol' ELSE 'normal_vol' END regime_label FROM tv)""".replace("WITH ", "")


@query(f"WITH RECURSIVE {TOKENS} SELECT ticker, date, len(tokens) n_tokens, array_to_string(tokens, '; ') tokens FROM tok")
def event_token_texts(s: SparkSession, d: str) -> DataFrame:
    return indicators.features(X.bars(s, d)).select("ticker", "date", F.size("technical_event_tokens").cast("long").alias("n_tokens"), F.array_join("technical_event_tokens", "; ").alias("tokens"))


#: The SQL of the flagship query, which plans.queries registers.
EVENT_TOKENS_SQL = f"WITH RECURSIVE {TOKENS}, x AS (SELECT ticker, unnest(tokens) t FROM tok) SELECT ticker, regexp_extract(t, '\\[(\\w+)', 1) token, count(*) n FROM x GROUP BY ALL"
_sql["event_tokens"] = EVENT_TOKENS_SQL
_sql["judge_distribution"] = f"WITH {JUDGE}, v AS (SELECT sample_id, sample_id % 7 > 0 ok, CASE WHEN sample_id % 7 = 0 THEN [0, 0, 1, 0, 0] ELSE list_transform(p, lambda x: printf('%.4f', x)::DOUBLE) END q FROM pred) SELECT sample_id, ok parse_ok, round((q[3] / list_sum(q))::DOUBLE, 3) neutral, (['strong_down','mild_down','neutral','mild_up','strong_up'])[list_position(q, list_max(q))] AS \"label\" FROM v"


@query(f"""WITH RECURSIVE {TOKENS} SELECT count(*) token_rows, round(avg(CASE WHEN len(tokens) = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) missing_rate, count(*) FILTER (regime_label = 'low_vol') low_vol, count(*) FILTER (regime_label = 'normal_vol') normal_vol,
 count(*) FILTER (regime_label = 'high_vol') high_vol, (SELECT array_to_string(tokens, ', ') FROM tok WHERE len(tokens) > 0 ORDER BY ticker, date LIMIT 1) example_tokens FROM tok""")
def token_report(s: SparkSession, d: str) -> DataFrame:
    return indicators.token_report(indicators.features(X.bars(s, d))).withColumn("missing_rate", r("missing_rate", 6))


# ---- features joined with samples on the last day of their window

@query(f"""WITH {IND}, sm AS (SELECT ticker, date event_date, lag(date, 1) OVER w window_end_date FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))
 SELECT b0.ticker ticker, event_date, window_end_date, round(ret_1d, 4) ret_1d, round(ret_5d, 4) ret_5d FROM sm JOIN b0 ON b0.ticker = sm.ticker AND b0.date = sm.window_end_date""")
def point_in_time_features(s: SparkSession, d: str) -> DataFrame:
    bars = X.bars(s, d)
    w = align.by_ticker()
    samples = bars.select("ticker", F.col("date").alias("event_date"), F.lag("date").over(w).alias("window_end_date"))
    x = align.feature_join(samples, indicators.indicators(bars))
    return x.select("ticker", "event_date", "window_end_date", r("ret_1d").alias("ret_1d"), r("ret_5d").alias("ret_5d"))


@query(f"""WITH {BARS}, x AS (SELECT ticker, date, lag(date, 1) OVER (PARTITION BY ticker ORDER BY date) k FROM bars), t AS (SELECT ticker || ':' || date k, date < DATE '2000-01-01' early FROM bars)
 SELECT (SELECT count(*) FROM x WHERE k >= date) n_late, (SELECT count(*) FROM (SELECT k FROM t WHERE early INTERSECT SELECT k FROM t WHERE NOT early)) n_overlap""")
def leakage_checks(s: SparkSession, d: str) -> DataFrame:
    b = X.bars(s, d).withColumn("known", F.lag("date").over(align.by_ticker())).withColumn("k", F.concat_ws(":", "ticker", F.col("date").cast("string")))
    early = F.col("date") < F.lit("2000-01-01").cast("date")
    return align.point_in_time_violations(b, "known", "date").crossJoin(align.overlap_count(b.where(early), b.where(~early), "k"))  # one row each


PHRASE = "['shares surged', 'shares plunged', 'stock rises after', 'stock falls after', 'trading higher after', 'trading lower after', 'shares rose', 'after hours', 'nothing']"


@query(f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(({PHRASE})[doc_id % 9 + 1]) ELSE 'none' END headline, CASE WHEN doc_id % 4 = 1 THEN coalesce("text", '') || ({PHRASE})[doc_id % 9 + 1] ELSE "text" END body FROM documents)
 SELECT doc_id, regexp_matches(lower(concat_ws(' ', headline, body)), 'shares surged|shares plunged|stock rises after|stock falls after|trading higher after|trading lower after') leakage_phrase_flag FROM x""")
def leakage_phrases(s: SparkSession, d: str) -> DataFrame:
    """Documents with one of nine phrases, six of which give a later price away, as headline or at the end of the text."""
    phrases = ("shares surged", "shares plunged", "stock rises after", "stock falls after", "trading higher after", "trading lower after", "shares rose", "after hours", "nothing")
    p = F.element_at(F.array(*map(F.lit, phrases)), (F.col("doc_id") % 9 + 1).cast("int"))
    x = X.read(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper(p)).otherwise("none").alias("headline"), F.when(F.col("doc_id") % 4 == 1, F.concat(F.coalesce("text", F.lit("")), p)).otherwise(F.col("text")).alias("body"), F.lit("2020-01-01 10:00:00").cast("timestamp").alias("timestamp_utc"))
    return align.leakage_flags(x).select("doc_id", "leakage_phrase_flag")


# ---- model-written rationales

RATION = PRED + """, ra AS (SELECT sample_id, ['long','short','hold','buy',NULL][sample_id % 5 + 1] act, CASE WHEN sample_id % 3 = 0 THEN list_transform(p, lambda x: round(x * 0.5, 6)) ELSE list_transform(p, lambda x: round(x, 6)) END q, sample_id % 4 = 0 bare FROM pred),
 rb AS (SELECT *, coalesce(CASE WHEN act IN ('long','short','hold') THEN act END, 'hold') a, q[1] + q[2] dn, q[4] + q[5] up, abs(list_sum(q) - 1) > 0.05 bad FROM ra),
 rc AS (SELECT *, CASE WHEN a = 'long' AND (bad OR up <= dn) THEN [0, 0, 0, 0.4, 0.6] WHEN a = 'short' AND (bad OR dn <= up) THEN [0.6, 0.4, 0, 0, 0] WHEN a = 'hold' AND (bad OR q[3] < 0.4) THEN [0, 0, 1, 0, 0] ELSE q END f FROM rb)"""


def _rationales(s: SparkSession, d: str) -> DataFrame:
    """Rationales as a model writes them: some with odd actions, sums of a half, or without lists and texts."""
    p = X.predictions(s, d)
    scale = F.when(F.col("sample_id") % 3 == 0, 0.5).otherwise(1.0)
    act = F.get(F.array(F.lit("long"), F.lit("short"), F.lit("hold"), F.lit("buy"), F.lit(None).cast("string")), (F.col("sample_id") % 5).cast("int"))
    q = F.transform("p", lambda x: F.round(x * scale, 6))
    dist = F.struct(*[F.get(q, F.lit(i)).alias(c) for i, c in enumerate(T.CLASSES)])
    said = F.when(F.col("sample_id") % 4 != 0, F.array(F.lit("a"), F.lit("b")))
    body = F.to_json(F.struct(said.alias("news_rationale"), F.array().cast("array<string>").alias("technical_rationale"), F.when(F.col("sample_id") % 4 != 0, "mixed").alias("conflict_resolution"), dist.alias("forecast_distribution"), act.alias("action"), F.lit("risk").alias("risk_note")))
    text = F.when(F.col("sample_id") % 2 == 0, F.concat(F.lit("Sure:\n```\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("so "), body, F.lit(" end")))
    return p.select("sample_id", F.from_json(T.extract_json(text), T.RATIONALE).alias("r"))


@query(f"""WITH {RATION} SELECT sample_id, a AS "action", round(f[1], 4)::DOUBLE strong_down, round(f[3], 4)::DOUBLE neutral, round(f[4], 4)::DOUBLE mild_up, round(f[5], 4)::DOUBLE strong_up, CASE WHEN bare THEN 'No rationale provided' ELSE 'a,b' END news, 'No rationale provided' technical, CASE WHEN bare THEN 'None' ELSE 'mixed' END conflict FROM rc""")
def rationale_repair(s: SparkSession, d: str) -> DataFrame:
    x = _rationales(s, d).select("sample_id", T.repaired_rationale(F.col("r")).alias("x"))
    return x.select("sample_id", "x.action", *[r(f"x.forecast_distribution.{c}").alias(c) for c in ("strong_down", "neutral", "mild_up", "strong_up")], F.array_join("x.news_rationale", ",").alias("news"), F.array_join("x.technical_rationale", ",").alias("technical"), F.col("x.conflict_resolution").alias("conflict"))


@query(f"""WITH {RATION} SELECT CASE WHEN bare THEN 'missing_field' WHEN list_sum(q) < 0.95 OR list_sum(q) > 1.05 THEN 'probability_sum' WHEN act IS NULL OR act NOT IN ('long','short','hold') THEN 'action' WHEN act = 'long' AND dn > 0.6 THEN 'long_against_down' WHEN act = 'short' AND up > 0.6 THEN 'short_against_up' END reason, count(*) n FROM rc GROUP BY ALL""")
def rationale_errors(s: SparkSession, d: str) -> DataFrame:
    """How often each rule is the first that a rationale breaks; null: valid."""
    return _rationales(s, d).groupBy(T.validation_error(F.col("r")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PRED}, x AS (SELECT sample_id, p, sample_id % 4 k FROM pred), v AS (SELECT sample_id, CASE k WHEN 0 THEN [0, 0, 1, 0, 0] WHEN 1 THEN [round(p[1], 4), 0, 1, 0, round(p[5], 4)] WHEN 2 THEN [0, 0, 0, 0, 0] ELSE list_transform(p, lambda y: round(y, 4)) END q FROM x)
 SELECT sample_id, round((CASE WHEN list_sum(q) > 0 THEN q[1] / list_sum(q) ELSE 0 END)::DOUBLE, 4) strong_down, round((CASE WHEN list_sum(q) > 0 THEN q[3] / list_sum(q) ELSE 1 END)::DOUBLE, 4) neutral FROM v""")
def judged_distribution(s: SparkSession, d: str) -> DataFrame:
    """Five-class answers: none, a part of the classes (neutral keeps its default of 1), all zeros, and all."""
    k = F.col("sample_id") % 4
    one = lambda i, v: F.concat(F.lit(f'"{T.CLASSES[i]}": '), v.cast("string"))
    v = lambda i: F.round(F.col("p")[i], 4)
    part = F.concat_ws(", ", one(0, v(0)), one(4, v(4)))
    zero = F.lit(", ".join(f'"{c}": 0.0' for c in T.CLASSES))
    t = F.when(k == 0, "no answer, strong_down: 1").when(k == 1, part).when(k == 2, zero).otherwise(F.concat_ws(", ", *[one(i, v(i)) for i in range(5)]))
    q = X.predictions(s, d).select("sample_id", T.parse_distribution(t).alias("q"))
    return q.select("sample_id", r(F.col("q")[0]).alias("strong_down"), r(F.col("q")[2]).alias("neutral"))


# ---- texts of prompts

SAY = "['There is no relevant information', 'No facts here', 'They do not contain much', 'first' || chr(10) || 'no tweets', 'A note on mentions', 'known mention', '']"


@query(f"""WITH {CONV}, x AS (SELECT conv_id, turn, ({SAY})[(conv_id + turn) % 7 + 1] || ' ' || w[1] s FROM cv) SELECT conv_id, turn, NOT regexp_matches(s, '^(?:.*[nN]o.*information.*|.*[nN]o.*facts.*|.*[nN]o.*mention.*|.*[nN]o.*tweets.*|.*do not contain.*)') informative FROM x""")
def informative_summaries(s: SparkSession, d: str) -> DataFrame:
    say = ("There is no relevant information", "No facts here", "They do not contain much", "first\nno tweets", "A note on mentions", "known mention", "")
    x = F.concat(F.element_at(F.array(*map(F.lit, say)), ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("int")), F.lit(" "), F.col("w")[0])
    return _turns(s, d).select("conv_id", "turn", T.is_informative(x).alias("informative"))


@query(f"""WITH {IND}, x AS (SELECT ticker, date, n, array_to_string(list_filter([CASE WHEN ret_1d IS NOT NULL THEN printf('ret_1d: %.4f', ret_1d) END, CASE WHEN ret_20d IS NOT NULL THEN printf('ret_20d: %.4f', ret_20d) END, CASE WHEN ret_5d IS NOT NULL THEN printf('ret_5d: %.4f', ret_5d) END], lambda y: y IS NOT NULL), ', ') t FROM b0)
 SELECT ticker, date, md5('Technical Indicator Tokens:' || chr(10) || CASE WHEN n % 3 = 0 THEN 'No technical features' ELSE t END || chr(10) || chr(10) || 'Instructions: go') content_md5 FROM x""")
def raw_number_prompts(s: SparkSession, d: str) -> DataFrame:
    """The token block of each prompt replaced by raw numbers; every third sample has no row of numbers."""
    i = indicators.indicators(X.bars(s, d)).select("ticker", "date", "ret_1d", "ret_20d", "ret_5d", F.row_number().over(align.by_ticker()).alias("n"))
    have = i.where("n % 3 <> 0").select("ticker", "date", T.raw_number_tokens(["ret_1d", "ret_20d", "ret_5d"]).alias("t"))
    prompt = F.lit("Technical Indicator Tokens:\n[MACD_BEARISH: hist=-0.98]\n[X]\n\nInstructions: go")
    x = i.select("ticker", "date").join(have, ["ticker", "date"], "left")
    return x.select("ticker", "date", F.md5(T.replace_block(prompt, "Technical Indicator Tokens:\n", "\n\nInstructions:", F.coalesce("t", F.lit(T.NO_NUMBERS)))).alias("content_md5"))


@query(f"""WITH {CONV} SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN 'Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.' ELSE 'Below is an instruction that describes a task. Write a response that appropriately completes the request.' END
 || chr(10) || chr(10) || '    ### Instruction:' || chr(10) || '    ' || body || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || '    ### Input:' || chr(10) || '    ' || role ELSE '' END || chr(10) || chr(10) || '    ### Response:' || chr(10) || '    ' || w[1]) prompt_md5,
 md5('Question: ' || body || chr(10) || chr(10) || 'Answer: ' || w[1]) qa_md5 FROM cv""")
def instruction_prompts(s: SparkSession, d: str) -> DataFrame:
    inp = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("")
    return _turns(s, d).select("conv_id", "turn", F.md5(T.instruction(F.col("body"), inp, F.col("w")[0])).alias("prompt_md5"), F.md5(T.question_answer(F.col("body"), F.col("w")[0])).alias("qa_md5"))


@query(f"""WITH {CONV}, x AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN list_concat([w[1], '$', 'x'], w) WHEN 1 THEN list_concat(['$', w[1] || 'y'], w[2:]) ELSE w END t, CASE WHEN turn % 2 = 0 THEN lower(substr(w[1], 1, 3)) ELSE lower(w[-1]) END q FROM cv),
 y AS (SELECT *, list_position(t, q) p, list_position(t, '$') dl FROM x), z AS (SELECT *, list_filter(range(1, len(t) + 1), lambda i: i > dl AND contains(t[i], q)) a FROM y)
 SELECT conv_id, turn, CAST(CASE WHEN p > 0 THEN p - 1 WHEN dl > 0 AND len(a) > 0 THEN a[1] - 1 ELSE len(t) - 1 END AS INT) place FROM z""")
def mention_places(s: SparkSession, d: str) -> DataFrame:
    w = F.col("w")
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.array(w[0], F.lit("$"), F.lit("x")), w)).when(F.col("turn") % 3 == 1, F.concat(F.array(F.lit("$"), F.concat(w[0], F.lit("y"))), F.slice("w", 2, 1 << 30))).otherwise(w)
    q = F.when(F.col("turn") % 2 == 0, F.substring(w[0], 1, 3)).otherwise(F.element_at("w", -1))
    return _turns(s, d).select("conv_id", "turn", T.mention_index(t, q).alias("place"))


GTOK = "['[MACD_BULLISH] [RSI_OVERSOLD]', 'rsi_oversold, price_above', '', NULL]"


@query(f"""WITH {PRED}, x AS (SELECT sample_id, ({GTOK})[sample_id % 4 + 1] t, CASE sample_id % 3 WHEN 0 THEN 'The macd_bullish sign' WHEN 1 THEN '' ELSE 'RSI_OVERSOLD and Price_Above' END ra FROM pred)
 SELECT sample_id, CAST(CASE WHEN ra = '' THEN 0 WHEN coalesce(trim(t), '') = '' THEN 1 WHEN sample_id % 4 = 0 THEN (contains(upper(ra), 'MACD_BULLISH')::INT + contains(upper(ra), 'RSI_OVERSOLD')::INT) / 2 ELSE (contains(upper(ra), 'RSI_OVERSOLD')::INT + contains(upper(ra), 'PRICE_ABOVE')::INT) / 2 END AS DOUBLE) grounding FROM x""")
def grounding_scores(s: SparkSession, d: str) -> DataFrame:
    t = F.get(F.array(F.lit("[MACD_BULLISH] [RSI_OVERSOLD]"), F.lit("rsi_oversold, price_above"), F.lit(""), F.lit(None).cast("string")), (F.col("sample_id") % 4).cast("int"))
    k = F.col("sample_id") % 3
    said = F.when(k == 0, "The macd_bullish sign").when(k == 1, "").otherwise("RSI_OVERSOLD and Price_Above")
    return X.predictions(s, d).select("sample_id", T.technical_grounding_text(t, said).alias("grounding"))


CF = "['[HIGH_VOLATILITY_REGIME: vol20_pctile=0.90]', '[LOW_VOLATILITY_REGIME: x]', '[MACD_BULLISH: hist=0.10]']"


@query(f"""WITH {PRED}, x AS (SELECT sample_id, CASE WHEN sample_id % 5 = 0 THEN '' ELSE true_label END h, ({CF})[sample_id % 3 + 1] t FROM pred), y AS (SELECT sample_id, unnest(['ORIGINAL','CF_NEWS_REMOVE','CF_TECH_NEUTRALIZE','CF_REGIME_FLIP']) cf_type,
 unnest([h, '', h, h]) hh, unnest([t, t, '[TECH_NEUTRAL: All indicators are neutral and uninformative]', CASE WHEN contains(t, '[HIGH_') THEN replace(t, '[HIGH_VOLATILITY_REGIME', '[LOW_VOLATILITY_REGIME') WHEN contains(t, '[LOW_') THEN replace(t, '[LOW_VOLATILITY_REGIME', '[HIGH_VOLATILITY_REGIME') ELSE t || ' [HIGH_VOLATILITY_REGIME: vol20=9.99, strength=strong]' END]) tt FROM x)
 SELECT sample_id, cf_type, 'News: ' || hh || ' Tokens: ' || tt prompt FROM y""")
def counterfactual_prompts(s: SparkSession, d: str) -> DataFrame:
    t = F.get(F.array(F.lit("[HIGH_VOLATILITY_REGIME: vol20_pctile=0.90]"), F.lit("[LOW_VOLATILITY_REGIME: x]"), F.lit("[MACD_BULLISH: hist=0.10]")), (F.col("sample_id") % 3).cast("int"))
    x = X.predictions(s, d).select("sample_id", F.when(F.col("sample_id") % 5 != 0, F.col("true_label")).alias("headline"), F.array(t).alias("technical_event_tokens"))
    return backtest.counterfactuals(x, "News: {headline} Tokens: {technical_event_tokens}")


# ---- rewards and reports

_RATIO = "exp(c - c0)"


@query(f"""WITH {LOGP}, x AS (SELECT *, CASE WHEN pair_id % 2 = 0 THEN 1.0::DOUBLE ELSE -0.5 END adv FROM logp), y AS (SELECT -adv * {_RATIO} a, -adv * least(greatest({_RATIO}, 0.8), 1.2) b, c - c0 d, r, r0 FROM x)
 SELECT round(avg(greatest(a, b)), 4) policy_loss, round(avg(CASE WHEN b > a THEN 1.0::DOUBLE ELSE 0 END), 6) clip_fraction, round(avg(0.5 * d * d), 6) approx_kl, round(avg(exp(d)), 4) mean_ratio FROM y""")
def ppo_diagnostics(s: SparkSession, d: str) -> DataFrame:
    x = X.logps(s, d).withColumn("adv", F.when(F.col("pair_id") % 2 == 0, 1.0).otherwise(-0.5))
    return metrics.ppo_report(x, "c", "c0", "adv").select(r("policy_loss").alias("policy_loss"), r("clip_fraction", 6).alias("clip_fraction"), r("approx_kl", 6).alias("approx_kl"), r("mean_ratio").alias("mean_ratio"))


@query(f"""WITH {LOGP}, x AS (SELECT c n, c0 o, r t FROM logp), y AS (SELECT pow(n - t, 2) a, pow(least(greatest(n, o - 0.2), o + 0.2) - t, 2) b FROM x) SELECT round(0.5 * avg(greatest(a, b)), 6) value_loss, round(avg(CASE WHEN b > a THEN 1.0::DOUBLE ELSE 0 END), 6) value_clip_fraction FROM y""")
def value_diagnostics(s: SparkSession, d: str) -> DataFrame:
    m = metrics.value_report(X.logps(s, d), "c", "c0", "r")
    return m.select(*[r(c, 6).alias(c) for c in m.columns])


_Z = "((c - r) - (c0 - r0))"
_MORE_LOSSES = {
    "robust": f"(ln(1 + exp(-0.1 * {_Z})) * 0.9 - ln(1 + exp(0.1 * {_Z})) * 0.1) / 0.8",
    "exo_pair": f"1 / (1 + exp(-0.1 * {_Z})) * (-ln(1 + exp(-0.1 * {_Z})) - ln(0.999)) + 1 / (1 + exp(0.1 * {_Z})) * (-ln(1 + exp(0.1 * {_Z})) - ln(0.001))",
    "alpha": "ln(1 + exp(-0.1 * (exp(-(r - r0)) - exp(-(c - c0)))))", "js": f"ln(1 + exp(-0.1 * ({_Z} - (ln(1 + exp(c - c0)) - ln(1 + exp(r - r0))))))",
}


@query(f"WITH {LOGP} " + " UNION ALL ".join(f"SELECT '{k}' kind, round(avg({v}), 6) mean_loss FROM logp" for k, v in _MORE_LOSSES.items()))
def more_preference_losses(s: SparkSession, d: str) -> DataFrame:
    kinds = {"robust": metrics.pair_loss("robust", eps=0.1), "exo_pair": metrics.pair_loss("exo_pair"), "alpha": metrics.pair_loss("sigmoid", divergence="alpha"), "js": metrics.pair_loss("sigmoid", divergence="js")}
    return metrics.mean_losses(X.logps(s, d), kinds).withColumn("mean_loss", r("mean_loss", 6))


@query(f"""WITH {LOGP}, a AS (SELECT row_number() OVER (ORDER BY c - r) n, c - r x FROM logp), b AS (SELECT row_number() OVER (ORDER BY c0 - r0) n, c0 - r0 y FROM logp) SELECT round(avg(ln(1 + exp(-0.1 * (x - y)))), 6) mean_loss FROM a JOIN b USING (n)""")
def aot_unpaired_loss(s: SparkSession, d: str) -> DataFrame:
    return metrics.preference_loss(X.logps(s, d), "aot").agg(r(F.avg("loss"), 6).alias("mean_loss"))


@query(f"""WITH {LOGP}, x AS (SELECT pair_id, pair_id % 7 bt, c - c0 x, pair_id % 3 > 0 good, r - r0 kl FROM logp), k AS (SELECT bt, greatest(avg(kl), 0) k FROM x GROUP BY bt)
 SELECT pair_id, round(CASE WHEN good THEN 1.5 * (1 - 1 / (1 + exp(-0.1 * (x - k)))) ELSE 1 - 1 / (1 + exp(-0.1 * (k - x))) END, 6) loss, round(CASE WHEN good THEN 1 - 1 / (1 + exp(-0.1 * x)) ELSE 1 / (1 + exp(-0.1 * x)) END, 6) apo FROM x JOIN k USING (bt)""")
def unpaired_losses(s: SparkSession, d: str) -> DataFrame:
    x = X.logps(s, d).select("pair_id", (F.col("pair_id") % 7).alias("bt"), (F.col("c") - F.col("c0")).alias("x"), (F.col("pair_id") % 3 > 0).alias("good"), (F.col("r") - F.col("r0")).alias("kl"))
    a = metrics.kto_loss(x, "bt", "x", "good", "kl", desirable=1.5)
    b = metrics.kto_loss(a.withColumnRenamed("loss", "kto"), "bt", "x", "good", "kl", kind="apo_zero_unpaired")
    return b.select("pair_id", r("kto", 6).alias("loss"), r("loss", 6).alias("apo"))


SEQ = "sq AS (SELECT vec_id, list_transform(embedding[1:6], lambda x: CAST(x AS DOUBLE)) rw, list_transform(embedding[7:12], lambda x: CAST(x AS DOUBLE)) vl FROM embeddings)"


def _sequences(s: SparkSession, d: str) -> DataFrame:
    part = lambda a: F.transform(F.slice("embedding", a, 6), lambda x: x.cast("double"))
    return X.read(s, d, "embeddings").select("vec_id", part(1).alias("rw"), part(7).alias("vl"))


_ADV = [f"(rw[{t}] + {f'vl[{t + 1}]' if t < 6 else '0'} - vl[{t}])" for t in range(1, 7)]


@query(f"""WITH {SEQ}, a AS (SELECT vec_id, vl, [{', '.join(' + '.join(f'{0.95**(j - t)}::DOUBLE * {_ADV[j]}' for j in range(t, 6)) for t in range(6))}] a FROM sq)
 SELECT vec_id, round(a[1], 6) first_advantage, round(a[6], 6) last_advantage, round(list_sum(a) + list_sum(vl), 6) total_return FROM a""")
def advantages(s: SparkSession, d: str) -> DataFrame:
    """Advantages and returns of one sequence a row."""
    x = _sequences(s, d).select("vec_id", metrics.gae(F.col("rw"), F.col("vl")).alias("a"), metrics.gae_returns(F.col("rw"), F.col("vl")).alias("g"))
    return x.select("vec_id", r(F.col("a")[0], 6).alias("first_advantage"), r(F.col("a")[5], 6).alias("last_advantage"), r(T.total(F.col("g")), 6).alias("total_return"))


@query(f"""WITH {SEQ}, k AS (SELECT vec_id, list_filter(list_transform(rw, lambda x, i: CASE WHEN i % 2 = vec_id % 2 OR i = 3 THEN x END), lambda x: x IS NOT NULL) k, rw FROM sq)
 SELECT vec_id, round(list_avg(k), 6) mean, round(list_var_samp(k), 6) var, round((rw[1] - list_avg(k)) / sqrt(list_var_samp(k) + 1e-8), 4) white, round(rw[1] / sqrt(list_var_samp(k) + 1e-8) - list_avg(k) / sqrt(list_var_samp(k) + 1e-8) + list_avg(k), 4) scaled FROM k""")
def masked_statistics(s: SparkSession, d: str) -> DataFrame:
    x = _sequences(s, d)
    mask = F.transform("rw", lambda v, i: ((i + 1) % 2 == F.col("vec_id") % 2) | (i == 2))
    x = x.withColumn("m", mask)
    v, m = F.col("rw"), F.col("m")
    return x.select("vec_id", r(metrics.masked_mean(v, m), 6).alias("mean"), r(metrics.masked_var(v, m), 6).alias("var"), r(metrics.masked_whiten(v, m)[0]).alias("white"), r(metrics.masked_whiten(v, m, shift_mean=False)[0]).alias("scaled"))


@query(f"""WITH {SEQ} SELECT vec_id, round(-0.05 * (rw[1] - vl[1]), 6) first_reward, round(-0.05 * (rw[6] - vl[6]) + 2 - CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 1 END, 6) last_reward FROM sq""")
def token_rewards(s: SparkSession, d: str) -> DataFrame:
    x = _sequences(s, d).select("vec_id", metrics.kl_rewards(F.col("rw"), F.col("vl"), F.lit(2.0), ended=F.col("vec_id") % 2 == 0, penalty=1.0).alias("k"))
    return x.select("vec_id", r(F.col("k")[0], 6).alias("first_reward"), r(F.col("k")[5], 6).alias("last_reward"))


@query(f"""WITH {PRED}, x AS (SELECT sample_id, window_end_date, CASE WHEN sample_id % 11 = 0 THEN -1.5::DOUBLE WHEN sample_id = 333 THEN -1.0::DOUBLE ELSE stock_return END r FROM pred), y AS (SELECT *, 1 + r f FROM x),
 z AS (SELECT sample_id, window_end_date, CASE WHEN count(*) FILTER (f = 0) OVER w > 0 THEN 0.0::DOUBLE ELSE (CASE WHEN count(*) FILTER (f < 0) OVER w % 2 = 1 THEN -1 ELSE 1 END) * exp(sum(CASE WHEN f <> 0 THEN ln(abs(f)) ELSE 0 END) OVER w) END eq FROM y WINDOW w AS (ORDER BY window_end_date, sample_id ROWS UNBOUNDED PRECEDING))
 SELECT sample_id, window_end_date, round(eq, 6) + 0.0 equity, round(max(eq) OVER (ORDER BY window_end_date, sample_id ROWS UNBOUNDED PRECEDING), 6) + 0.0 running_max FROM z""")
def equity_of_ruin(s: SparkSession, d: str) -> DataFrame:
    """Returns below -1 turn the product's sign, and one of -1 ends it."""
    p = X.predictions(s, d).select("sample_id", "window_end_date", F.when(F.col("sample_id") % 11 == 0, -1.5).when(F.col("sample_id") == 333, -1.0).otherwise(F.col("stock_return")).alias("strategy_return"))
    return backtest.equity_curve(p).select("sample_id", "window_end_date", (r("equity", 6) + 0.0).alias("equity"), (r("running_max", 6) + 0.0).alias("running_max"))


@query(f"""WITH {BT}, x AS (SELECT sample_id % 25 k, window_end_date, sample_id, CASE action WHEN 'long' THEN 1 WHEN 'short' THEN -1 ELSE 0 END p, strategy_return, action FROM sr), y AS (SELECT abs(p - coalesce(lag(p) OVER (PARTITION BY k ORDER BY sample_id), 0)) c FROM x)
 SELECT (SELECT round(avg(c), 6) FROM y) turnover, round(avg(CASE WHEN action <> 'hold' THEN 1.0::DOUBLE ELSE 0 END), 6) coverage, round(avg(strategy_return) / sqrt(avg(pow(least(strategy_return, 0), 2))) * sqrt(252), 6) sortino, round(pow(exp(sum(ln(1 + strategy_return))), 252.0::DOUBLE / count(*)) - 1, 6) annual_return FROM x""")
def extended_backtest(s: SparkSession, d: str) -> DataFrame:
    t = _trades(s, d).withColumn("k", F.col("sample_id") % 25)
    m = backtest.backtest_metrics(backtest.equity_curve(t))
    return backtest.turnover(t, "k", "sample_id").crossJoin(m).select(r("turnover", 6).alias("turnover"), r("coverage", 6).alias("coverage"), r("sortino", 6).alias("sortino"), r("annual_return", 6).alias("annual_return"))  # one row each


@query("""WITH x AS (SELECT vec_id // 4 sample_id, vec_id % 4 candidate_id, CASE WHEN vec_id % 50 = 0 THEN NULL ELSE CAST(embedding[1] AS DOUBLE) + 0.5 END s FROM embeddings)
 SELECT count(*) scored_rows, count(DISTINCT sample_id) unique_samples, round(avg(CASE WHEN s BETWEEN 0 AND 1 THEN 1.0::DOUBLE ELSE 0 END), 6) valid_score_rate, round(avg(s), 6) mean_overall_proxy_score, CASE WHEN avg(CASE WHEN s BETWEEN 0 AND 1 THEN 1.0::DOUBLE ELSE 0 END) >= 0.95 AND count(DISTINCT sample_id) >= 400 THEN 'PASS' ELSE 'FAIL' END status FROM x""")
def judge_report(s: SparkSession, d: str) -> DataFrame:
    x = X.candidates(s, d).withColumn("overall_proxy_score", F.when((F.col("sample_id") * 4 + F.col("candidate_id")) % 50 != 0, F.col("reward") + 0.5))
    m = preference.judge_report(x)
    return m.select("scored_rows", "unique_samples", r("valid_score_rate", 6).alias("valid_score_rate"), r("mean_overall_proxy_score", 6).alias("mean_overall_proxy_score"), "status")


@query(f"""WITH RECURSIVE {MARKET}, {EMA} SELECT ticker, date, round(coalesce(ret_1d, 0), 4) first, round(a - b, 4) macd, CASE WHEN rk <= 0.33 THEN 1.0::DOUBLE ELSE 0 END low, CASE WHEN rk >= 0.66 THEN 1.0::DOUBLE ELSE 0 END high, 0.25::DOUBLE last, CASE WHEN rk <= 0.33 THEN 0.5::DOUBLE WHEN rk >= 0.66 THEN 1.5 ELSE 1 END sigma, 35 size FROM b0 JOIN e USING (ticker, date) LEFT JOIN market USING (date)""")
def condition_vectors(s: SparkSession, d: str) -> DataFrame:
    f = indicators.features(X.bars(s, d)).withColumns({c: F.lit(0.25) for c in preference.GROUNDING})
    c = preference.condition_vector(f)
    return c.select("ticker", "date", r(F.col("cond")[0]).alias("first"), r(F.col("cond")[6]).alias("macd"), F.col("cond")[26].alias("low"), F.col("cond")[28].alias("high"), F.col("cond")[34].alias("last"), "sigma", F.size("cond").alias("size"))


@query(f"""WITH {PRED}, x AS (SELECT sample_id, p, CASE WHEN sample_id % 9 = 0 THEN 3 ELSE k END k FROM pred), y AS (SELECT sample_id, p[k] t, -list_sum(list_transform(p, lambda v: v * ln(v + 1e-9))) h FROM x) SELECT sample_id, round(t, 6) flow_prob_true_label, round(h, 6) flow_entropy, round(t - 0.1 * h, 6) flow_overall_reward FROM y""")
def distribution_rewards(s: SparkSession, d: str) -> DataFrame:
    e = X.read(s, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double")).alias("logits"))
    y = e.join(X.predictions(s, d).select("sample_id", F.when(F.col("sample_id") % 9 == 0, "odd").otherwise(F.col("true_label")).alias("label")), "sample_id")
    m = preference.distribution_reward(y, "logits", "label", X.LABELS)
    return m.select("sample_id", *[r(c, 6).alias(c) for c in ("flow_prob_true_label", "flow_entropy", "flow_overall_reward")])


@query(f"""WITH {PRED} SELECT sample_id, p[k] = list_max(p) AND list_position(p, list_max(p)) = k positive FROM pred""")
def argmax_split(s: SparkSession, d: str) -> DataFrame:
    p = X.predictions(s, d).withColumn("k", F.array_position(F.array(*map(F.lit, X.LABELS)), F.col("true_label")) - 1)
    return preference.split_by_argmax(p, "p", "k").select("sample_id", "positive")


@query(f"""WITH {TRIALS} SELECT trial, count(*) FILTER (correct) correct, count(*) FILTER (NOT correct AND sample_id % 3 > 0) incorrect FROM tr GROUP BY trial""")
def trial_summaries(s: SparkSession, d: str) -> DataFrame:
    t = _trials(s, d).select("trial", F.lit("PURCHASE").alias("target"), F.when(F.col("correct"), "purchase").otherwise("other").alias("prediction"), (F.col("sample_id") % 3 > 0).alias("finished"))
    return preference.trial_summary(t).withColumn("trial", F.col("trial").cast("long"))


# ---- alignment, labels, phases

@query(f"""WITH {RET} SELECT ticker, date, CASE WHEN stock_return > 0 THEN 'Positive' ELSE 'Negative' END sentiment, CASE WHEN stock_return <= 1e-7 THEN 0 ELSE 1 END two, CASE WHEN stock_return < -0.004 THEN 0 WHEN stock_return < 0.005 THEN 1 ELSE 2 END three FROM lab WHERE stock_return IS NOT NULL AND NOT (stock_return >= -0.005 AND stock_return < 0.0055)""")
def movement_labels(s: SparkSession, d: str) -> DataFrame:
    x = align.drop_flat(_labelled(s, d).where("stock_return IS NOT NULL"), "stock_return")
    c = F.col("stock_return")
    return x.select("ticker", "date", align.sentiment_label(c).alias("sentiment"), align.movement_class(c).alias("two"), align.movement_class(c, 3).alias("three"))


@query(f"""WITH {BARS}, x AS (SELECT ticker, date, adj_close / lag(adj_close) OVER v - 1 m, list(adj_close) OVER a p, last(adj_close) OVER b q FROM bars WINDOW v AS (PARTITION BY ticker ORDER BY date), a AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 4 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING), b AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 5 DAYS PRECEDING))
 SELECT CASE WHEN date < DATE '1999-01-01' THEN 'train' WHEN date < DATE '2000-01-01' THEN 'dev' ELSE 'test' END phase, ticker, date, round(m, 4) movement FROM x WHERE len(p) > 0 AND q IS NOT NULL AND m IS NOT NULL AND NOT (m >= -0.005 AND m < 0.0055) AND date >= DATE '1996-01-01' AND date < DATE '2001-01-01'""")
def movement_phases(s: SparkSession, d: str) -> DataFrame:
    phases = {"train": ("1996-01-01", "1999-01-01"), "dev": ("1999-01-01", "2000-01-01"), "test": ("2000-01-01", "2001-01-01")}
    return align.movement_series(X.bars(s, d), phases).withColumn("movement", r("movement"))


@query(f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) k FROM bars), sm AS (SELECT a.ticker ticker, a.date d3, b.date d2, c.date d1, a.k k FROM n a JOIN n b ON a.ticker = b.ticker AND b.k = a.k - 1 JOIN n c ON a.ticker = c.ticker AND c.k = a.k - 2 WHERE a.k % 3 = 0),
 ms AS (SELECT ticker, date_add(DATE '1995-01-02', CAST(doc_id * 7 % 60 AS INT)) d, doc_id FROM (SELECT DISTINCT p_brand ticker, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) % 25 b FROM part) JOIN documents ON doc_id % 25 = b),
 j AS (SELECT sm.ticker ticker, k, CASE WHEN d < d1 THEN d1 WHEN d < d2 THEN d2 ELSE d3 END tday, doc_id, d md FROM sm JOIN ms ON sm.ticker = ms.ticker AND d >= d1 - 20 AND d < d3), j2 AS (SELECT j.*, source, row_number() OVER (PARTITION BY ticker, k, tday ORDER BY md, 'n' || j.doc_id) rk FROM j JOIN documents USING (doc_id)), g AS (SELECT ticker, k, tday, least(count(*), 2) n_msgs, string_agg(source, '|' ORDER BY rk) FILTER (rk <= 2) msgs FROM j2 GROUP BY ALL)
 SELECT ticker, CAST(k AS BIGINT) k, CAST(tday AS DATE) date, n_msgs, msgs FROM g QUALIFY count(*) OVER (PARTITION BY ticker, k) = 3""".replace("date_add(DATE '1995-01-02', CAST(doc_id * 7 % 60 AS INT))", "DATE '1995-01-02' + CAST(doc_id * 7 % 60 AS INT)"))
def trading_day_messages(s: SparkSession, d: str) -> DataFrame:
    """Samples of three trading days that all have messages of the days before them."""
    w = align.by_ticker()
    b = X.bars(s, d).select("ticker", "date", F.row_number().over(w).cast("long").alias("k"), F.lag("date", 1).over(w).alias("d2"), F.lag("date", 2).over(w).alias("d1"))
    b = b.where("k % 3 = 0").select("ticker", F.struct("ticker", "k").alias("sample_id"), F.array("d1", "d2", "date").alias("dates"), F.date_sub("d1", 20).alias("first_day"))
    n = X.news(s, d).select("ticker", F.date_add(F.lit("1995-01-02").cast("date"), (F.substring("news_id", 2, 20).cast("long") * 7 % 60).cast("int")).alias("day"), F.col("news_id").alias("id"), F.col("source").alias("text"))
    return align.align_to_trading_days(b, n, 2).select("sample_id.ticker", "sample_id.k", "date", F.col("n_msgs").cast("long").alias("n_msgs"), F.array_join("msgs", "|").alias("msgs"))


@query("""WITH t AS (SELECT 'U' || user_id ticker, date_trunc('hour', ts) bar, first(value ORDER BY ts, event_id) o, max(value) h, min(value) l, last(value ORDER BY ts, event_id) c, count(*) n FROM events GROUP BY ALL),
 g AS (SELECT ticker, unnest(generate_series(min(bar), max(bar), INTERVAL 1 HOUR)) bar FROM t GROUP BY ticker), f AS (SELECT g.ticker ticker, g.bar bar, last_value(h IGNORE NULLS) OVER w h, last_value(l IGNORE NULLS) OVER w l, last_value(c IGNORE NULLS) OVER w c, coalesce(n, 0) n FROM g LEFT JOIN t USING (ticker, bar) WINDOW w AS (PARTITION BY ticker ORDER BY g.bar ROWS UNBOUNDED PRECEDING)),
 p AS (SELECT *, lag(c) OVER (PARTITION BY ticker ORDER BY bar) pc FROM f), r AS (SELECT *, CASE WHEN pc IS NULL THEN h - l ELSE greatest(h - l, abs(h - pc), abs(l - pc)) END tr FROM p)
 SELECT ticker, bar, round(c, 4) AS "close", n n_ticks, round(CASE WHEN count(*) OVER a = 14 THEN avg(tr) OVER a ELSE 0 END, 4) atr, CASE WHEN count(*) OVER b = 20 THEN CAST(sign(round(c - avg(c) OVER b, 9)) AS INT) ELSE 0 END trend FROM r WINDOW a AS (PARTITION BY ticker ORDER BY bar ROWS 13 PRECEDING), b AS (PARTITION BY ticker ORDER BY bar ROWS 19 PRECEDING)""")
def timeframe_features(s: SparkSession, d: str) -> DataFrame:
    t = indicators.timeframe_features(X.intraday(s, d))
    return t.select("ticker", "bar", r("close").alias("close"), "n_ticks", r("atr").alias("atr"), "trend")


# ---- token arrays

VOCAB = "vb AS (SELECT w, CAST(row_number() OVER (ORDER BY w) AS INT) id FROM (SELECT DISTINCT unnest(w) w FROM cv WHERE conv_id % 2 = 0))"


@query(f"""WITH {CONV}, {VOCAB}, t AS (SELECT conv_id, turn, unnest(w[1:12]) x, generate_subscripts(w[1:12], 1) i FROM cv) SELECT conv_id * 100 + turn k, count(*) n, CAST(sum(coalesce(id, 0) * i) AS BIGINT) checksum, count(*) FILTER (id IS NULL) n_unknown FROM t LEFT JOIN vb ON vb.w = x GROUP BY ALL""")
def vocabulary_index(s: SparkSession, d: str) -> DataFrame:
    c = _turns(s, d).withColumn("k", F.col("conv_id") * 100 + F.col("turn"))
    vocab = preference.vocabulary(c.where("conv_id % 2 = 0").select(F.explode("w").alias("word")))
    x = preference.index_tokens(c, vocab, "k", "w", 12)
    weighted = F.aggregate(F.transform("ids", lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return x.select("k", F.size("ids").cast("long").alias("n"), weighted.alias("checksum"), F.size(F.filter("ids", lambda v: v == 0)).cast("long").alias("n_unknown"))


@query(f"""WITH {CONV}, m AS (SELECT conv_id, list(list_transform(w, lambda x: CAST(length(x) AS INT)) ORDER BY turn) g FROM cv GROUP BY conv_id), x AS (SELECT conv_id, [g[1:2], g[3:4]] dd FROM m)
 SELECT conv_id, array_to_string(flatten(flatten(list_transform(dd, lambda a: list_resize(list_transform(a[1:2], lambda b: list_resize(b[1:5], 5, 0)), 2, [0, 0, 0, 0, 0])))), ' ') words, array_to_string(list_transform(dd, lambda a: least(len(a), 2)), ' ') n_msgs,
 array_to_string(flatten(list_transform(dd, lambda a: list_resize(list_transform(a[1:2], lambda b: CAST(least(len(b), 5) AS INT)), 2, 0))), ' ') n_words FROM x""")
def dense_batches(s: SparkSession, d: str) -> DataFrame:
    """Two days of two messages of five words, place by place."""
    m = _turns(s, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.transform("w", lambda x: F.length(x)).alias("g")))).alias("t"))
    g = F.transform("t", lambda x: x["g"])
    m = m.select("conv_id", F.array(F.slice(g, 1, 2), F.slice(g, 3, 2)).alias("dd"))
    b = preference.dense_batch(m, "conv_id", "dd", 2, 2, 5)
    line = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), " ")
    return b.select("conv_id", line(F.flatten(F.flatten("words"))).alias("words"), line(F.col("n_msgs")).alias("n_msgs"), line(F.flatten("n_words")).alias("n_words"))


@query(f"""WITH {CONV}, p AS (SELECT a.conv_id conv_id, a.turn turn, len(a.w) x, len(b.w) y FROM cv a JOIN cv b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn FROM p WHERE x <= 20 AND y <= 20""")
def pairs_within_length(s: SparkSession, d: str) -> DataFrame:
    t = _turns(s, d)
    p = t.select("conv_id", "turn", F.col("w").alias("chosen")).join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("rejected")), ["conv_id", "turn"])
    return preference.filter_pair_length(p, 20).select("conv_id", "turn")


@query(f"""WITH {CONV}, x AS (SELECT body, len(regexp_split_to_array(trim(body), '\\s+')) n FROM cv ORDER BY conv_id * 100 + turn LIMIT 400) SELECT round(sum(length(body)) / sum(n), 6) chars_per_token FROM x""")
def chars_per_token(s: SparkSession, d: str) -> DataFrame:
    t = _turns(s, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "body")
    return preference.chars_per_token(t, "body").select(r("chars_per_token", 6).alias("chars_per_token"))


@query(f"""WITH {CONV} SELECT conv_id, turn, md5(role || ' {{headline}}') prompt_hash, replace(role || ' ' || body, role || ' ', '') answer, lower(role) = 'user' exact FROM cv""")
def prompt_removal(s: SparkSession, d: str) -> DataFrame:
    t = _turns(s, d)
    return t.select("conv_id", "turn", F.md5(F.concat_ws(" ", "role", F.lit("{headline}"))).alias("prompt_hash"), T.strip_prompt(F.concat_ws(" ", "role", "body"), F.concat(F.col("role"), F.lit(" "))).alias("answer"), T.exact_match(F.col("role"), F.lit("USER")).alias("exact"))


@query("""WITH x AS (SELECT CAST(user_id % 7 AS BIGINT) k, CAST(event_id AS BIGINT) id, CAST(value AS DOUBLE) v, event_id % 3 b FROM events), w AS (SELECT avg(v) m, stddev_pop(v) s FROM x WHERE b = 2), h AS (SELECT k, id, v, row_number() OVER (PARTITION BY k ORDER BY b DESC, id DESC) rn FROM x),
 q AS (SELECT k, count(*) n, avg(v) m, stddev_pop(v) s FROM h WHERE rn <= 32 GROUP BY k) SELECT x.k AS "key", id, round((v - CASE WHEN n < 16 THEN w.m ELSE q.m END) / (CASE WHEN n < 16 THEN w.s ELSE q.s END + 1e-6), 6) advantage FROM x JOIN q ON x.k = q.k CROSS JOIN w WHERE b = 2""")
def buffered_advantages(s: SparkSession, d: str) -> DataFrame:
    """Three batches one after another; the last one's advantages against what the keys' buffers hold."""
    e = X.read(s, d, "events").select((F.col("user_id") % 7).cast("long").alias("key"), F.col("event_id").cast("long").alias("id"), F.col("value").cast("double").alias("reward"))
    held = s.createDataFrame([], "key long, held array<double>")
    out = None
    for b in range(3):
        out, held = streams.buffered_advantage(e.where(F.col("id") % 3 == b), held)
    return out.withColumn("advantage", r("advantage", 6))


@query("""SELECT doc_id, coalesce(length("text"), 0) >= 200 long_enough, substr("text", 1, 50) cut FROM documents""")
def length_flags(s: SparkSession, d: str) -> DataFrame:
    x = X.read(s, d, "documents")
    long_enough = clean.length_filter(x, "text", 200).select("doc_id", F.lit(True).alias("f"))
    return x.join(long_enough, "doc_id", "left").select("doc_id", F.coalesce("f", F.lit(False)).alias("long_enough"), clean.truncate_text(F.col("text"), 50).alias("cut"))

