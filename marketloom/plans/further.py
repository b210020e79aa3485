"""Registered queries of the operators that reshape preference data, judge, clean and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, backtest, clean, indicators, metrics, models, preference
from ..streaming import streams
from . import fixtures as X
from .more import CONV, SEQ, _sequences, _turns
from .queries import BARS, CAND, LOGP, MARKET, NEWS, PRED, TRIALS, _trials, query, r

IDS = "ids AS (SELECT vec_id, list_transform(embedding[1:12], lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 40) AS INT) % 4) ids FROM embeddings)"


def _ids(s: SparkSession, d: str) -> DataFrame:
    ids = F.transform(F.slice("embedding", 1, 12), lambda x: F.floor(F.abs(x.cast("double")) * 40).cast("int") % 4)
    return X.read(s, d, "embeddings").select("vec_id", ids.alias("ids"))


def joined(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), " ")


# ---- arrays of token ids


@query(f"""WITH {IDS}, x AS (SELECT *, list_max(list_filter(range(1, 12), lambda i: ids[i] = 1 AND ids[i + 1] = 2)) pos,
  list_filter(range(0, 12), lambda i: ids[i + 1] = 3) h, list_transform(list_filter(range(0, 11), lambda i: ids[i + 1] = 1 AND ids[i + 2] = 2), lambda i: i + 2) e FROM ids),
 y AS (SELECT *, CASE WHEN h[1] > e[1] THEN list_prepend(0, h) ELSE h END g FROM x)
 SELECT vec_id, array_to_string(list_transform(ids, lambda v, i: CASE WHEN pos IS NULL OR i <= pos + 1 THEN -100 ELSE v END), ' ') last_answer,
  array_to_string(list_transform(ids, lambda v, i: CASE WHEN len(g) = 0 OR len(e) = 0 THEN -100
   WHEN len(list_filter(range(1, least(len(g), len(e)) + 1), lambda j: (CASE WHEN j = 1 THEN 0 ELSE g[j] END) < i AND i <= e[j])) > 0 THEN -100
   WHEN len(e) < len(g) AND i > g[len(g)] THEN -100 ELSE v END), ' ') all_answers FROM y""")
def template_masks(s: SparkSession, d: str) -> DataFrame:
    """Labels after the last response template, and in all responses of several turns."""
    ids = F.col("ids")
    return _ids(s, d).select("vec_id", joined(preference.mask_by_template(ids, [1, 2])).alias("last_answer"), joined(preference.mask_turns(ids, [3], [1, 2])).alias("all_answers"))


@query(f"""WITH {IDS}, x AS (SELECT *, CASE WHEN ids[1] = 0 THEN ids[1:8] ELSE list_prepend(0, ids[1:8]) END p FROM ids)
 SELECT vec_id, array_to_string(list_concat(p[-5:], list_append(ids[9:10 + vec_id % 3], 3)[1:3]), ' ') shaped, array_to_string(list_transform(ids, lambda v, i: CASE WHEN i <= 5 THEN -100 ELSE v END), ' ') labels,
  array_to_string(list_concat([9, 9, 9], ids), ' ') padded_left, array_to_string(list_concat(ids, [9, 9, 9]), ' ') padded_right, coalesce(list_min(list_filter(range(1, 13), lambda i: ids[i] = 2)) - 1, 12) first_two,
  array_to_string(list_transform(ids, lambda v, i: CASE WHEN i > coalesce(list_min(list_filter(range(1, 13), lambda j: ids[j] = 2)), 99) THEN -1 ELSE v END), ' ') stopped FROM x""")
def token_shapes(s: SparkSession, d: str) -> DataFrame:
    i = F.col("ids")
    answer = F.slice(i, F.lit(9), (F.col("vec_id") % 3 + 2).cast("int"))
    return _ids(s, d).select(
        "vec_id", joined(preference.shape_tokens(F.slice(i, 1, 8), answer, 0, 3, 5, 3)).alias("shaped"), joined(preference.mask_prompt(i, F.lit(5))).alias("labels"),
        joined(preference.pad(i, 15, 9, "left")).alias("padded_left"), joined(preference.pad(i, 15, 9)).alias("padded_right"),
        preference.first_true(F.transform(i, lambda v: v == 2)).cast("long").alias("first_two"), joined(preference.truncate_after(i, 2, -1)).alias("stopped"),
    )


def _shaped_sql(mode: str) -> str:
    cut = "p[1:4]" if mode == "start" else "p[-4:]"
    return f"""SELECT '{mode}' AS "mode", vec_id, CASE WHEN len(p) + len(a) > room THEN {cut} ELSE p END p, a, room FROM x"""


@query(f"""WITH {IDS}, w AS (SELECT vec_id, ids[1:1 + vec_id % 8] p, ids[9:9 + vec_id % 4] a FROM ids),
 x AS (SELECT *, 9 - CASE WHEN p[1] <> 0 THEN 1 ELSE 0 END - CASE WHEN a[len(a)] <> 3 THEN 1 ELSE 0 END room FROM w), y AS ({_shaped_sql('start')} UNION ALL {_shaped_sql('end')}),
 z AS (SELECT "mode", vec_id, CASE WHEN p[1] = 0 THEN p ELSE list_prepend(0, p) END p, CASE WHEN len(p) + len(a) > room THEN a[1:greatest(room - 4, 0)] ELSE a END a FROM y),
 f AS (SELECT "mode", vec_id, p, list_concat(p, CASE WHEN coalesce(a[len(a)], -1) = 3 THEN a ELSE list_append(a, 3) END) c FROM z)
 SELECT "mode", vec_id, array_to_string(p, ' ') prompt, array_to_string(c, ' ') completion, array_to_string(list_transform(c, lambda v, i: CASE WHEN i <= len(p) THEN -100 ELSE v END), ' ') labels FROM f""")
def token_sequences(s: SparkSession, d: str) -> DataFrame:
    """Prompt and answer in one sequence of at most 9 ids, by either way of cutting the prompt."""
    x = _ids(s, d).withColumns({"p": F.slice("ids", F.lit(1), (F.col("vec_id") % 8 + 1).cast("int")), "a": F.slice("ids", F.lit(9), (F.col("vec_id") % 4 + 1).cast("int"))})
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), preference.shape_sequence(F.col("p"), F.col("a"), 0, 3, 9, 4, f"keep_{m}").alias("t")) for m in ("start", "end")])
    x = x.select("vec_id", F.explode(modes).alias("m"))
    return x.select("m.mode", "vec_id", *[joined(F.col(f"m.t.{c}")).alias(c) for c in ("prompt", "completion", "labels")])


# ---- preference data


@query(f"""WITH {CAND}, p AS (SELECT a.sample_id, a.candidate_id c, b.candidate_id r FROM cand a JOIN cand b ON a.sample_id = b.sample_id AND a.reward - b.reward >= 0.1)
 SELECT sample_id, c completion, true AS label FROM p UNION ALL SELECT sample_id, r, false FROM p""")
def unpaired_rows(s: SparkSession, d: str) -> DataFrame:
    return preference.unpair(preference.preference_pairs(X.candidates(s, d)).drop("margin"))


@query(f"""WITH {CONV}, x AS (SELECT conv_id, turn, w, CAST(len(w) // 2 + 1 AS INT) pos FROM cv), y AS (SELECT *, list_concat(w[1:pos - 1], ['zz'], w[pos + 1:]) v FROM x),
 z AS (SELECT *, CASE WHEN w[pos] = 'zz' THEN len(w) - 1 ELSE pos - 1 END n FROM y)
 SELECT conv_id, turn, md5(array_to_string(w[1:n], ' ')) prompt, md5(array_to_string(w[n + 1:], ' ')) chosen, md5(array_to_string(v[n + 1:], ' ')) rejected FROM z""")
def implicit_prompts(s: SparkSession, d: str) -> DataFrame:
    """Two answers that differ from one word on: what stands before it is their prompt."""
    at = F.floor(F.size("w") / 2).cast("int")
    x = _turns(s, d).select("conv_id", "turn", F.col("w").alias("chosen"), F.transform("w", lambda v, i: F.when(i == at, "zz").otherwise(v)).alias("rejected"))
    return preference.extract_prompt(x).select("conv_id", "turn", *[F.md5(F.array_join(c, " ")).alias(c) for c in ("prompt", "chosen", "rejected")])


@query(f"""WITH {CONV} SELECT conv_id, turn, md5(coalesce(lag(body) OVER (PARTITION BY conv_id ORDER BY turn), last_value(body) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) kl_md5 FROM cv""")
def rotated_completions(s: SparkSession, d: str) -> DataFrame:
    return preference.rotate_completions(_turns(s, d), "conv_id", "turn", "body").select("conv_id", "turn", F.md5("kl_completion").alias("kl_md5"))


@query("""WITH x AS (SELECT greatest(count(*) FILTER (quality = 1), 1) d, greatest(count(*) - greatest(count(*) FILTER (quality = 1), 1), 1) u FROM labels)
 SELECT d desirable, u undesirable, round(u / d, 2) least_weight, round(u / d * 1.33, 2) most_weight, round(d / u / 1.33, 2) least_undesirable, round(d / u, 2) most_undesirable FROM x""")
def balance_weights(s: SparkSession, d: str) -> DataFrame:
    x = preference.balance_weights(X.read(s, d, "labels").withColumn("good", F.coalesce(F.col("quality") == 1, F.lit(False))), "good")
    return x.withColumns({c: F.col(c).cast("long") for c in ("desirable", "undesirable")})


@query("""SELECT vec_id AS "key/id", label AS "key/more/label", CAST(embedding[1] AS DOUBLE) first FROM embeddings""")
def flat_structs(s: SparkSession, d: str) -> DataFrame:
    e = X.read(s, d, "embeddings")
    nested = F.struct(F.col("vec_id").alias("id"), F.struct("label").alias("more")).alias("key")
    return preference.flatten_struct(e.select(nested, F.col("embedding")[0].cast("double").alias("first")))


@query(f"""WITH {TRIALS} SELECT sample_id, response FROM tr WHERE trial = 0 AND correct""")
def first_demonstrations(s: SparkSession, d: str) -> DataFrame:
    return preference.demonstrations(_trials(s, d))


# ---- judges and rewards

_UNIT = "((CAST('0x' || substr(md5(concat_ws(':', vec_id, 42, {0})), 1, 13) AS BIGINT) + 0.5::DOUBLE) / pow(2.0::DOUBLE, 52))"


@query(f"""WITH {SEQ}, x AS (SELECT vec_id, rw, {_UNIT.format("'t'")} t, list_transform([0, 1, 2, 3, 4, 5], lambda i: 0.5 * sqrt(-2 * ln({_UNIT.format("'a' || i")})) * cos(2 * pi() * {_UNIT.format("'b' || i")})) z0 FROM sq)
 SELECT vec_id, round(t, 6) t, round(z0[1], 5) z0_first, round(z0[6], 5) z0_last, round(t * rw[6] + (1 - t) * z0[6], 5) zt_last, round(rw[6] - z0[6], 5) v_last FROM x""")
def flow_triples(s: SparkSession, d: str) -> DataFrame:
    x = _sequences(s, d).select("vec_id", F.col("rw").alias("z1"), F.lit(0.5).alias("sigma"))
    x = preference.flow_pairs(x, ["vec_id"])
    return x.select("vec_id", r("t", 6).alias("t"), r(F.col("z0")[0], 5).alias("z0_first"), r(F.col("z0")[5], 5).alias("z0_last"), r(F.col("zt")[5], 5).alias("zt_last"), r(F.col("v")[5], 5).alias("v_last"))


@query(f"""WITH {SEQ}, x AS (SELECT unnest(rw) z, unnest([0, 1, 2, 3, 4, 5]) i FROM sq) SELECT i, round(avg(z), 6) mean, round(var_pop(z), 6) mse FROM x GROUP BY i""")
def flow_means(s: SparkSession, d: str) -> DataFrame:
    return preference.flow_baseline(_sequences(s, d), "rw").select("i", r("mean", 6).alias("mean"), r("mse", 6).alias("mse"))


JUDGED = """jd AS (SELECT vec_id pair_id, CAST(label % 3 AS INT) - 1 rank, CAST('0x' || substr(md5(vec_id || ':42'), 1, 1) AS INT) % 2 = 1 flipped FROM embeddings)"""


def _judged(s: SparkSession, d: str) -> DataFrame:
    return preference.pairwise_results(X.read(s, d, "embeddings").select(F.col("vec_id").alias("pair_id"), (F.col("label") % 3 - 1).cast("int").alias("rank")))


@query(f"WITH {JUDGED} SELECT pair_id, flipped, CASE WHEN flipped THEN 1 - rank ELSE rank END winner FROM jd")
def pairwise_judgements(s: SparkSession, d: str) -> DataFrame:
    return _judged(s, d).select("pair_id", "flipped", "winner")


@query(f"WITH {JUDGED} SELECT round(avg(CASE WHEN (CASE WHEN flipped THEN 1 - rank ELSE rank END) = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) win_rate, count(*) n FROM jd")
def pairwise_win_rate(s: SparkSession, d: str) -> DataFrame:
    return preference.win_rate(_judged(s, d)).select(r("win_rate", 6).alias("win_rate"), "n")


@query(f"WITH {LOGP}, x AS (SELECT pair_id, 1 / (1 + exp((r - c) / 2.0)) p FROM logp) SELECT pair_id, round(p, 6) p, CASE WHEN p > 0.5 THEN 0 ELSE 1 END winner FROM x")
def soft_judgements(s: SparkSession, d: str) -> DataFrame:
    p = preference.soft_win(F.col("c"), F.col("r"), 2.0)
    return X.logps(s, d).select("pair_id", p.alias("p")).select("pair_id", r("p", 6).alias("p"), F.when(F.col("p") > 0.5, 0).otherwise(1).alias("winner"))


@query("""WITH x AS (SELECT vec_id, [CASE WHEN vec_id % 7 = 0 THEN -1 ELSE 1 END, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE 1 END] v FROM embeddings)
 SELECT vec_id, CASE WHEN list_min(v) = -1 THEN -1 WHEN list_min(v) = 1 THEN 1 ELSE 0 END verdict FROM x""")
def mixed_judgements(s: SparkSession, d: str) -> DataFrame:
    vote = lambda k, bad: F.when(F.col("vec_id") % k == 0, bad).otherwise(1)
    return X.read(s, d, "embeddings").select("vec_id", preference.all_true(F.array(vote(7, -1), vote(3, 0), vote(5, 0))).alias("verdict"))


@query(f"""WITH {PRED}, x AS (SELECT sample_id // 4 seq_id, sample_id % 4 step, p[k] q, true_label = pred_label ok FROM pred), y AS (SELECT *, lag(q) OVER w b, lead(step) OVER w nx FROM x WINDOW w AS (PARTITION BY seq_id ORDER BY step))
 SELECT seq_id, step, round(coalesce(q - b, 0) + CASE WHEN nx IS NOT NULL THEN 0 WHEN ok THEN 1 ELSE -1 END, 6) reward FROM y""")
def dense_rewards(s: SparkSession, d: str) -> DataFrame:
    true = F.element_at("p", F.array_position(F.array(*map(F.lit, X.LABELS)), F.col("true_label")).cast("int"))
    x = X.predictions(s, d).select(F.floor(F.col("sample_id") / 4).alias("seq_id"), (F.col("sample_id") % 4).alias("step"), true.alias("p"), (F.col("true_label") == F.col("pred_label")).alias("ok"))
    return preference.dense_reward(x, F.when(F.col("ok"), 1.0).otherwise(-1.0)).select("seq_id", "step", r("reward", 6).alias("reward"))


@query(f"""WITH {LOGP} SELECT pair_id, round(CASE pair_id % 3 WHEN 0 THEN -c WHEN 1 THEN -2 * abs(c) + 4 ELSE c END, 6) reward FROM logp""")
def control_rewards(s: SparkSession, d: str) -> DataFrame:
    task = F.element_at(F.array(*map(F.lit, ("[negative]", "[neutral]", "[positive]"))), (F.col("pair_id") % 3 + 1).cast("int"))
    return X.logps(s, d).select("pair_id", r(preference.control_reward(task, F.col("c")), 6).alias("reward"))


@query(f"""WITH {PRED} SELECT sample_id, round(least(greatest(2 * (0.4 * p[1] + 0.2 * p[2] + 0.15 * p[3] - 0.15 * 20 * p[4] + 0.1 * p[5] + 0.1 * stock_return * 100), 0), 1), 6) score FROM pred""")
def proxy_scores(s: SparkSession, d: str) -> DataFrame:
    p = [2 * F.col("p")[i] for i in range(5)]
    return X.predictions(s, d).select("sample_id", r(preference.overall_proxy(p[0], p[1], p[2], 20 * p[3], p[4], 200 * F.col("stock_return")), 6).alias("score"))


# ---- metrics


@query(f"""WITH {PRED}, x AS (SELECT stock_return > 0 t, p[4] + p[5] > p[1] + p[2] h FROM pred), y AS (SELECT CAST(count(*) FILTER (t AND h) AS DOUBLE) tp, CAST(count(*) FILTER (NOT t AND h) AS DOUBLE) fp, CAST(count(*) FILTER (NOT t AND NOT h) AS DOUBLE) tn, CAST(count(*) FILTER (t AND NOT h) AS DOUBLE) fn FROM x)
 SELECT *, round((tp * tn - fp * fn) / sqrt(nullif((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn), 0)), 6) mcc FROM y""")
def binary_movements(s: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    return metrics.binary_mcc(X.predictions(s, d), F.col("stock_return") > 0, p[3] + p[4] > p[0] + p[1]).withColumn("mcc", r("mcc", 6))


@query(f"WITH {PRED} SELECT round(avg(p[1]), 6) mean_entailment, round(avg(2 * p[5]), 6) mean_contradiction, round(avg(CASE WHEN 2 * p[5] > 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) hallucination_rate FROM pred")
def grounding_summary(s: SparkSession, d: str) -> DataFrame:
    m = metrics.grounding_metrics(X.predictions(s, d).select(F.col("p")[0].alias("e"), (2 * F.col("p")[4]).alias("c")), "e", "c")
    return m.select(*[r(c, 6).alias(c) for c in m.columns])


@query(f"WITH {LOGP} SELECT pair_id, round(ln(1 + exp(-(c - r - 0.5))) + 0.01 * pow(c + r, 2), 6) loss, round(ln(1 + exp(-(c - r - (c0 - r0)))), 6) margin_loss FROM logp")
def reward_losses(s: SparkSession, d: str) -> DataFrame:
    c, x = F.col("c"), F.col("r")
    return X.logps(s, d).select("pair_id", r(metrics.reward_loss(c, x, 0.5, 0.01), 6).alias("loss"), r(metrics.reward_loss(c, x, F.col("c0") - F.col("r0")), 6).alias("margin_loss"))


@query(f"""WITH {SEQ}, x AS (SELECT vec_id, rw, vl, list_sum(list_transform(rw, lambda v: exp(v))) t FROM sq) SELECT vec_id, round(-list_sum(list_transform(rw, lambda v: exp(v) / t * ln(exp(v) / t))), 6) entropy,
 round(least(1, exp(10 * list_avg(rw[1:2 + vec_id % 4]) + 10 * list_avg(vl[1:2 + vec_id % 4]))), 6) weight FROM x""")
def entropy_and_weights(s: SparkSession, d: str) -> DataFrame:
    """Entropy of logits, and the weight of a pair from the masked means of both sides."""
    mask = F.transform("rw", lambda v, i: i < F.col("vec_id") % 4 + 2)
    ten = lambda c: F.transform(c, lambda v: v * 10)
    x = _sequences(s, d)
    return x.select("vec_id", r(metrics.logits_entropy(F.col("rw")), 6).alias("entropy"), r(metrics.wpo_weight(metrics.masked_mean(ten("rw"), mask), metrics.masked_mean(ten("vl"), mask)), 6).alias("weight"))


@query(f"WITH {LOGP}, t AS (SELECT avg(c) m, stddev_pop(c) s FROM logp WHERE pair_id % 5 <> 0 AND pair_id % 13 <> 0) SELECT pair_id, CASE WHEN pair_id % 13 = 0 THEN 0.0::DOUBLE ELSE round((c - m) / (s + 1e-8), 6) END c FROM logp, t")
def standardised(s: SparkSession, d: str) -> DataFrame:
    x = X.logps(s, d).withColumn("c", F.when(F.col("pair_id") % 13 != 0, F.col("c")))
    return models.standardize(x.where("pair_id % 5 <> 0"), x, ["c"]).select("pair_id", r("c", 6).alias("c"))


@query("""SELECT vec_id, CASE WHEN label % 5 = 0 THEN 1.0::DOUBLE ELSE 0 END regime_a, CASE WHEN label % 5 = 1 THEN 1.0::DOUBLE ELSE 0 END regime_b FROM embeddings""")
def dummy_columns(s: SparkSession, d: str) -> DataFrame:
    x = X.read(s, d, "embeddings").select("vec_id", F.when(F.col("label") % 5 == 0, "a").when(F.col("label") % 5 == 1, "b").otherwise("c").alias("regime"))
    return models.dummies(x, "regime", ("a", "b")).drop("regime")


_BY = """m AS (SELECT true_label AS "method", avg(CASE WHEN pred_label = true_label THEN 1.0::DOUBLE ELSE 0 END) a, avg(stock_return) b FROM pred GROUP BY 1)"""


def _by_method(s: SparkSession, d: str) -> DataFrame:
    hit = (F.col("pred_label") == F.col("true_label")).cast("double")
    return X.predictions(s, d).groupBy(F.col("true_label").alias("method")).agg(F.avg(hit).alias("a"), F.avg("stock_return").alias("b"))


@query(f"""WITH {PRED}, {_BY} SELECT "method", round(a, 4) accuracy, round(b, 4) f1, CASE WHEN "method" LIKE '%Up' THEN round(b, 4) END mcc, "method" NOT LIKE '%Up' mcc_missing FROM m""")
def method_table(s: SparkSession, d: str) -> DataFrame:
    """accuracy by its own name, f1 by its spare one, mcc for some methods only."""
    m = _by_method(s, d)
    x = m.select("method", F.explode(F.array(F.struct(F.lit("accuracy").alias("metric"), F.col("a").alias("value")), F.struct(F.lit("test_f1").alias("metric"), F.col("b").alias("value")), F.struct(F.lit("mcc").alias("metric"), F.when(F.col("method").endswith("Up"), F.col("b")).alias("value")))).alias("x")).select("method", "x.*")
    t = backtest.metrics_table(x, "method", "metric", "value", ("accuracy", "f1", "mcc"), {"accuracy": "test_accuracy", "f1": "test_f1"})
    return t.select("method", *[F.col(c).try_cast("double").alias(c) for c in ("accuracy", "f1", "mcc")], (F.col("mcc") == "N/A").alias("mcc_missing"))


@query(f"""WITH {PRED}, {_BY} SELECT CAST(row_number() OVER (ORDER BY "method") + 1 AS INT) n, '| ' || "method" || ' | ' || printf('%.4f', a) || ' | ' || printf('%.4f', b) || ' |' line FROM m
 UNION ALL SELECT 0, '| Model | Accuracy | Return |' UNION ALL SELECT 1, '|-------|----------|--------|'""")
def method_report(s: SparkSession, d: str) -> DataFrame:
    return backtest.markdown_table(_by_method(s, d), "method", {"a": "Accuracy", "b": "Return"})


@query(f"""WITH {MARKET}, x AS (SELECT ticker, date, count(*) OVER w n, avg(g) OVER w ag, avg(f) OVER w af FROM b1 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING)),
 y AS (SELECT avg(CASE WHEN n = 14 AND ag + af > 0 THEN 1.0::DOUBLE ELSE 0 END) > 0.95 a FROM x), t AS (SELECT avg(CASE WHEN ret_20d IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) > 0.95 b FROM b0), z AS (SELECT count(DISTINCT CASE WHEN rk <= 0.33 THEN 'l' WHEN rk >= 0.66 THEN 'h' ELSE 'n' END) >= 2 c FROM market)
 SELECT unnest(['rsi', 'tokens', 'regimes']) AS "check", CASE WHEN unnest([a, b, c]) THEN 'PASS' ELSE 'FAIL' END status FROM y, t, z""")
def feature_gates(s: SparkSession, d: str) -> DataFrame:
    """Tokens count as missing before a ticker has a month of returns."""
    f = indicators.features(X.bars(s, d)).withColumn("technical_event_tokens", F.when(F.col("ret_20d").isNotNull(), F.col("technical_event_tokens")))
    return backtest.quality_gates(f, backtest.feature_gates())


@query(f"""WITH {PRED}, x AS (SELECT count(*) >= 5000 a, count(DISTINCT true_label) >= 3 b, count(*) = count(DISTINCT sample_id) c, avg(CASE WHEN sample_id % 10 <> 0 THEN 1.0::DOUBLE ELSE 0 END) > 0.95 d FROM pred)
 SELECT unnest(['samples', 'classes', 'unique', 'returns']) AS "check", CASE WHEN unnest([a, b, c, d]) THEN 'PASS' ELSE 'FAIL' END status FROM x""")
def sample_gates(s: SparkSession, d: str) -> DataFrame:
    """Every tenth return is missing, so that one gate fails."""
    p = X.predictions(s, d).withColumn("stock_return", F.when(F.col("sample_id") % 10 != 0, F.col("stock_return")))
    return backtest.quality_gates(p, backtest.sample_gates(label="true_label", change="stock_return"))


@query("""SELECT 'test_' || user_id % 7 || '.py' file, count(*) tests, count(*) FILTER (event_type = 'error') failed FROM events GROUP BY 1""")
def test_log_summary(s: SparkSession, d: str) -> DataFrame:
    e = X.read(s, d, "events")
    node = F.concat(F.lit("test_"), (F.col("user_id") % 7).cast("string"), F.lit(".py::case_"), F.col("event_id").cast("string"))
    return backtest.log_rollup(e.select(node.alias("nodeid"), F.when(F.col("event_type") == "error", "failed").otherwise("passed").alias("outcome")))


@query("""SELECT count("value") n, round(avg("value"), 6) mean, round(var_pop("value"), 6) var FROM events""")
def running_moments(s: SparkSession, d: str) -> DataFrame:
    """The streaming aggregate on a table."""
    return streams.running_moments(X.read(s, d, "events"), "value").select("n", r("mean", 6).alias("mean"), r("var", 6).alias("var"))


@query("""WITH RECURSIVE b AS (SELECT user_id % 40 batch_id, avg("value") kl, count(*) n FROM events GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY batch_id) k FROM b),
 f AS (SELECT 0::BIGINT k, 0.05::DOUBLE v UNION ALL SELECT o.k, v * (1 + least(greatest(kl / 6 - 1, -0.2), 0.2) * n / 10000) FROM f JOIN o ON o.k = f.k + 1) SELECT round(v, 8) coefficient FROM f ORDER BY k DESC LIMIT 1""")
def adaptive_coefficient(s: SparkSession, d: str) -> DataFrame:
    b = X.read(s, d, "events").groupBy((F.col("user_id") % 40).alias("batch_id")).agg(F.avg("value").alias("kl"), F.count(F.lit(1)).alias("n"))
    return streams.adaptive_coefficient(b).select(r("coefficient", 8).alias("coefficient"))


# ---- cleaning and alignment


@query("""SELECT 'T' || doc_id % 9 ticker, md5("text") body_md5, TIMESTAMP '2020-01-01' + to_days(CAST(doc_id % 300 AS INT)) timestamp_utc, source, true AS no_author FROM documents""")
def normalised_news(s: SparkSession, d: str) -> DataFrame:
    """News under other column names, without a body, author or url."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).cast("string")
    raw = X.read(s, d, "documents").select(F.concat(F.lit("T"), (F.col("doc_id") % 9).cast("string")).alias("Stock_Symbol"), day.alias("Date"), F.col("text").alias("Article_Title"), F.col("source").alias("Publisher"))
    n, _ = clean.normalize_news(raw)
    return n.select("ticker", F.md5("body").alias("body_md5"), "timestamp_utc", "source", F.col("author").isNull().alias("no_author"))


@query(f"""WITH {BARS} SELECT ticker, date, round("close", 9) adj_close FROM bars WHERE volume % 11 <> 0 AND volume % 7 <> 0 AND volume % 13 <> 0""")
def clean_price_rows(s: SparkSession, d: str) -> DataFrame:
    """Prices under other names; every row with a bad close, volume or date goes."""
    v = F.col("volume")
    raw = X.bars(s, d).select(
        F.col("ticker").alias("Symbol"), F.when(v % 13 == 0, "no day").otherwise(F.col("date").cast("string")).alias("Day"), "open", "high", "low",
        F.when(v % 11 == 0, -F.col("close")).otherwise(F.col("close")).alias("Close"), F.when(v % 7 == 0, -v - 1).otherwise(v).alias("Vol"),
    )
    p, _ = clean.normalize_prices(raw)
    return clean.clean_prices(p).select("ticker", "date", r("adj_close", 9).alias("adj_close"))


@query("""SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN '' ELSE 'n' END note, CASE WHEN vec_id % 3 = 0 THEN 0.0::DOUBLE ELSE CAST(embedding[1] AS DOUBLE) END x, CASE WHEN vec_id % 5 = 0 THEN 0.33::DOUBLE ELSE CAST(embedding[2] AS DOUBLE) END p FROM embeddings""")
def filled_groups(s: SparkSession, d: str) -> DataFrame:
    i, e = F.col("vec_id"), F.col("embedding")
    x = X.read(s, d, "embeddings").select("vec_id", F.when(i % 2 != 0, "n").alias("note"), F.when(i % 3 != 0, e[0].cast("double")).alias("x"), F.when(i % 5 != 0, e[1].cast("double")).alias("p"))
    return clean.fill_groups(x, ("note",), ("x",), ("p",))


@query(f"""WITH {BARS}, x AS (SELECT ticker, date, CASE WHEN volume % 3 > 0 THEN "close" END c FROM bars) SELECT ticker, date, round(last_value(c IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 9) c FROM x""")
def forward_filled(s: SparkSession, d: str) -> DataFrame:
    x = X.bars(s, d).select("ticker", "date", F.when(F.col("volume") % 3 > 0, F.col("close")).alias("c"))
    return indicators.forward_fill(x, ["c"]).select("ticker", "date", r("c", 9).alias("c"))


@query(f"""WITH {BARS}, {NEWS}, m AS (SELECT ticker, CAST(timestamp_utc AS DATE) AS "day", news_id id, md5(body) t FROM news)
 SELECT b.ticker, b.date, count(*) n, md5(string_agg(t, ' ' ORDER BY "day", id)) texts_md5 FROM bars b JOIN m ON b.ticker = m.ticker AND "day" BETWEEN b.date - 5 AND b.date - 1 GROUP BY ALL""")
def lookback_messages(s: SparkSession, d: str) -> DataFrame:
    """Messages of the five calendar days before each bar, by the digests of their whole texts."""
    m = X.news(s, d).select("ticker", F.to_date("timestamp_utc").alias("day"), F.col("news_id").alias("id"), F.md5("body").alias("text"))
    x = align.lookback(X.bars(s, d).select("ticker", "date"), m, 5)
    return x.select("ticker", "date", F.size("texts").cast("long").alias("n"), F.md5(F.array_join("texts", " ")).alias("texts_md5"))


@query(f"""WITH {LOGP}, {CAND} SELECT pair_id, round(c, 6) c, round(reward, 6) reward FROM logp JOIN cand ON pair_id = sample_id * 4 + candidate_id""")
def zipped_columns(s: SparkSession, d: str) -> DataFrame:
    b = X.candidates(s, d).select((F.col("sample_id") * 4 + F.col("candidate_id")).alias("pair_id"), "reward", F.lit(0).alias("c"))
    return align.zip_columns(X.logps(s, d), b, "pair_id").select("pair_id", r("c", 6).alias("c"), r("reward", 6).alias("reward"))


@query(f"""WITH {BARS}, x AS (SELECT ticker, date, "close" / lag("close") OVER w - 1 m, lead("close") OVER w - "close" f FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))
 SELECT ticker, date, CASE WHEN m > 0 THEN 'Positive' ELSE 'Negative' END sentiment, sign(f) + 1 trend FROM x WHERE m IS NOT NULL AND NOT (m >= -0.005 AND m < 0.0055)""")
def trend_labels(s: SparkSession, d: str) -> DataFrame:
    """Sentiment of each move that is not flat, and the class of the next one."""
    w = indicators.by_ticker()
    x = X.bars(s, d).select("ticker", "date", (F.try_divide("close", F.lag("close").over(w)) - 1).alias("m"), indicators.trend_class().alias("trend"))
    return align.drop_flat(x.where("m IS NOT NULL"), "m").select("ticker", "date", align.sentiment_label(F.col("m")).alias("sentiment"), "trend")


@query("""SELECT doc_id FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 50""")
def seeded_sample(s: SparkSession, d: str) -> DataFrame:
    return align.sample_n(X.read(s, d, "documents").select("doc_id"), 50, "doc_id")


@query(f"""WITH {BARS}, x AS (SELECT ticker, date, row_number() OVER (ORDER BY date, ticker) k FROM bars) SELECT ticker, date FROM x WHERE k > (SELECT CAST(floor(count(*) * 0.85::DOUBLE) AS BIGINT) FROM bars)""")
def latest_rows_from_start(s: SparkSession, d: str) -> DataFrame:
    return align.latest_fraction(X.bars(s, d).select("ticker", "date"), 0.15, "date", "ticker", before=0.85).select("ticker", "date")


@query(f"""WITH {BARS} SELECT DISTINCT ticker, 0::BIGINT n_news FROM bars WHERE ticker IN ('Brand#11', 'Brand#22')""")
def fallback_universe(s: SparkSession, d: str) -> DataFrame:
    """No ticker has both news and prices: those of the fallback that have prices."""
    news = X.news(s, d).withColumn("ticker", F.concat("ticker", F.lit("?")))
    return clean.select_universe(news, X.bars(s, d), 10, ("Brand#11", "Brand#22", "Brand#00"))


@query(f"""WITH {BARS}, y AS (SELECT max(year(date)) - 2 a FROM bars) SELECT year(date) AS "year", count(*) n FROM bars WHERE year(date) >= (SELECT max(a.y) - 2 FROM (SELECT DISTINCT year(date) y FROM bars) a WHERE a.y - 1 IN (SELECT year(date) FROM bars) AND a.y - 2 IN (SELECT year(date) FROM bars))
 AND year(date) <= (SELECT max(a.y) FROM (SELECT DISTINCT year(date) y FROM bars) a WHERE a.y - 1 IN (SELECT year(date) FROM bars) AND a.y - 2 IN (SELECT year(date) FROM bars)) GROUP BY 1""")
def year_range(s: SparkSession, d: str) -> DataFrame:
    """The wanted years have no rows: the latest three without a gap."""
    x = clean.select_years(X.bars(s, d), "date", 2018, 2023)
    return x.groupBy(F.year("date").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))


# ---- texts


@query(f"""WITH {CONV} SELECT conv_id * 100 + turn k, md5("role") answer FROM cv WHERE conv_id * 100 + turn > (SELECT min(conv_id * 100 + turn) FROM cv)""")
def extracted_answers(s: SparkSession, d: str) -> DataFrame:
    x = _turns(s, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), F.concat(F.replace("body", F.lit("#### "), F.lit("")), F.lit("#### "), "role").alias("text"))
    return clean.answer_rows(x, "text", "k").select("k", F.md5("answer").alias("answer"))


@query("""SELECT vec_id, CAST(CASE WHEN vec_id % 5 = 0 THEN 0 ELSE vec_id % 4 END AS INT) n_valid FROM embeddings""")
def batch_answers(s: SparkSession, d: str) -> DataFrame:
    """Lists of answers, fenced, with one that lacks a key; every fifth is cut off."""
    i = F.col("vec_id")
    good = F.array_repeat(F.lit('{"id": 1, "label": "Neutral"}'), (i % 4).cast("int"))
    body = F.concat(F.lit("```json\n["), F.array_join(F.concat(good, F.array(F.lit('{"id": 2}'))), ", "), F.when(i % 5 == 0, "").otherwise("]"), F.lit("\n```"))
    return X.read(s, d, "embeddings").select("vec_id", T.valid_items(body, ("id", "label")).alias("n_valid"))


@query(f"""WITH {PRED} SELECT sample_id, CAST(printf('%.4f', p[1]) AS DOUBLE) soundness, CASE WHEN sample_id % 3 = 0 THEN 0.0::DOUBLE ELSE CAST(printf('%.4f', p[2]) AS DOUBLE) END groundedness, 0.0::DOUBLE overconfidence FROM pred""")
def judge_scores(s: SparkSession, d: str) -> DataFrame:
    """Three scores of a judge's answer; what is missing is 0."""
    part = F.when(F.col("sample_id") % 3 != 0, F.concat(F.lit(', "groundedness": '), T.fixed(F.col("p")[1], 4))).otherwise("")
    t = F.concat(F.lit('so: {"soundness": '), T.fixed(F.col("p")[0], 4), part, F.lit("} done"))
    x = X.predictions(s, d).select("sample_id", t.alias("t"))
    return x.select("sample_id", *[T.parse_number(F.col("t"), c).alias(c) for c in ("soundness", "groundedness", "overconfidence")])
