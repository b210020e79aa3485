"""Preference data: candidate ranking, pairs, weighted sets and their reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import softmax, word_count
from ..sources.shared import numbered, saved


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rk", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("reward"), "candidate_id")))


def preference_pairs(df: DataFrame, margin: float = 0.10, mode: str = "all") -> DataFrame:
    """Ordered pairs of a sample's candidates whose rewards differ by the margin: all of them, or best against worst.

    Candidates are collected by sample, so the pairs need one shuffle and no join.
    """
    c = F.array_sort(F.collect_list(F.struct((-F.col("reward")).alias("o"), "candidate_id", "reward")))
    d = df.groupBy("sample_id").agg(c.alias("c"))
    if mode == "extremes":
        d = d.withColumn("c", F.array(F.element_at("c", 1), F.element_at("c", -1))).where("size(c) > 1")
    d = d.select("sample_id", F.posexplode("c").alias("i", "a"), "c").select("sample_id", "a", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("b"))
    m = F.col("a.reward") - F.col("b.reward")
    return d.where(m >= margin).select("sample_id", F.col("a.candidate_id").alias("chosen"), F.col("b.candidate_id").alias("rejected"), m.alias("margin"))


def rwsft(df: DataFrame, k: int = 2) -> DataFrame:
    """The k best candidates of each sample with a positive weight."""
    return _ranked(df).where(F.col("rk") <= k).select("sample_id", "candidate_id", F.greatest(F.lit(0.01), F.col("reward") + 0.1).alias("weight"))


def best_of_n(df: DataFrame, k: int = 1) -> DataFrame:
    return _ranked(df).where(F.col("rk") <= k).select("sample_id", "candidate_id", "reward", "rk")


def overall_proxy(p_true: Column, tech: Column, entail: Column, contra: Column, util: Column, sound: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * p_true + 0.2 * tech + 0.15 * entail - 0.15 * contra + 0.1 * util + 0.1 * sound))


def pairwise_results(df: DataFrame, key: str = "pair_id", rank: str = "rank", seed: int = 42) -> DataFrame:
    """Ranks of a judge that saw some pairs in reverse order, turned back; a flipped -1 (no verdict) becomes 2."""
    flip = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))), 1, 1), 16, 10).cast("int") % 2 == 1
    return df.withColumns({"flipped": flip, "winner": F.when(flip, 1 - F.col(rank)).otherwise(F.col(rank))})


def win_rate(df: DataFrame, winner: str = "winner") -> DataFrame:
    """Share of all pairs that the second answer wins; pairs without a verdict count as not won."""
    return df.agg(F.avg((F.col(winner) == 1).cast("double")).alias("win_rate"), F.count(F.lit(1)).alias("n"))


def soft_win(a: Column, b: Column, temperature: float = 1.0) -> Column:
    """Probability that the first wins."""
    return softmax(F.array(a / temperature, b / temperature))[0]


def all_true(votes: Column) -> Column:
    """Any invalid vote -1; all 1 gives 1, else 0. Votes other than these are an error."""
    odd = F.exists(votes, lambda v: F.coalesce(~v.isin(-1, 0, 1), F.lit(True)))
    return F.when(odd, F.raise_error(F.concat(F.lit("invalid votes "), F.to_json(votes)))).when(F.array_contains(votes, -1), -1).when(F.forall(votes, lambda v: v == 1), 1).otherwise(0)


def control_reward(task: Column, x: Column) -> Column:
    return F.when(task == "[negative]", -x).when(task == "[neutral]", -2 * F.abs(x) + 4).when(task == "[positive]", x).otherwise(F.raise_error(F.concat(F.lit("unknown task "), task)))


def retry_pairs(trials: DataFrame) -> DataFrame:
    """The last wrong response before the first right one of each sample. trials: sample_id, trial, response, correct."""
    w = Window.partitionBy("sample_id").orderBy("trial")
    d = trials.withColumns({"rejected": F.lag("response").over(w), "_was": F.lag("correct").over(w)})
    return d.where("correct AND NOT _was").groupBy("sample_id").agg(F.min_by(F.struct("trial", F.col("response").alias("chosen"), "rejected"), "trial").alias("p")).select("sample_id", "p.*")


def demonstrations(trials: DataFrame) -> DataFrame:
    return trials.where("trial = 0 AND correct").select("sample_id", "response")


def dense_reward(df: DataFrame, bonus: Column) -> DataFrame:
    """Change of the true option's probability from prefix to prefix, and a bonus at the last. df: seq_id, step, p."""
    w = Window.partitionBy("seq_id").orderBy("step")
    last = F.lead("step").over(w).isNull()
    return df.withColumn("reward", F.coalesce(F.col("p") - F.lag("p").over(w), F.lit(0.0)) + F.when(last, bonus).otherwise(0.0))


def unpair(df: DataFrame) -> DataFrame:
    """prompt, completion, label; passes on what isn't paired."""
    if "chosen" not in df.columns:
        return df
    two = F.array(F.struct(F.col("chosen").alias("completion"), F.lit(True).alias("label")), F.struct(F.col("rejected").alias("completion"), F.lit(False).alias("label")))
    return df.select(*[c for c in df.columns if c not in ("chosen", "rejected")], F.explode(two).alias("x")).select("*", "x.*").drop("x")


def common_prefix_length(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x != y), True)
    return F.when(n <= 0, 0).when(differ > 0, differ - 1).otherwise(n).cast("int")


def extract_prompt(df: DataFrame, a: str = "chosen", b: str = "rejected") -> DataFrame:
    """The common start of two strings, or of two arrays of turns, as the prompt; in strings, a space before the cut
    belongs to the answers. Where one is the start of the other, the cut is before the shorter one's last place."""
    text = dict(df.dtypes)[a] == "string"
    x, y = (F.split(a, ""), F.split(b, "")) if text else (F.col(a), F.col(b))
    n, short = common_prefix_length(x, y), F.least(F.size(x), F.size(y))
    n = F.when(n == short, F.greatest(n - 1, F.lit(0))).otherwise(F.when((n > 0) & (F.substring(F.col(a), n, F.lit(1)) == " "), n - 1).otherwise(n) if text else n)
    d = df.withColumn("_n", n)
    cut = (lambda c, at, size: F.substring(F.col(c), at, size)) if text else (lambda c, at, size: F.slice(F.col(c), at, size))
    tail = lambda c: cut(c, F.col("_n") + 1, F.length(c) if text else F.size(c))
    return d.withColumns({"prompt": cut(a, F.lit(1), F.col("_n")), a: tail(a), b: tail(b)}).drop("_n")


def dataset_kind(df: DataFrame) -> str:
    """Which of the known key sets a table has."""
    have = set(df.columns)
    kinds = [("preference", {"chosen", "rejected"}), ("unpaired", {"prompt", "completion", "label"}), ("prompt_completion", {"prompt", "completion"}), ("conversation", {"messages"}), ("prompt", {"prompt"}), ("text", {"text"})]
    return next((k for k, need in kinds if need <= have), "unknown")


def rotate_completions(df: DataFrame, batch: str, order: str, completion: str = "completion") -> DataFrame:
    """Each row's completion is that of the row before in its batch, the first's that of the last."""
    w = Window.partitionBy(batch).orderBy(order)
    last = F.last(completion).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("kl_completion", F.coalesce(F.lag(completion).over(w), last))


def balance_weights(df: DataFrame, label: str = "label", desirable: float = 1.0, undesirable: float = 1.0) -> DataFrame:
    """Counts of both labels (1 at least) and the recommended bounds of either weight, given the other one."""
    d = df.agg(F.greatest(F.count_if(F.col(label)), F.lit(1)).alias("desirable"), F.count(F.lit(1)).alias("_n"))
    d = d.select("desirable", F.greatest(F.col("_n") - F.col("desirable"), F.lit(1)).alias("undesirable"))
    up, down = F.col("undesirable") * undesirable / F.col("desirable"), F.col("desirable") * desirable / F.col("undesirable")
    bounds = {"least_weight": up, "most_weight": up * 1.33, "least_undesirable": down / 1.33, "most_undesirable": down}
    return d.withColumns({k: F.bround(v, 2) for k, v in bounds.items()})


# Arrays of token ids, one sequence a row.


def shape_tokens(prompt: Column, completion: Column, bos: int, eos: int, most_prompt: int, most_completion: int) -> Column:
    """BOS if missing, the prompt's last tokens, the completion's first ones with EOS at its end."""
    p = F.when(F.try_element_at(prompt, F.lit(1)) == bos, prompt).otherwise(F.concat(F.array(F.lit(bos)), prompt))
    keep = F.slice(p, F.greatest(F.size(p) - most_prompt, F.lit(0)) + 1, most_prompt)
    return F.concat(keep, F.slice(F.concat(completion, F.array(F.lit(eos))), 1, most_completion))


def mask_prompt(ids: Column, prompt_size: Column) -> Column:
    return F.transform(ids, lambda x, i: F.when(i < prompt_size, -100).otherwise(x))


def shape_sequence(prompt: Column, answer: Column, bos: int, eos: int, most: int, most_prompt: int, mode: str = "keep_end") -> Column:
    """struct(prompt, completion, labels) of at most `most` ids with BOS and EOS, which are added where they are missing.

    Where both are too long together, the prompt keeps `most_prompt` ids of its start or end, then the answer what is left.
    """
    missing = F.when((F.size(prompt) > 0) & (prompt[0] != bos), 1).otherwise(0) + F.when((F.size(answer) > 0) & (F.try_element_at(answer, F.lit(-1)) != eos), 1).otherwise(0)
    room = F.lit(most) - missing
    start = F.lit(1) if mode == "keep_start" else F.greatest(F.size(prompt) - most_prompt, F.lit(0)) + 1
    p = F.when(F.size(prompt) + F.size(answer) > room, F.slice(prompt, start, F.lit(most_prompt))).otherwise(prompt)
    a = F.when(F.size(p) + F.size(answer) > room, F.slice(answer, F.lit(1), F.greatest(room - most_prompt, F.lit(0)))).otherwise(answer)
    p = F.when(F.try_element_at(p, F.lit(1)) == bos, p).otherwise(F.concat(F.array(F.lit(bos)), p))
    c = F.concat(p, F.when(F.try_element_at(a, F.lit(-1)) == eos, a).otherwise(F.concat(a, F.array(F.lit(eos)))))
    return F.struct(p.alias("prompt"), c.alias("completion"), mask_prompt(c, F.size(p)).alias("labels"))


def _places(ids: Column, template: list[int]) -> Column:
    """0-based places where the template starts."""
    n, t = len(template), F.array(*map(F.lit, template))
    all_places = F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0)))
    return F.filter(all_places, lambda i: F.slice(ids, i + 1, F.lit(n)) == t)


def mask_by_template(ids: Column, template: list[int]) -> Column:
    """Labels only after the template's last place; the whole row is ignored where it is missing."""
    at = F.try_element_at(_places(ids, template), F.lit(-1))
    return F.transform(ids, lambda x, i: F.when(at.isNull() | (i < at + len(template)), -100).otherwise(x))


def mask_turns(ids: Column, instruction: list[int], response: list[int]) -> Column:
    """Labels only in the responses of several turns: between a response template and the next instruction template.

    The row is ignored where either template is missing; what follows an unanswered instruction is ignored too.
    """
    ends = F.transform(_places(ids, response), lambda i: i + len(response))
    starts = _places(ids, instruction)
    starts = F.when(F.get(starts, F.lit(0)) > F.get(ends, F.lit(0)), F.concat(F.array(F.lit(0)), starts)).otherwise(starts)
    spans = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    spans = F.filter(spans, lambda x: x["s"].isNotNull() & x["e"].isNotNull())
    spans = F.transform(spans, lambda x, i: F.struct(F.when(i == 0, 0).otherwise(x["s"]).alias("s"), x["e"].alias("e")))
    open_from = F.when(F.size(ends) < F.size(starts), F.try_element_at(starts, F.lit(-1)))
    none = (F.size(starts) == 0) | (F.size(ends) == 0)
    plan = F.array(F.struct(none.alias("none"), spans.alias("spans"), open_from.alias("from")))  # worked out once a row
    hidden = lambda w, i: w["none"] | F.exists(w["spans"], lambda x: (x["s"] <= i) & (i < x["e"])) | F.coalesce(i >= w["from"], F.lit(False))
    return F.transform(plan, lambda w: F.transform(ids, lambda x, i: F.when(hidden(w, i), -100).otherwise(x)))[0]


def pad(ids: Column, length: int, value: int, side: str = "right") -> Column:
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))
    return F.concat(ids, fill) if side == "right" else F.concat(fill, ids)


def first_true(flags: Column) -> Column:
    """0-based place of the first true value, the length if there is none."""
    at = F.array_position(flags, True)
    return F.when(at > 0, at - 1).otherwise(F.size(flags))


def truncate_after(ids: Column, stop: int, fill: int) -> Column:
    """Everything after the first stop token becomes fill."""
    at = F.array_position(ids, stop)
    return F.transform(ids, lambda x, i: F.when((at > 0) & (i >= at), fill).otherwise(x))


def pack_blocks(df: DataFrame, key: str, ids: str, sep: int | str, length: int) -> DataFrame:
    """Rows laid end to end in key order, each with a separator, cut into blocks of one length; the rest is dropped.

    Rows are dealt to as many ranges of the key as a shuffle has partitions; offsets come from the ranges' sizes and a
    window inside each range. Rows that share a key follow each other in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(key, F.concat(F.col(ids), F.array(F.lit(sep))).alias("_t")).withColumn("_n", F.size("_t").cast("long"))
    d = saved(rows.repartitionByRange(parts, key).withColumn("_r", F.spark_partition_id()))
    sizes = d.groupBy("_r").agg(F.sum("_n").alias("_s"))
    before = sizes.select("_r", (F.sum("_s").over(Window.orderBy("_r")) - F.col("_s")).alias("_before"))
    w = Window.partitionBy("_r").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(F.broadcast(before), "_r").withColumn("_at", F.col("_before") + F.sum("_n").over(w) - F.col("_n"))
    # A row goes to the blocks it reaches as one slice each, not token by token.
    first, last = F.floor(F.col("_at") / length), F.floor((F.col("_at") + F.col("_n") - 1) / length)
    d = d.select("_at", "_t", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("block") * length - F.col("_at"), F.lit(0))
    hi = F.least((F.col("block") + 1) * length - F.col("_at"), F.size("_t").cast("long"))
    t = d.select("block", F.greatest("_at", F.col("block") * length).alias("at"), F.slice("_t", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    blocks = t.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("x"))
    return blocks.select("block", F.flatten(F.transform("x", lambda e: e["part"])).alias("input_ids")).where(F.size("input_ids") == length)


def flatten_struct(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested structs as columns named by their path; a field name that holds the separator is an error."""
    from pyspark.sql.types import StructType

    def walk(schema: StructType, path: list[str]) -> list[Column]:
        out = []
        for f in schema.fields:
            if sep in f.name:
                raise ValueError(f"separator {sep!r} is in the key {f.name!r}")
            at = [*path, f.name]
            out += walk(f.dataType, at) if isinstance(f.dataType, StructType) else [F.col(".".join(f"`{a}`" for a in at)).alias(sep.join(at))]
        return out

    return df.select(*walk(df.schema, []))


def to_prompt_completion(df: DataFrame, messages: str = "messages") -> DataFrame:
    """All turns but the last as the prompt, the last as the completion; conversations of one turn are left out."""
    m = F.col(messages)
    return df.where(F.size(m) > 1).withColumns({"prompt": F.slice(m, F.lit(1), F.size(m) - 1), "completion": F.element_at(m, -1)})


def fit_budget(df: DataFrame, by: str, order: str, text: str, budget: int) -> DataFrame:
    """The first rows of each group whose words fit the budget together; null texts have none."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.when(F.col(text).isNull(), 0).otherwise(word_count(F.col(text)))
    return df.withColumn("_used", F.sum(n).over(w)).where(F.col("_used") <= budget).drop("_used")


def batch_prompts(df: DataFrame, key: str, fields: list[str], k: int = 5) -> DataFrame:
    """batch, n_items and a JSON list of k rows each, in key order; numbers come from key ranges, not from one task."""
    d = numbered(df, key).select(F.floor((F.col("n") - 1) / k).alias("batch"), F.struct("n", F.struct(*fields).alias("row")).alias("x"))
    d = d.groupBy("batch").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return d.select("batch", F.size("x").alias("n_items"), F.to_json(F.transform("x", lambda e: e["row"])).alias("prompt"))


def judge_report(df: DataFrame, score: str = "overall_proxy_score", least_rate: float = 0.95, least_samples: int = 400) -> DataFrame:
    """One row: rows, samples, share of scores in [0, 1], their mean, PASS or FAIL."""
    valid = F.coalesce(F.col(score).between(0.0, 1.0), F.lit(False))
    d = df.agg(F.count(F.lit(1)).alias("scored_rows"), F.countDistinct("sample_id").alias("unique_samples"), F.avg(valid.cast("double")).alias("valid_score_rate"), F.avg(score).alias("mean_overall_proxy_score"))
    ok = (F.col("valid_score_rate") >= least_rate) & (F.col("unique_samples") >= least_samples)
    return d.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


#: The columns of a condition vector, in order; the regimes stand between.
TECHNICALS = ("ret_1d", "ret_5d", "ret_20d", "volatility_10d", "volatility_20d", "rsi_14", "macd", "macd_signal", "macd_hist", "sma_5", "sma_20", "sma_60", "price_vs_sma20", "price_vs_sma60", "bb_width", "bb_position", "atr_14", "volume_zscore_20", "gap_pct_last_day", "market_ret_1d", "market_ret_5d", "market_ret_20d", "market_vol_20d", "market_vol_20d_rank", "relative_strength_5d", "relative_strength_20d")
GROUNDING = ("financial_soundness_score", "technical_grounding_score", "news_entailment_rate", "news_contradiction_rate", "utility_score", "overall_proxy_score")
REGIMES = ("low_vol", "normal_vol", "high_vol")


def condition_vector(df: DataFrame) -> DataFrame:
    """cond (26 technicals, 3 regimes, 6 grounding scores; nulls 0) and sigma by regime; unknown regimes are normal."""
    regime = F.when(F.col("regime_label").isin(*REGIMES), F.col("regime_label")).otherwise("normal_vol")
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    cond = F.array(*map(value, TECHNICALS), *[F.when(regime == x, 1.0).otherwise(0.0) for x in REGIMES], *map(value, GROUNDING))
    return df.withColumns({"cond": cond, "sigma": F.when(regime == "low_vol", 0.5).when(regime == "high_vol", 1.5).otherwise(1.0)})


def distribution_reward(df: DataFrame, logits: str, label: str, names: tuple[str, ...]) -> DataFrame:
    """flow_p (softmax), flow_prob_true_label (an unknown label is Neutral), flow_entropy and flow_overall_reward."""
    known = F.when(F.col(label).isin(*names), F.col(label)).otherwise("Neutral")
    d = df.withColumn("flow_p", softmax(F.col(logits))).withColumn("flow_prob_true_label", F.element_at("flow_p", F.array_position(F.array(*map(F.lit, names)), known).cast("int")))
    d = d.withColumn("flow_entropy", -F.aggregate("flow_p", F.lit(0.0), lambda a, x: a + x * F.ln(x + 1e-9)))
    return d.withColumn("flow_overall_reward", F.col("flow_prob_true_label") - 0.1 * F.col("flow_entropy"))


def flow_pairs(df: DataFrame, key: list[str], target: str = "z1", sigma: str = "sigma", seed: int = 42) -> DataFrame:
    """z0 = sigma * noise, zt = t * z1 + (1 - t) * z0 and v = z1 - z0; noise and t come from digests, so that any run gives the same."""
    unit = lambda tag: (F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(seed), tag)), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    noise = F.transform(target, lambda z, i: F.sqrt(-2 * F.ln(unit(F.concat(F.lit("a"), i.cast("string"))))) * F.cos(2 * 3.141592653589793 * unit(F.concat(F.lit("b"), i.cast("string")))))
    d = df.withColumns({"t": unit(F.lit("t")), "z0": F.transform(noise, lambda x: F.col(sigma) * x)})
    return d.withColumns({"zt": F.zip_with(target, "z0", lambda a, b: F.col("t") * a + (1 - F.col("t")) * b), "v": F.zip_with(target, "z0", lambda a, b: a - b)})


def flow_baseline(df: DataFrame, target: str = "z1") -> DataFrame:
    """i, mean, mse: the mean target of each place, and the error of always guessing it; summed before the shuffle."""
    return df.select(F.posexplode(target).alias("i", "_z")).groupBy("i").agg(F.avg("_z").alias("mean"), F.var_pop("_z").alias("mse"))


def split_by_argmax(df: DataFrame, scores: str, truth: str) -> DataFrame:
    """positive: whether the best of the options' scores (the first of equals) is the true one, 0-based."""
    return df.withColumn("positive", F.array_position(scores, F.array_max(scores)) - 1 == F.col(truth))


def trial_summary(trials: DataFrame) -> DataFrame:
    """Correct and incorrect finished trials of each trial number. trials: trial, target, prediction, finished."""
    ok = F.coalesce(F.lower("target") == F.lower("prediction"), F.lit(False))
    return trials.groupBy("trial").agg(F.count_if(ok).alias("correct"), F.count_if(F.col("finished") & ~ok).alias("incorrect"))


def filter_pair_length(df: DataFrame, most: int, a: str = "chosen", b: str = "rejected") -> DataFrame:
    return df.where((F.size(a) <= most) & (F.size(b) <= most))


def index_tokens(df: DataFrame, vocab: DataFrame, key: str, tokens: str, most: int) -> DataFrame:
    """key, ids: the ids of each row's first `most` tokens by a table word, id; unknown words are 0."""
    t = df.select(key, F.posexplode(F.slice(tokens, 1, most)).alias("i", "word"))
    j = t.join(vocab, "word", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("id", F.lit(0)).alias("id")))).alias("x"))
    return df.select(key).join(j, key, "left").select(key, F.coalesce(F.transform("x", lambda e: e["id"]), F.array().cast("array<int>")).alias("ids"))


def vocabulary(words: DataFrame) -> DataFrame:
    """word, id: the distinct words numbered from 1 in the order of their code points; 0 stays free for unknown ones.

    Numbers come from ranges of the words and the ranges' sizes: no task and no driver holds the vocabulary. Null is no word.
    """
    return numbered(words.where("word IS NOT NULL").select("word").distinct(), "word", name="id").select("word", F.col("id").cast("int").alias("id"))


def stock_word_ids(stocks: DataFrame, vocab: DataFrame) -> DataFrame:
    """stock_id, word_id: the vocabulary's id of each symbol in lower case, null if it has none."""
    return stocks.select("stock_id", F.lower("symbol").alias("word")).join(vocab, "word", "left").select("stock_id", F.col("id").alias("word_id"))


def dense_batch(df: DataFrame, key: str, msgs: str, n_days: int, n_msgs: int, n_words: int) -> DataFrame:
    """Token ids (days of messages of ids) cut and padded with 0 to one shape, with the count of messages of each day and of words of each message."""
    zero = lambda n: F.array_repeat(F.lit(0), n)
    fill = lambda a, n, empty: F.concat(F.slice(a, 1, n), F.array_repeat(empty, F.greatest(F.lit(n) - F.size(a), F.lit(0))))
    day = lambda m: fill(F.transform(F.slice(m, 1, n_msgs), lambda w: fill(w, n_words, F.lit(0))), n_msgs, zero(n_words))
    sizes = lambda m: fill(F.transform(F.slice(m, 1, n_msgs), lambda w: F.least(F.size(w), F.lit(n_words))), n_msgs, F.lit(0))
    words = fill(F.transform(F.slice(msgs, 1, n_days), day), n_days, F.array_repeat(zero(n_words), n_msgs))
    counts = fill(F.transform(F.slice(msgs, 1, n_days), lambda m: F.least(F.size(m), F.lit(n_msgs))), n_days, F.lit(0))
    return df.select(key, words.alias("words"), counts.alias("n_msgs"), fill(F.transform(F.slice(msgs, 1, n_days), sizes), n_days, zero(n_msgs)).alias("n_words"))


def chars_per_token(df: DataFrame, text: str, n: int = 400, key: str = "id") -> DataFrame:
    """Characters for each whitespace token over the first n rows by key."""
    d = df.orderBy(key).limit(n)
    return d.agg(F.try_divide(F.sum(F.length(text)), F.sum(word_count(F.col(text)))).alias("chars_per_token"))
