"""Classification, calibration, preference-loss and reinforcement-learning reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import softmax, total


def confusion(df: DataFrame, names: tuple[str, ...], true: str = "true_label", pred: str = "pred_label", unknown: str = "Neutral") -> DataFrame:
    """A row for each of the label pairs, zeros included; unknown labels count as one of them."""
    known = lambda c: F.when(F.col(c).isin(*names), F.col(c)).otherwise(unknown)
    got = df.groupBy(known(true).alias("true_label"), known(pred).alias("pred_label")).count()
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in names for b in names], "true_label string, pred_label string")
    return grid.join(got, ["true_label", "pred_label"], "left").select("true_label", "pred_label", F.coalesce("count", F.lit(0)).alias("n"))


def classification_metrics(df: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """accuracy, macro_f1 over the labels seen on either side, and multiclass mcc (0 where undefined)."""
    pairs = df.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).count()
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("count").alias("nt"), F.lit(0).cast("long").alias("np"), F.when(F.col("t") == F.col("p"), F.col("count")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("nt"), F.col("count").alias("np"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    by = sides.groupBy("label").agg(F.sum("nt").alias("nt"), F.sum("np").alias("np"), F.sum("hit").alias("hit"))
    d = by.agg(
        F.sum("hit").cast("double").alias("c"), F.sum("nt").cast("double").alias("s"), F.avg(F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("nt") + F.col("np")), F.lit(0.0))).alias("macro_f1"),
        F.sum(F.col("nt").cast("double") * F.col("np")).alias("tp"), F.sum(F.col("nt").cast("double") * F.col("nt")).alias("tt"), F.sum(F.col("np").cast("double") * F.col("np")).alias("pp"),
    )
    s2 = F.col("s") * F.col("s")
    mcc = F.coalesce(F.try_divide(F.col("c") * F.col("s") - F.col("tp"), F.sqrt((s2 - F.col("pp")) * (s2 - F.col("tt")))), F.lit(0.0))
    return d.select((F.col("c") / F.col("s")).alias("accuracy"), "macro_f1", mcc.alias("mcc"))


def binary_mcc(df: DataFrame, true: Column, pred: Column) -> DataFrame:
    d = df.agg(F.count_if(true & pred).cast("double").alias("tp"), F.count_if(~true & pred).cast("double").alias("fp"), F.count_if(~true & ~pred).cast("double").alias("tn"), F.count_if(true & ~pred).cast("double").alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return d.withColumn("mcc", F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))))


def probability_scores(df: DataFrame, names: tuple[str, ...], p: str = "p", true: str = "true_label", eps: float = 1e-9) -> DataFrame:
    """Mean negative log likelihood, Brier score as the multiclass sum and as the one-vs-rest mean."""
    q = F.transform(p, lambda x: (x + eps) / (total(F.col(p)) + len(names) * eps))
    at = F.array_position(F.array(*map(F.lit, names)), F.col(true)).cast("int")
    sq = F.aggregate(F.transform("_q", lambda x, i: F.pow(x - F.when(i + 1 == F.col("_at"), 1.0).otherwise(0.0), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    d = df.select(q.alias("_q"), at.alias("_at"))
    return d.agg(F.avg(-F.ln(F.element_at("_q", F.col("_at")))).alias("nll"), F.avg(sq).alias("brier_sum"), F.avg(sq / len(names)).alias("brier_macro"))


def row_normalised(p: Column, eps: float = 1e-9) -> Column:
    """An array of probabilities divided by its sum and a little."""
    return F.transform(p, lambda x: x / (total(p) + eps))


def bin_of(x: Column, bins: int) -> Column:
    """0-based number of the equal bin of [0, 1] that holds x, by the edges themselves."""
    return F.size(F.filter(F.array(*[F.lit(i * (1 / bins)) for i in range(1, bins)]), lambda e: x >= e)).cast("long")


def ece(df: DataFrame, names: tuple[str, ...], bins: int = 10, p: str = "p", true: str = "true_label") -> DataFrame:
    """Expected calibration error of each class over equal bins, and its mean: one exploded aggregation.

    Probabilities are divided by their sum first. A bin has its lower edge, the last one both; edges are the multiples of 1 / bins.
    """
    d = df.select(F.col(true).alias("t"), F.posexplode(row_normalised(F.col(p))).alias("k", "p"))
    d = d.select("k", "p", (F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1) == F.col("t")).cast("double").alias("y"), bin_of(F.col("p"), bins).alias("bin"))
    b = d.groupBy("k", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("conf"), F.avg("y").alias("acc"))
    by = b.groupBy("k").agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("e"))
    return by.agg(F.avg("e").alias("ece_macro"))


def calibration_curve(df: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    b = bin_of(confidence, bins).alias("bin")
    return df.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(correct.cast("double")).alias("accuracy"))


def grounding_metrics(df: DataFrame, entail: str, contra: str) -> DataFrame:
    return df.agg(F.avg(entail).alias("mean_entailment"), F.avg(contra).alias("mean_contradiction"), F.avg((F.col(contra) > 0.5).cast("double")).alias("hallucination_rate"))


def score_summary(df: DataFrame, group: str, score: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.median(score).alias("median"))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_sigmoid(x: Column) -> Column:
    return -softplus(-x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


LOSSES = ("sigmoid", "robust", "exo_pair", "hinge", "ipo", "bco_pair", "sppo_hard", "nca_pair", "aot_pair", "aot", "apo_zero", "apo_down", "discopop")


def pair_loss(kind: str, beta: float = 0.1, eps: float = 0.0, tau: float = 0.05, delta: float = 0.0, divergence: str = "kl", alpha: float = 1.0) -> Column:
    """The loss of a pair as a column over c, r, c0, r0, for all kinds but the aot ones, which sort."""
    big_c, big_r = F.col("c") - F.col("c0"), F.col("r") - F.col("r0")
    z = big_c - big_r
    if divergence == "alpha":
        z = (F.exp(F.least(-alpha * big_r, F.lit(80.0))) - F.exp(F.least(-alpha * big_c, F.lit(80.0)))) / alpha
    elif divergence == "js":
        z = z - (softplus(big_c) - softplus(big_r))
    ls, e = log_sigmoid, eps or 1e-3
    m = sigmoid(beta * z / tau)
    return {
        "sigmoid": lambda: -ls(beta * z) * (1 - eps) - ls(-beta * z) * eps,
        "robust": lambda: (-ls(beta * z) * (1 - eps) + ls(-beta * z) * eps) / (1 - 2 * eps),
        "exo_pair": lambda: sigmoid(beta * z) * (ls(beta * z) - F.ln(F.lit(1 - e))) + sigmoid(-beta * z) * (ls(-beta * z) - F.ln(F.lit(e))),
        "hinge": lambda: F.greatest(F.lit(0.0), 1 - beta * z),
        "ipo": lambda: F.pow(z - 1 / (2 * beta), F.lit(2.0)),
        "bco_pair": lambda: -ls(beta * big_c - delta) - ls(-(beta * big_r - delta)),
        "sppo_hard": lambda: F.pow(big_c - 0.5 / beta, F.lit(2.0)) + F.pow(big_r + 0.5 / beta, F.lit(2.0)),
        "nca_pair": lambda: -ls(beta * big_c) - 0.5 * ls(-beta * big_c) - 0.5 * ls(-beta * big_r),
        "apo_zero": lambda: 1 - sigmoid(beta * big_c) + sigmoid(beta * big_r),
        "apo_down": lambda: sigmoid(beta * big_c) + 1 - sigmoid(beta * (big_c - big_r)),
        "discopop": lambda: -ls(beta * z) * (1 - m) + F.exp(-beta * z) * m,
    }[kind]()


def mean_losses(df: DataFrame, losses: dict[str, Column]) -> DataFrame:
    """kind, mean_loss: the means of many losses in one scan."""
    one = df.agg(*[F.avg(v).alias(k) for k, v in losses.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"`{k}`").alias("mean_loss")) for k in losses])).alias("x")).select("x.*")


def preference_loss(df: DataFrame, kind: str, beta: float = 0.1, eps: float = 0.0, tau: float = 0.05, delta: float = 0.0, divergence: str = "kl", alpha: float = 1.0, key: str = "pair_id") -> DataFrame:
    """A loss for each pair. df: pair_id, c, r, c0, r0 log-probabilities of policy and reference.

    aot losses pair the sorted values of both sides; ranks come from key-range counts, not from one sort in one task.
    """
    if kind in ("aot", "aot_pair"):
        from ..sources.shared import numbered

        c, r, c0, r0 = (F.col(x) for x in ("c", "r", "c0", "r0"))
        one, two = (c - c0, r - r0) if kind == "aot_pair" else (c - r, c0 - r0)
        a = numbered(df.select(one.alias("x")), "x").select("n", "x")
        b = numbered(df.select(two.alias("y")), "y").select("n", "y")
        d = F.col("x") - F.col("y")
        return a.join(b, "n").select(F.col("n").alias(key), (-log_sigmoid(beta * d) * (1 - eps) - log_sigmoid(-beta * d) * eps).alias("loss"))
    return df.select(key, pair_loss(kind, beta, eps, tau, delta, divergence, alpha).alias("loss"))


def preference_metrics(df: DataFrame, beta: float = 0.1) -> DataFrame:
    a, b = beta * (F.col("c") - F.col("c0")), beta * (F.col("r") - F.col("r0"))
    return df.agg(F.avg(a).alias("chosen_reward"), F.avg(b).alias("rejected_reward"), F.avg((a > b).cast("double")).alias("accuracy"), F.avg(a - b).alias("margin"))


def reward_loss(chosen: Column, rejected: Column, margin: Column | float = 0.0, center: float = 0.0) -> Column:
    m = margin if isinstance(margin, Column) else F.lit(float(margin))
    return softplus(-(chosen - rejected - m)) + center * F.pow(chosen + rejected, F.lit(2.0))


def kto_loss(df: DataFrame, batch: str, logratio: str, label: str, kl: str, beta: float = 0.1, desirable: float = 1.0, undesirable: float = 1.0, kind: str = "kto") -> DataFrame:
    """KTO loss of each row against its batch's mean divergence, not below 0; apo_zero_unpaired takes no divergence."""
    x = F.col(logratio)
    if kind == "apo_zero_unpaired":
        return df.withColumn("loss", F.when(F.col(label), desirable * (1 - sigmoid(beta * x))).otherwise(undesirable * sigmoid(beta * x)))
    means = df.groupBy(batch).agg(F.greatest(F.avg(kl), F.lit(0.0)).alias("_k"))  # one row a batch, summed before the shuffle
    k = F.col("_k")
    loss = F.when(F.col(label), desirable * (1 - sigmoid(beta * (x - k)))).otherwise(undesirable * (1 - sigmoid(beta * (k - x))))
    return df.join(means, batch).withColumn("loss", loss).drop("_k")


def _sums(values: Column, mask: Column) -> Column:
    """struct(n, s, q): count, sum and sum of squared distances from the mean of the masked values, each worked out once."""
    kept = F.filter(F.zip_with(values, mask, lambda v, m: F.when(m, v)), lambda v: v.isNotNull())
    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda t, x: t + x), F.size(a))
    with_mean = F.transform(F.array(kept), lambda a: F.struct(a.alias("a"), mean(a).alias("mean")))
    return F.transform(with_mean, lambda s: F.struct(F.size(s["a"]).alias("n"), s["mean"].alias("mean"), F.aggregate(s["a"], F.lit(0.0), lambda t, x: t + (x - s["mean"]) * (x - s["mean"])).alias("q")))[0]


def masked_mean(values: Column, mask: Column) -> Column:
    return _sums(values, mask)["mean"]


def masked_var(values: Column, mask: Column) -> Column:
    """With Bessel's correction; null for one value or none."""
    return F.transform(F.array(_sums(values, mask)), lambda s: F.try_divide(s["q"], s["n"] - 1))[0]


def masked_whiten(values: Column, mask: Column, shift_mean: bool = True) -> Column:
    one = F.transform(F.array(_sums(values, mask)), lambda s: F.struct(s["mean"].alias("mean"), F.sqrt(F.try_divide(s["q"], s["n"] - 1) + 1e-8).alias("sd")))
    return F.transform(one, lambda s: F.transform(values, lambda v: (v - s["mean"]) / s["sd"] + (F.lit(0.0) if shift_mean else s["mean"])))[0]


def kl_rewards(logp: Column, ref: Column, score: Column, coef: float = 0.05, ended: Column | None = None, penalty: float = 0.0) -> Column:
    """Penalty for each token, the score added at the last one; there, sequences that have not ended lose `penalty`."""
    last = F.size(logp) - 1
    extra = score if ended is None else score - F.when(ended, 0.0).otherwise(penalty)
    return F.transform(F.zip_with(logp, ref, lambda a, b: -coef * (a - b)), lambda x, i: F.when(i == last, x + extra).otherwise(x))


def gae(rewards: Column, values: Column, gamma: float = 1.0, lam: float = 0.95) -> Column:
    """Advantages of one sequence: the recursion runs from its end, the newest advantage first."""
    following = F.concat(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.array(F.lit(0.0)))
    delta = F.zip_with(rewards, F.zip_with(values, following, lambda v, n: gamma * n - v), lambda r, d: r + d)
    empty = F.array().cast("array<double>")
    return F.aggregate(F.reverse(delta), empty, lambda acc, d: F.concat(F.array(d + gamma * lam * F.coalesce(F.get(acc, F.lit(0)), F.lit(0.0))), acc))


def gae_returns(rewards: Column, values: Column, gamma: float = 1.0, lam: float = 0.95) -> Column:
    return F.zip_with(gae(rewards, values, gamma, lam), values, lambda a, v: a + v)


def ppo_report(df: DataFrame, new: str, old: str, adv: str, clip: float = 0.2) -> DataFrame:
    """One row of diagnostics from logged log-probabilities; clipped is where the clipped loss is the larger one."""
    d = F.col(new) - F.col(old)
    ratio = F.exp(d)
    kept = F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip))
    free, clipped = -F.col(adv) * ratio, -F.col(adv) * kept
    return df.agg(F.avg(F.greatest(free, clipped)).alias("policy_loss"), F.avg((clipped > free).cast("double")).alias("clip_fraction"), F.avg(0.5 * d * d).alias("approx_kl"), F.avg(ratio).alias("mean_ratio"))


def value_report(df: DataFrame, new: str, old: str, returns: str, clip: float = 0.2) -> DataFrame:
    """Value loss with the new value held near the old one, and how often that matters."""
    near = F.least(F.greatest(F.col(new), F.col(old) - clip), F.col(old) + clip)
    free, clipped = F.pow(F.col(new) - F.col(returns), F.lit(2.0)), F.pow(near - F.col(returns), F.lit(2.0))
    return df.agg((0.5 * F.avg(F.greatest(free, clipped))).alias("value_loss"), F.avg((clipped > free).cast("double")).alias("value_clip_fraction"))


def logits_entropy(logits: Column) -> Column:
    """Entropy of the softmax of logits."""
    return entropy_of(softmax(logits))


def entropy_of(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def wpo_weight(chosen: Column, rejected: Column) -> Column:
    return F.least(F.lit(1.0), F.exp(chosen + rejected))
