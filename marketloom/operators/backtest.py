"""Counterfactual expansion, trading rules, equity curve and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fixed, flip_regime, render


#: Fixed value: the token that stands for all technicals.
NEUTRAL_TOKEN = "[TECH_NEUTRAL: All indicators are neutral and uninformative]"


def counterfactuals(df: DataFrame, template: str) -> DataFrame:
    """Four prompts a sample: as it is, without news, with neutral technicals, with the regime turned round. Missing news or tokens are empty."""
    news, tokens = F.coalesce("headline", F.lit("")), F.coalesce(F.array_join("technical_event_tokens", "\n"), F.lit(""))
    kinds = [("ORIGINAL", news, tokens), ("CF_NEWS_REMOVE", F.lit(""), tokens), ("CF_TECH_NEUTRALIZE", news, F.lit(NEUTRAL_TOKEN)), ("CF_REGIME_FLIP", news, flip_regime(tokens))]
    rows = F.array(*[F.struct(F.lit(k).alias("cf_type"), render(template, headline=h, technical_event_tokens=t).alias("prompt")) for k, h, t in kinds])
    return df.select("sample_id", F.explode(rows).alias("x")).select("sample_id", "x.*")


def direction(label: Column) -> Column:
    """-1 for a label with "down" in it, 1 for one with "up", in any spelling of letters; else 0."""
    x = F.lower(label)
    return F.when(x.contains("down"), -1).when(x.contains("up"), 1).otherwise(0)


def flip_rate(df: DataFrame, order: str = "run") -> DataFrame:
    """Share of samples whose direction differs from the original's, by type. df: sample_id, cf_type, pred_label and order.

    Of rows that repeat a sample and type, the last by `order` counts. Samples without an original are left out.
    """
    last = df.groupBy("sample_id", "cf_type").agg(F.max_by(direction(F.col("pred_label")), order).alias("_d"))
    base = F.max(F.when(F.col("cf_type") == "ORIGINAL", F.col("_d"))).over(Window.partitionBy("sample_id"))
    d = last.withColumn("_b", base).where("_b IS NOT NULL AND cf_type <> 'ORIGINAL'")
    return d.groupBy("cf_type").agg(F.avg((F.col("_d") != F.col("_b")).cast("double")).alias("flip_rate"), F.count(F.lit(1)).alias("n"))


def action(up: Column, down: Column, least: float = 0.6) -> Column:
    return F.when(up > least, "long").when(down > least, "short").otherwise("hold")


def strategy_return(act: Column, r: Column, cost: float = 0.0005) -> Column:
    return F.when(act == "long", r - cost).when(act == "short", -r - cost).otherwise(0.0)


def equity_curve(df: DataFrame, date: str = "window_end_date", key: str = "sample_id", r: str = "strategy_return") -> DataFrame:
    """Cumulative product, its running maximum and the drawdown, in (date, key) order.

    Dates are summed first; only the table of dates is scanned in order. The product is kept as the sum of logarithms
    of magnitudes, the count of negative factors and that of zeros, so that any return is folded, also one of -1 or less.
    """
    f = 1 + F.col(r)
    d = df.withColumns({"_l": F.when(f != 0, F.ln(F.abs(f))).otherwise(0.0), "_m": (f < 0).cast("long"), "_z": (f == 0).cast("long")})
    parts = ("_l", "_m", "_z")
    days = d.groupBy(date).agg(*[F.sum(c).alias(c) for c in parts])
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(date, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}0") for c in parts])
    in_day = Window.partitionBy(date).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    so_far = {c: F.col(f"{c}0") + F.coalesce(F.sum(c).over(in_day), F.lit(0)) for c in parts}
    d = d.join(before, date).withColumns(so_far)
    d = d.withColumn("equity", F.when(F.col("_z") > 0, 0.0).otherwise(F.when(F.col("_m") % 2 == 1, -1.0).otherwise(1.0) * F.exp("_l")))
    tops = d.groupBy(date).agg(F.max("equity").alias("_top")).select(date, F.max("_top").over(w).alias("_high"))
    d = d.join(tops, date).withColumn("running_max", F.greatest(F.col("_high"), F.max("equity").over(in_day)))
    return d.withColumn("drawdown", F.try_divide("equity", "running_max") - 1).drop("_high", *parts, *[f"{c}0" for c in parts])


def backtest_metrics(curve: DataFrame, act: str = "action", r: str = "strategy_return", date: str = "window_end_date") -> DataFrame:
    trade = F.col(act) != "hold"
    sd = F.stddev_samp(r)
    down = F.sqrt(F.avg(F.pow(F.least(F.col(r), F.lit(0.0)), F.lit(2.0))))
    f = 1 + F.col(r)
    sign = F.when(F.count_if(f == 0) > 0, 0.0).when(F.count_if(f < 0) % 2 == 1, -1.0).otherwise(1.0)
    log = F.sum(F.when(f != 0, F.ln(F.abs(f))))
    total = sign * F.exp(log) - 1
    year = F.lit(252.0) / F.count(F.lit(1))  # of the logarithm: beside 1, a small product would be lost
    return curve.agg(
        F.count_if(trade).alias("trades"), F.count_if(F.col(act) == "long").alias("longs"), F.count_if(F.col(act) == "short").alias("shorts"), total.alias("total_return"),
        F.coalesce(F.try_divide(F.avg(r), sd) * 252**0.5, F.lit(0.0)).alias("sharpe"), F.coalesce(F.try_divide(F.avg(r), down) * 252**0.5, F.lit(0.0)).alias("sortino"), F.min("drawdown").alias("max_drawdown"),
        F.coalesce(F.try_divide(F.count_if(trade & (F.col(r) > 0)), F.count_if(trade)), F.lit(0.0)).alias("win_rate"), F.avg(trade.cast("double")).alias("coverage"),
        (F.pow(sign, year) * F.exp(log * year) - 1).alias("annual_return"),
    )


def quality_gates(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, value, status: every check is an aggregate that is true where the table passes; one pass over the table."""
    one = df.agg(*[c.cast("boolean").alias(n) for n, c in checks.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.when(F.col(f"`{n}`"), "PASS").otherwise("FAIL").alias("status")) for n in checks])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def sample_gates(key: str = "sample_id", label: str = "label_5", change: str = "abnormal_return") -> dict[str, Column]:
    """Checks of aligned samples for quality_gates: enough of them, enough classes, no repeats, returns known."""
    n = F.count(F.lit(1))
    return {"samples": n >= 5000, "classes": F.countDistinct(label) >= 3, "unique": n == F.countDistinct(key), "returns": F.avg(F.col(change).isNotNull().cast("double")) > 0.95}


def feature_gates(rsi: str = "rsi_14", tokens: str = "technical_event_tokens", regime: str = "regime_label") -> dict[str, Column]:
    """Checks of features for quality_gates: RSI in range, tokens there, at least two regimes."""
    share = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")) > 0.95, F.lit(False))
    return {"rsi": share(F.col(rsi).between(0, 100)), "tokens": share(F.col(tokens).isNotNull()), "regimes": F.countDistinct(regime) >= 2}


def metrics_table(df: DataFrame, method: str, metric: str, value: str, names: tuple[str, ...], spare: dict[str, str] | None = None) -> DataFrame:
    """A row for each method, a column for each metric (its spare name's value where it is missing), 'N/A' where there is none."""
    spare = spare or {}
    wide = df.groupBy(method).pivot(metric, [*names, *spare.values()]).agg(F.first(value))
    got = lambda n: F.coalesce(*[F.round(c, 4).cast("string") for c in (n, spare.get(n)) if c], F.lit("N/A"))
    return wide.select(method, *[got(n).alias(n) for n in names])


def markdown_table(df: DataFrame, method: str, columns: dict[str, str], percent: bool = False) -> DataFrame:
    """n, line: a heading (n = 0 and 1) and a row for each method in order, missing values 0. One row a method: a report, not a data set."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    cells = [F.concat(fixed(value(c) * 100, 2), F.lit("%")) if percent else fixed(value(c), 4) for c in columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", method, *cells), F.lit(" |"))
    rows = df.select((F.row_number().over(Window.orderBy(method)) + 1).alias("n"), line.alias("line"))
    names = ["Model", *columns.values()]
    head = [(0, "| " + " | ".join(names) + " |"), (1, "|" + "|".join("-" * (len(x) + 2) for x in names) + "|")]
    return df.sparkSession.createDataFrame(head, "n int, line string").unionByName(rows)


def log_rollup(df: DataFrame, nodeid: str = "nodeid", outcome: str = "outcome") -> DataFrame:
    d = df.groupBy(F.split(nodeid, "::")[0].alias("file"))
    return d.agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col(outcome) == "failed").alias("failed"))


def turnover(df: DataFrame, by: str = "ticker", order: str = "window_end_date", act: str = "action") -> DataFrame:
    """Mean change of position (long 1, short -1, hold 0) from row to row, each ticker from a flat start."""
    position = F.when(F.col(act) == "long", 1).when(F.col(act) == "short", -1).otherwise(0)
    d = df.withColumn("_p", position)
    change = F.abs(F.col("_p") - F.coalesce(F.lag("_p").over(Window.partitionBy(by).orderBy(order)), F.lit(0)))
    return d.select(change.alias("_c")).agg(F.avg("_c").alias("turnover"))
