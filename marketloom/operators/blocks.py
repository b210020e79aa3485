"""Long histories cut into blocks of time, so that a key with many rows is many tasks.

Three kinds of work over a key's ordered rows need no task with the whole key: functions that look a bounded number of rows
back (`with_halo`: a block gets copies of the rows before it), recursions whose steps are affine maps (`ema`, `macd`: a
block folds its own rows, the blocks' maps are composed, and each block starts from the result), and the first row at or
after a time (`next_trading_day`: a block's rows are merged in order, and what it lacks is the next block's first).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import saved

#: A table with a row for each piece of a block is broadcast up to so many rows (some 50 bytes each), and joined by shuffle beyond.
FEW_PIECES = 200_000


def bucket(date: str, days: int) -> Column:
    return F.floor(F.unix_date(date) / days).cast("int")


def with_halo(df: DataFrame, f: Callable[[DataFrame], DataFrame], rows: int, days: int = 1024, fine_days: int = 64, by: str = "ticker", date: str = "date", needs: str | None = None) -> DataFrame:
    """f(df), where f works on each key's rows by date and looks at most `rows` rows back; computed in blocks of `days` days.

    Rows of the last days before a block, as many pieces of fine_days as hold `rows` rows (whose column `needs` is not null,
    if it is given), are copied to it and dropped after f. f gets blocks as keys of their own, must keep its rows' column
    `_core`, and returns the same rows as on the whole table; df's own partitions by key and date pieces are counted before
    they move, and each row is shuffled once with the copies. Rows with a null key or date are left out.
    """
    if days % fine_days:
        raise ValueError("days must be a multiple of fine_days")
    per = days // fine_days
    d = df.where(F.col(by).isNotNull() & F.col(date).isNotNull()).withColumn("_fine", bucket(date, fine_days))
    counted = F.count(F.lit(1) if needs is None else F.col(needs))
    pieces = d.groupBy(by, "_fine").agg(counted.alias("_n")).withColumn("_block", F.floor(F.col("_fine") / per).cast("int"))
    order = Window.partitionBy(by).orderBy("_fine")
    pieces = pieces.withColumn("_upto", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # A piece goes to each later block before whose start fewer than `rows` rows lie behind the piece.
    blocks = pieces.groupBy(by, "_block").agg((F.max("_upto") - F.sum("_n")).alias("_before"))
    starts = F.collect_list(F.struct("_block", "_before")).over(Window.partitionBy(by).orderBy("_block").rowsBetween(1, Window.unboundedFollowing))
    later = blocks.select(by, "_block", "_before", starts.alias("_later"))
    reached = F.filter("_later", lambda b: b["_before"] - F.col("_upto") < rows)
    to = pieces.join(later.select(by, "_block", "_later"), [by, "_block"]).select(by, "_fine", F.transform(reached, lambda b: b["_block"]).alias("_to"))
    to = saved(to.where(F.size("_to") > 0))
    few = to.limit(FEW_PIECES + 1).count() <= FEW_PIECES
    home = F.floor(F.col("_fine") / per).cast("int")
    places = F.concat(F.array(home), F.coalesce("_to", F.array().cast("array<int>")))
    both = d.join(F.broadcast(to) if few else to, [by, "_fine"], "left").withColumn("_at", F.explode(places)).withColumn("_core", F.col("_at") == home).drop("_to")
    out = f(both.withColumn(by, F.struct(F.col(by).alias("key"), F.col("_at").alias("block"))).drop("_fine", "_at"))
    return out.where("_core").drop("_core").withColumn(by, F.col(f"{by}.key"))


def ema(df: DataFrame, spans: dict[str, tuple[str, int]], days: int = 256, by: str = "ticker", date: str = "date") -> DataFrame:
    """Exponential means without adjustment, name -> (column, span), over each key's rows by date.

    A step is m -> (1 - a) m + a x, so k steps are (1 - a)^k m plus a sum that a block has by itself. Blocks are the rows of
    `days` days, at most so many that (1 - a)^-k stays a good number; their sums are carried on key by key over the small
    table of blocks. The first value is the first mean. Nulls leave the mean as it is, and take no step. A key's rows need
    dates that differ.
    """
    fastest = min(n for _, n in spans.values())
    if fastest < 2:
        raise ValueError("spans must be 2 or more")
    length = min(256, int(230 / -math.log1p(-2 / (1 + fastest))))
    block = Window.partitionBy(by, "_bucket").orderBy(date)
    d = df.withColumn("_bucket", bucket(date, days)).withColumn("_part", F.floor((F.row_number().over(block) - 1) / length).cast("int"))
    inside = Window.partitionBy(by, "_bucket", "_part").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    rates = {name: 2 / (1 + n) for name, (_, n) in spans.items()}
    d = d.withColumns({f"_k_{name}": F.count(x).over(inside) for name, (x, _) in spans.items()})
    d = d.withColumns({f"_s_{name}": F.coalesce(F.sum(F.col(x) * rates[name] * F.pow(F.lit(1 - rates[name]), -F.col(f"_k_{name}"))).over(inside), F.lit(0.0)) for name, (x, _) in spans.items()})
    own = lambda name: F.pow(F.lit(1 - rates[name]), F.col(f"_k_{name}"))

    last = F.max_by(F.struct(*[c for name in spans for c in (own(name).alias(f"u_{name}"), (own(name) * F.col(f"_s_{name}")).alias(f"v_{name}"))]), F.col(date))
    firsts = [F.min_by(x, F.when(F.col(x).isNotNull(), F.col(date))).alias(f"first_{name}") for name, (x, _) in spans.items()]
    maps = d.groupBy(by, "_bucket", "_part").agg(last.alias("m"), *firsts)
    carried = _carried(maps.select(by, "_bucket", "_part", "m.*", *[f"first_{name}" for name in spans]), list(spans), by)
    # Both sides meet by (key, bucket), as the windows have dealt the rows already.
    out = d.join(carried, [by, "_bucket"]).withColumn("_c", F.element_at("_parts", F.col("_part") + 1))

    def mean(name: str) -> Column:
        begun = (F.col(f"_k_{name}") > 0) | F.col(f"_c.h_{name}")
        return F.when(begun, own(name) * (F.col(f"_c.c_{name}") + F.col(f"_s_{name}")))

    return out.select(*df.columns, *[mean(name).alias(name) for name in spans])


def _carried(maps: DataFrame, names: list[str], by: str) -> DataFrame:
    """key, _bucket, _parts: for each part of a bucket the mean it starts from (c_; h_: whether there was one before it).

    The blocks' maps are folded in order. A key's blocks are one array, for which a block is some 50 bytes. Before a key's first value, its mean counts as that value.
    """
    fields = [f"{p}_{n}" for n in names for p in ("u", "v", "first")]
    all_blocks = F.array_sort(F.collect_list(F.struct("_bucket", "_part", *fields)))
    state = lambda values: F.struct(*[v.alias(f"c_{n}") for n, v in zip(names, values, strict=True)])

    def step(acc: Column, b: Column) -> Column:
        start = [F.coalesce(acc["now"][f"c_{n}"], b[f"first_{n}"]) for n in names]
        after = [b[f"u_{n}"] * s + b[f"v_{n}"] for n, s in zip(names, start, strict=True)]
        row = F.struct(b["_bucket"].alias("_bucket"), b["_part"].alias("_part"), *[s.alias(f"c_{n}") for n, s in zip(names, start, strict=True)], *[acc["now"][f"c_{n}"].isNotNull().alias(f"h_{n}") for n in names])
        return F.struct(state(after).alias("now"), F.concat(acc["out"], F.array(row)).alias("out"))

    kind = "array<struct<_bucket:int,_part:int," + ",".join(f"c_{n}:double" for n in names) + "," + ",".join(f"h_{n}:boolean" for n in names) + ">>"
    zero = F.struct(state([F.lit(None).cast("double") for _ in names]).alias("now"), F.array().cast(kind).alias("out"))
    folded = maps.groupBy(by).agg(F.aggregate(all_blocks, zero, step, lambda a: a["out"]).alias("b"))
    each = folded.select(by, F.explode("b").alias("b")).select(by, F.col("b._bucket").alias("_bucket"), F.struct(F.col("b._part").alias("_part"), *[F.col(f"b.{p}_{n}").alias(f"{p}_{n}") for n in names for p in "ch"]).alias("b"))
    return each.groupBy(by, "_bucket").agg(F.array_sort(F.collect_list("b")).alias("_parts"))


def macd(df: DataFrame, x: str = "adj_close", days: int = 256, by: str = "ticker", date: str = "date") -> DataFrame:
    """macd, macd_signal and macd_hist of x, each mean by blocks."""
    d = ema(df, {"_fast": (x, 12), "_slow": (x, 26)}, days, by, date)
    d = d.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    d = ema(d, {"macd_signal": ("macd", 9)}, days, by, date)
    return d.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def next_trading_day(news: DataFrame, calendar: DataFrame, same_day_before: int | None = None, days: int = 128) -> DataFrame:
    """event_date of each news item: the first trading day after its day, or that day if it trades and the hour is before
    same_day_before; items after the last trading day are dropped.

    Distinct days of news and of trading are merged in order within blocks of (ticker, days); where a block has no later
    trading day, the next block that has one gives its first. Only the blocks' first days are ordered over a whole ticker.
    """
    day = F.to_date("timestamp_utc")
    early = F.lit(False) if same_day_before is None else F.hour("timestamp_utc") < same_day_before
    d = news.withColumn("_day", F.when(early, F.date_sub(day, 1)).otherwise(day))
    asked = d.select("ticker", F.col("_day").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("date").alias("trade")).distinct()
    trades = calendar.select("ticker", F.col("date").alias("at"), F.lit(0).alias("kind"), F.col("date").alias("trade"))
    both = asked.unionByName(trades).withColumn("_bucket", bucket("at", days))
    ahead = Window.partitionBy("ticker").orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    firsts = both.groupBy("ticker", "_bucket").agg(F.min("trade").alias("_first")).select("ticker", "_bucket", F.first("_first", ignorenulls=True).over(ahead).alias("_next"))
    inside = Window.partitionBy("ticker", "_bucket").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    merged = both.withColumn("_own", F.last("trade", ignorenulls=True).over(inside)).where("kind = 1")
    table = merged.join(firsts, ["ticker", "_bucket"]).select("ticker", F.col("at").alias("_day"), F.coalesce("_own", "_next").alias("event_date")).where("event_date IS NOT NULL")
    return d.join(table, ["ticker", "_day"]).select(*news.columns, "event_date")
