"""Trajectories of states and actions as texts with a held-out last action."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed


@dataclass(frozen=True)
class Group:
    """`count` entities of `width` numbers each in a state; one is seen where its number `seen` is not 0.

    shown: the numbers that are printed, those of an inner tuple side by side.
    """

    name: str
    legend: str
    count: int
    width: int
    seen: int
    shown: tuple[tuple[int, ...], ...]


#: The layout of a state (four allies, six enemies, own features), the legends, and the actions.
ALLIES = Group("allies", "{relative (x,y); weapon_cooldown; health}", 4, 20, 0, ((2, 3), (4,), (5,)))
ENEMIES = Group("enemies", "{available attack;  relative (x,y); health}", 6, 8, 4, ((0,), (2, 3), (5,)))
OWN_HEALTH = 4
ACTIONS = ("DEAD", "STOP", "NORTH", "SOUTH", "EAST", "WEST", "Attack Enemy 0", "Attack Enemy 1", "Attack Enemy 2", "Attack Enemy 3", "Attack Enemy 4", "Attack Enemy 5")
#: Fixed value: steps of a chunk; the last one's action is held out.
CHUNK = 8


def _number(state: Column, i: int, fmt: str) -> Column:
    x = F.get(state, F.lit(i)).cast("double")
    decimals = re.fullmatch(r"%\.([1-9])f", fmt)
    return F.coalesce(fixed(x, int(decimals[1])), F.format_string(fmt, x)) if decimals else F.format_string(fmt, x)


def state_text(state: Column, groups: tuple[Group, ...] = (ALLIES, ENEMIES), own: int = OWN_HEALTH, fmt: str = "%.2f") -> Column:
    """A state's seen entities, group by group, and the own health. Numbers that the state lacks are never seen."""
    parts, at = [], 0
    for g in groups:
        entities = []
        for j in range(g.count):
            base = at + g.width * j
            fields = [F.concat(F.lit("["), F.concat_ws(" ", *[_number(state, base + i, fmt) for i in f]), F.lit("]")) if len(f) > 1 else _number(state, base + f[0], fmt) for f in g.shown]
            entities.append(F.when(F.coalesce(F.get(state, F.lit(base + g.seen)), F.lit(0.0)) != 0, F.concat(F.lit(f"{{id {j}: "), F.concat_ws("; ", *fields), F.lit("}; "))))
        seen = F.array_compact(F.array(*entities))
        parts.append(F.when(F.size(seen) == 0, f"None visible {g.name}; ").otherwise(F.concat(F.lit(f"visible {g.name}: {g.legend} "), F.array_join(seen, ""))))
        at += g.width * g.count
    return F.concat(F.lit("{State:{"), *parts, F.lit("own_health: "), _number(state, at + own, fmt), F.lit("}; "))


def other_action(answer: Column, key: Column, actions: int, seed: int = 42) -> Column:
    """An action that is not the answer, by the digest of key and seed: the same on every run and any partitioning."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(seed))), 1, 7), 16, 10).cast("long") % (actions - 1)
    return F.when(draw >= answer, draw + 1).otherwise(draw).cast("int")


def trajectory_chunks(steps: DataFrame, groups: tuple[Group, ...] = (ALLIES, ENEMIES), actions: tuple[str, ...] = ACTIONS, own: int = OWN_HEALTH, fmt: str = "%.2f", seed: int = 42) -> DataFrame:
    """trajectory, agent, chunk, text, answer, negative of each whole chunk of eight steps.

    steps: trajectory, agent, t from 0, state (array, at even t), action (0-based, at odd t). The text has the states and
    actions in order without the last action, which is the answer; negative is another action. The last chunk counts as well
    when it is whole; chunks that lack their last action are left out, other steps that are missing leave a gap. Texts are
    made before the shuffle, which brings at most eight pieces together.
    """
    names = F.array(*map(F.lit, actions))
    said = F.concat(F.lit("Action: "), F.get(names, F.col("action")), F.lit("; } "))
    piece = F.when(F.col("t") % 2 == 0, state_text(F.col("state"), groups, own, fmt)).when(F.col("t") % CHUNK != CHUNK - 1, said)
    d = steps.select("trajectory", "agent", F.floor(F.col("t") / CHUNK).cast("long").alias("chunk"), "t", piece.alias("piece"), F.when(F.col("t") % CHUNK == CHUNK - 1, F.col("action")).alias("held"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("t", "piece")))), lambda x: x["piece"]), "")
    g = d.groupBy("trajectory", "agent", "chunk").agg(text.alias("text"), F.max("held").alias("answer")).where("answer IS NOT NULL")
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in ("trajectory", "agent", "chunk")])
    return g.withColumn("negative", other_action(F.col("answer"), key, len(actions), seed))


def span_means(logps: Column, lengths: Column, tail: int = 1) -> Column:
    """The mean log-probability of each option's tokens: its last `length` tokens before the `tail` that end its sequence.

    logps: an array of the options' token arrays, whatever their lengths; lengths: how many tokens each option has. Null for
    an option that has none, or whose sequence is shorter than that.
    """

    def mean(x: Column, i: Column) -> Column:
        n = F.element_at(lengths, i + 1)
        ok = x.isNotNull() & (n > 0) & (F.size(x) >= n + tail)
        span = F.slice(x, F.when(ok, F.size(x) - tail - n + 1).otherwise(1), F.when(ok, n).otherwise(0))
        return F.when(ok, F.aggregate(span, F.lit(0.0), lambda a, v: a + v) / n)

    return F.transform(logps, mean)


def cut_spans(flat: Column, sizes: Column) -> Column:
    """An array of arrays from one flat array and the sizes of the pieces that lie in it end to end."""
    ends = F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, n: a + n))
    return F.when(F.size(sizes) > 0, F.zip_with(ends, sizes, lambda e, n: F.slice(flat, e - n + 1, n))).otherwise(F.array().cast("array<array<double>>"))
